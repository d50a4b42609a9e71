"""Operators against brute force and exact round trips on small tables."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3, n=40):
    """Random texts with copies, shared passages, nulls, empties and one long text."""
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdéß", k=rng.randint(1, 5))) for _ in range(400)]
    passage = rng.choices(words, k=70)
    rows = []
    for i in range(n):
        body = rng.choices(words, k=rng.choice((0, 3, 30, 80, 200)))
        if i % 3 == 0:
            at = rng.randint(0, len(body))
            body = body[:at] + passage[rng.randint(0, 10) :] + body[at:]
        rows.append((i, rng.choice((" ", "\n", "\t ")).join(body)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, rows[0][1]), (n + 4, rows[6][1]), (n + 4, rows[6][1]), (None, rows[6][1]), (n + 5, " ".join(rng.choices(words, k=3000)) + " " + " ".join(passage)), (n + 6, "same " * 120), (n + 7, "same " * 90)]
    return rows


def test_substrings_equal_brute_force(docs_of):
    from sedge.llm.substrings import substring_dedup

    rows = corpus()
    first = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for k in range(len(w) - 49) if i is not None else ():
            key = tuple(w[k : k + 50])
            first[key] = min(first.get(key, i), i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49) if i is not None else ():
            if first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()))
    got = [tuple(r) for r in substring_dedup(docs_of(rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[2] for r in want) > 500


def test_removed_repeats_leave_the_kept_words(docs_of):
    from sedge.llm.substrings import remove_repeats, substring_dedup

    rows = [r for r in corpus() if r[0] is not None]
    docs = docs_of(dict(rows).items())
    kept = {r["doc_id"]: r["kept_sha256"] for r in substring_dedup(docs).collect()}
    out = remove_repeats(docs)
    assert out.columns == docs.columns
    seen = {r["doc_id"]: r for r in out.collect()}
    for i, sha in kept.items():
        text = seen[i]["text"] if i in seen else ""
        assert hashlib.sha256(" ".join(WORD.findall(text or "")).encode()).hexdigest() == sha
        if i in seen and text is not None:
            assert seen[i]["n_chars"] == len(text)


def simhash(text):
    from xxhash import xxh64_intdigest

    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("shard_points", [20_000, 8])
def test_simhash_equals_brute_force(docs_of, shard_points):
    from sedge.llm.simhash import near_duplicates

    rng = random.Random(5)
    rows = [r for r in corpus(n=60) if r[0] is not None]
    for k in range(30):  # near copies: one word changed
        words = WORD.findall(rows[5 + k % 7][1] or "x")
        words[rng.randrange(len(words))] = f"Z{k}"
        rows.append((1000 + k, " ".join(words)))
    prints = [simhash(t) for _, t in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = components_of(len(rows), near)
    low = {}
    for (i, _), r in zip(rows, root):
        low[r] = min(low.get(r, i), i)
    want = sorted((i, f"{p:016x}", low[r]) for (i, _), p, r in zip(rows, prints, root))
    got = sorted(tuple(r) for r in near_duplicates(docs_of(rows), shard_points=shard_points).collect())
    assert got == want
    assert any(c != i for i, _, c in want)


def test_vantage_trees_find_all_links():
    from sedge.llm.common import local_forest
    from sedge.llm.simhash import BLOCKS, Shards, block_of, shard_edges

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 500, dtype=np.uint64)
    near = []
    for _ in range(500):
        x = int(base[rng.integers(60)])
        for b in rng.choice(64, rng.integers(1, 8), replace=False):
            x ^= 1 << int(b)
        near.append(x)
    p = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    a, b = np.nonzero(np.bitwise_count(p[:, None] ^ p[None]) <= 4)
    truth = local_forest(len(p), a, b)
    top = Shards(4)
    us, vs = [], []
    for block in range(BLOCKS):
        value = block_of(p, block)
        for leaf in range(top.leaves):
            lives = top.home[value] == leaf
            visits = np.array([leaf in top.visits[top.starts[v] : top.starts[v + 1]] for v in value])
            ids = np.concatenate([np.flatnonzero(lives), np.flatnonzero(visits)])
            u, v = shard_edges(p[ids], np.arange(len(ids)) < lives.sum(), block, leaf=16)
            us.append(ids[u])
            vs.append(ids[v])
    assert np.array_equal(local_forest(len(p), np.concatenate(us), np.concatenate(vs)), truth)


def test_vectors_equal_brute_force(spark):
    from sedge.llm.embeddings import near_vectors

    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 16))
    vectors = [base[k % 20] + rng.standard_normal(16) * 0.05 for k in range(100)] + list(base) + [base[3]] * 4 + [2 * base[3]]
    rows = [(i, [float(x) for x in np.float32(v)], i % 3) for i, v in enumerate(vectors)]
    bad = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, rows[5][1], None), (904, [], 1), (905, [1.0, None], 1), (906, rows[5][1][:8], 2), (907, [float("inf")] * 16, 1), (None, rows[5][1], 2)]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int").withColumn("n", F.lit("x")).withColumn("cid", F.lit(1))
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    root = components_of(len(rows), list(zip(*np.nonzero(link))))
    want = {i: (int(link[i].sum()), root[i], root[i] == i) for i in range(len(rows))} | {b[0]: (0, b[0], b[0] is not None) for b in bad}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(df).collect()}
    assert set(got) == set(want)
    found, all_links = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert found >= 0.97 * all_links
    if found == all_links:
        assert got == want


def test_split_buckets_lose_no_pair(spark, monkeypatch):
    from sedge.llm import embeddings

    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, [float(v) for v in np.float32(centre + rng.standard_normal(16) * 0.02)], 0) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    whole = {tuple(r) for r in embeddings.near_vectors(df).collect()}
    monkeypatch.setattr(embeddings, "CELL", 7)
    assert {tuple(r) for r in embeddings.near_vectors(df).collect()} == whole
    assert max(r[1] for r in whole) == 59


def test_packing_round_trip(docs_of):
    from tokenizers import Tokenizer

    from sedge.llm.packing import pack_documents
    from sedge.llm.queries import tokenizer_path

    rows = corpus() + [(500, "It's <|endoftext|> naïve ŒUVRE ＡＢ 12.5% é x"), (501, "Word! " * 3000)]
    got = pack_documents(docs_of(rows), tokenizer_path(), capacity=256).collect()
    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256))]
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // 256) * 1.05 + 1


def test_local_search_empties_bins():
    from sedge.llm.packing import best_fit, local_search

    lengths = np.array([60, 60, 40, 40, 50, 50, 30, 70, 45, 55, 35, 65, 20, 80, 33, 33, 34])
    start = [[i] for i in range(len(lengths))]  # a bin each
    out = local_search(start, lengths, 100)
    assert sorted(i for b in out for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 100 for b in out)
    assert len(out) <= -(-lengths.sum() // 100) + 1
    assert len(best_fit(lengths, 100)) <= 9


def test_decontamination_by_tiles(docs_of, spark):
    from sedge.llm.decontaminate import contaminated, keep_clean

    item = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "only three words"), (3, None), (4, "")], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    rows = [
        (1, "intro " + " ".join(item[20:]).upper() + " bridge, " + " ".join(item[:20]) + "."),  # reordered
        (2, " ".join(item[:20])),  # half of it
        (3, " ".join(w for k, w in enumerate(item) if k % 4)),  # no five words in a row
        (4, "Only THREE words!"),
        (5, None),
        (6, ""),
        (7, " ".join(item[:30]) + " and more " * 5000),
    ]
    got = {(r["doc_id"], r["item_id"]): (round(r["coverage"], 3), r["n_tiles"]) for r in contaminated(docs_of(rows), bench).collect()}
    assert got == {(1, 1): (1.0, 2), (4, 2): (1.0, 1), (7, 1): (0.75, 1)}
    assert {r["doc_id"] for r in keep_clean(docs_of(rows), bench).collect()} == {2, 3, 5, 6}


def test_greedy_tiles_take_the_longest_first():
    from sedge.llm.decontaminate import Items

    items = Items.of([(1, "a b c d e f g h i j k l")])
    (_, coverage, tiles), = items.leaks("a b c d e f g x c d e f g h i j k l", 0.5)
    assert sorted(tiles) == [(2, 8, 10)] and coverage == pytest.approx(10 / 12)


def tiles_by_pairs(item, doc):
    """The longest match of unmarked words, first in the item, then in the document, again and again."""
    mine, theirs, tiles = [False] * len(item), [False] * len(doc), []
    while True:
        best = (4, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not mine[i + n] and not theirs[j + n]:
                    n += 1
                best = max(best, (n, -i, -j)) if n > 4 else best
        n, i, j = best[0], -best[1], -best[2]
        if n < 5:
            return tiles
        mine[i : i + n] = theirs[j : j + n] = [True] * n
        tiles.append((i, j, n))


def test_tiles_of_repetitive_texts_equal_all_pairs():
    from sedge.llm.decontaminate import Items

    rng = random.Random(12)
    for _ in range(150):
        item = rng.choices("ab", k=rng.randint(5, 25)) if rng.random() < 0.7 else ["la"] * rng.randint(5, 20)
        doc = rng.choices("abc" if rng.random() < 0.5 else ["a", "b", "la", "la"], k=rng.randint(0, 50))
        want = tiles_by_pairs(item, doc)
        got = Items.of([(1, " ".join(item))]).leaks(" ".join(doc), 0.01)
        assert [t for *_, tiles in got for t in tiles] == want


def test_one_word_a_thousand_times_takes_little_memory():
    import time
    import tracemalloc

    from sedge.llm.decontaminate import Items

    items = Items.of([(1, "la " * 1000), (2, "tra la " * 500)])
    tracemalloc.start()
    began = time.time()
    got = items.leaks("la " * 20_000 + "tra la " * 10_000)
    assert time.time() - began < 5 and tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert {(i, c, len(t)) for i, c, t in got} == {(1, 1.0, 1), (2, 1.0, 1)}


def best_run_by_all_runs(text, grams):
    """The greatest Dice coefficient of two or more consecutive lines, by trying them all."""
    lines = [w for line in text.split("\n") if (w := re.findall("[a-z0-9]+", line.lower()))]
    best = 0
    for i in range(len(lines)):
        for j in range(i + 1, len(lines) + 1):
            words = [w for line in lines[i:j] for w in line]
            mine = set(zip(words, words[1:]))
            best = max(best, 2 * len(mine & grams) / (len(mine) + len(grams)))
    return best


def test_best_runs_equal_all_runs(docs_of):
    from sedge.llm.licenses import LONG, TEMPLATES, _template_bigrams, licences

    rng = random.Random(15)
    long = {k: {tuple(g.split()) for g in _template_bigrams(t)} for k, t in TEMPLATES.items() if len(_template_bigrams(t)) >= LONG}
    rows = []
    for d in range(40):
        words = TEMPLATES[rng.choice(sorted(long))].split()
        words = [w if rng.random() > rng.choice((0, 0.03, 0.08)) else "zz" for w in words]
        lines, at = [], 0
        while at < len(words):
            lines.append(" ".join(words[at : at + (n := rng.randint(1, 12))]))
            at += n
            if rng.random() < 0.2:
                lines.append(rng.choice(("", "//", "int x", lines[-1])))
        noise = lambda: [f"code {rng.randrange(99)} software license" for _ in range(rng.randint(0, 6))]
        rows.append((d, "\n".join(noise() + lines + noise())))
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licences(docs_of(rows)).collect() if r["license"] in long}
    want = {(d, k): best for d, t in rows for k, g in long.items() if (best := best_run_by_all_runs(t, g)) >= 0.8}
    assert got == {k: pytest.approx(v, abs=1e-12) for k, v in want.items()} and len(want) > 20


def test_ten_thousand_lines_with_a_licence_word_each(docs_of):
    import time

    from sedge.llm.licenses import TEMPLATES, licences

    mit = TEMPLATES["MIT"].split()
    lines = [" ".join(mit[k : k + 10]) for k in range(0, len(mit), 10)]
    rows = [(1, "\n".join(f"license x{i} software" for i in range(10_000))), (2, "\n".join(lines * (10_000 // len(lines)))), (3, "\n".join([f"x{i}" for i in range(10_000)] + lines))]
    licences(docs_of(rows[:0])).collect()
    began = time.time()
    got = {(r["doc_id"], r["license"]): (r["dice"], r["n_units"]) for r in licences(docs_of(rows)).collect()}
    assert got == {(2, "MIT"): (1.0, 1), (3, "MIT"): (1.0, 0)} and time.time() - began < 30


def test_shards_round_trip_and_versions(docs_of, spark, tmp_path):
    from sedge.llm.sharding import ShardStore, arrival_of, shard

    rows = [(i, t) for i, (_, t) in enumerate(corpus())]
    docs = docs_of(rows)
    got = sorted((r["doc_id"], r["text_md5"] or "") for r in shard(docs, arrivals=4).collect())
    assert got == sorted((i, hashlib.md5(t.encode()).hexdigest() if t is not None else "") for i, t in rows)

    store = ShardStore(spark, f"file://{tmp_path}/s", fan_in=3)
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    store.append(big, arrival_of(F.col("doc_id"), 3), 3)
    assert store.version() == 3 and [r.rows for r in store.runs()] == [1334, 1333, 1333]
    assert store.read(big.schema, 2).count() == 2667
    store.compact(big.schema)
    (run,) = store.runs()
    assert (run.tier, run.rows, store.version()) == (1, 4000, 4)
    with pytest.raises(Exception):
        store.commit([], 3)  # version 4 is there already
    assert store.read(big.schema).select("doc_id").distinct().count() == 4000


def test_license_bounds_hold_and_words_tell():
    from sedge.llm.licenses import LEAST, TEMPLATES, _template_bigrams, bounds, telling_words

    grams = [_template_bigrams(t) for t in TEMPLATES.values()]
    words = telling_words(grams)
    for g in grams:
        lo, hi = bounds(len(g))
        assert 2 * min(lo - 1, len(g)) / (lo - 1 + len(g)) < LEAST if lo > 1 else True
        assert 2 * len(g) / (hi + 1 + len(g)) < LEAST
        silent = [x for x in g if not set(x.split()) & set(words)]
        assert 2 * len(silent) / (len(silent) + len(g)) < LEAST


def test_licenses(docs_of):
    from sedge.llm.licenses import TEMPLATES, licences

    mit = TEMPLATES["MIT"]
    rows = [
        (1, "some words here\nReleased under the MIT license!\nmore words"),
        (2, "Preface.\n\n" + mit[:300] + "\n" + mit[300:] + "\n\nAfterword"),  # a paragraph over two lines
        (3, mit.replace("Software", "Program")),
        (4, None), (5, ""), (6, "license"), (7, "the license of a licensed thing " * 2000),
        (8, "Released under the MIT License.\nReleased under the MIT License."),
    ]
    got = {(r["doc_id"], r["license"]): r["dice"] for r in licences(docs_of(rows)).collect()}
    assert set(got) == {(1, "MIT-notice"), (2, "MIT"), (3, "MIT"), (8, "MIT-notice")}
    assert got[1, "MIT-notice"] == 1.0 and got[2, "MIT"] >= 0.98 and 0.8 <= got[3, "MIT"] < 1


def test_licences_of_several_paragraphs_inside_long_texts(docs_of):
    from sedge.llm.licenses import TEMPLATES, licences

    mit, apache, gpl = (TEMPLATES[k] for k in ("MIT", "Apache-2.0-header", "GPL-3.0-header"))
    cut = lambda t, *at: "\n\n".join(t[a:b] for a, b in zip((0, *at), (*at, len(t))))
    code = "\n".join(f"def function_{i}(value): return value + {i}" for i in range(120))
    wrapped = "\n".join(f"# {x}" for x in re.findall(r".{1,70}(?:\s|$)", apache))
    rows = [
        (1, code + "\n\n" + cut(mit, mit.index("The above"), mit.index("THE SOFTWARE IS")) + "\n\n" + code),
        (2, "#!/usr/bin/env python\n" + wrapped + "\n" + code),  # code directly below the header
        (3, cut(gpl, gpl.index("This program is distributed")) + "\n" + code + "\n" + code),
        (4, code + "\nwarranties and merchantability of nothing\n" + code),
    ]
    assert {(r["doc_id"], r["license"]) for r in licences(docs_of(rows)).collect()} == {(1, "MIT"), (2, "Apache-2.0-header"), (2, "Apache-2.0-notice"), (3, "GPL-3.0-header")}  # the header's first line is the notice


def test_components(spark):
    from sedge.llm.common import components

    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5)]
    nodes = sorted({x for e in edges for x in e})
    place = {x: i for i, x in enumerate(nodes)}
    root = components_of(len(nodes), [(place[a], place[b]) for a, b in edges])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: nodes[root[place[x]]] for x in touched}


def test_levels_look_only_at_what_the_one_before_left(docs_of, monkeypatch):
    from sedge.llm import substrings

    assert substrings.levels(50) == [13, 25, 50] and substrings.levels(8) == [8]
    seen = {}
    whole = substrings.surviving

    def counted(runs):
        out = whole(runs)
        level = len(seen)
        places = lambda df, c: {(r["doc_id"], p) for r in df.collect() for x in r[c] for p in range(x["lo"], x["hi"] + 1)}
        seen[level] = places(runs, "runs"), places(out, "places")
        return out

    monkeypatch.setattr(substrings, "surviving", counted)
    # 13 words in common, 30 words in common, 60 words in common, nothing in common
    word = iter(range(10**6))
    fresh = lambda n: [f"w{next(word)}" for _ in range(n)]
    shared = [fresh(n) for n in (40, 44, 60)]
    rows = [(k, " ".join(fresh(80) + shared[k % 3] + fresh(80))) for k in range(6)] + [(9, " ".join(fresh(200)))]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.substring_dedup(docs_of(rows)).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 60, 9: 0}
    (all_places, first), (second_in, second_out) = seen[0], seen[1]
    assert second_in == first and len(second_out) < len(first) < len(all_places)
    assert {(5, p) for p in range(80, 91)} <= second_out and not any(d == 9 for d, _ in first)


def test_stars_of_very_many_edges(spark, monkeypatch):
    """Hubs by broadcast, by counted keys and by windows give the same components."""
    from sedge.llm import common

    edges = spark.createDataFrame([(5, k) for k in range(10, 700)] + [(k, 5000 - k) for k in range(600, 900)] + [(7, 8)], "u bigint, v bigint").repartition(6)
    want = sorted(map(tuple, common.components(edges).collect()))
    assert len({r for _, r in want}) > 100
    monkeypatch.setattr(common, "BROADCAST_NODES", 0)
    assert sorted(map(tuple, common.components(edges).collect())) == want
    monkeypatch.setattr(common, "HOT_KEYS", 1)
    assert sorted(map(tuple, common.components(edges).collect())) == want


def test_few_edges_need_no_rounds(spark, monkeypatch):
    """One task's forest is the result; with many tasks' edges the rounds, forests over again or not, give the same."""
    from sedge.llm import common

    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(k, 300 - k) for k in range(130, 150)], "u bigint, v bigint").repartition(7)
    measured = common._measured
    monkeypatch.setattr(common, "_measured", None)
    want = sorted(map(tuple, common.components(edges).collect()))
    assert len({r for _, r in want}) == 12 and dict(want)[60] == 0
    monkeypatch.setattr(common, "_measured", measured)
    for most in (10, 40, 100):
        monkeypatch.setattr(common, "TASK_EDGES", most)
        assert sorted(map(tuple, common.components(edges).collect())) == want


def test_equal_blocks_are_searched_by_the_others():
    from sedge.llm.common import local_forest
    from sedge.llm.simhash import BLOCKS, Shards, shard_edges

    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**48, 200, dtype=np.uint64) << np.uint64(16) | np.uint64(77)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(48, rng.integers(0, 7), replace=False) + 16) for b in base for _ in range(5)]
    p = np.unique(np.array(near, np.uint64))
    a, b = np.nonzero(np.bitwise_count(p[:, None] ^ p[None]) <= 4)
    edges = shard_edges(p, np.ones(len(p), bool), 0, leaf=8)
    assert np.array_equal(local_forest(len(p), *edges), local_forest(len(p), a, b))
    lives = rng.random(len(p)) < 0.5
    ok = lives[a] | lives[b]
    assert np.array_equal(local_forest(len(p), *shard_edges(p, lives, 0, leaf=8)), local_forest(len(p), a[ok], b[ok]))
    # no value visits more leaves than its ball has values
    top = Shards(10)
    assert np.diff(top.starts).max() <= 16 and BLOCKS == 4


def test_lost_commits_start_again(spark, tmp_path):
    from sedge.llm.sharding import LostCommit, ShardStore, arrival_of

    one, two = (ShardStore(spark, f"file://{tmp_path}/s", fan_in=2, keep=1) for _ in range(2))
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    one.append(rows, F.lit(0), 1)
    stale, true_version = [0], two.version
    two.version = lambda: stale.pop() if stale else true_version()  # at first it hasn't seen the other's commit
    two.append(rows, F.lit(0), 1)
    two.version = true_version
    assert one.version() == 2 and one.read(rows.schema).count() == 600
    with pytest.raises(LostCommit):
        one.commit([], 1)
    before = one.read(rows.schema, 2)
    one.compact(rows.schema)
    assert one.version() == 3 and before.count() == 600  # a reader of the version before still finds its runs
    one.append(rows, F.lit(0), 1)
    assert one.read(rows.schema).count() == 900
    with pytest.raises(ValueError, match="no longer kept"):
        one.read(rows.schema, 2)
    files = [f for r in one.runs() for f in __import__("glob").glob(r.path.removeprefix("file:") + "/part-*")]
    assert len(files) == sum(r.files for r in one.runs()) and sum(r.bytes for r in one.runs()) >= sum(__import__("os").path.getsize(f) for f in files)


def test_tilings_equal_a_direct_search(docs_of, spark):
    """Coverage by greedy string tiling worked out by looking for the longest unmarked match again and again."""
    from sedge.llm.decontaminate import contaminated

    rng = random.Random(6)
    items = [[f"i{k}w{j}" for j in range(n)] for k, n in enumerate((12, 20, 33, 7))]
    rows = []
    for d in range(40):
        item = rng.choice(items)
        parts = []
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(item))
            parts += item[at : at + rng.randint(3, 20)] + [f"x{rng.randrange(50)}" for _ in range(rng.randint(1, 5))]
        rows.append((d, " ".join(parts)))

    def coverage(item, words):
        mine, theirs = [True] * len(item), [True] * len(words)
        while True:
            best = (0, 0, 0)
            for i in range(len(item)):
                for j in range(len(words)):
                    n = 0
                    while i + n < len(item) and j + n < len(words) and mine[i + n] and theirs[j + n] and item[i + n] == words[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < 5:
                return 1 - sum(mine) / len(item)
            mine[i : i + n] = theirs[j : j + n] = [False] * n

    want = {(d, k): round(c, 9) for d, t in rows for k, item in enumerate(items) if (c := coverage(item, t.split())) >= 0.6}
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in contaminated(docs_of(rows), bench).collect()}
    assert got == want and len(want) > 5
