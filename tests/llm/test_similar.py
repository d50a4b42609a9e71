"""The pipeline's near copies against all pairs of shingle sets."""

import random

import pytest

from tests.llm.test_brute_force import WORD, components_of


def shingle_set(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def kept_by_all_pairs(rows):
    sets = [shingle_set(t) for _, t in rows]
    link = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    root = components_of(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if link(sets[i], sets[j])])
    low = {}
    for (i, _), r in zip(rows, root):
        low[r] = min(low.get(r, i), i)
    return set(low.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"Z{rng.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("first, cell", [(8, 500), (1, 3)])
def test_keep_one_equals_all_pairs(docs_of, monkeypatch, first, cell):
    from sedge.llm import similar, simhash

    monkeypatch.setattr(similar, "FIRST", first)
    monkeypatch.setattr(similar, "CELL", cell)
    rng = random.Random(8)
    base = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (60, 200, 200, 400)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)]
    rows += [(100 + k, edited(rng, base[k % 4], rng.randrange(1, 9))) for k in range(80)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE\ttwo"), (304, "one"), (305, " ".join(base[1][:185])), (306, " ".join(base[3] * 2))]
    want = kept_by_all_pairs(rows)
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(rows)).collect()} == want
    assert 10 < len(want) < len(rows) - 20
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in rows}
    assert any((prints[i] ^ prints[j]).bit_count() > 4 and len(shingle_set(t) & shingle_set(s)) >= 0.8 * len(shingle_set(t) | shingle_set(s)) > 0 for i, t in rows for j, s in rows if i < j)


@pytest.mark.parametrize("frequent, bits", [(1 << 18, 1 << 26), (5, 64)])
def test_keep_one_finds_near_copies_that_share_no_band(docs_of, monkeypatch, frequent, bits):
    """Bands and trees decide what is looked at first, not what is found."""
    from pyspark.sql import functions as F

    from sedge.llm import similar, simhash

    sketches = similar.sketches
    monkeypatch.setattr(similar, "sketches", lambda *args: sketches(*args).withColumn("bands", F.array().cast("array<bigint>")))
    monkeypatch.setattr(similar, "FREQUENT", frequent, raising=False)
    monkeypatch.setattr(similar, "MET_BITS", bits, raising=False)
    rng = random.Random(12)
    line = [f"c{k}" for k in range(12)]
    base = [[f"w{rng.randrange(3000)}" for _ in range(n)] + line for n in (30, 60, 200, 400)]
    rows = [(k, " ".join(b)) for k, b in enumerate(base)] + [(100 + k, edited(rng, base[k % 4], 1 + k % 4)) for k in range(40)]
    rows += [(300, None), (301, ""), (302, "one two"), (303, "ONE\ttwo")] + [(400 + k, " ".join([*line, *(f"u{rng.randrange(10**6)}" for _ in range(50))])) for k in range(20)]
    want = kept_by_all_pairs(rows)
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(rows)).collect()} == want
    assert 24 < len(want) < len(rows) - 10


def test_keep_one_looks_first_at_what_the_trees_link(docs_of, monkeypatch):
    from sedge.llm import similar, simhash

    asked, given = [], []
    trees, verified = simhash.near_duplicates, similar._verified
    monkeypatch.setattr(simhash, "near_duplicates", lambda docs: asked.append(1) or trees(docs))
    monkeypatch.setattr(similar, "_verified", lambda pairs, sets: given.append(pairs.count()) or verified(pairs, sets))
    monkeypatch.setattr(similar, "FIRST", 0)
    rng = random.Random(3)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    rows = [(k, edited(rng, base, 1) if k else " ".join(base)) for k in range(12)] + [(50, ""), (51, "other words")]
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(rows)).collect()} == kept_by_all_pairs(rows) == {0, 50, 51}
    assert asked == [1] and given[0] > 0


def test_no_step_plans_another_steps_joins_over_again(docs_of, monkeypatch):
    """The driver holds a step's whole plan, with figures of every task of it."""
    from sedge.llm import common, similar, simhash

    joins = {}

    def counted(df, name):
        joins[name] = max(joins.get(name, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return store(df, name)

    store = common.store
    for module in (common, similar, simhash):
        monkeypatch.setattr(module, "store", counted)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    rows = [(k, f"a b c d e f g{k // 50}") for k in range(210)]
    assert {r["doc_id"] for r in simhash.keep_one(docs_of(rows)).collect()} == kept_by_all_pairs(rows)
    assert len(joins) > 8 and max(joins.values()) <= 6, joins
