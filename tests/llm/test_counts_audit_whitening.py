"""Token counts against the library, the filter audit against its definition, whitening against plain numpy."""

import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute_force import WORD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def vocabulary():
    from sedge.llm.queries import tokenizer_path

    return tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(vocabulary):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@pytest.fixture(scope="module")
def counter(vocabulary):
    from sedge.llm.token_counts import TokenCounter, prove

    return TokenCounter(vocabulary, prove(vocabulary))


def test_token_query_equals_the_library(spark, library):
    from sedge.llm import queries

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = len(library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)


#: White space of all kinds, letters and digits of several scripts, characters that younger tables of Unicode class otherwise, contractions, special strings.
BITS = [" ", "  ", "\n", "\t", "\xa0", "　", " ", "\x1c", "\x85", "a", "B", "é", "1", "²", "٣", "漢", "!", "'s", "'LL", "<|endoftext|>", "<|end", "|>", "՘", "֋", "\U00010940", "😀", "​", "\x00", "word", "the", "-", "ǅ", "́", "ﬁ", "_"]


@pytest.mark.parametrize("block", [4, 1 << 20])
def test_tokens_of_random_strings_equal_the_library(counter, library, block, monkeypatch):
    from sedge.llm import token_counts

    monkeypatch.setattr(token_counts, "BLOCK", block)
    rng = random.Random(block)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 20))) for _ in range(8000)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


def test_whole_tokens_are_proven(counter, library):
    """Every string of the set is one token alone and after another pre-token; strings that merging can't reach alone aren't in it."""
    for t in random.Random(2).sample(sorted(counter.whole), 2000):
        assert len(library.encode(t, add_special_tokens=False).ids) == 1
        if t.isalpha():
            assert len(library.encode("7" + t, add_special_tokens=False).ids) == 2
    assert " the" in counter.whole and "the cat" not in counter.whole and "qqzx" not in counter.whole


def test_only_the_rest_is_merged(vocabulary):
    from sedge.llm.token_counts import TokenCounter, prove

    one = TokenCounter(vocabulary, prove(vocabulary))
    assert one.count("the house is on the hill") == 6 and not one.merges
    assert one.count("the xqzv") > 2 and list(one.merges) == [" xqzv"]


def test_long_and_odd_texts_are_counted(spark, docs_of, vocabulary, library):
    from sedge.llm.token_counts import token_counts

    rows = [(1, None), (1, None), (None, "a b"), (2, ""), (3, "word " * 400_000), (4, "x" * 50_000), (5, "<|endoftext|>" * 3 + " "), (6, " \n" * 30_000)]
    got = sorted(map(tuple, token_counts(docs_of(rows), vocabulary).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024) for i, t in rows]
    assert got == sorted(want, key=str)
    assert token_counts(docs_of(rows).where("false"), vocabulary).count() == 0


def test_other_vocabularies_are_refused():
    from sedge.llm.queries import tokenizer_path
    from sedge.llm.token_counts import prove

    with pytest.raises(ValueError, match="byte-level"):
        prove(tokenizer_path("word_bpe_49k.json"))


# ---------------------------------------------------------------- filter audit


def audit_by_definition(docs, labels):
    """Each order applied to each row, filter by filter."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t) else set()
        fails |= {"D"} if set(t) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and i > least[t] else set()
        rows.append((part or "", fails, i in good, i in toxic))
    out, removed = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[part, f] += len(gone)
                out[part, order, step] = [len(left), len(gone), sum(f in r[1] for r in mine) - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    return {(p, o, s): (*v, removed[p, o[s - 1]]) for (p, o, s), v in out.items()}


NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def audit_rows(seed=9):
    rng = random.Random(seed)
    pool = [" ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.choice((3, 150, 210, 400)))) + rng.choice(("", " ABCDEFGH" * 5, " #")) for _ in range(40)]
    docs = [(i, rng.choice(pool), rng.choice(("en", "de", None, ""))) for i in range(150)]
    docs += [(None, pool[0], "en"), (200, None, "en"), (201, "", "fr"), (3, docs[3][1], "en"), (3, docs[4][1], None), (202, "é" * 300 + " A", "en"), (203, " \t\n\x0b\x0c\r", "de"), (204, "One Word", "de")]
    labels = [(i, rng.choice((0, 1, None)), rng.choice((0, 1, None))) for i in rng.sample(range(150), 90)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (999, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("cells,blocks", [(1 << 22, 128), (64, 1), (1 << 10, 3)])
def test_audit_equals_the_definition(spark, cells, blocks):
    """Also with a filter so small that most texts share cells."""
    from sedge.llm import filter_audit

    docs, labels = audit_rows()
    table = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumns({c: F.lit("x") for c in ("mask", "digest", "part", "good", "n", "least", "once")}).repartition(5)
    got = filter_audit.filter_audit(table, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("good", F.lit(5)), cells, blocks).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NAMES) for r in got} == audit_by_definition(docs, labels)


def test_filter_clears_only_unique_texts(spark, docs_of):
    """No copy is cleared, and nearly all unique texts are."""
    from sedge.llm import filter_audit

    rows = [(i, f"text number {i}") for i in range(3000)] + [(5000 + i, f"text number {7 * i}") for i in range(50)]
    docs = docs_of(rows).repartition(6)
    bits = filter_audit.sketch(filter_audit.marks(docs), len(rows))
    left = {r["doc_id"] for r in filter_audit.possible_repeats(docs, bits).collect()}
    again = {7 * i for i in range(50)} | {5000 + i for i in range(50)}
    assert again <= left and len(left - again) < 30


def test_audit_of_long_texts_and_empty_tables(spark, monkeypatch):
    from sedge.llm import filter_audit

    text = ("one two THREE\t" * 5000 + "é ").encode()
    whole = filter_audit.failures(text)
    for block in (1, 7, 1000):
        monkeypatch.setattr(filter_audit, "TEXT_BLOCK", block)
        assert filter_audit.failures(text) == whole == 0b0110
    docs, labels = audit_rows()
    empty = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").where("false")
    none = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").where("false")
    assert filter_audit.filter_audit(empty, none).count() == 0


# ---------------------------------------------------------------- whitening


def whitening_by_numpy(vectors):
    """x, n, deviations, covariance of the distinct x vectors, all in plain Python and numpy."""
    x = {i: tuple(math.floor(256 * c) for c in v) for i, v in vectors}
    distinct = sorted(set(x.values()))
    n, sums = len(distinct), [sum(c) for c in zip(*distinct)]
    deviation = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums)] for v in distinct])
    return x, n, sums, deviation, centred.T @ centred / n


def test_whitening_equals_numpy(spark):
    from sedge.llm import queries

    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect() if r["embedding"] is not None and all(c is not None and math.isfinite(c) for c in r["embedding"])]
    x, n, sums, deviation, cov = whitening_by_numpy(rows)
    values, vectors = np.linalg.eigh(cov)
    got = queries.op13_whitening(spark, SF).collect()
    assert len(got) == 4 * len(rows)
    by = {(r["vec_id"], r["component"]): r for r in got}
    for k in range(1, 5):
        e, u = values[-k], vectors[:, -k]
        want = {i: float((np.array(v) - np.array(sums) / n) @ u / math.sqrt(e)) for i, v in x.items()}
        first = next(iter(want))
        sign = math.copysign(1, want[first] * by[first, k]["whitened"])
        for i in want:
            r = by[i, k]
            assert r["whitened"] * sign == pytest.approx(want[i], abs=1e-9)
            assert (r["n"], r["deviation"]) == (n, deviation[i]) and r["identity_error"] < 1e-9
            assert r["explained"] == pytest.approx(e / np.trace(cov), rel=1e-9)


@pytest.mark.parametrize("high", [1, 5, 1 << 20, 1 << 61])
def test_popcounts_give_exact_products(high):
    from sedge.llm.whitening import cross_products

    rng = random.Random(high)
    rows = [[rng.randrange(high), rng.randrange(3), 0, rng.randrange(high)] for _ in range(131)]
    bits = np.array([max(c).bit_length() for c in zip(*rows)])
    sums, products = cross_products(np.array(rows, np.int64), bits)
    assert list(sums) == [sum(c) for c in zip(*rows)]
    for i in range(4):
        for j in range(4):
            assert products[i, j] == (sum(r[i] * r[j] for r in rows) if i <= j else 0)


def test_odd_vectors(spark):
    """Nulls, not-a-number, infinities, other lengths, copies, huge entries and clashing names."""
    from sedge.llm.whitening import whiten

    rng = random.Random(3)
    fine = [(i, [rng.uniform(-1, 1), rng.uniform(-3, 3), 0.5]) for i in range(40)]
    fine += [(100, fine[0][1]), (0, fine[0][1]), (None, fine[1][1])]
    odd = [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 2.0]), (203, [float("inf"), 0.0, 1.0]), (204, []), (205, [1.0]), (206, [1e300, 0.0, 0.0])]
    table = spark.createDataFrame(fine + odd, "vec_id bigint, embedding array<double>").withColumns({c: F.lit("x") for c in ("x", "n", "component", "high", "label")}).repartition(4)
    got = whiten(table).collect()
    x, n, _, deviation, cov = whitening_by_numpy(list(enumerate(v for _, v in fine)))
    assert n == 40 and len(got) == 3 * len(fine)
    assert Counter(r["vec_id"] for r in got) == Counter({i: 3 * k for i, k in Counter(i for i, _ in fine).items()})
    assert {int(r["deviation"]) for r in got} == set(deviation.values())
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)  # the third entry is constant
    assert all(r["identity_error"] < 1e-9 and r["n"] == 40 for r in got)
    assert whiten(table.where("vec_id >= 200 and vec_id <> 205 and vec_id <> 206")).count() == 0
    assert whiten(table.where("false")).count() == 0


def test_wide_vectors_stay_exact(spark):
    """Entries whose squares leave 64 bits: deviations stay exact as decimals, null as longs."""
    from sedge.llm.whitening import whiten

    rows = [(0, [1e9, 2.0]), (1, [-1e9, 1.5]), (2, [0.25, 0.0])]
    _, _, _, deviation, _ = whitening_by_numpy(rows)
    got = whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    assert {r["vec_id"]: int(r["deviation"]) for r in got.collect()} == deviation and max(deviation.values()) > 2**63
    assert got.where("component = 1 and whitened is not null").count() == 3
    one = whiten(spark.createDataFrame([(7, [1.0, 2.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 2
