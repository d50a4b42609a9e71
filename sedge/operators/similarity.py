"""Exact set-similarity joins and leakage gates.

Candidates come from prefix filtering: with members in order of rarity, two sets of Jaccard
similarity t or more share a member among the first size - ceil(t size) + 1 of each. Only those
prefixes are joined, with bounds on sizes and on what may still be shared after the places where
they meet; each candidate pair is then verified. Members that one side alone has come first in
the order and meet nothing, so they are counted and dropped before anything is joined. Texts that are
equal are one class, so copies are not expanded into pairs.

leaks() cuts prefixes where a text is read, by word frequencies of bounded size, so
members outside prefixes are never shuffled or written. Prefixes are longer by MEETS - 1 there, and similar
sets then meet MEETS times. Of pairs that do, marks (a bit a member or two, each the parity of the members
that fall on it) tell most that can't reach the threshold: sets differ in at least as many members as their
marks in bits. Only texts of the other pairs are moved. Every filter is a bound, so no pair is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import jaccard, ngrams, normalise_transcript, tokens
from ..sources.shared import dropped, stored

#: Words that leaks() tells apart by frequency, and rows that are broadcast at most.
FREQUENT, BROADCAST_ROWS = 1 << 20, 250_000
#: Bits, a power of two, that tell words of both sides from others.
MET_BITS = 1 << 26
#: Members of its prefix that a pair must share, if it must share so many at all.
MEETS = 2
#: Bands of two min-hashes by which leaks() finds what to try first; results don't depend on them.
BANDS = 4
#: Words of texts that a task works on at a time (a longer text is one piece); results don't depend on it.
PIECE = 1 << 18
_rng = np.random.default_rng(23)
_FLIP, _TIMES = (_rng.integers(0, 1 << 63, 2 * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))


def _prefixed(df: DataFrame, key: str, members: str, frequency: DataFrame, threshold: float) -> DataFrame:
    """One row per prefix member that may meet another: key, m, size, place (in order of rarity)."""
    n = F.size(members)
    sized = df.select(key, n.alias("size"), (n - F.ceil(F.round(n * threshold, 9)).cast("int") + 1).alias("length"))
    flat = df.select(key, F.explode(members).alias("m")).join(frequency, "m")
    ordered = flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("f", "m"))).alias("met"))
    rows = sized.join(ordered, key).withColumn("own", F.col("size") - F.size("met")).where("own < length")
    return rows.select(key, "size", "own", F.posexplode(F.slice("met", 1, F.col("length") - F.col("own"))).alias("p", "x")).select(key, "size", (F.col("own") + F.col("p")).alias("place"), F.col("x.m").alias("m"))


def candidates(left: DataFrame, right: DataFrame, lkey: str, rkey: str, members: str, threshold: float, same: bool = False) -> DataFrame:
    """Pairs (lkey, rkey) that may reach threshold; each once. same: left and right are one table, where a member of one set alone occurs twice."""
    both = left.select(F.explode(members).alias("m"), F.lit(0).alias("side")).unionByName(right.select(F.explode(members).alias("m"), F.lit(1).alias("side")))
    frequency = both.groupBy("m").agg(F.count("*").alias("f"), F.min("side").alias("a"), F.max("side").alias("b")).where(f"a < b and f > {2 if same else 1}").select("m", "f")
    one = _prefixed(left, lkey, members, frequency, threshold).withColumnRenamed("place", "lplace")
    two = _prefixed(right, rkey, members, frequency, threshold).withColumnsRenamed({"size": "rsize", "place": "rplace"})
    fits = (F.col("rsize") >= F.col("size") * threshold - 1e-9) & (F.col("rsize") <= F.col("size") / threshold + 1e-9)
    enough = F.ceil(threshold / (1 + threshold) * (F.col("size") + F.col("rsize")) - 1e-9)
    room = F.least(F.col("size") - F.col("lplace"), F.col("rsize") - F.col("rplace")) >= enough
    return one.join(two, "m").where(fits & room).select(lkey, rkey).distinct()


def jaccard_self_join(df: DataFrame, key: str, members: str, threshold: float) -> DataFrame:
    """a < b with similarity of at least threshold."""
    base = df.select(F.col(key).alias("a"), F.array_distinct(members).alias("xs")).where(F.size("xs") > 0)
    other = base.select(F.col("a").alias("b"), "xs")
    pairs = candidates(base, other, "a", "b", "xs", threshold, same=True).where("a < b")
    scored = pairs.join(base.withColumnRenamed("xs", "xa"), "a").join(other.withColumnRenamed("xs", "xb"), "b")
    return scored.select("a", "b", jaccard(F.col("xa"), F.col("xb")).alias("similarity")).where(F.col("similarity") >= threshold)


def _bounded(df: DataFrame) -> DataFrame:
    """df, broadcast if it has BROADCAST_ROWS rows at most."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def _bands(members: np.ndarray) -> np.ndarray:
    low = ((members ^ _FLIP[:, None]) * _TIMES[:, None]).min(1)
    return _mixed(_mixed(low[::2]) + np.uint64(3) * low[1::2] + np.arange(BANDS, dtype=np.uint64))


def _marks(members: np.ndarray) -> bytes:
    """Parities of the members that fall on each bit; a power of two of bits, as many as members at least."""
    size = 1 << max(6, (len(members) - 1).bit_length())
    return np.packbits((np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def _apart(one: bytes, two: bytes) -> int:
    """Members, at least, that one of two sets alone has, by their marks."""
    numbers = []
    for x in (one, two):
        number, size = int.from_bytes(x, "little"), 8 * len(x)
        while size > 8 * min(len(one), len(two)):
            size //= 2
            number = (number >> size) ^ (number & ((1 << size) - 1))
        numbers.append(number)
    return (numbers[0] ^ numbers[1]).bit_count()


def _alike(pairs: DataFrame, marks: DataFrame, threshold: float) -> DataFrame:
    """The pairs (node, other) that may reach threshold by the sizes and marks of their words or of their word pairs."""
    most = (1 - threshold) / (1 + threshold)

    def near(x: list, y: list, k: int) -> bool:
        may = most * (x[k] + y[k]) + 1e-9
        return abs(x[k] - y[k]) <= may and _apart(x[k + 1], y[k + 1]) <= may

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            one, two = (list(zip(*(batch.column(c).to_pylist() for c in range(at, at + 4)), strict=True)) for at in (2, 6))
            yield batch.select(["node", "other"]).filter(pa.array([near(x, y, 0) or near(x, y, 2) for x, y in zip(one, two, strict=True)], pa.bool_()))

    sides = [marks.select(F.col("node").alias(key), *(F.col(c).alias(f"{c}{k}") for c in ("n", "words", "size", "pairs"))) for k, key in enumerate(("node", "other"))]
    both = pairs.join(sides[0], "node").join(sides[1], "other")
    return both.select("node", "other", *(f"{c}{k}" for k in (0, 1) for c in ("n", "words", "size", "pairs"))).mapInArrow(read, "node bigint, other bigint")


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch's rows in pieces of PIECE list entries, but for the last row of each."""
    before = np.cumsum([0, *batch.column(column).value_lengths().to_numpy(zero_copy_only=False)])[:-1]
    cuts = [*np.flatnonzero(np.diff(before // PIECE, prepend=-1)), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def _prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """m, node, ref, held, n, place: of each text's words (m even) and of its word pairs (m odd) the first n - ceil(threshold n) + MEETS by rarity; its bands, at place -1; and at place -2, with the number of pairs as m, the marks of both.

    Rarity is the number of texts that hold a word; of a pair, that of its rarer word. Only the FREQUENT
    commonest words are told apart; others come first, in the order of their hashes, as any order of
    all members serves. Words that no other side's text holds are counted and dropped, but for a few that share their bit.
    """
    words = texts.select("node", "ref", "held", F.transform(tokens(F.col("norm")), lambda x: F.xxhash64("grp", x)).alias("w"))
    each = words.select(F.col("ref").isNotNull().alias("r"), F.col("held").isNotNull().alias("h"), F.explode(F.array_distinct("w")).alias("m"))
    shared = stored(each.groupBy("m").agg(F.count("*").alias("f"), F.max("r").alias("r"), F.max("h").alias("h")).where("f > 1 and r and h").select("m", "f"), "frequency")
    top = shared.orderBy(F.desc("f"), "m").limit(FREQUENT) if shared.count() > FREQUENT else shared
    table = top.select("m", F.col("f").cast("int").alias("f")).toArrow()
    order = np.argsort(table["m"].to_numpy())
    # a bit a word, 64 to a row: no more rows than MET_BITS / 64
    place = F.pmod("m", F.lit(MET_BITS))
    met = shared.groupBy(F.floor(place / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(m, {MET_BITS}) % 64 as int))")).alias("bits")).toArrow()
    bits = np.zeros(MET_BITS // 64, np.int64)
    bits[met["at"].to_numpy()] = met["bits"].to_numpy()
    dropped(shared)
    known = texts.sparkSession.sparkContext.broadcast((table["m"].to_numpy()[order], table["f"].to_numpy()[order], bits))

    def first(members: np.ndarray, odd: int, *rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, bytes]:
        """Members of the prefix, their places, how many there are in all, and their marks."""
        found, at = np.unique(members, return_index=True)
        n, marks = len(found), _marks(found)
        most = min(n, n - math.ceil(round(n * threshold, 9)) + MEETS)
        if most < n:  # of members too common for the prefix none need be sorted
            rarest = rarity[-1][at]
            some = np.flatnonzero(rarest <= np.partition(rarest, most - 1)[most - 1])
            found, at = found[some], at[some]
        order = np.lexsort((found, *(x[at] for x in rarity)))[:most]
        place = np.flatnonzero(rarity[-1][at[order]] > 0)
        return found[order[place]] & ~np.uint64(1) | np.uint64(odd), place, n, marks

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, bits = known.value
        for batch in (piece for whole in it for piece in _pieces(whole, 3)):
            lists = batch.column(3)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *lists.value_lengths().to_numpy(zero_copy_only=False)])
            cell = flat & (MET_BITS - 1)
            often = (bits[cell >> 6] >> (cell & 63)) & 1
            if len(hashes):
                at = np.minimum(np.searchsorted(hashes, flat), len(hashes) - 1)
                often = np.where(hashes[at] == flat, counts[at], often)
            who, m, n, place, marks = [], [], [], [], []
            for k in range(batch.num_rows):
                w, f = flat[ends[k] : ends[k + 1]].view(np.uint64), often[ends[k] : ends[k + 1]]
                a, b, fa, fb = (w[:-1], w[1:], f[:-1], f[1:]) if len(w) > 1 else (w, np.zeros(1, np.uint64), f, f)
                pairs = _mixed(_mixed(a) + np.uint64(3) * b)
                (*own, n_own, mark), (*both, n_both, marked) = first(w, 0, f), first(pairs, 1, np.maximum(fa, fb), np.minimum(fa, fb))
                for found, places, size in ((*own, n_own), (*both, n_both), (_bands(pairs), np.full(BANDS, -1), 0), (np.array([n_both], np.uint64), np.array([-2]), n_own)):
                    who.append(np.full(len(found), k))
                    m.append(found)
                    n.append(np.full(len(found), size))
                    place.append(places)
                    marks.extend([None] * len(found))
                marks[-1] = {"words": mark, "pairs": marked}
            who = pa.array(np.concatenate([*who, np.zeros(0, np.int64)]).astype(np.int64))
            numbers = [pa.array(np.concatenate([*x, np.zeros(0, kind)]).astype(kind)) for x, kind in ((n, np.int32), (place, np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*m, np.zeros(0, np.uint64)]).view(np.int64)), *(batch.column(c).take(who) for c in range(3)), *numbers, pa.array(marks, pa.struct({"words": pa.binary(), "pairs": pa.binary()}))], ["m", "node", "ref", "held", "n", "place", "marks"])

    kind = texts.schema["ref"].dataType.simpleString()
    return words.withColumn("held", F.col("held").isNotNull()).mapInArrow(read, f"m bigint, node bigint, ref {kind}, held boolean, n int, place int, marks struct<words: binary, pairs: binary>")


@F.pandas_udf(T.DoubleType())
def _score(one: pd.Series, two: pd.Series) -> pd.Series:
    """The larger Jaccard similarity of words and of word pairs of normalised texts."""

    def sets(text: str) -> tuple[set, set]:
        w = text.split(" ")
        return set(w), set(zip(w, w[1:] or [None]))  # noqa: B905

    def share(a: set, b: set) -> float:
        shared = len(a & b)
        return shared / (len(a) + len(b) - shared)

    return pd.Series([max(share(a, b) for a, b in zip(sets(x), sets(y), strict=True)) for x, y in zip(one, two, strict=True)], dtype="float64")


def _matched(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """node, ref, score of the pairs (node, other) at threshold, once they are compared as texts."""
    nodes = stored(pairs.select(F.explode(F.array("node", "other")).alias("node")).distinct(), "nodes")
    some = texts.join(_bounded(nodes), "node", "left_semi")
    both = pairs.join(some.select("node", "grp", F.col("norm").alias("one")), "node").join(some.select(F.col("node").alias("other"), "ref", F.col("grp").alias("_g"), F.col("norm").alias("two")), "other")
    return both.where("grp = _g").select("node", "ref", _score("one", "two").alias("score")).where(F.col("score") >= threshold)


def _met_often(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs (node, other) of texts that meet MEETS times in their words or in their word pairs at places that leave room, or as often as they must at all."""
    fits = (F.col("rn") >= F.col("n") * threshold - 1e-9) & (F.col("rn") <= F.col("n") / threshold + 1e-9)
    enough = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("rn")) - 1e-9)
    # MEETS - 1 shared members may lie before
    room = F.least(F.col("n") - F.col("place"), F.col("rn") - F.col("rplace")) + MEETS - 1 >= enough
    earlier = F.col("best").isNull() | (F.col("ref") < F.col("best"))
    met = left.join(right, "m").where(fits & room & earlier & (F.col("node") != F.col("other"))).select("node", "other", F.pmod("m", F.lit(2)).alias("odd"), F.least(enough, F.lit(MEETS)).alias("least"))
    often = met.groupBy("node", "other").agg(*(F.count_if(F.col("odd") == k).alias(f"c{k}") for k in (0, 1)), *(F.min(F.when(F.col("odd") == k, F.col("least"))).alias(f"l{k}") for k in (0, 1)))
    return often.where("c0 >= l0 or c1 >= l1").select("node", "other")


def leaks(reference: DataFrame, held_out: DataFrame, key: str, text: str, threshold: float = 0.85, within: str | None = None) -> DataFrame:
    """held, ref, score: per held-out row the first reference row (by key) that it matches: equal when normalised, or the larger Jaccard similarity of words and word pairs at threshold. `within` names a column that must be equal.

    Each distinct text of a group is worked on once. Its own reference row and the first one of each of its bands (of
    min-hashes) are tried first; the prefix join then looks only for references before the best of these, so groups of near copies
    are not expanded into pairs. Bands decide what is looked at, never what is found.
    """
    cols = [F.col(within).alias("grp")] if within else [F.lit("").alias("grp")]
    # a generator of one row keeps texts from being normalised again for the filter and the digest
    sides = [df.select(F.col(key).alias("id"), *cols, F.explode(F.array(normalise_transcript(F.col(text)))).alias("norm")).where("norm <> '' and grp is not null") for df in (reference, held_out)]
    kind = sides[0].schema["id"].dataType
    none = F.lit(None).cast(kind)
    both = sides[0].select("grp", "norm", F.col("id").alias("ref"), none.alias("held")).unionByName(sides[1].select("grp", "norm", none.alias("ref"), F.col("id").alias("held")))
    # written once, as normalising is most of the work
    sources = stored(both.select("*", F.unhex(F.sha2("norm", 256)).alias("digest"), F.monotonically_increasing_id().alias("node")), "sources")
    asked = stored(sources.where("held is not null").select("held", "grp", "digest"), "asked")
    classes = stored(sources.groupBy("grp", "digest").agg(F.min("ref").alias("ref"), F.min("held").alias("held"), F.min("node").alias("node")), "classes")
    texts = stored(sources.select("node", "grp", "norm").join(_bounded(classes.select("node", "ref", "held")), "node"), "texts")
    dropped(sources)
    rows = stored(_prefixes(texts, threshold), "prefixes")

    held, band = F.col("held"), rows.where("place = -1")
    marks = rows.where("place = -2").select("node", F.col("n"), "marks.words", F.col("m").alias("size"), "marks.pairs")
    lead = band.where("ref is not null").groupBy("m").agg(F.min(F.struct("ref", F.col("node").alias("other"))).alias("lead"))
    tries = band.where(held).select("m", "node").join(lead, "m").select("node", F.col("lead.other").alias("other")).where("node <> other").distinct()
    own = texts.where("ref is not null and held is not null").select("node", "ref", F.lit(1.0).alias("score"))
    tried = stored(own.unionByName(_matched(stored(_alike(tries, marks, threshold), "pairs"), texts, threshold)), "matches")
    best = tried.groupBy("node").agg(F.min("ref").alias("best"))

    left = rows.where(held & (F.col("place") >= 0)).select("m", "node", "n", "place").join(_bounded(best), "node", "left")
    right = rows.where("ref is not null and place >= 0").select("m", F.col("node").alias("other"), "ref", F.col("n").alias("rn"), F.col("place").alias("rplace"))
    rest = stored(_met_often(left, right, threshold), "met")
    found = tried.unionByName(_matched(stored(_alike(rest, marks, threshold), "pairs"), texts, threshold))
    first = stored(found.groupBy("node").agg(F.min(F.struct("ref", "score")).alias("x")).join(classes.select("node", "grp", "digest"), "node").select("grp", "digest", "x.*"), "first")
    dropped(texts, rows, classes, tried, rest)
    # every row of a class matches what its class matches
    return asked.join(_bounded(first), ["grp", "digest"]).select("held", "ref", "score")


def exact_matches(reference: DataFrame, held_out: DataFrame, key: str, text: str) -> DataFrame:
    """Held-out rows whose normalised text some reference row has."""
    norm: Column = normalise_transcript(F.col(text))
    return held_out.withColumn("_n", norm).join(reference.select(norm.alias("_n")).where("_n <> ''").distinct(), "_n", "left_semi").select(F.col(key).alias("held"))


#: n-grams of the items whose hashes are broadcast at most; more of them meet the documents' by a shuffle.
BROADCAST_GRAMS = 1_000_000


def ngram_overlap(items: DataFrame, docs: DataFrame, item: str, doc: str, text: str, n: int) -> DataFrame:
    """Per item: how many of its n-grams occur in some document, and their share.

    Documents' n-grams are 64-bit hashes with their places; those whose hash is no item's end in the
    task that reads them (a broadcast whose size is counted first), and only what is left is spelled
    out and compared as text.
    """
    mine = stored(items.select(F.col(item).alias("k"), F.explode(ngrams(tokens(normalise_transcript(F.col(text))), n)).alias("g")).where("g <> ''"), "grams")
    hashes = mine.select(F.xxhash64(F.split("g", " ")).alias("h")).distinct()
    if hashes.count() <= BROADCAST_GRAMS:
        hashes = F.broadcast(hashes)
    # a generator of one row keeps the words from being worked out again for each place
    words = docs.select(F.explode(F.array(tokens(normalise_transcript(F.col(text))))).alias("w")).where(F.size("w") > 0)
    run = lambda i: F.slice("w", i, F.lit(n))
    places = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.struct(F.xxhash64(run(i)).alias("h"), i.alias("i")))
    hit = words.select("w", F.inline(places)).join(hashes, "h", "left_semi").select(F.array_join(run(F.col("i")), " ").alias("g")).distinct()
    seen = hit.join(mine.select("g").distinct(), "g", "left_semi")
    return mine.join(seen.withColumn("hit", F.lit(1)), "g", "left").groupBy("k").agg(F.count("*").alias("n_grams"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_seen")).select(F.col("k").alias(item), "n_grams", "n_seen", (F.col("n_seen") / F.col("n_grams")).alias("share"))
