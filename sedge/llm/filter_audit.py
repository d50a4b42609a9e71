"""How five document filters overlap: counts of every combination of failures, and what every order of the filters removes.

Filters A to D look at one text: too few words, too few different words, too many capitals, odd
characters. E fails a text that a smaller doc_id has too, anywhere in the table. To find such texts
without moving every text:

1. one pass notes each row's part, failures of A to D and a 256-bit digest (`marks`, without text);
2. each task folds its digests into fragments of a counting Bloom filter: cells that it met once, and
   those it met twice or more. Fragments of a block of cells are merged by saturating addition. A text
   that has a cell counted once alone is unique for certain;
3. a second pass sends only the other texts, the possible repeats, to be grouped by their full text
   (copies of a task are one row before the shuffle), which gives the smallest doc_id of each text;
4. rows whose text repeats join that by digest (digests of many rows by a bounded broadcast) and
   shift the counts of their combinations: `mask_counts` is additive over rows.

Combinations number 32 a part, so every order's steps are sums over them.

The merged filter is broadcast: CELLS_A_ROW bits a row, and MAX_BLOCKS * BLOCK_CELLS bits (64 MB) at most.
Beyond 33 million rows it fills up: more unique texts then shuffle as possible repeats (two in five
at 270 million rows), and results stay whole.

Nulls: a null text is an empty one, so null and empty texts are copies of each other; a null lang is
the part ""; rows without doc_id never count as smaller ids and never fail E, but count in all else;
null labels mark nothing. Ties: rows of the same smallest doc_id all pass E. Repeated rows count
each; labels of a doc_id that repeat hold if any of them does. Texts of any length are read whole, in
blocks. Other columns aren't read, so may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_stored, join_counted, store

FILTERS = "ABCDE"
MIN_WORDS = 200
#: Cells of the filter for each row, and in each block; blocks at most.
CELLS_A_ROW = 16
BLOCK_CELLS = 1 << 22
MAX_BLOCKS = 128
#: Rows whose cells a task sorts at a time.
ROWS_A_FRAGMENT = 1 << 20
#: Bytes of a text whose words are split at a time.
TEXT_BLOCK = 1 << 24

_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_ODD = re.compile(rb"[#$%&*|]")
_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(0x80, 0xC0))
_MARKS = "doc_id bigint, part string, mask int, digest binary"


def failures(text: bytes) -> int:
    """Bits 0 to 3: whether a text fails A, B, C, D."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        cut = _BLANK.search(text, at + TEXT_BLOCK)
        end = cut.start() if cut else len(text)
        words = text[at:end].split()
        n += len(words)
        distinct.update(words)
        at = end
    capitals = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _FOLLOWING))
    return (n < MIN_WORDS) | (100 * len(distinct) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | bool(_ODD.search(text)) << 3


def marks(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, part, failures of A to D and the digest of its text."""

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(2)
            masks = [failures(t.as_py()) for t in texts]
            digests = [hashlib.sha256(t.as_buffer()).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text")).mapInArrow(mark, _MARKS)


def _cells(digests: np.ndarray, blocks: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The block (of `size` cells) of each digest, and its two cells there."""
    words = digests.view("<u8").reshape(-1, 4)
    return (words[:, 0] % np.uint64(blocks)).astype(np.int64), (words[:, 1:3] % np.uint64(size)).astype(np.int64)


def _digests(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8)


def fragments(digests: DataFrame, blocks: int, size: int = BLOCK_CELLS) -> DataFrame:
    """Per task and block of cells: the cells (u4, sorted) that its rows met once, and those met more often."""

    def fragment(block: np.ndarray, cell: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, times = np.unique((block[:, None] * size + cell).ravel(), return_counts=True)
        for b in np.unique(block).tolist():
            lo, hi = np.searchsorted(place, [b * size, (b + 1) * size])
            own, many = (place[lo:hi] - b * size).astype("<u4"), times[lo:hi] > 1
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([own[~many].tobytes()], pa.binary()), pa.array([own[many].tobytes()], pa.binary())], ["block", "once", "more"])

    def fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        for batch in it:
            parts.append(_digests(batch.column(0)))
            if sum(map(len, parts)) >= 32 * ROWS_A_FRAGMENT:
                yield from fragment(*_cells(np.concatenate(parts), blocks, size))
                parts = []
        if parts:
            yield from fragment(*_cells(np.concatenate(parts), blocks, size))

    return digests.mapInArrow(fold, "block int, once binary, more binary")


def repeated_cells(parts: DataFrame, size: int = BLOCK_CELLS) -> DataFrame:
    """Per block the bits of the cells that were met more than once, from its fragments added up (counts stop at two)."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(size, np.uint8)
        for once, more in zip(pdf["once"], pdf["more"], strict=True):
            at = np.frombuffer(once, "<u4")
            count[at] = np.minimum(count[at] + 1, 2)
            count[np.frombuffer(more, "<u4")] = 2
        return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(count > 1).tobytes()]})

    return parts.groupBy("block").applyInPandas(add, "block int, bits binary")


def sketch(noted: DataFrame, rows: int, size: int = BLOCK_CELLS, most: int = MAX_BLOCKS) -> np.ndarray:
    """The merged filter's bits, by block: at most `most` blocks of `size` cells (a multiple of 8)."""
    blocks = min(most, max(1, -(-rows * CELLS_A_ROW // size)))
    out = np.zeros((blocks, size // 8), np.uint8)
    for r in repeated_cells(fragments(noted.select("digest"), blocks, size), size).collect():  # `most` rows at most
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out


def possible_repeats(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """doc_id, text, digest of the rows that the filter doesn't clear."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def probe(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in it:
            digests = pa.array([hashlib.sha256(t.as_buffer()).digest() for t in batch.column(1)], pa.binary())
            if not len(digests):
                continue
            block, cell = _cells(_digests(digests), len(known), 8 * known.shape[1])
            seen = known[block[:, None], cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1
            keep = pa.array(seen.all(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), digests.filter(keep)], ["doc_id", "text", "digest"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return rows.mapInArrow(probe, "doc_id bigint, text binary, digest binary")


def least_ids(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """digest, least (smallest doc_id), n (rows) of each full text that several rows have."""
    return possible_repeats(docs, bits).groupBy("text").agg(F.first("digest").alias("digest"), F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("text")


def mask_counts(docs: DataFrame, labels: DataFrame, size: int = BLOCK_CELLS, most: int = MAX_BLOCKS) -> DataFrame:
    """part, mask (bit k: fails FILTERS[k]), n, good, toxic: rows, and those that labels call good or toxic."""
    marked = labels.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    noted = marks(docs)
    known = noted.where("doc_id is not null").join(marked.where("good + toxic > 0"), "doc_id", "left")
    noted = store(known.unionByName(noted.where("doc_id is null").withColumns({"good": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})).fillna(0, ["good", "toxic"]), "marks")
    rows = noted.count()
    least = store(least_ids(docs, sketch(noted, rows, size, most)), "least")
    again = join_counted(noted, least, ["digest"], rows).where(F.col("doc_id") > F.col("least")).drop("least")
    shift = F.explode(F.array(F.struct("mask", F.lit(-1).alias("w")), F.struct((F.col("mask") + 16).alias("mask"), F.lit(1).alias("w"))))
    shifted = again.select("part", "good", "toxic", shift.alias("s")).select("part", "good", "toxic", "s.mask", "s.w")
    counts = noted.select("part", "good", "toxic", "mask", F.lit(1).alias("w")).unionByName(shifted)
    out = store(counts.groupBy("part", "mask").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("good")).alias("good"), F.sum(F.col("w") * F.col("toxic")).alias("toxic")), "mask-counts")
    drop_stored(noted)
    drop_stored(least)
    return out


def order_steps(spark: SparkSession) -> DataFrame:
    """For each combination of failures and each step of each order (32 * 600 rows): what a row of that combination adds to the step's counts."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[f] for f in order)
        for step, f in enumerate(order, 1):
            before, bit = sum(1 << g for g in order[: step - 1]), 1 << f
            for mask in range(32):
                fails, gone = bool(mask & bit), bool(mask & before)
                rows.append((mask, name, step, int(not mask & (before | bit)), int(fails and not gone), int(fails and gone), int(mask == bit), 120 // mask.bit_count() if fails else 0))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["mask", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley"]), "mask int, filter_order string, step int, kept int, removed int, redundant int, unique_fails int, shapley int")


def filter_audit(docs: DataFrame, labels: DataFrame, size: int = BLOCK_CELLS, most: int = MAX_BLOCKS) -> DataFrame:
    """One row per part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; `size` and `most` set the filter's geometry."""
    counts = mask_counts(docs, labels, size, most)
    each = counts.join(F.broadcast(order_steps(docs.sparkSession)), "mask")
    total = lambda what, of="n": F.sum(F.col(of) * F.col(what)).alias
    return each.groupBy("part", "filter_order", "step").agg(
        *[total(c)(c) for c in ("kept", "removed", "redundant", "unique_fails")],
        total("removed", "good")("good_lost"),
        total("removed", "toxic")("toxic_lost"),
        total("shapley")("shapley"),
    )


#: The same counts in DuckDB's SQL, E by a window over whole texts.
AUDIT_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
marked AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
         CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
         + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
         + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 3 * length(body) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END
         + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 16 ELSE 0 END AS mask
  FROM words LEFT JOIN marked USING (doc_id)),
counts AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM flags GROUP BY part, mask),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(letter, bit)),
orders(filter_order, used) AS (
  SELECT '', 0
  UNION ALL
  SELECT filter_order || letter, used + bit FROM orders, letters WHERE used & bit = 0),
steps AS (
  SELECT filter_order, step, l.bit,
         (SELECT coalesce(sum(e.bit), 0) FROM letters e WHERE position(e.letter IN filter_order) < step) AS prior
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders WHERE length(filter_order) = 5) o
  JOIN letters l ON l.letter = substr(filter_order, step, 1))
SELECT part, filter_order, step,
       sum(CASE WHEN mask & (prior + bit)::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS kept,
       sum(CASE WHEN mask & bit > 0 AND mask & prior::BIGINT = 0 THEN n ELSE 0 END)::BIGINT AS removed,
       sum(CASE WHEN mask & bit > 0 AND mask & prior::BIGINT > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
       sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
       sum(CASE WHEN mask & bit > 0 AND mask & prior::BIGINT = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
       sum(CASE WHEN mask & bit > 0 AND mask & prior::BIGINT = 0 THEN bad ELSE 0 END)::BIGINT AS toxic_lost,
       sum(CASE WHEN mask & bit > 0 THEN n * (120 // bit_count(mask)) ELSE 0 END)::BIGINT AS shapley
FROM counts, steps
GROUP BY part, filter_order, step
"""
