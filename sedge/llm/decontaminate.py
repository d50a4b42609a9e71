"""Benchmark passages in documents by greedy string tiling.

Words are lower-case runs of letters and digits (any byte beyond ASCII counts as a letter). All
runs of `SEED_WORDS` words of the benchmark's items are hashed into a table of seeds; a document's
rolling (Karp-Rabin) hashes of such runs are looked up in it, which joins documents and items on
shared seeds. For each item whose seeds could cover enough of it, tiling then marks the longest
match between unmarked words of item and document, again and again, until no match of SEED_WORDS
words is left (of equally long ones the first in the item, then the first in the document). The length of
the longest is found by bisection over rolling hashes of all unmarked words on both sides: no pairs of
equal seeds are made, so memory stays in proportion to the texts, however often their words repeat. The share of the item's words under tiles is its coverage: tiles may lie anywhere
in the document in any order, so reordered passages count as well. From `COVERAGE` up the
document leaks the item. Items shorter than SEED_WORDS words must occur whole.

The benchmark is read in blocks of bounded size; each is broadcast and held against all documents
in one scan without a shuffle, so documents of any number, length or repetition cost one task's
stream. Null texts, null and wordless items match nothing; a null doc_id or item_id is carried; repeated
rows of documents or items give repeated results. Ties between tiles go as said above, so results don't
depend on the rows' order. An empty table on either side gives an empty result (keep_clean: all
documents). Very long and repetitive texts are tiled whole. Of documents only doc_id and text are read,
so other columns may have any names; keep_clean returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, WINDOW_BASES, span_hashes, window_hashes

SEED_WORDS = 5
COVERAGE = 0.6
#: Bytes of item text that one block, and so one broadcast, may hold.
BLOCK_BYTES = 4_000_000
_FILTER_BITS = 20

_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


def word_hashes(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").lower().encode(errors="replace"), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _LETTER[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return span_hashes(raw, starts, ends, BASES[0]) if len(starts) else np.zeros(0, np.uint64)


@dataclass
class Items:
    """One block of the benchmark: words by item, and its seeds sorted by hash."""

    ids: list[int | None]
    words: list[np.ndarray]
    seed: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, list[int]]  # length below SEED_WORDS: items of that length
    maybe: np.ndarray  # whether some seed has these low bits

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        ids = [i for i, _ in rows]
        words = [word_hashes(t) for _, t in rows]
        seeds = [window_hashes(w, SEED_WORDS, WINDOW_BASES[0]) for w in words]
        seed = np.concatenate([*seeds, np.zeros(0, np.uint64)])
        item = np.repeat(np.arange(len(words)), [len(s) for s in seeds])
        place = np.concatenate([*(np.arange(len(s)) for s in seeds), np.zeros(0, np.int64)])
        order = np.argsort(seed, kind="stable")
        short: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if 0 < len(w) < SEED_WORDS:
                short.setdefault(len(w), []).append(k)
        maybe = np.zeros(1 << _FILTER_BITS, bool)
        maybe[(seed & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)] = True
        return cls(ids, words, seed[order], item[order], place[order], short, maybe)

    def leaks(self, text: str | None, least: float = COVERAGE) -> list[tuple[int | None, float, list[tuple[int, int, int]]]]:
        """(item id, coverage, tiles) of each leaked item; a tile is (start in item, start in document, words)."""
        words = word_hashes(text)
        out = []
        for n, members in self.short.items():
            windows = window_hashes(words, n, WINDOW_BASES[0])
            for k in members:
                at = np.flatnonzero(windows == window_hashes(self.words[k], n, WINDOW_BASES[0])[0])
                if len(at):
                    out.append((self.ids[k], 1.0, [(0, int(at[0]), n)]))
        rolling = window_hashes(words, SEED_WORDS, WINDOW_BASES[0])
        where = np.flatnonzero(self.maybe[(rolling & np.uint64((1 << _FILTER_BITS) - 1)).astype(np.int64)])
        if not len(where):
            return out
        met = np.unique(rolling[where])
        first, last = np.searchsorted(self.seed, met, "left"), np.searchsorted(self.seed, met, "right")
        times = last - first
        if not times.any():
            return out
        at = np.repeat(first - np.cumsum(times) + times, times) + np.arange(times.sum())
        order = np.argsort(self.item[at], kind="stable")
        cuts = np.flatnonzero(np.diff(self.item[at][order])) + 1
        for part in np.split(at[order], cuts):
            k = int(self.item[part[0]])
            n = len(self.words[k])
            if _spread(self.place[part], n).sum() < least * n:
                continue  # even with all seeds marked it stays below
            # only words under this item's seeds can lie under tiles
            under = np.flatnonzero(_spread(where[np.isin(rolling[where], self.seed[part])], len(words)))
            tiles = greedy_tiles(self.words[k], words[under], np.flatnonzero(np.diff(under) > 1) + 1)
            coverage = sum(t[2] for t in tiles) / n
            if coverage >= least:
                out.append((self.ids[k], coverage, [(i, int(under[j]), size) for i, j, size in tiles]))
        return out


def _spread(starts: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a seed that begins at one of `starts`."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + SEED_WORDS, n), -1)
    return np.cumsum(step[:-1]) > 0


class _Side:
    """One side's words, which of them are marked, and where unbroken stretches begin."""

    def __init__(self, words: np.ndarray, breaks: np.ndarray):
        self.words, self.marked = words, np.zeros(len(words), bool)
        self.broken = np.zeros(len(words), np.int64)
        self.broken[breaks] = 1

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of `size` unmarked words within a stretch."""
        if len(self.words) < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        marks, breaks = (np.concatenate([[0], np.cumsum(x)]) for x in (self.marked, self.broken))
        starts = np.flatnonzero((marks[size:] == marks[:-size]) & (breaks[size:] == breaks[1 : len(breaks) - size + 1]))
        return starts, window_hashes(self.words, size, WINDOW_BASES[0])[starts]


def greedy_tiles(item: np.ndarray, doc: np.ndarray, breaks: np.ndarray, least: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (start in item, start in doc, words); no tile crosses a place of `breaks` in doc."""
    mine, theirs = _Side(item, np.zeros(0, np.int64)), _Side(doc, breaks)
    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(doc))

    def meet(size: int) -> bool:
        return bool(np.isin(mine.free(size)[1], theirs.free(size)[1]).any())

    while most >= least:
        if not meet(most):  # the longest match, by bisection: parts of a match match
            low, high = least - 1, most
            while high - low > 1:
                half = (low + high) // 2
                low, high = (half, high) if meet(half) else (low, half)
            most = low
            if most < least:
                break
        starts, hashes = mine.free(most)
        spots, others = theirs.free(most)
        order = np.argsort(others, kind="stable")
        spots, others = spots[order], others[order]
        tried: dict[int, int] = {}  # hash: the next of its spots to look at
        for i, h in zip(starts[(both := np.isin(hashes, others))].tolist(), hashes[both].tolist(), strict=True):
            if mine.marked[i] or mine.marked[i + most - 1]:
                continue
            at = tried.get(h)
            if at is None:
                at = int(np.searchsorted(others, np.uint64(h)))
            while at < len(others) and others[at] == h and (theirs.marked[spots[at]] or theirs.marked[spots[at] + most - 1]):
                at += 1
            tried[h] = at
            if at < len(others) and others[at] == h:
                j = int(spots[at])
                mine.marked[i : i + most] = theirs.marked[j : j + most] = True
                tiles.append((i, j, most))
        most -= 1
    return tiles


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The benchmark's items in blocks of bounded size, in a fixed order."""
    part: list[tuple] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if part and size + len(r[1]) > block_bytes:
            yield Items.of(part)
            part, size = [], 0
        part.append((r[0], r[1]))
        size += len(r[1])
    if part:
        yield Items.of(part)


_SCHEMA = "doc_id bigint, item_id bigint, coverage double, n_tiles int, longest_tile int, tiles array<struct<item_start:int,doc_start:int,words:int>>"


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """One row per (document, leaked item): doc_id, item_id, coverage, n_tiles, longest_tile, tiles."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    out = spark.createDataFrame([], _SCHEMA)
    tile = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("words", pa.int32())]))
    types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), tile)
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)

        def read(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in it:
                rows = [
                    (doc_id, item, coverage, len(tiles), max(t[2] for t in tiles), [{"item_start": a, "doc_start": b, "words": c} for a, b, c in sorted(tiles)])
                    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for item, coverage, tiles in own.leaks(text, least)
                ]
                cols = list(zip(*rows, strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "coverage", "n_tiles", "longest_tile", "tiles"])

        out = out.unionByName(texts.mapInArrow(read, _SCHEMA))
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE) -> DataFrame:
    """docs without the rows that leak an item."""
    at = docs.columns.index("text")
    for items in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def sift(it: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in it:
                yield batch.filter(pa.array([not own.leaks(t, least) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(sift, docs.schema)
    return docs
