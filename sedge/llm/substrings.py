"""Exact removal of word passages that an earlier document already holds, by level-wise doubling.

A window of `size` words repeats only if each shorter window in it repeats. So the levels go up by
doubling (13, 25 and 50 words for a size of 50), and each level looks only at the places that the one
before it left, until none are left or full windows are reached:

1. At a level of L words a place, that is the start of a full window, is stood for by its mark: the
   least hash of the windows of L words inside its full window. Equal full windows have equal
   marks, and neighbouring places mostly share one, so a document gives few marks (about 2 in 39
   of its places at the first level for 50 words). Places whose mark no other document has end here.
2. The rest is extended to twice the length, and so on.
3. At the last level a place's window is compared by a 128-bit cryptographic digest of its words;
   windows that are also in a document of smaller doc_id are removed, and their words with them. Two
   different windows among 10**13 have equal digests with a probability below 10**-12.

Documents of equal word sequences are compared once: all windows of the later ones repeat. Hashes
are counted by partial aggregation and joined back, the few most frequent ones by a broadcast of
bounded size, so a passage that a third of all documents hold is no single task's group. Nothing is sampled or capped.

Null text: no words. A null doc_id has no place in the order: such rows lose nothing and take
nothing from others. Rows with one doc_id don't take from each other. Texts shorter than a window
stay whole; long ones are held once by the task that reads them. Columns besides doc_id and text
may have any names; remove_repeats returns them unchanged. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, WINDOW_BASES, drop_stored, join_counted, span_hashes, store, window_hashes, word_spans

SIZE = 50
#: Words of the shortest level: phrases below it repeat in any two texts.
SHORTEST = 10


def levels(size: int) -> list[int]:
    """Lengths from the shortest one up to size, each about twice the one before."""
    out = [size]
    while -(-out[0] // 2) >= SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def _low(hashes: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width numbers."""
    out, have = hashes, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def window_marks(words: np.ndarray, size: int, level: int) -> np.ndarray:
    """The mark of each window of size words: the least hash of the windows of level words in it."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    return _low(window_hashes(words, level, WINDOW_BASES[0]), size - level + 1)


def mark_runs(marks: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mark, first place, last place) of each run of neighbouring places in `alive` with one mark."""
    if not len(alive):
        return np.zeros(0, np.uint64), alive, alive
    own = marks[alive]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(alive) != 1) | (own[1:] != own[:-1])]))
    last = np.concatenate([first[1:], [len(alive)]]) - 1
    return own[first], alive[first], alive[last]


def places_of(runs: list[dict]) -> np.ndarray:
    """The places that runs of first and last places cover, in order."""
    return np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs])) if runs else np.zeros(0, np.int64)


def _words(text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(raw)
    return span_hashes(raw, starts, ends, BASES[0]) if len(starts) else np.zeros(0, np.uint64)


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window that starts at one of starts."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))


_RUNS = "array<struct<mark:bigint,lo:int,hi:int>>"


def _run_lists(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(m) for m, _, _ in found])]).astype(np.int32)
    mark, lo, hi = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
    flat = pa.StructArray.from_arrays([pa.array(mark.astype(np.uint64).view(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["mark", "lo", "hi"])
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, th, n_words, sha (of the words joined by blanks), runs of the first level."""
    level = levels(size)[0]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            counts, shas, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = (text or b"").split()
                line = b" ".join(words)
                counts.append(len(words))
                shas.append(hashlib.sha256(line).hexdigest())
                marks = window_marks(_words(line), size, level) if len(words) >= size else np.zeros(0, np.uint64)
                found.append(mark_runs(marks, np.arange(len(marks))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), _run_lists(found)], ["doc_id", "th", "n_words", "sha", "runs"])

    return _keyed(docs).mapInArrow(read, f"doc_id bigint, th bigint, n_words bigint, sha string, runs {_RUNS}")


def _extended(texts: DataFrame, size: int, level: int) -> DataFrame:
    """doc_id, th, runs of the level, of the places in the column places."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [mark_runs(window_marks(_words(text), size, level), places_of(runs)) for text, runs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _run_lists(found)], ["doc_id", "th", "runs"])

    return texts.select("doc_id", "th", "text", "places").mapInArrow(read, f"doc_id bigint, th bigint, runs {_RUNS}")


def _windows(texts: DataFrame, size: int) -> DataFrame:
    """Windows (pos, h1, h2: their words' digest) of each text at the places in the column places, and one row with the text itself (pos -1)."""
    names = ["doc_id", "th", "pos", "h1", "h2", "text"]

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            total = 0

            def flush() -> Iterator[pa.RecordBatch]:
                if rows:
                    n = [len(r[2]) for r in rows]
                    digest = np.frombuffer(b"".join([r[3] for r in rows]), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([r[0] for r in rows], n).astype(np.int64)), pa.array(np.repeat([r[1] for r in rows], n).astype(np.int64)), pa.array(np.concatenate([r[2] for r in rows])), *(pa.array(digest[:, k]) for k in (0, 1)), pa.nulls(sum(n), pa.binary())], names)
                    m = len(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array(np.full(m, -1, np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([r[4] for r in rows], pa.binary())], names)

            for doc_id, th, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.split()
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                starts = np.concatenate([[0], ends[:-1] + 1])
                pos = places_of(runs)
                digests = b"".join([hashlib.blake2b(line[a:b], digest_size=16).digest() for a, b in zip(starts[pos].tolist(), ends[pos + size - 1].tolist(), strict=True)])
                rows.append((doc_id, th, pos.astype(np.int32), digests, text))
                total += len(pos) + len(text) // 16
                if total > 500_000:
                    yield from flush()
                    rows.clear()
                    total = 0
            yield from flush()

    return texts.select("doc_id", "th", "text", "places").mapInArrow(read, "doc_id bigint, th bigint, pos int, h1 bigint, h2 bigint, text binary")


def surviving(runs: DataFrame) -> DataFrame:
    """doc_id, th, places (runs): of one level's marks (doc_id, th, runs) those that several documents have."""
    marks = runs.select("doc_id", "th", F.explode("runs").alias("r")).select("doc_id", "th", "r.*")
    shared = marks.groupBy("mark").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("mark", "n")
    total = runs.agg(F.sum(F.size("runs"))).first()[0] or 0
    return join_counted(marks, shared, ["mark"], total).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("places"))


def repeats(docs: DataFrame, size: int = SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles without runs; first: sha, doc_id, th of the first document of each word sequence; texts of first documents with the starts of their repeated windows)."""
    profile = store(profiles(docs, size), "profiles")
    first = profile.where("doc_id is not null").groupBy("sha").agg(F.min(F.struct("doc_id", "th")).alias("r")).select("sha", "r.*")
    runs = profile.join(first.select("doc_id", "th"), ["doc_id", "th"], "left_semi").where(F.size("runs") > 0).select("doc_id", "th", "runs")
    texts = _keyed(docs)
    stored = None
    for level in levels(size)[1:-1]:
        after = store(_extended(texts.join(surviving(runs), ["doc_id", "th"]), size, level), f"level{level}")
        if stored is not None:
            drop_stored(stored)
        runs = stored = after
        if runs.isEmpty():
            break
    found = store(_windows(texts.join(surviving(runs), ["doc_id", "th"]), size), "windows")
    windows = found.where("pos >= 0").select("doc_id", "th", "pos", "h1", "h2")
    low = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").drop("high")
    gone = join_counted(windows, low, ["h1", "h2"], windows.count()).where("doc_id > low").groupBy("doc_id", "th").agg(F.collect_list("pos").alias("starts"))
    cut = found.where("pos = -1").select("doc_id", "th", "text").join(gone, ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    return profile.drop("runs"), first, cut


def substring_dedup(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            removed, shas = [], []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = text.split()
                out = covered(len(words), np.array(starts, np.int64), size)
                removed.append(int(out.sum()))
                shas.append(hashlib.sha256(b" ".join([words[i] for i in np.flatnonzero(~out).tolist()])).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string())], ["doc_id", "th", "n_removed", "kept"])

    profile, first, cut = repeats(docs, size)
    changed = cut.select("doc_id", "th", "text", "starts").mapInArrow(read, "doc_id bigint, th bigint, n_removed bigint, kept string")
    settled = first.join(changed, ["doc_id", "th"], "left").select("sha", F.col("doc_id").alias("first"), "n_removed", "kept")
    later = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= size)
    cut_too = (F.col("doc_id") == F.col("first")) & F.col("kept").isNotNull()
    return profile.join(settled, "sha", "left").select(
        "doc_id", "n_words",
        F.when(later, F.col("n_words")).when(cut_too, F.col("n_removed")).otherwise(F.lit(0).cast("bigint")).alias("n_removed"),
        F.when(later, F.lit(hashlib.sha256(b"").hexdigest())).when(cut_too, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """docs with repeated words cut out of text (n_chars follows, if there); documents that lose all their words go."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = []
            for text, starts in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                begin, end = word_spans(np.frombuffer(text, np.uint8))
                out = covered(len(begin), np.array(starts, np.int64), size)
                # runs of kept words with the white space inside them; one line break where words went
                edge = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))
                texts.append(b"\n".join([text[begin[a] : end[b - 1]] for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "th", "kept"])

    profile, first, cut = repeats(docs, size)
    changed = cut.select("doc_id", "th", "text", "starts").mapInArrow(read, "doc_id bigint, th bigint, kept string")
    later = profile.where(F.col("n_words") >= size).join(first.select("sha", F.col("doc_id").alias("first")), "sha").where("doc_id > first").select("doc_id", "th", F.lit("").alias("kept")).distinct()
    edits = changed.unionByName(later)
    # the row's own columns travel in a struct, so that none of their names can meet one used here
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    row = F.col("row").withField("text", F.coalesce("kept", "row.text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(F.col("kept").isNotNull(), F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return rows.join(edits, ["doc_id", "th"], "left").where("kept is null or kept <> ''").select(row.alias("row")).select("row.*")
