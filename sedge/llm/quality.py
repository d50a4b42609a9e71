"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed lower-case byte trigrams, of runs of four character classes
(upper, lower, digit, white space, mark, beyond ASCII; so the shape of a text counts in any
language), and of a few binned shares (distinct words, words repeated at once, repeated lines,
length). Counts are damped, weighted by rarity, scaled to length one per block, and projected on
the leading singular vectors of a bounded sample of labelled documents: the latent-semantic
space. Each document's cosines with all labelled vectors are exact, one block of documents at a
time; its nearest labelled vectors vote, weighted by a power of their similarity and so that both
classes have equal voices in all. Equally near vectors are taken by doc_id.

The labelled sample holds at most `per_class` documents a class, which bounds the two matrices
that are broadcast whatever the input. Null, empty and wordless texts have the shape of an empty
text and get their neighbours' vote like any other; long texts are counted whole. Without labels of
both classes every score is 1.0: nothing tells documents apart, so none is rejected. Repeated rows
are scored each, and repeated labelled texts vote once. score() reads doc_id and text alone,
keep_good() returns all columns as they are, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_held_out
from .labelled import training_rows

PER_CLASS = 2000
TRIGRAMS, CLASSES, BINS = 2048, 6**4, 40
WIDTH = TRIGRAMS + CLASSES + BINS
RANK = 64
NEIGHBOURS = 15
#: Power of the cosine that weighs a vote.
SHARPNESS = 8
CUTOFF = 0.5
#: Documents whose cosines are computed together.
BLOCK = 256

_KIND = np.full(256, 5, np.uint16)  # beyond ASCII
_KIND[:128] = 4  # marks
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[32, *range(9, 14)]] = 3


def nearest(cosines: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest numbers; of equal ones (to five places) the first columns, that is the smallest doc_ids."""
    cosines = np.round(cosines, 5)
    least = np.partition(cosines, -k, axis=1)[:, -k]
    above, level = cosines > least[:, None], cosines == least[:, None]
    level &= np.cumsum(level, axis=1) <= (k - above.sum(1))[:, None]
    return np.nonzero(above | level)[1].reshape(len(cosines), k)


def counts_of(text: str | None, out: np.ndarray) -> None:
    """Fills out (WIDTH float32 numbers) with a text's damped counts."""
    raw = (text or "").encode(errors="replace")
    words = raw.split()
    shape = np.frombuffer(raw, np.uint8)
    low = np.frombuffer(raw.lower(), np.uint8).astype(np.uint32)
    if len(raw) >= 3:
        code = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1] * np.uint32(0x85EBCA77) + low[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(21)
        out[:TRIGRAMS] = np.bincount(code, minlength=TRIGRAMS)
    if len(raw) >= 4:
        kind = _KIND[shape]
        out[TRIGRAMS : TRIGRAMS + CLASSES] = np.bincount(((kind[:-3] * 6 + kind[1:-2]) * 6 + kind[2:-1]) * 6 + kind[3:], minlength=CLASSES)
    np.log1p(out, out=out)
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shares = (
        len(set(words)) / n if n else 0.0,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n if n else 0.0,
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        min(np.log2(n + 1) / 16, 0.999),
    )
    for k, share in enumerate(shares):
        at = share * 9.0  # between two of ten bins, so that close shares stay close
        i = min(int(at), 8)
        base = TRIGRAMS + CLASSES + 10 * k
        out[base + i] += 1 - (at - i)
        out[base + i + 1] += at - i


def counts_matrix(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(out, texts, strict=True):
        counts_of(text, row)
    return out


_PARTS = ((0, TRIGRAMS, 0.6), (TRIGRAMS, TRIGRAMS + CLASSES, 1.0), (TRIGRAMS + CLASSES, WIDTH, 0.8))


def weighted(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rarity weights, then length one for each block of features, times the block's share."""
    out = counts * rarity
    for a, b, share in _PARTS:
        norm = np.linalg.norm(out[:, a:b], axis=1, keepdims=True)
        out[:, a:b] *= share / np.maximum(norm, 1e-9)
    return out


@dataclass
class QualityModel:
    rarity: np.ndarray
    basis: np.ndarray  # WIDTH x RANK
    vectors: np.ndarray  # labelled documents, length one
    labels: np.ndarray
    voices: np.ndarray  # of each labelled document, so that both classes have the same number together

    def latent(self, texts: list[str | None]) -> np.ndarray:
        out = weighted(counts_matrix(texts), self.rarity) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not len(self.labels):
            return np.ones(len(texts))
        out = np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            cosines = self.latent(texts[at : at + BLOCK]) @ self.vectors.T
            near = nearest(cosines, k)
            weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS * self.voices[near]
            votes = self.labels[near]
            # a half vote for each side keeps the score defined where nothing is near
            out[at : at + BLOCK] = ((weight * votes).sum(1) + 1e-3) / (weight.sum(1) + 2e-3)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", per_class: int = PER_CLASS) -> QualityModel:
    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = counts_matrix(batch.column(1).to_pylist()).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "label", "counts"])

    # bounded: 2 * per_class rows of WIDTH half-precision counts
    sample = training_rows(docs, labels, column, per_class).select(F.col("doc_id").cast("bigint"), "text", "label").mapInArrow(count, "doc_id bigint, label int, counts binary").toArrow()
    label = np.array(sample.column("label").to_pylist(), np.float64)
    if len(set(label.tolist())) < 2:
        return QualityModel(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    order = np.argsort(np.array(sample.column("doc_id").to_pylist()), kind="stable")
    counts = np.stack([np.frombuffer(b, np.float16) for b in sample.column("counts").to_pylist()])[order].astype(np.float32)
    label = label[order]
    share = label.mean()
    voices = np.where(label == 1, 0.5 / share, 0.5 / (1 - share))
    rarity = np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))).astype(np.float32) + 0.2
    rarity[TRIGRAMS + CLASSES :] = 1
    basis = leading(weighted(counts, rarity), RANK)
    model = QualityModel(rarity, basis, np.zeros((0, 1), np.float32), label, voices)
    vectors = weighted(counts, rarity) @ basis
    model.vectors = (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return model


def leading(x: np.ndarray, rank: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of x by subspace iteration."""
    rank = min(rank, *x.shape)
    q = np.random.default_rng(7).standard_normal((x.shape[1], rank + 16)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return np.ascontiguousarray(q @ v[:rank].T, np.float32)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            ids = batch.column(0).to_pylist()
            value = own.scores(batch.column(1).to_pylist())
            out = pa.array([i is not None and crc_held_out(i) for i in ids], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(value), pa.array((value >= CUTOFF).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(vote, "doc_id bigint, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier doesn't reject, with their own columns: each row is judged by its own text."""
    model = fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    at = columns.index("text")

    def sift(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in it:
            good = own.scores(batch.column(at).to_pylist()) >= CUTOFF
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(sift, docs.schema)
