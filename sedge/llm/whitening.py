"""Whitening of embeddings, with exact integer scatter by bit-sliced popcounts.

Each entry c becomes the integer x = floor(256 c). The fit list is each distinct x vector once. Per
dimension the smallest x is taken off, so that what is left has few, non-negative bits; each task
packs bit plane b of dimension i, over blocks of rows, into 64-bit words P[i, b]. Then
sum(y_i y_j) = sum over b, c of 2^(b+c) popcount(P[i, b] & P[j, c]), exactly, and sum(y_i) likewise from
one plane. Tasks send one row per pair of dimensions (dims^2 / 2, whatever the number of vectors), in
limbs of 40 bits, which Spark adds up. With n vectors and sums S the driver holds n sum(y_i y_j) - S_i S_j
as integers, so centring loses nothing, and only then divides by n^2 and takes the eigenvectors.

Rows that take no part and get no row: vectors that are null, or hold null or non-finite entries, or
an entry whose x is beyond 2^62, or whose length isn't the most frequent one among distinct vectors (the
longest, on ties). A null vec_id is carried. Repeated vectors count once in the fit and get their rows
each. Components number min(4, dimensions); components of equal eigenvalue come in eigh's order, and
each has one sign for all rows. Where an eigenvalue is zero (all vectors alike in that direction)
whitened is null, and explained is null where the trace is; identity_error covers the other components
and is null if there is none. Only vec_id and embedding are read, so other columns may have any
names. An empty table, or one without a usable vector, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, store

COMPONENTS = 4
SCALE = 256
#: Bits of the words that a task holds at a time: planes times rows.
PLANE_BITS = 1 << 26
#: Sums travel in limbs of this many bits.
LIMB = 40
LIMBS = 4
_MAX = 2.0**62


def _grid(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, x) of the usable vectors, all of one length at a time."""
    lists = column.cast(pa.list_(pa.float64()))
    starts, stops = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
    values = lists.values
    flat = values.to_numpy(zero_copy_only=False)  # a null entry is NaN here
    with np.errstate(invalid="ignore", over="ignore"):
        bad = ~(np.abs(np.floor(flat * SCALE)) <= _MAX)
    upto = np.concatenate([[0], np.cumsum(bad)])
    size = stops - starts
    fine = (upto[stops] == upto[starts]) & ~lists.is_null().to_numpy(zero_copy_only=False)
    for d in np.unique(size[fine]).tolist():
        at = np.flatnonzero(fine & (size == d))
        rows = flat[starts[at][:, None] + np.arange(d)] if d else np.zeros((len(at), 0))
        yield at, np.floor(rows * SCALE).astype(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    n, d = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), pa.array(x.ravel()))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, x of every usable vector."""

    def floor(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at, x in _grid(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(x)], ["vec_id", "x"])

    return vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(floor, "vec_id bigint, x array<bigint>")


def planes(y: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Words (plane, word) of the bit planes of y (rows, dims; not negative): bits[i] planes of dimension i, lowest first."""
    words = -(-len(y) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    first = np.cumsum(bits) - bits
    for b in range(int(bits.max(initial=0))):
        has = np.flatnonzero(bits > b)
        packed = np.packbits((y[:, has] >> b & 1).astype(np.uint8), axis=0)
        out[first[has] + b, : packed.shape[0]] = packed.T
    return out.view(np.uint64)


def cross_products(y: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of y_i and of y_i y_j (i <= j; zero below), as Python integers, by weighted AND-popcounts of bit planes."""
    word = planes(y, bits)
    dims, first = len(bits), np.cumsum(bits) - bits
    owner = np.repeat(np.arange(dims), bits)
    wide = int(bits.max(initial=0)) + len(y).bit_length() > 62
    weight = np.array([1 << b for n in bits.tolist() for b in range(n)], object if wide else np.int64)
    sums, products = np.zeros(dims, object), np.zeros((dims, dims), object)

    def weighed(count: np.ndarray, lo: int) -> np.ndarray:
        """Per dimension from the owner of plane lo on: its planes' counts by their weights."""
        held = owner[lo:]
        out = np.zeros(dims, object if wide else np.int64)
        np.add.at(out, held, count.astype(out.dtype) * weight[lo:])
        return out.astype(object)

    sums += weighed(np.bitwise_count(word).sum(axis=1, dtype=np.int64), 0)
    for i in range(dims):
        lo = int(first[i])
        for b in range(int(bits[i])):
            products[i] += weighed(np.bitwise_count(word[lo:] & word[lo + b]).sum(axis=1, dtype=np.int64), lo) * (1 << b)
    return sums, products


def _limbs(value: int) -> list[int]:
    return [value >> LIMB * k & (1 << LIMB) - 1 for k in range(LIMBS)]


@dataclass
class Whitening:
    """n vectors; per dimension the least x and the sum of x; eigenvalues, components (columns), trace."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    #: The most that |n x - S| can be on the fit list, by dimension.
    reach: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exactly: int64 where squares' sums fit, else Python integers."""
        if sum(r * r for r in self.reach) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            out = (centred / self.n).astype(np.float64) @ self.vectors / np.sqrt(self.values)
        out[:, ~self.solid] = np.nan
        return out

    @property
    def solid(self) -> np.ndarray:
        """Which components have an eigenvalue that isn't zero but for rounding."""
        return self.values > self.trace * len(self.sums) * 2.0**-52


def fit(distinct: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of a stored table of distinct x vectors of `dims` entries."""

    def ranges(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if len(batch):
                x = _matrix(batch.column(0), dims)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(x.min(axis=0)), pa.array(x.max(axis=0))], ["i", "lo", "hi"])

    seen = {r["i"]: r for r in distinct.mapInArrow(ranges, "i int, lo bigint, hi bigint").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()}
    lo = np.array([seen[i]["lo"] for i in range(dims)], np.int64)
    span = [seen[i]["hi"] - seen[i]["lo"] for i in range(dims)]
    bits = np.array([s.bit_length() for s in span])
    step = max(64, PLANE_BITS // max(1, int(bits.sum())))

    def scatter(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, object), np.zeros((dims, dims), object)
        parts: list[np.ndarray] = []

        def add() -> None:
            nonlocal n, sums, products, parts
            x = np.concatenate(parts)
            s, p = cross_products(x - lo, bits)
            n, sums, products, parts = n + len(x), sums + s, products + p, []

        for batch in it:
            for at in range(0, len(batch), step):
                parts.append(_matrix(batch.column(0).slice(at, step), dims))
                if sum(map(len, parts)) >= step:
                    add()
        if parts:
            add()
        if n:
            cells = [(-1, -1, n), *((i, -1, s) for i, s in enumerate(sums)), *((i, j, products[i, j]) for i in range(dims) for j in range(i, dims))]
            cols = [pa.array(c, pa.int32()) for c in zip(*[(i, j) for i, j, _ in cells], strict=True)]
            limbs = [pa.array(c, pa.int64()) for c in zip(*[_limbs(v) for *_, v in cells], strict=True)]
            yield pa.RecordBatch.from_arrays([*cols, *limbs], ["i", "j", *(f"l{k}" for k in range(LIMBS))])

    limbs = [f"l{k}" for k in range(LIMBS)]
    sent = distinct.mapInArrow(scatter, ", ".join(["i int", "j int", *(f"{c} bigint" for c in limbs)]))
    total = {(r["i"], r["j"]): sum(r[c] << LIMB * k for k, c in enumerate(limbs)) for r in sent.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in limbs]).collect()}
    n = total[-1, -1]
    least = [total[i, -1] for i in range(dims)]
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * total[i, j] - least[i] * least[j]) / (n * n)
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values, kind="stable")[:components]
    sums = [s + n * int(low) for s, low in zip(least, lo, strict=True)]
    reach = [max(abs(n * int(low) - s), abs(n * (int(low) + w) - s)) for low, w, s in zip(lo, span, sums, strict=True)]
    return Whitening(n, sums, np.maximum(values[top], 0), vectors[:, top], float(np.trace(cov)), reach)


def _identity_error(distinct: DataFrame, dims: int, model: Whitening) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance (divisor n, centred) minus the identity."""
    solid = np.flatnonzero(model.solid)
    names = [f"w{k}" for k in solid.tolist()]
    if not names:
        return None

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            w = model.whitened(model.centred(_matrix(batch.column(0), dims)))
            yield pa.RecordBatch.from_arrays([pa.array(w[:, k]) for k in solid], names)

    projected = distinct.mapInArrow(project, ", ".join(f"{c} double" for c in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = projected.agg(*[F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs]).first()
    return max(abs(got[f"{a}{b}"] - (a == b)) for a, b in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation (decimal), whitened, explained, identity_error: a row per usable vector and component."""
    out = "vec_id bigint, component int, n bigint, high bigint, low bigint, whitened double, explained double, identity_error double"
    rows = integer_vectors(vectors)
    everything = store(rows.select("x").distinct(), "distinct-vectors")
    commonest = everything.where(F.size("x") > 0).groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    exact = (F.col("high").cast("decimal(19,0)") * F.lit(1 << 62).cast("decimal(19,0)") + F.col("low")).alias("deviation")
    if commonest is None:
        return vectors.sparkSession.createDataFrame([], out).select("vec_id", "component", "n", exact, "whitened", "explained", "identity_error")
    dims = commonest["d"]
    distinct = everything.where(F.size("x") == dims)
    model = fit(distinct, dims, components)
    error = _identity_error(distinct, dims, model)
    drop_stored(everything)
    k = len(model.values)
    shares = (model.values / model.trace).tolist() if model.trace > 0 else [None] * k

    def project(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            q = model.centred(_matrix(batch.column(1), dims))
            m = len(q)
            square = (q * q).sum(axis=1)
            w = model.whitened(q)
            high = np.array([int(s) >> 62 for s in square], np.int64) if square.dtype == object else np.zeros(m, np.int64)
            low = np.array([int(s) & (1 << 62) - 1 for s in square], np.int64) if square.dtype == object else square
            each = lambda a: pa.array(np.repeat(a, k))
            cols = [
                batch.column(0).take(each(np.arange(m))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n)),
                each(high),
                each(low),
                pa.array(w.ravel(), pa.float64(), from_pandas=True),
                pa.array(shares * m, pa.float64()),
                pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in out.split(", ")])

    return rows.where(F.size("x") == dims).mapInArrow(project, out).select("vec_id", "component", "n", exact, "whitened", "explained", "identity_error")
