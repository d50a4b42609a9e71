"""Near-duplicate vectors by cross-polytope hashing, with every candidate pair verified.

A vector is rotated by three rounds of random signs and a fast Hadamard transform; its hash is
the signed axis it lies closest to. A table joins a few such hashes into a bucket, so many that
buckets outnumber vectors; besides its own bucket a vector also enters those where one hash is its
second closest axis (multiprobe). Vectors that share a bucket of any of the `TABLES` tables are
candidates, and their cosine is computed in double precision: only pairs of `COSINE` or more link.

Bucket numbers are counted first, without vectors; a vector is only sent to the buckets that it
shares with another.

Identical vectors are one class with a count, and classes are compared, so copies are never
expanded into pairs. A bucket of more than `CELL` classes is split into cells and every two cells
meet in a task of their own, so no task grows with a hot bucket and no pair is lost. A pair is
counted in the first bucket it shares and in no other; buckets emit counts and a forest of links,
not pairs.

Vectors link only with equal labels and equal lengths. Null labels, vectors that are null, empty,
zero or hold null or non-finite numbers, and rows without vec_id link with nothing (kept, own
component; for a null vec_id both are null and false). Repeated rows are vectors of their own; rows that
share a vec_id are named by it together. Entries of any size count (the largest doubles too). Ties: a
component's name is its smallest vec_id, so nothing depends on the rows' order. Vectors of any
length are read whole. Only vec_id, embedding and label are read, so other columns may have any names.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_root, components, join_counted, local_forest, store

COSINE = 0.98
TABLES = 6
CELL = 2000
#: Bucket rows that one task should hold; buckets are dealt to tasks by hash, a few thousand at a time.
TASK_ROWS = 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row (a power of two wide), scaled to keep lengths."""
    n, width = x.shape
    half = 1
    while half < width:
        y = x.reshape(n, width // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        half *= 2
    return x / np.sqrt(width)


def functions_for(n: int, dim: int) -> int:
    """Hashes a bucket joins: the fewest, two at least, that make as many buckets as there are vectors."""
    axes = 2 * (1 << max(0, dim - 1).bit_length())
    return max(2, math.ceil(math.log(max(2, n)) / math.log(axes) - 1e-9)) if axes > 2 else 2


def codes_of(x: np.ndarray, functions: int) -> np.ndarray:
    """n x TABLES x (functions + 1) bucket numbers of n unit vectors, their own bucket first."""
    n, dim = x.shape
    width = 1 << max(0, dim - 1).bit_length()
    padded = np.zeros((n, width))
    padded[:, :dim] = x
    rng = np.random.default_rng(dim)
    out = np.zeros((n, TABLES, functions + 1), np.int64)
    rows = np.arange(n)
    for t in range(TABLES):
        best, second = [], []
        for _ in range(functions):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            far = np.abs(y)
            first = far.argmax(1)
            far[rows, first] = -1
            other = far.argmax(1)
            best.append(first * 2 + (y[rows, first] < 0))
            second.append(other * 2 + (y[rows, other] < 0))
        own = sum(b * (2 * width) ** k for k, b in enumerate(best))
        out[:, t, 0] = own
        for k in range(functions):
            out[:, t, k + 1] = own + (second[k] - best[k]) * (2 * width) ** k
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors. Each is first scaled by the power of two that its largest entry calls for, so that no square leaves the range of doubles; that changes no digit."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit(flat.reshape(len(column), -1))


def meet(x: np.ndarray, codes: np.ndarray, table: int, code: int, left: np.ndarray, right: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs left x right that reach `least`: what each vector gains in links from pairs first met in this bucket, and forest roots.

    left and right are index arrays, equal for one cell with itself.
    """
    same = left is right
    gain = np.zeros(len(x), np.int64)
    near_a, near_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(left), 512):
        rows = left[at : at + 512]
        a, b = np.nonzero(x[rows] @ x[right].T >= least)
        a, b = rows[a], right[b]
        if same:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        near_a.append(a)
        near_b.append(b)
        for k in range(0, len(a), 50_000):
            i, j = a[k : k + 50_000], b[k : k + 50_000]
            ci, cj = codes[i, : table + 1], codes[j, : table + 1]
            shared = (ci[:, :, :, None] == cj[:, :, None, :]).any(3)  # pair, table, probe of i
            first = ~shared[:, :table].any((1, 2))
            lowest = np.where(shared[:, table], ci[:, table], np.iinfo(np.int64).max).min(1) == code
            own = first & lowest
            np.add.at(gain, i[own], counts[j[own]])
            np.add.at(gain, j[own], counts[i[own]])
    return gain, local_forest(len(x), np.concatenate(near_a), np.concatenate(near_b))


def near_vectors(vectors: DataFrame, least: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    e = F.col("embedding")
    finite = ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & (F.size(e) > 0) & finite & F.exists(e, lambda v: v != 0)
    base = vectors.select(F.col("vec_id").cast("bigint"), F.col("label"), e, F.coalesce(usable, F.lit(False)).alias("usable"))
    base = base.withColumn("k1", F.xxhash64("label", "embedding")).withColumn("k2", F.hash("embedding", "label"))
    classes = store(
        base.where("usable").groupBy("label", F.size("embedding").alias("dim"), "k1", "k2").agg(F.first("embedding").alias("embedding"), F.min("vec_id").alias("low"), F.count("*").alias("n"))
        .withColumn("cid", F.monotonically_increasing_id()), "classes",
    )

    n_classes = classes.count()

    def hashed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            dims = batch.column(1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                codes = codes_of(_unit(part.column(2)), functions_for(n_classes, int(dim))).reshape(part.num_rows, -1)
                offsets = np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes.ravel()))], ["cid", "codes"])

    bucket = ["label", "dim", "tab", "code"]
    codes = store(classes.select("cid", "dim", "embedding").mapInArrow(hashed, "cid bigint, codes array<bigint>").join(classes.select("cid", "label", "dim"), "cid"), "codes")
    keys = codes.select("cid", "label", "dim", (F.size("codes") / TABLES).cast("int").alias("probes"), F.posexplode("codes").alias("pos", "code"))
    keys = keys.select("cid", "label", "dim", F.floor(F.col("pos") / F.col("probes")).cast("int").alias("tab"), "code")
    shared = keys.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1").withColumn("cells", F.ceil(F.col("n") / CELL).cast("int"))
    total = codes.agg(F.sum(F.size("codes"))).first()[0] or 0
    places = join_counted(keys, shared, bucket, total).groupBy("cid").agg(F.collect_list(F.struct("tab", "code", "cells")).alias("places"))
    rows = classes.select("cid", "label", "dim", "embedding", "n").join(places, "cid").join(codes.select("cid", "codes"), "cid").withColumn("p", F.explode("places")).select("*", "p.*").drop("p", "places")
    # a row of cell c meets every cell d: in the task of {c, d}, with its own cell's rows and the other's
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("cid"), F.col("cells")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    rows = rows.withColumn("c1", F.least("cell", "other")).withColumn("c2", F.greatest("cell", "other"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf[[*bucket, "c1", "c2"]].assign(label=pd.factorize(pdf["label"])[0]).to_numpy(np.int64)
        order = np.lexsort(keys.T[::-1])
        cuts = np.flatnonzero((np.diff(keys[order], axis=0) != 0).any(1)) + 1
        cell, cid, counts = pdf["cell"].to_numpy(), pdf["cid"].to_numpy(), pdf["n"].to_numpy()
        embedding, packed = pdf["embedding"].to_numpy(), pdf["codes"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in np.split(order, cuts):
            if len(part) < 2:
                continue
            x = unit(np.stack(embedding[part]).astype(np.float64))
            codes = np.stack(packed[part]).reshape(len(part), TABLES, -1)
            _, _, tab, code, c1, c2 = keys[part[0]].tolist()
            left = np.flatnonzero(cell[part] == c1)
            right = left if c1 == c2 else np.flatnonzero(cell[part] == c2)
            gain, root = meet(x, codes, tab, code, left, right, counts[part], least)
            some = np.flatnonzero((gain > 0) | (root != np.arange(len(root))))
            if len(some):
                own = cid[part]
                out.append((own[some], gain[some], own[root[some]]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("cid", "gain", "root"), cols, strict=True)))

    tasks = max(1, -(-total // TASK_ROWS))
    dealt = rows.select(*bucket, "c1", "c2", "cell", "cid", "n", "embedding", "codes", F.pmod(F.xxhash64(*bucket, "c1", "c2"), F.lit(tasks)).alias("task"))
    met = store(dealt.groupBy("task").applyInPandas(join, "cid bigint, gain bigint, root bigint"), "met")
    gains = met.groupBy("cid").agg(F.sum("gain").alias("gain"))
    roots = components(met.where("cid <> root").select(F.col("cid").alias("u"), F.col("root").alias("v")))
    rooted = classes.select("label", "dim", "k1", "k2", "cid", "low", F.col("n").alias("size")).join(gains, "cid", "left").join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = by_root(rooted, "root", "low", n_classes, "component_id").select("label", "dim", "k1", "k2", (F.col("size") - 1 + F.coalesce("gain", F.lit(0))).alias("n_links"), "component_id").withColumn("usable", F.lit(True))
    slim = base.select("vec_id", "label", F.coalesce(F.size("embedding"), F.lit(-1)).alias("dim"), "k1", "k2", "usable")
    out = slim.join(named, ["label", "dim", "k1", "k2", "usable"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
