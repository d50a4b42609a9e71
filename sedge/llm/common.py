"""Helpers that several training-data operators share."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import shuffles_removed

#: Java's form of the word separator: blank and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a local one only where none is named (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    set_one = spark.sparkContext.getCheckpointDir()
    if set_one:
        return set_one
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sedge-"))
    return spark.sparkContext.getCheckpointDir()


#: Folders that store() has written and nothing has removed yet, oldest first.
_stored: list[str] = []


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    _stored.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    _stored.remove(path)


def drop_stored(df: DataFrame) -> None:
    """Remove what store() wrote, once nothing reads it any more."""
    files = df.inputFiles()[:1]
    for path in [p for p in _stored if any(p.rpartition("/")[2] in f for f in files)]:
        _remove(df.sparkSession, path)


def stored_folders() -> list[str]:
    """What store() has written so far and nothing has removed."""
    return list(_stored)


def drop_stored_since(spark: SparkSession, before: list[str]) -> None:
    """Remove all that store() has written since `before`, but for the last folder: what a stage needed on the way to its stored result."""
    for path in [p for p in _stored[:-1] if p not in before]:
        _remove(spark, path)


def unused(name: str, df: DataFrame) -> str:
    """name, with as many underscores before it as make it a name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text, unchanged; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 = 1: rows that no model may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def parallelism(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


#: Keys that join_counted() may send to every task at most.
HOT_KEYS = 2000


def join_counted(rows: DataFrame, keys: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined with keys (unique in `on`), where keys has `n`, the rows of each key, which sum to `total` at most.

    Keys with more than total / HOT_KEYS rows number less than HOT_KEYS: those are broadcast and
    their rows stay where they are; the rest meet by a shuffle in which no key is large. n is dropped.
    """
    bound = max(100, total // HOT_KEYS)
    if total <= bound:
        return rows.join(keys.drop("n"), on)
    hot = F.broadcast(keys.where(F.col("n") > bound).drop("n"))
    cold = rows.join(hot.select(*on), on, "left_anti").join(keys.where(F.col("n") <= bound).drop("n"), on)
    return rows.join(hot, on).unionByName(cold)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in own}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(own))
    return out


# ---------------------------------------------------------------- hashing in numpy

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Multipliers of the two word hashes and of the two window hashes; any odd 64-bit numbers do.
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
WINDOW_BASES = (0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads all bits of each 64-bit number."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) < n:
        size = 1 << max(12, int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        got = _powers[base] = (out[0], out[1])
    return got


_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes of a text."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~_WHITE[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A 64-bit hash of each span raw[start:end] in one pass over the bytes."""
    up, down = powers(base, len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    lengths = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + lengths * np.uint64(_ODD))


def window_hashes(words: np.ndarray, size: int, base: int) -> np.ndarray:
    """A 64-bit hash of each run of size words, from the words' hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(base, len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix((total[size:] - total[:n]) * down[:n])


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


# ---------------------------------------------------------------- connected components


#: Nodes of a graph whose minima (two numbers each) are broadcast; larger graphs shuffle them.
BROADCAST_NODES = 200_000
#: Edges that a task of the graph's steps should hold.
TASK_EDGES = 50_000


def _measured(edges: DataFrame) -> tuple[int, int, int, tuple]:
    """Number of edges and of nodes, the most edges that a node has, and what only an equal set of edges gives."""
    ends = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = ends.groupBy("u").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
    twice, nodes, most, total = degree.agg(F.sum("n"), F.count("*"), F.max("n"), F.sum("s")).first()
    return (twice or 0) // 2, nodes, most or 0, (twice, total)


def _forests(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, that connect what the edges of each task connect, as far as it holds TASK_EDGES at a time: fewer edges, and shorter paths."""

    def shrink(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros((2, 0), np.int64)
        for batch in it:
            ends = np.concatenate([ends, [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]], axis=1)
            nodes, at = np.unique(ends, return_inverse=True)
            at = at.reshape(2, -1)
            root = local_forest(len(nodes), at[0], at[1])
            linked = np.flatnonzero(root != np.arange(len(root)))
            ends = np.stack([nodes[linked], nodes[root[linked]]])
            if ends.shape[1] > TASK_EDGES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["u", "v"])
                ends = np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["u", "v"])

    return edges.mapInArrow(shrink, "u bigint, v bigint")


def _stars(edges: DataFrame) -> DataFrame:
    """node, root of edges (u, v) in which every u has one v, its root."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node that an edge (u, v) names.

    Tasks reduce their edges to forests, over again as long as that halves the tasks; where one
    task is left (TASK_EDGES edges at most) its forest is the result. Otherwise alternating
    large-star and small-star steps on what is left: no step holds a
    component in one task (the minima of at most BROADCAST_NODES nodes are broadcast; beyond, a hub's
    goes to its neighbours by join_counted), the edge set never outgrows its start, and rounds grow
    as the logarithm of the longest path.
    """
    now = store(edges.where("u <> v").select(F.col("u").cast("bigint"), F.col("v").cast("bigint")), "edges")
    tasks = lambda n: n // TASK_EDGES + 1
    n = now.count()
    while True:
        had, before = tasks(n), now
        now = store(_forests(before.coalesce(had)), "edges")
        drop_stored(before)
        if had == 1:
            return _stars(now)
        n = now.count()
        if 2 * tasks(n) > had:
            break
    n, nodes, most, seen = _measured(now)
    for _ in range(rounds):

        def with_least(rows: DataFrame, n: int = n, nodes: int = nodes, most: int = most) -> DataFrame:
            """rows (u, v) with m, the least v of their u."""
            least = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
            if nodes <= BROADCAST_NODES:
                return rows.join(F.broadcast(least.drop("n")), "u")
            if most > max(100, 2 * n // HOT_KEYS):
                return join_counted(rows, least, ["u"], 2 * n)
            return rows.withColumn("m", F.min("v").over(Window.partitionBy("u")))

        # large star: every neighbour above a node goes to the least of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        # small star: a node's lower neighbours, and the node, go to the least of them
        stars = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        after = store(with_least(large).select(F.explode(stars).alias("e")).select("e.*").where("u <> v").distinct().coalesce(tasks(n)), "edges")
        drop_stored(now)
        now, before = after, seen
        n, nodes, most, seen = _measured(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _stars(now)


def by_root(rows: DataFrame, key: str, low: str, total: int, out: str) -> DataFrame:
    """rows with `out`, the least `low` of all rows with their key; a key of any number of rows stays spread."""
    least = rows.groupBy(key).agg(F.min(low).alias(out), F.count("*").alias("n"))
    return join_counted(rows, least, [key], total)


def local_forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member's index of each of n nodes' components under edges a-b."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def batches(it: Iterator, size: int) -> Iterator[list]:
    part: list = []
    for x in it:
        part.append(x)
        if len(part) >= size:
            yield part
            part = []
    if part:
        yield part
