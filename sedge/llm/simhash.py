"""SimHash near-duplicates, found exactly by vantage-point trees.

Fingerprint: bit k of a document is 1 if it is set in over half the XXH64 hashes (seed 42) of its
4-word shingles. Fingerprints link at `RADIUS` or fewer differing bits, and documents fall into
the connected components of those links.

Search: fingerprints are compared once per distinct value. Of two that differ in at most 4 bits,
some 16-bit block of the four differs in at most 1. For each block a vantage-point tree splits
the block's values by their Hamming distance from a vantage value at the median; its leaves are
shards. A fingerprint lives in its own leaf and also visits every other leaf that holds a value of
the ball of radius 1 round its block: branches are pruned by triangle bounds, and what reaches a
leaf must have one of the ball's 17 values there, so no fingerprint is sent to more than 17 leaves of
a block however deep the tree. Inside a shard the tree goes on in memory down to small leaves,
where whole fingerprints are compared; fingerprints of one block value go on by the other blocks,
of which one differs in at most RADIUS // (blocks left) bits. So every link is found, none is
guessed. Shards grow in number as the input grows, up to 16,384 a block; beyond some 3e8 distinct
fingerprints they grow in size, a shard of 1e10 then holds about 600,000 and their visitors.

A shard doesn't emit all its pairs, only a forest that connects the same fingerprints, so a
thousand near copies give a thousand edges. Components come from star contraction.

Null and wordless texts have fingerprint zero and link like any other. Fewer words than a shingle
count as one shingle. Null doc_ids are carried and never name a component unless all its ids are null.
Repeated rows give a row each and share a component. Long texts are hashed in parts of bounded size.
Only doc_id and text are read, so other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_root, components, local_forest, store
from .similar import smallest_of_components

WORDS, SEED, RADIUS = 4, 42, 4
BLOCKS, BLOCK_BITS = 4, 16
#: A ball round a block that some pair within RADIUS must share: RADIUS // BLOCKS.
BLOCK_RADIUS = RADIUS // BLOCKS
#: Fingerprints that a shard should hold, and points of an in-memory leaf.
SHARD_POINTS, LEAF = 20_000, 128
_CHUNK = 1 << 15


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    from xxhash import xxh64_intdigest

    found = text.lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)], np.uint64)
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(found) - words + 1].tolist()
    stops = ends[words - 1 :].tolist()
    return np.fromiter([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64, len(starts))


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    hashes = shingle_hashes(text or b"", words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            prints = np.fromiter((fingerprint(t, words) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("binary")).mapInArrow(read, "doc_id bigint, fp bigint")


# ---------------------------------------------------------------- vantage-point trees


class Shards:
    """The top of a vantage-point tree over all values of one block: 2**depth leaves at most.

    It depends on the depth alone, so every task builds the same one: home[v] is the leaf of
    value v; visits[starts[v]:starts[v + 1]] are the other leaves that v's ball may reach.
    """

    def __init__(self, depth: int, bits: int = BLOCK_BITS, radius: int = BLOCK_RADIUS):
        self.radius, self.leaves = radius, 0
        self.ball = [np.uint32(sum(1 << b for b in some)) for n in range(1, radius + 1) for some in combinations(range(bits), n)]
        size = 1 << bits
        self.home = np.zeros(size, np.int32)
        self._seen: list[tuple[np.ndarray, int]] = []
        everything = np.arange(size, dtype=np.uint32)
        self._grow(everything, everything, depth, np.random.default_rng(11))
        values = np.concatenate([q for q, _ in self._seen])
        leaf = np.concatenate([np.full(len(q), k, np.int32) for q, k in self._seen])
        order = np.argsort(values, kind="stable")
        self.visits = leaf[order]
        self.starts = np.searchsorted(values[order], np.arange(size + 1))

    def _grow(self, points: np.ndarray, queries: np.ndarray, depth: int, rng: np.random.Generator) -> None:
        if depth and len(points) > 1:
            vantage = points[rng.integers(len(points))]
            far = np.bitwise_count(points ^ vantage).astype(np.int32)
            cut = int(np.median(far))
            inner = far <= cut
            if inner.all():
                cut -= 1
                inner = far <= cut
            if inner.any() and not inner.all():
                reach = np.bitwise_count(queries ^ vantage).astype(np.int32)
                self._grow(points[inner], queries[reach - self.radius <= cut], depth - 1, rng)
                self._grow(points[~inner], queries[reach + self.radius > cut], depth - 1, rng)
                return
        # of the queries that the bounds let through, those with a value of their ball here
        here = np.zeros(len(self.home), bool)
        here[points] = True
        near = np.zeros(len(queries), bool)
        for offset in self.ball:
            near |= here[queries ^ offset]
        self.home[points] = self.leaves
        self._seen.append((queries[near & ~here[queries]], self.leaves))
        self.leaves += 1


_tops: dict[int, Shards] = {}


def tops(depth: int) -> Shards:
    if depth not in _tops:
        _tops[depth] = Shards(depth)
    return _tops[depth]


def block_of(prints: np.ndarray, block: int) -> np.ndarray:
    return ((prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint32)


def _leaf_edges(points: np.ndarray, visitors: np.ndarray, prints: np.ndarray, out: list[np.ndarray]) -> None:
    """Edges that connect what the leaf's links connect; points and visitors are indexes into prints."""
    near_a, near_b = [], []
    own = prints[points]
    step = max(1, (1 << 20) // max(1, len(points)))
    for at in range(0, len(points), step):
        a, b = np.nonzero(np.bitwise_count(own[at : at + step, None] ^ own[None, :]) <= RADIUS)
        a += at
        keep = a < b
        near_a.append(a[keep])
        near_b.append(b[keep])
    root = local_forest(len(points), np.concatenate(near_a), np.concatenate(near_b))
    mine = np.flatnonzero(root != np.arange(len(points)))
    if len(mine):
        out.append(np.stack([points[mine], points[root[mine]]]))
    for at in range(0, len(visitors), step):
        part = visitors[at : at + step]
        a, b = np.nonzero(np.bitwise_count(prints[part][:, None] ^ own[None, :]) <= RADIUS)
        if len(a):
            pair = np.unique(a * len(points) + root[b])
            out.append(np.stack([part[pair // len(points)], points[pair % len(points)]]))


def _search(points: np.ndarray, visitors: np.ndarray, prints: np.ndarray, blocks: tuple[int, ...], leaf: int, out: list[np.ndarray]) -> None:
    """Edges that connect all links among points and between them and visitors whose first block of `blocks` differs in at most RADIUS // len(blocks) bits."""
    radius = RADIUS // len(blocks)
    value = block_of(prints, blocks[0])
    todo = [(points, visitors)]
    while todo:
        points, visitors = todo.pop()
        if not len(points):
            continue
        if len(points) > leaf:
            vantage = value[points[len(points) // 2]]
            far = np.bitwise_count(value[points] ^ vantage).astype(np.int32)
            cut = int(np.median(far))
            inner = far <= cut
            if inner.all():
                cut -= 1
                inner = far <= cut
            if inner.any() and not inner.all():
                reach = np.bitwise_count(value[visitors] ^ vantage).astype(np.int32)
                ins, outs = points[inner], points[~inner]
                # points near the boundary visit the other side; once is enough for a pair
                over = ins[far[inner] + radius > cut]
                todo.append((ins, visitors[reach - radius <= cut]))
                todo.append((outs, np.concatenate([visitors[reach + radius > cut], over])))
                continue
            if len(blocks) > 1 and not far.any():  # one value: the other blocks tell them apart
                for k in range(1, len(blocks)):
                    _search(points, visitors, prints, (*blocks[k:], *blocks[1:k]), leaf, out)
                continue
        _leaf_edges(points, visitors, prints, out)


def shard_edges(prints: np.ndarray, lives: np.ndarray, block: int, leaf: int = LEAF) -> np.ndarray:
    """2 x n indexes of prints whose edges connect all links of one shard: between those that live in it, and with its visitors."""
    out: list[np.ndarray] = []
    _search(np.flatnonzero(lives), np.flatnonzero(~lives), prints, (block, *(b for b in range(BLOCKS) if b != block)), leaf, out)
    if not out:
        return np.zeros((2, 0), np.int64)
    edges = np.concatenate(out, axis=1)
    root = local_forest(len(prints), edges[0], edges[1])
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return np.stack([linked, root[linked]])


def depth_for(n: int, shard_points: int = SHARD_POINTS) -> int:
    return min(BLOCK_BITS - 2, max(0, math.ceil(math.log2(max(1, n) / shard_points))))


def links(prints: DataFrame, n: int, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that connect exactly what links of RADIUS bits connect. prints: one column fp, n rows."""
    depth = depth_for(n, shard_points)

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = tops(depth)
        for batch in it:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            own = fp.view(np.uint64)
            for block in range(BLOCKS):
                value = block_of(own, block)
                first, last = top.starts[value], top.starts[value + 1]
                times = last - first
                who = np.repeat(np.arange(len(fp)), times)
                at = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
                for part, shard, lives in ((np.arange(len(fp)), top.home[value], True), (who, top.visits[at], False)):
                    yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32) * BLOCKS + block, pa.int32()), pa.array(np.full(len(part), lives)), pa.array(fp[part])], ["shard", "lives", "fp"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy()
        own = fp.view(np.uint64)
        a, b = shard_edges(own, pdf["lives"].to_numpy(), int(pdf["shard"].iloc[0]) % BLOCKS)
        return pd.DataFrame({"u": fp[a], "v": fp[b]})

    dealt = prints.select("fp").mapInArrow(deal, "shard int, lives boolean, fp bigint")
    return dealt.groupBy("shard").applyInPandas(join, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, words: int = WORDS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) of every row."""
    prints = store(fingerprints(docs, words), "fingerprints")
    distinct = store(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    n = distinct.count()
    roots = components(links(distinct, n, shard_points))
    rooted = store(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
    named = by_root(rooted, "root", "low", n, "component_id").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents of which none with a smaller doc_id is a near copy by the pipeline's own rule (similar.py); of rows with one doc_id, all stay together.

    What near_duplicates() links by vantage-point trees is looked at first and verified on whole sets of shingles. As 4 bits
    reach only nearly identical texts, similar.py finds the other texts of its rule, all of them.
    """
    found = smallest_of_components(docs, near_duplicates(docs).select("doc_id", "component_id"))
    return docs.join(found, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id is null"))
