"""Joins with guarantees: paired, reconciled, interval, dominance, closest pair, upsert, isolation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Full outer join on key with `side`: both, left or right. require_paired() makes anything but both an error."""
    left, right = a.withColumn("_a", F.lit(1)), b.withColumn("_b", F.lit(1))
    side = F.when(F.col("_a").isNull(), "right").when(F.col("_b").isNull(), "left").otherwise("both")
    return left.join(right, key, "full_outer").withColumn("side", side).drop("_a", "_b")


def require_paired(pairs: DataFrame, key: str) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit("only on one side: "), F.col(key).cast("string")))
    return pairs.where(F.when(F.col("side") == "both", F.lit(True)).otherwise(bad.cast("boolean"))).drop("side")


def differing(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """Keys of a whose column isn't the same in b, or that b lacks."""
    right = b.select(key, F.col(column).alias("_other"))
    return a.join(right, key, "left").where(~F.col(column).eqNullSafe(F.col("_other"))).select(key)


def reconcile(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float) -> DataFrame:
    """Findings: keys whose published value is missing or off by more than tolerance."""
    right = b.select(key, F.col(value).alias("published"))
    return a.join(right, key, "left").where(F.col("published").isNull() | (F.abs(F.col(value) - F.col("published")) > tolerance)).select(key, value, "published")


def flips(a: DataFrame, b: DataFrame, key: str, column: str, *groups: str) -> DataFrame:
    """Gains, losses and changes of a boolean between two runs."""
    joined = a.select(key, *groups, F.col(column).alias("x")).join(b.select(key, F.col(column).alias("y")), key)
    return joined.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(F.col("x") != F.col("y")).alias("flipped"), F.count_if(~F.col("x") & F.col("y")).alias("gains"), F.count_if(F.col("x") & ~F.col("y")).alias("losses"))


def pareto(points: DataFrame, low: str, high: str) -> DataFrame:
    """Points that no other dominates (low less or equal and high greater or equal, one of them strictly). Equal points both stay.

    Sorting replaces the quadratic comparison: per low value only its best high counts, and a
    running maximum over smaller lows decides. Ranges of low are summed up first, so that each
    range needs only the maximum of those before it and no task sees all points.
    """
    best = points.groupBy(low).agg(F.max(high).alias("_best"))
    # where ranges are cut is decided by a sample, so it is decided once
    parts = stored(best.repartitionByRange(low).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(low).rowsBetween(Window.unboundedPreceding, -1)
    before = parts.groupBy("_part").agg(F.max("_best").alias("_top"))
    carried = before.select("_part", F.max("_top").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    front = parts.withColumn("_seen", F.max("_best").over(inside)).join(F.broadcast(carried), "_part").where(F.coalesce(F.greatest("_seen", "_carried") < F.col("_best"), F.lit(True)))
    return points.join(front.select(low, "_best"), low).where(F.col(high) == F.col("_best")).drop("_best")


def interval_latest(points: DataFrame, spans: DataFrame, key: list[str], at: str, start: str, end: str, payload: str, width: float) -> DataFrame:
    """Each distinct point with the payload of the latest span of its key that covers it (null end: open). Spans are cut into bins of `width`, so the range join is an equi-join; an open or long span is found through the bins it covers up to the point's key maximum."""
    last = points.groupBy(*key).agg(F.max(at).alias("_last"))
    binned = spans.join(last, key).where(F.col(start) <= F.col("_last")).withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.least(F.coalesce(F.col(end), F.col("_last")), F.col("_last")) / width)))).drop("_last")
    hit = points.withColumn("_bin", F.floor(F.col(at) / width)).join(binned, [*key, "_bin"], "left")
    covers = (F.col(at) >= F.col(start)) & (F.col(at) <= F.coalesce(F.col(end), F.lit(float("inf"))))
    return hit.groupBy(*points.columns).agg(F.max_by(F.when(covers, F.col(payload)), F.when(covers, F.col(start))).alias(payload))


def suppressed(utterances: DataFrame, reflexes: DataFrame, key: str, start: str, fired: str) -> DataFrame:
    """Utterances with the earliest reflex of their key at or after their start (null: not suppressed)."""
    left = utterances.select("*", F.col(start).alias("_t"), F.lit(None).cast("double").alias("_fired"))
    right = reflexes.select(key, F.col(fired).cast("double").alias("_t"), F.col(fired).cast("double").alias("_fired"))
    both = left.unionByName(right, allowMissingColumns=True)
    # a look-ahead minimum over each key's merged time line: one shuffle, no pairs
    ahead = Window.partitionBy(key).orderBy(F.desc("_t"), F.col("_fired").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("reflex", F.min("_fired").over(ahead)).where(F.col(start).isNotNull() & F.col("_fired").isNull()).drop("_t", "_fired")


def closest_pair(df: DataFrame, name: str, family: str, size: str) -> DataFrame:
    """The two members of different families with the least relative gap in size.

    In size order the best partner of a row is the last row of another family before it. Ranges of
    size are scanned each by itself; across ranges only each one's first row, last row and last
    row of another family than that can be partners, so those few are scanned once more.
    """
    own = F.struct(F.col(size).alias("v"), F.col(name).alias("n"), F.col(family).alias("f"))
    # where ranges are cut is decided by a sample, so it is decided once
    parts = stored(df.select(own.alias("x")).repartitionByRange("x").select("x", F.spark_partition_id().alias("part")), "sizes")

    def pairs(rows: DataFrame, within: list) -> DataFrame:
        order = Window.partitionBy(*within).orderBy("x")
        before = F.lag("x").over(order)
        # the row before, if its family differs; carried on over rows of one family
        other = F.when(before["f"] != F.col("x.f"), before)
        carried = F.last("other", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        found = rows.withColumn("other", other).withColumn("other", carried).where("other is not null")
        return found.select(F.col("other.n").alias("a"), F.col("x.n").alias("b"), ((F.col("x.v") - F.col("other.v")) / F.col("x.v")).alias("gap"))

    ends = parts.groupBy("part").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    last_other = parts.join(F.broadcast(ends), "part").where(F.col("x.f") != F.col("last.f")).groupBy("part").agg(F.max("x").alias("x"))
    edges = ends.select("first").unionByName(ends.select(F.col("last").alias("first"))).unionByName(last_other.select(F.col("x").alias("first"))).select(F.col("first").alias("x")).distinct()
    return pairs(parts, ["part"]).unionByName(pairs(edges, [F.lit(0)])).orderBy("gap", "a", "b").limit(1)


def unordered_pairs(df: DataFrame, name: str) -> DataFrame:
    """Two-member subsets of a dimension; for relations whose size is known to be small."""
    return df.select(F.col(name).alias("a")).join(df.select(F.col(name).alias("b")), F.col("a") < F.col("b"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and old ones whose key no new row has."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def lost_keys(old: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that a merge has lost; must be empty."""
    return old.select(*keys).distinct().join(merged.select(*keys).distinct(), keys, "left_anti")


def shared_members(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    return a.select(column).intersect(b.select(column))


def straddling(df: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that occur in more than one split."""
    return df.groupBy(group).agg(F.countDistinct(split).alias("n_splits")).where("n_splits > 1")


def latest_by_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    row = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(row, order).alias("r")).select("r.*")


def divergence(a: Column, b: Column, context: int = 3) -> Column:
    """struct(at, ours, theirs): the first position (from 0) where two arrays differ, and what stands there; null if they are equal."""
    n = F.greatest(F.size(a), F.size(b))
    at = F.get(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: ~F.get(a, i).eqNullSafe(F.get(b, i))), F.lit(0))
    return F.when(at.isNotNull(), F.struct(at.alias("at"), F.slice(a, at + 1, context).alias("ours"), F.slice(b, at + 1, context).alias("theirs")))
