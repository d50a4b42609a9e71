"""Exact order statistics of groups of any size, without a group in one task.

Groups of up to `small` rows are sorted where they stand. For larger ones the range that holds a rank is
cut into BUCKETS parts, of equal width and of equal ratio by turns, tasks send counts, least and greatest value of each part, the part that
holds the rank becomes the new range, from its least to its greatest value, and so on until a range is
one value or holds few enough rows to be sorted. All groups and ranks go through one pass
together; a pass sends BUCKETS rows a range at most, and no pass sees a range that is done.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

SMALL = 100_000
BUCKETS = 1024


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys], F.lit(True))


def _joined(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a and what b has besides keys, where the keys are equal or both null."""
    rest = [c for c in b.columns if c not in keys]
    return a.alias("a").join(b.alias("b"), _same("a", "b", keys)).select("a.*", *[f"b.{c}" for c in rest])


def _small(rows: DataFrame, keys: list[str], points: dict[str, tuple[float, bool]]) -> DataFrame:
    """Order statistics of groups whose rows are few."""
    made = [F.percentile("v", F.lit(p)).alias(name) if between else F.expr(f"percentile_disc({p}) within group (order by v)").alias(name) for name, (p, between) in points.items()]
    return rows.groupBy(*keys).agg(*made)


def _bucket(v: Column, lo: Column, hi: Column, by_size: bool) -> Column:
    """The part of the range that holds v: equal parts, or parts of equal ratio. The ends have parts of their own, so each pass takes them off; halves keep wide ranges finite."""
    # any scale does that never falls as v grows; this one gives every power of two the same room
    scaled = lambda x: F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * (750 + F.log(F.abs(x)))) if by_size else x / 2
    share = (scaled(v) - scaled(lo)) / (scaled(hi) - scaled(lo))
    inner = F.least(F.greatest(F.floor(F.nanvl(share, F.lit(0.0)) * (BUCKETS - 2)), F.lit(0)), F.lit(BUCKETS - 3))
    return F.when(v == lo, F.lit(0)).when(v == hi, F.lit(BUCKETS - 1)).otherwise(inner + 1).cast("int")


def select_ranks(rows: DataFrame, keys: list[str], wanted: DataFrame, small: int = SMALL) -> DataFrame:
    """keys, r, v: the r-th smallest v of each group, for wanted (keys, r, lo, hi: the group's least and greatest v)."""
    open_ = stored(wanted.select(*keys, "r", "lo", "hi", F.lit(0).cast("bigint").alias("below"), F.lit(None).cast("bigint").alias("held")), "ranks")
    found = open_.where("lo = hi").select(*keys, "r", F.col("lo").alias("v"))
    open_ = open_.where("lo <> hi")
    spot = [*keys, "lo", "hi", "below"]
    for turn in count():
        many = open_.where(f"held is null or held > {small}")
        if not many.limit(1).count():
            break
        ranges = many.select(*spot).distinct()
        inside = _joined(rows, ranges, keys).where("v >= lo and v <= hi")
        parts = inside.groupBy(*spot, _bucket(F.col("v"), F.col("lo"), F.col("hi"), turn % 2 == 1).alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.sum("n").over(Window.partitionBy(*spot).orderBy("part"))
        parts = parts.withColumn("upto", F.col("below") + upto)
        narrowed = _joined(many.select(*spot, "r"), parts, spot).where("r <= upto and r > upto - n")
        few = open_.where(f"held <= {small}")
        after = stored(narrowed.select(*keys, "r", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("upto") - F.col("n")).alias("below"), F.col("n").alias("held")).unionByName(few), "ranks")
        found = found.unionByName(after.where("lo = hi").select(*keys, "r", F.col("lo").alias("v")))
        open_ = after.where("lo <> hi")
    ranges = open_.select(*spot).distinct()
    place = F.row_number().over(Window.partitionBy(*spot).orderBy("v")) + F.col("below")
    placed = _joined(rows, ranges, keys).where("v >= lo and v <= hi").withColumn("place", place)
    last = _joined(open_.select(*spot, "r"), placed, spot).where("place = r").select(*keys, "r", "v")
    return found.unionByName(last)


def order_statistics(df: DataFrame, keys: list[str], value: str, points: dict[str, tuple[float, bool]], small: int = SMALL) -> DataFrame:
    """keys and one column a point (name: share p, whether to interpolate) for each group with a value that isn't null.

    Without interpolation the nearest rank ceil(p n), at least 1, a member; with it the value p (n - 1) of the
    way, from its two neighbours. Not a number comes last, as in Spark's order.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("v"))
    sizes = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "sizes")
    if not sizes.where(F.col("n") > small).limit(1).count():
        return _small(rows, keys, points)
    ranked = {name: (F.lit(p) * (F.col("n") - 1), None) if between else (None, F.greatest(F.ceil(F.round(F.lit(p) * F.col("n"), 9)), F.lit(1))) for name, (p, between) in points.items()}
    of = lambda h, r: (F.floor(h) + 1, F.ceil(h) + 1) if r is None else (r, r)
    want = sizes.where(F.col("n") > small).select(*keys, "n", "lo", "hi", F.explode(F.array_distinct(F.array(*[x.cast("bigint") for h, r in ranked.values() for x in of(h, r)]))).alias("r"))
    large = sizes.where(F.col("n") > small).select(*keys, "n")
    values = select_ranks(_joined(rows, large, keys), keys, want, small)
    by_rank = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("at"))  # a group's few ranks
    at = lambda r: F.element_at("at", r.cast("bigint"))
    made = [at(r).alias(name) if r is not None else (at(F.floor(h) + 1) + (h - F.floor(h)) * (at(F.ceil(h) + 1) - at(F.floor(h) + 1))).alias(name) for name, (h, r) in ranked.items()]
    big = _joined(large, by_rank, keys).select(*keys, *made)
    few = sizes.where(F.col("n") <= small).select(*keys)
    return _small(_joined(rows, few, keys), keys, points).unionByName(big)


def beside(groups: DataFrame, more: DataFrame, keys: list[str]) -> DataFrame:
    """groups with the other columns of more, null where it lacks the group; without keys, one row each."""
    rest = [c for c in more.columns if c not in keys]
    return groups.alias("a").join(more.alias("b"), _same("a", "b", keys), "left").select("a.*", *[f"b.{c}" for c in rest])
