"""Samples, quotas and splits that depend on nothing but stable hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import stable_key
from ..sources.shared import stored


def placed(df: DataFrame, stratum: str, order: list[Column]) -> DataFrame:
    """df with `place`, a row's number in its stratum's order from 1, and `size` of the stratum.

    Rows are dealt by ranges of (stratum, order), numbered inside each range and moved on by what the
    ranges before it hold, so a stratum of any size is no one task's sort. Ranges and strata in
    them are a small relation.
    """
    keys = [F.col(stratum), *order]
    # where ranges are cut is decided by a sample, so it is decided once
    parts = stored(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "places")
    counts = parts.groupBy("_part", stratum).agg(F.count("*").alias("_m"))
    before = Window.partitionBy(stratum).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.col(stratum).alias("_s"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(stratum)).alias("size"))
    here = F.row_number().over(Window.partitionBy("_part", stratum).orderBy(*order))
    joined = parts.withColumn("_here", here).withColumnRenamed("_part", "_p").join(F.broadcast(offsets), (F.col("_p") == F.col("_part")) & F.col(stratum).eqNullSafe(F.col("_s")))
    return joined.select(*df.columns, (F.col("_here") + F.col("_before")).alias("place"), "size")


def round_robin(df: DataFrame, stratum: str, key: str, n: int, seed: int | str, salt: str = "sample", by_size: bool = True, exactly: bool = False) -> DataFrame:
    """n rows: the first of each stratum in hash order, then the second of each, and so on; small strata first (or strata by name). exactly: fewer than n rows are an error."""
    h = stable_key(seed, salt, F.col(key))
    first = Window.partitionBy(stratum).orderBy("h", key)
    # no row beyond a stratum's n-th can be chosen: cut early, so the final sort sees few
    ranked = df.withColumn("h", h).withColumn("r", F.row_number().over(first)).where(F.col("r") <= n)
    if by_size:
        sizes = df.groupBy(stratum).agg(F.count("*").alias("size"))
        ranked = ranked.join(sizes, stratum)
        order = ["r", "size", stratum]
    else:
        order = ["r", stratum]
    chosen = ranked.orderBy(*order).limit(n).select(*df.columns)
    if not exactly:
        return chosen
    enough = df.limit(n).agg(F.count("*").alias("_n")).select(F.assert_true(F.col("_n") >= n, F.lit(f"fewer than {n} rows to choose from")).alias("_ok"))
    return chosen.join(F.broadcast(enough), F.col("_ok").isNull()).drop("_ok")


def hash_order(key: Column, seed: int | str, salt: str) -> Column:
    """A column to order by for a fixed shuffle."""
    return stable_key(seed, salt, key)


def largest_remainder(weights: DataFrame, name: str, weight: str, n: int) -> DataFrame:
    """name, quota: n dealt out in proportion to weight; what rounding leaves goes to the largest remainders, ties by name. One row a name, so one small window."""
    total = Window.partitionBy(F.lit(1))
    x = F.col(weight) * n / F.sum(weight).over(total)
    rest = weights.select(F.col(name), x.alias("x"), F.floor(x).alias("base"))
    rank = F.row_number().over(total.orderBy(F.desc(F.round(F.col("x") - F.col("base"), 9)), name))
    left = F.lit(n) - F.sum("base").over(total)
    return rest.select(name, (F.col("base") + F.when(rank <= left, 1).otherwise(0)).cast("bigint").alias("quota"))


def assign_by_quota(df: DataFrame, key: str, stratum: str, shares: list[tuple[str, float]], seed: int | str, salt: str = "variant", ties: str = "name") -> DataFrame:
    """df with `assigned`: each stratum in hash order is cut into blocks of largest-remainder size, in the order of shares. Equal remainders go by `name`, or in the order `declared`."""
    total = sum(s for _, s in shares)
    names = F.array(*[F.lit(n) for n, _ in shares])
    counts = df.groupBy(stratum).agg(F.count("*").alias("_n"))
    parts = counts.select(stratum, "_n", F.posexplode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s / total).alias("share")) for n, s in shares])).alias("_i", "_s"))
    exact = F.round(F.col("_n") * F.col("_s.share"), 9)
    parts = parts.withColumn("_base", F.floor(exact)).withColumn("_rest", F.round(exact - F.col("_base"), 9))
    each = Window.partitionBy(stratum)
    left = F.col("_n") - F.sum("_base").over(each)
    ranked = parts.withColumn("_left", left).withColumn("_rank", F.row_number().over(each.orderBy(F.desc("_rest"), "_s.name" if ties == "name" else "_i")))
    sizes = ranked.groupBy(stratum).agg(F.array_sort(F.collect_list(F.struct("_i", (F.col("_base") + F.when(F.col("_rank") <= F.col("_left"), 1).otherwise(0)).alias("q")))).alias("_q"))
    # how many whole blocks end before a row's place says which block it is in
    start = F.struct(F.lit(0).cast("bigint").alias("upto"), F.lit(0).alias("before"))
    block = F.aggregate("_q", start, lambda a, x: F.struct((a["upto"] + x["q"]).alias("upto"), (a["before"] + F.when(F.col("place") > a["upto"] + x["q"], 1).otherwise(0)).alias("before")))["before"]
    rows = placed(df.withColumn("_h", stable_key(seed, salt, F.col(key))), stratum, [F.col("_h"), F.col(key)])
    return rows.join(F.broadcast(sizes), stratum).withColumn("assigned", F.get(names, block)).select(*df.columns, "assigned")


def zero_filled(df: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """Counts of every category, also of those that don't occur."""
    known = df.sparkSession.createDataFrame([(c,) for c in categories], f"{column} string")
    return known.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))
