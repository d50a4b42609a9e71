"""Latency trials: wide to long, nearest-rank percentiles, budgets, checks over ordered conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import budget_verdict
from .ranks import beside, order_statistics


def long_form(df: DataFrame, keys: list[str], measures: list[str], name: str = "stage", value: str = "value") -> DataFrame:
    """One row a measure; blanks (null) are left out."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(keys, measures, name, value).where(F.col(value).isNotNull())


def percentiles(df: DataFrame, keys: list[str], value: str = "value", points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Count, nearest-rank percentiles and greatest value of each group."""
    return beside(df.groupBy(*keys).agg(F.count(value).alias("n"), F.max(value).alias("highest")), order_statistics(df, keys, value, {f"p{p}": (p / 100, False) for p in points}), keys)


def against_budget(df: DataFrame, budgets: dict[str, float], name: str) -> DataFrame:
    """percentiles() with budget and verdict."""
    table = F.create_map(*[F.lit(x) for kv in budgets.items() for x in kv]) if budgets else F.lit(None).cast("map<string,double>")
    out = df.withColumn("budget", F.try_element_at(table, F.col(name)).cast("double"))
    return out.withColumn("verdict", budget_verdict(F.col("p95"), F.col("budget"), F.col("n")))


def headroom(cooled: DataFrame, hot: DataFrame, key: str, value: str) -> DataFrame:
    """Change of a value between two runs, in percent of the first."""
    b = hot.select(key, F.col(value).alias("hot"))
    return cooled.select(key, F.col(value).alias("cooled")).join(b, key).withColumn("change", F.try_divide(100.0 * (F.col("hot") - F.col("cooled")), F.col("cooled")))


def contiguous(df: DataFrame, order: str, ok: Column, *keys: str) -> DataFrame:
    """Rows before the first one that fails, in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_ok", F.bool_and(ok).over(w)).where("_ok").drop("_ok")


def highest_threshold(scores: DataFrame, group: str, score: str, thresholds: list[float], most_missed: float) -> DataFrame:
    """The highest threshold at which no group misses more than a share. Each score is binned once to the thresholds it reaches, so rows aren't multiplied by them."""
    levels = F.array(*[F.lit(float(t)) for t in sorted(thresholds)])
    reached = F.size(F.filter(levels, lambda t: F.col(score) >= t))
    binned = scores.groupBy(group, reached.alias("reached")).agg(F.count("*").alias("n"))
    totals = binned.groupBy(group).agg(F.sum("n").alias("total"))
    steps = binned.join(totals, group).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(len(thresholds)))))
    missed = steps.groupBy(group, "i").agg((F.sum(F.when(F.col("reached") < F.col("i"), F.col("n")).otherwise(0)) / F.max("total")).alias("missed"))
    return missed.groupBy("i").agg(F.max("missed").alias("worst")).where(F.col("worst") <= most_missed).agg(F.max(F.element_at(levels, F.col("i"))).alias("threshold"))


def last_gain(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The last value of a key less the one before; null for a single one. Each task sends on a key's last two rows."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    two = df.select(key, order, value).withColumn("_r", place).where("_r <= 2")
    at = lambda k: F.max(F.when(F.col("_r") == k, F.col(value)))
    return two.groupBy(key).agg((at(1) - at(2)).alias("gain"))
