"""Scores of predictions: exact match, F1, safety, word error rate, agreement, contingency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .ranks import beside, order_statistics


def rate(condition: Column) -> Column:
    """Share of rows where condition holds; null for no rows."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def share_of(part: Column, whole: Column) -> Column:
    """Rows with both over rows with whole; null without the latter."""
    return F.try_divide(F.count_if(part & whole).cast("double"), F.nullif(F.count_if(whole), F.lit(0)))


def summary(df: DataFrame, *keys: str) -> DataFrame:
    """Scores of predictions (correct, dispatched, parsed_ok) a group; null where a share has no base."""
    safe = F.col("dispatched").isin("unknown", "hover")
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        rate(F.col("correct")).alias("exact_match"),
        share_of(safe, ~F.col("correct")).alias("safe_failure_rate"),
        rate(F.col("dispatched") != "unknown").alias("false_command_rate"),
        rate(F.col("parsed_ok")).alias("schema_validity"),
    )


def confusion(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return df.groupBy(gold, predicted).agg(F.count("*").alias("n"))


def class_scores(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """tp, fp, fn and F1 of each class that occurs in gold; 0 over 0 counts as 0. From the confusion counts, so rows are shuffled once, pre-aggregated."""
    cells = confusion(df, gold, predicted)
    by_gold = cells.groupBy(F.col(gold).alias("class")).agg(F.sum(F.when(F.col(gold) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"), F.sum("n").alias("support"))
    by_predicted = cells.groupBy(F.col(predicted).alias("class")).agg(F.sum("n").alias("predicted"))
    joined = by_gold.join(by_predicted, "class", "left").withColumn("predicted", F.coalesce("predicted", F.lit(0)))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), (F.col("support") + F.col("predicted")).cast("double")), F.lit(0.0))
    return joined.select("class", "tp", (F.col("predicted") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"), f1.alias("f1"))


def macro_f1(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    return class_scores(df, gold, predicted).agg(F.avg("f1").alias("macro_f1"))


def micro_f1(df: DataFrame, gold: str, predicted: str, *keys: str) -> DataFrame:
    """F1 over the members of two sets summed over rows; null where there are no members at all."""
    shared = F.sum(F.size(F.array_intersect(gold, predicted)))
    total = F.sum(F.size(F.array_distinct(gold)) + F.size(F.array_distinct(predicted)))
    return df.groupBy(*keys).agg(F.try_divide(2.0 * shared, total.cast("double")).alias("micro_f1"))


def pooled_rate(df: DataFrame, errors: str, words: str, *keys: str) -> DataFrame:
    """Sum of errors over sum of words, rows without words left out; never a mean of rates."""
    return df.where(F.col(words) > 0).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(errors).alias("errors"), F.sum(words).alias("words"), F.try_divide(F.sum(errors).cast("double"), F.sum(words).cast("double")).alias("rate"))


def weighted_pool(df: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    """Group rates pooled by their number of items."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight).cast("double")).alias("pooled"))


def contingency(df: DataFrame, first: str, second: str, *keys: str) -> DataFrame:
    """a, b, c, d: both, first only, second only, neither."""
    x, y = F.col(first), F.col(second)
    return df.groupBy(*keys).agg(F.count_if(x & y).alias("a"), F.count_if(x & ~y).alias("b"), F.count_if(~x & y).alias("c"), F.count_if(~x & ~y).alias("d"))


def cochran_q(df: DataFrame, columns: list[str]) -> DataFrame:
    """q, dof of 0/1 columns over items: closed form of column and row sums, so one pass with a partial aggregate."""
    k = len(columns)
    row = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    sums = df.agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], F.sum(row).alias("t"), F.sum(row * row).alias("t2"))
    squares = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(k)), F.lit(0))
    top = (k - 1) * (k * squares - F.col("t") * F.col("t"))
    bottom = k * F.col("t") - F.col("t2")
    return sums.select(F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top.cast("double"), bottom.cast("double"))).alias("q"), F.lit(k - 1).alias("dof"))


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F with its degrees of freedom; null where a group has fewer than two rows or nothing varies within groups."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    total = g.agg(F.count("*").alias("k"), F.sum("n").alias("nn"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.min("n").alias("least"))
    between = F.col("s2") - F.col("s") * F.col("s") / F.col("nn")
    d1, d2 = F.col("k") - 1, F.col("nn") - F.col("k")
    f = F.when((F.col("least") < 2) | (F.col("within") <= 0) | (d1 < 1), F.lit(None)).otherwise(F.try_divide(between / d1, F.col("within") / d2))
    return total.select(f.alias("f"), d1.alias("d1"), d2.alias("d2"))


def group_moments(df: DataFrame, group: str, value: str, threshold: float) -> DataFrame:
    """Mean, sample deviation (0 for one row), extremes, median, quartiles and the count above a threshold."""
    moments = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count_if(F.col(value) >= threshold).alias("n_above"),
    )
    return beside(moments, order_statistics(df, [group], value, {"median": (0.5, True), "q1": (0.25, True), "q3": (0.75, True)}), [group])


def position(df: DataFrame, name: str, value: str, own: str) -> DataFrame:
    """Of one member among the others: how many are worse (greater) and better, and the percentile of better ones."""
    mine = df.where(F.col(name) == own).select(F.col(value).alias("mine"))
    return df.where(F.col(name) != own).join(F.broadcast(mine.limit(1))).agg(
        F.count_if(F.col(value) > F.col("mine")).alias("worse"), F.count_if(F.col(value) < F.col("mine")).alias("better"),
        F.try_divide(100.0 * F.count_if(F.col(value) < F.col("mine")), F.count("*").cast("double")).alias("percentile"),
    )


def bootstrap(df: DataFrame, group: str, numerator: str, denominator: str, seed: int, unit: str, resamples: int = 10_000) -> DataFrame:
    """group, ratio, lo, hi: a group's ratio of sums with a seeded percentile interval over Poisson resamples; tasks send sums, never rows."""
    rows = df.withColumn(group, F.col(group).cast("string"))
    return stats.poisson_bootstrap(rows, [group], {"ratio": (F.col(numerator), F.col(denominator))}, seed, unit, resamples).drop("measure", "n")
