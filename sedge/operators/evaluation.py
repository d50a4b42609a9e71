"""Grids, taxonomies, tests between groups and report relations over scored predictions and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import formats, stats
from .metrics import share_of
from .ranks import beside, order_statistics
from .trials import long_form

SAFE = ("unknown", "hover")


# ---------------------------------------------------------------- who failed, and how


def failure_origin(dispatched: Column, raw: Column) -> Column:
    """Which mechanism made a failure safe: the model declined, the model asked to hover, or the validator fell back; null for an actionable one."""
    emitted = F.get_json_object(raw, "$.intent")
    return F.when(dispatched == "unknown", "model_unknown").when((dispatched == "hover") & (emitted == "hover"), "model_hover").when(dispatched == "hover", "validator_fallback")


def abstention_grid(predictions: DataFrame, keys: list[str], out_of_domain: Column) -> DataFrame:
    """Per configuration: errors, safe ones by origin, unknowns volunteered on real commands; rates are null where nothing stands below the line.

    predictions: keys, gold_intent, dispatched, raw, correct. The rate of false commands is given
    where out_of_domain (over the keys) holds.
    """
    wrong = ~F.col("correct")
    origin = failure_origin(F.col("dispatched"), F.col("raw"))
    safe = F.col("dispatched").isin(*SAFE)
    g = predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(wrong).alias("errors"), F.count_if(wrong & safe).alias("safe_failures"), share_of(safe, wrong).alias("safe_failure_rate"),
        *[F.count_if(wrong & (origin == o)).alias(f"safe_{o}") for o in ("model_unknown", "model_hover", "validator_fallback")],
        F.count_if((F.col("gold_intent") != "unknown") & (F.col("dispatched") == "unknown")).alias("volunteered_unknown"),
        F.avg((F.col("dispatched") != "unknown").cast("double")).alias("_false"),
    )
    return g.withColumn("false_command_rate", F.when(out_of_domain, F.col("_false"))).drop("_false")


#: What an error would have done.
ERROR_CLASSES = ("right intent, wrong parameters", "wrong intent, still actionable", "resolved to a safe action")


def error_taxonomy(predictions: DataFrame) -> DataFrame:
    """class, n over the errors: each is in one class; sign flips of the yaw (gold is minus the prediction) are counted apart, and all errors.

    predictions: correct, dispatched, gold_intent, gold, predicted (JSON; null if unreadable).
    """
    same = F.get_json_object("predicted", "$.intent").eqNullSafe(F.col("gold_intent"))
    kind = F.when(F.col("dispatched").isin(*SAFE), ERROR_CLASSES[2]).when(same, ERROR_CLASSES[0]).otherwise(ERROR_CLASSES[1])
    yaw = lambda c: F.get_json_object(c, "$.yaw").try_cast("double")
    flip = (kind == ERROR_CLASSES[0]) & (yaw("gold") == -yaw("predicted"))
    wrong = predictions.where(~F.col("correct")).select(kind.alias("kind"), F.coalesce(flip, F.lit(False)).alias("flip"))
    counts = wrong.agg(*[F.count_if(F.col("kind") == c).alias(c) for c in ERROR_CLASSES], F.count_if("flip").alias("yaw sign flips"), F.count("*").alias("total"))
    return counts.unpivot([], counts.columns, "class", "n")


# ---------------------------------------------------------------- tests between groups


def arcsine(share: Column) -> Column:
    """The variance-stabilising transform of a share."""
    return F.asin(F.sqrt(share))


def anova_guarded(df: DataFrame, group: str, value: str) -> DataFrame:
    """f, d1, d2 and reason: the one-way analysis of variance, or why it doesn't apply. Only group moments meet in one place."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    t = g.agg(
        F.count("*").alias("k"), F.sum("n").alias("nn"), F.min("n").alias("least"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s2"),
        F.sum((F.col("n") - 1) * F.col("v")).alias("within"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bool_and(F.coalesce(F.col("lo") == F.col("hi"), F.lit(True))).alias("constant"),
    )
    reason = F.when(F.coalesce(F.col("least"), F.lit(0)) < 2, "a group has fewer than two values").when(F.col("lo") == F.col("hi"), "all values are equal").when(F.col("constant"), "every group is constant")
    d1, d2 = F.col("k") - 1, F.col("nn") - F.col("k")
    f = F.try_divide((F.col("s2") - F.col("s") * F.col("s") / F.col("nn")) / d1, F.col("within") / d2)
    return t.withColumn("reason", reason).select(F.when(F.col("reason").isNull() & (d1 > 0), f).alias("f"), d1.alias("d1"), d2.alias("d2"), "reason")


def tukey_pairs(df: DataFrame, group: str, value: str) -> DataFrame:
    """a, b, difference, q, k, dof of every two groups: Tukey and Kramer's studentised range. Pairs are of group moments, one row a group, never of rows."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v")).where("n > 0")
    pooled = g.agg(F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("dof"), F.sum((F.col("n") - 1) * F.col("v")).alias("within"))
    one = g.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("m").alias("ma"))
    two = g.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    scale = F.sqrt(F.col("within") / F.col("dof") / 2 * (1 / F.col("na") + 1 / F.col("nb")))
    return one.join(two, F.col("a") < F.col("b")).join(F.broadcast(pooled)).select("a", "b", (F.col("ma") - F.col("mb")).alias("difference"), F.try_divide(F.abs(F.col("ma") - F.col("mb")), scale).alias("q"), "k", "dof")


def tukey(df: DataFrame, group: str, value: str) -> DataFrame:
    """tukey_pairs with the p-value of each pair."""
    return tukey_pairs(df, group, value).withColumn("p", stats.range_p(F.col("q"), F.col("k"), F.col("dof")))


# ---------------------------------------------------------------- conditions


def ratio_intervals(df: DataFrame, key: str, unit: str, ratios: dict[str, tuple[Column, Column]], seed: int, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """Per key and measure: ratio of sums, and its percentile bootstrap interval under Poisson resampling of units, the same draws for all measures, so that differences are paired."""
    return stats.poisson_bootstrap(df, [key], ratios, seed, unit, resamples, confidence)


# ---------------------------------------------------------------- trials


def trial_summary(trials: DataFrame, keys: list[str], stages: list[str], points: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Per configuration: trials timed, distinct items judged, accuracy, worst memory and heat, throttled share, tokens a second, and each stage's count and percentiles; blanks don't count.

    trials: keys, item_id, correct, peak_rss_mb, temperature_c, throttled_now, tokens_predicted, slm_decode_ms, total_ms and the stages.
    """
    both = F.col("tokens_predicted").isNotNull() & F.col("slm_decode_ms").isNotNull()
    g = trials.groupBy(*keys).agg(
        F.count("total_ms").alias("n_latency"), F.countDistinct(F.when(F.col("correct").isNotNull(), F.col("item_id"))).alias("n_accuracy"), F.round(F.avg(F.col("correct").cast("double")), 6).alias("accuracy"),
        F.round(F.max("peak_rss_mb"), 2).alias("peak_rss_mb"), F.round(F.max("temperature_c"), 1).alias("max_temperature_c"), F.count_if(F.col("throttled_now") == 1).alias("throttled_trials"),
        F.sum(F.when(both, F.col("tokens_predicted"))).cast("double").alias("_tokens"), F.sum(F.when(both, F.col("slm_decode_ms") / 1000.0)).alias("_seconds"), *[F.count(s).alias(f"{s}_n") for s in (*stages, "total_ms")],
    )
    share = F.round(F.try_divide(F.col("throttled_trials").cast("double"), F.nullif(F.col("n_latency"), F.lit(0)).cast("double")), 4)
    speed = F.round(F.try_divide(F.col("_tokens"), F.nullif(F.col("_seconds"), F.lit(0.0))), 2)
    g = g.withColumn("throttled_fraction", share).withColumn("tokens_per_second", speed).drop("_tokens", "_seconds")
    long = long_form(trials, keys, [*stages, "total_ms"], "_stage", "_value")
    ranks = order_statistics(long, [*keys, "_stage"], "_value", {f"p{p}": (p / 100, False) for p in points})
    at = lambda s, p: F.round(F.max(F.when(F.col("_stage") == s, F.col(f"p{p}"))), 2).alias(f"{s}_p{p}")
    return beside(g, ranks.groupBy(*keys).agg(*[at(s, p) for s in (*stages, "total_ms") for p in points]), keys)


def segment_measures(segments: DataFrame, keys: list[str], measured: list[str], derived: dict[str, Column], done: Column) -> DataFrame:
    """Long form (measure, value) of measured and derived times; derived ones only of segments that are done."""
    wide = segments.select(*keys, *[F.col(m).cast("double").alias(m) for m in measured], *[F.when(done, c.cast("double")).alias(name) for name, c in derived.items()])
    return wide.unpivot(keys, [*measured, *derived], "measure", "value").where("value is not null")


def headroom_report(cooled: DataFrame, hot: DataFrame, key: str, value: str) -> DataFrame:
    """One row: configurations of both runs, worst and mean change in percent of the cooled run, and the configuration of the worst (ties by name)."""
    j = cooled.select(key, F.col(value).alias("a")).join(hot.select(key, F.col(value).alias("b")), key).withColumn("change", F.try_divide(100.0 * (F.col("b") - F.col("a")), F.col("a")))
    return j.agg(F.count("*").alias("n"), F.max("change").alias("worst"), F.avg("change").alias("mean"), F.max_by(F.struct(key), F.struct("change", F.xxhash64(key)))[key].alias("worst_at"))


def operating_point(curve: DataFrame, threshold: str, at: float) -> DataFrame:
    """The one row of a curve at the operating threshold; an error if there is none or more than one."""
    here = curve.where(F.col(threshold) == at)
    n = here.agg(F.count("*").alias("_n"))
    checked = F.assert_true(F.col("_n") == 1, F.concat(F.lit(f"operating threshold {at}: "), F.col("_n").cast("string"), F.lit(" rows")))
    return n.select("_n", checked.alias("_ok")).where("_ok is null").join(here, F.lit(True), "left").drop("_n", "_ok")


# ---------------------------------------------------------------- detectors


def class_misses(takes: DataFrame, truth: str, take: str, score: str, fired: str) -> DataFrame:
    """Per class: takes, share that fired, the ids of those missed in order, and the mean of the takes' best scores. takes: a row for each take and frame."""
    best = takes.groupBy(truth, take).agg(F.max(score).alias("best"), F.bool_or(fired).alias("fired"))
    missed = F.array_sort(F.collect_list(F.when(~F.col("fired"), F.col(take))))
    return best.groupBy(truth).agg(F.count("*").alias("n"), F.avg(F.col("fired").cast("double")).alias("share"), missed.alias("missed"), F.avg("best").alias("mean_best"))


def stream_rates(events: DataFrame, key: str, hours: Column) -> DataFrame:
    """Per class: events, events an hour, and the exact Poisson interval of that rate. events: a row a class with its count n."""
    return events.withColumn("ci", stats.poisson_ci(F.col("n"), hours)).select(key, "n", (F.col("n") / hours).alias("per_hour"), F.col("ci.lo").alias("lo"), F.col("ci.hi").alias("hi"))


def prompted_gap(pools: dict[str, DataFrame], bucket: str, errors: str, words: str, prompted: str, unprompted: str) -> DataFrame:
    """Per pool and bucket: items and pooled error rate; and of each bucket in both named pools the prompted rate less the unprompted one."""
    both = None
    for name, df in pools.items():
        part = df.select(F.lit(name).alias("pool"), F.col(bucket).alias("bucket"), F.col(errors).alias("e"), F.col(words).alias("w"))
        both = part if both is None else both.unionByName(part)
    rate = both.groupBy("pool", "bucket").agg(F.count("*").alias("n"), F.try_divide(F.sum("e").cast("double"), F.nullif(F.sum("w"), F.lit(0)).cast("double")).alias("rate"))
    gap = rate.groupBy("bucket").agg((F.max(F.when(F.col("pool") == prompted, F.col("rate"))) - F.max(F.when(F.col("pool") == unprompted, F.col("rate")))).alias("gap"))
    return rate.join(gap, "bucket").select("pool", "bucket", "n", "rate", F.when(F.col("pool") == prompted, F.col("gap")).alias("gap")).orderBy("pool", "bucket")


# ---------------------------------------------------------------- report relations


def accuracy_with_timing(accuracy: DataFrame, timing: DataFrame, keys: list[str], blank: Column, measure: str, timed: list[str]) -> DataFrame:
    """Accuracy rows with the timings of their configuration where it was timed; `measure` is null where blank holds (nothing to score there)."""
    return accuracy.join(timing.select(*keys, *timed), keys, "left").withColumn(measure, F.when(~blank, F.col(measure)))


def quantisation_delta(reference: DataFrame, deployed: DataFrame, tests: DataFrame, model: str, config: list[str], score: str) -> DataFrame:
    """Deployed scores beside the reference's of the same model, the difference in points, and the paired test's counts and p-value where one was made."""
    ref = reference.select(model, F.col(score).alias("reference"))
    out = deployed.select(model, *config, F.col(score).alias("deployed")).join(ref, model, "left").join(tests, [model, *config], "left")
    return out.withColumn("delta", 100.0 * (F.col("deployed") - F.col("reference"))).withColumn("delta_text", formats.signed(F.col("delta")))


def split_by_match(rows: DataFrame, measured: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their measures, rows without any): none is dropped."""
    return rows.join(measured, key, "inner"), rows.join(measured.select(key), key, "left_anti")


def indexed_tests(tests: DataFrame, family: str) -> DataFrame:
    """The tests of one family by their two names."""
    return tests.where(F.col("family") == family).drop("family")


def declared_pairs(spark, *families: tuple[str, list[str], list[str]]) -> DataFrame:
    """family, a, b: each family's configurations of the first list with those of the second, as declared; a pair with itself is none."""
    rows = [(name, a, b) for name, first, second in families for a in first for b in second if a != b]
    return spark.createDataFrame(rows, "family string, a string, b string")


def with_verdict(df: DataFrame, value: str, budget: float, floor: bool = False) -> DataFrame:
    """Ordered projection's verdict against a ceiling, or a floor; null values have none."""
    ok = F.col(value) >= budget if floor else F.col(value) <= budget
    return df.withColumn("verdict", F.when(ok, "MEETS").when(F.col(value).isNotNull(), "MISS"))


def weakest(df: DataFrame, group: str, value: str) -> DataFrame:
    """The least value over all groups with its group (ties by name): what a report quotes as the floor."""
    return df.where(F.col(value).isNotNull()).agg(F.min_by(F.struct(group, value), F.struct(value, group)).alias("r")).select("r.*")


def run_state(trials: DataFrame, temperature: str, cooled: Column) -> DataFrame:
    """One row of text: lowest and highest temperature and number of the cooled trials."""
    a = trials.where(cooled).agg(F.min(temperature).alias("lo"), F.max(temperature).alias("hi"), F.count(temperature).alias("n"))
    return a.select(F.when(F.col("n") > 0, F.format_string("%.1f to %.1f over %d trials", "lo", "hi", "n")).otherwise("--").alias("state"))


def corpus_sizes(files: DataFrame, corpus: str, size: str) -> DataFrame:
    """Per corpus: files and bytes, in order."""
    return files.groupBy(corpus).agg(F.count("*").alias("files"), F.sum(size).alias("bytes")).orderBy(corpus)


def sizes_by_split(df: DataFrame, family: str, split: str, size: str, splits: list[str]) -> DataFrame:
    """A row a family with its summed size in each split, its least and greatest member."""
    return df.groupBy(family).pivot(split, splits).agg(F.sum(size)).join(df.groupBy(family).agg(F.min(size).alias("least"), F.max(size).alias("greatest")), family)
