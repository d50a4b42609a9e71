"""Evaluation of recorded runs: items of segments, keyword trials, detector traces, takes and label passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import signal
from .ranks import beside, order_statistics
from ..sources.shared import stored
from .sampling import placed

SAFE = ("unknown", "hover")
#: Causes of a failed item, in the order in which they are tried.
CAUSES = ("parser wrong on reference text", "no segment", "split by endpointer", "perfect transcript, parser wrong", "ASR error, wrong intent", "ASR error, right intent, wrong slot")


# ---------------------------------------------------------------- items of segments


def outcome(segments: Column) -> Column:
    """struct(correct, correct_last, safe, n): correct if there are segments and all are; without any, wrong but safe."""
    n = F.size(segments)
    last = F.coalesce(F.try_element_at(segments, F.lit(-1))["correct"], F.lit(False))
    return F.struct(
        ((n > 0) & F.forall(segments, lambda s: s["correct"])).alias("correct"), last.alias("correct_last"),
        F.forall(segments, lambda s: s["dispatched"].isin(*SAFE)).alias("safe"), n.alias("n"),
    )


def failure_cause(segments: Column, text_correct: Column, errors: Column, gold_intent: Column, intent: Column) -> Column:
    """Why a wrong item is wrong: the first of CAUSES that holds of it; the last one needs no evidence."""
    holds = (~text_correct, F.size(segments) == 0, F.size(segments) > 1, errors == 0, ~intent.eqNullSafe(gold_intent), F.lit(True))
    named = F.array(*[F.when(h, F.lit(cause)) for h, cause in zip(holds, CAUSES, strict=True)])
    return F.element_at(F.filter(named, lambda c: c.isNotNull()), 1)


def condition_summary(items: DataFrame, condition: str, segments: str, errors: str, words: str) -> DataFrame:
    """Per condition: items, share right, word error rate over all references, safe share of failures, segments."""
    o = items.withColumn("o", outcome(F.col(segments)))
    wrong = ~F.col("o.correct")
    return o.groupBy(condition).agg(
        F.count("*").alias("n"), F.avg(F.col("o.correct").cast("double")).alias("right"), F.avg(F.col("o.correct_last").cast("double")).alias("right_last"),
        F.try_divide(F.sum(errors).cast("double"), F.nullif(F.sum(words), F.lit(0))).alias("error_rate"),
        F.try_divide(F.count_if(wrong & F.col("o.safe")).cast("double"), F.nullif(F.count_if(wrong), F.lit(0))).alias("safe_failures"), F.sum("o.n").alias("n_segments"),
    )


def stage_sums(items: DataFrame, segments: str, stages: list[str], host: str, target: str) -> DataFrame:
    """p50 and p95 of summed stages; null unless every item comes from the target host."""
    flat = items.select(F.lit(0).alias("all"), F.col(host).alias("host"), F.explode(segments).alias("s")).select("all", "host", sum((F.col(f"s.{c}") for c in stages[1:]), F.col(f"s.{stages[0]}")).alias("total"))
    a = beside(flat.groupBy("all").agg(F.bool_and(F.coalesce(F.col("host") == target, F.lit(False))).alias("all_target"), F.count("total").alias("n")), order_statistics(flat, ["all"], "total", {"p50": (0.5, False), "p95": (0.95, False)}), ["all"])
    return a.select("n", *[F.when(F.col("all_target"), F.col(p)).alias(p) for p in ("p50", "p95")])


# ---------------------------------------------------------------- keyword trials


def own_event(events: Column, intent: Column) -> Column:
    """The first event of the trial's own class."""
    return F.try_element_at(F.filter(events, lambda e: e["intent"] == intent), F.lit(1))


def cross_trigger(trials: DataFrame, truth: str, events: str, intents: list[str]) -> DataFrame:
    """Per class: trials, those that fired each intent (once a trial, however often it fired), and misses of the own one."""

    def fires(intent: str) -> Column:
        return F.exists(events, lambda e: e["intent"] == intent)

    fired = [F.count_if(fires(i)).alias(f"fired_{i}") for i in intents]
    return trials.groupBy(truth).agg(F.count("*").alias("n"), *fired, F.count_if(own_event(F.col(events), F.col(truth)).isNull()).alias("missed"))


def keyword_measures(trials: DataFrame, keys: list[str], truth: str, events: str, offset: str, frame_s: float = 0.08) -> DataFrame:
    """Long form (measure, value) of detected trials: latency, its algorithmic and system parts, and recovery over aborted ones."""
    e = trials.withColumn("e", own_event(F.col(events), F.col(truth))).where("e is not null")
    algorithmic = ((F.col("e.frame_index") + 1) * frame_s - F.col(offset)) * 1000
    recovery = F.when(F.col("e.in_flight") & F.col("e.aborted") & F.col("e.server_idle_ms").isNotNull(), F.greatest("e.abort_return_ms", "e.server_idle_ms"))
    wide = e.select(*keys, F.col("e.latency_offset_ms").alias("offset"), algorithmic.alias("algorithmic"), (F.col("e.latency_offset_ms") - algorithmic).alias("system"), recovery.alias("recovery"))
    return wide.unpivot(keys, ["offset", "algorithmic", "system", "recovery"], "measure", "value").where("value is not null")


# ---------------------------------------------------------------- detector traces


def first_above(trace: Column, threshold: float) -> Column:
    """Index (from 0) of the first score at threshold; null if none is."""
    return F.array_min(F.transform(F.arrays_zip(trace.alias("v"), F.sequence(F.lit(0), F.size(trace) - 1).alias("i")), lambda x: F.when(x["v"] >= threshold, x["i"])))


def trace_scores(traces: DataFrame, label: str, trace: str, end_s: str, threshold: float, frame_s: float = 0.08) -> DataFrame:
    """Per class: traces, miss rate and mean delay from the keyword's end."""
    at = traces.where(F.size(trace) > 0).withColumn("at", first_above(F.col(trace), threshold))
    return at.groupBy(label).agg(F.count("*").alias("n"), F.avg(F.col("at").isNull().cast("double")).alias("missed"), F.avg((F.col("at") + 1) * frame_s - F.col(end_s)).alias("delay_s"))


def keyword_spans(clips: DataFrame) -> DataFrame:
    """path, onset, end, exact of clips (path, label, voice, base, length_scale, onset, exact_length or null): bases of known length are exact, others get their class and voice's median ratio of length to scale."""
    known = clips.where("exact_length is not null").groupBy("base").agg(F.min("exact_length").alias("length"))
    joined = clips.join(known, "base", "left")
    ratio = joined.where("length is not null").groupBy("label", "voice").agg(F.median(F.col("length") / F.col("length_scale")).alias("ratio"))
    length = F.coalesce("length", F.col("ratio") * F.col("length_scale"))
    return joined.join(ratio, ["label", "voice"], "left").select("path", "onset", (F.col("onset") + length).alias("end"), F.col("length").isNotNull().alias("exact"))


def fit_residual(clips: DataFrame) -> DataFrame:
    """The worst error of the ratio fit over clips whose length is known."""
    known = clips.where("exact_length is not null").groupBy("base").agg(F.min("exact_length").alias("length"))
    all_known = clips.join(known, "base")
    ratio = all_known.groupBy("label", "voice").agg(F.median(F.col("length") / F.col("length_scale")).alias("ratio"))
    return all_known.join(ratio, ["label", "voice"]).agg(F.max(F.abs(F.col("length") - F.col("ratio") * F.col("length_scale"))).alias("worst"))


# ---------------------------------------------------------------- takes


def frame_levels(samples: Column, width: int) -> Column:
    return F.transform(signal.frames(samples, width), signal.rms)


def noise_floor(takes: DataFrame, key: str, samples: str, width: int) -> DataFrame:
    """20th (interpolated) percentile of frame levels after the mean is removed; the whole level of a take of fewer than four frames."""
    c = takes.select(key, signal.centred(F.col(samples)).alias("x")).withColumn("levels", frame_levels(F.col("x"), width))
    flat = c.select(key, F.explode_outer("levels").alias("v"), F.size("levels").alias("n"), signal.rms(F.col("x")).alias("whole"))
    g = flat.groupBy(key).agg(F.percentile("v", F.lit(0.2)).alias("p"), F.max("n").alias("n"), F.max("whole").alias("whole"))
    return g.select(key, F.when(F.col("n") < 4, F.col("whole")).otherwise(F.col("p")).alias("floor"))


def speech_bounds(levels: Column, floor: Column, frame_s: float) -> Column:
    """struct(lead, tail): seconds before the first and after the last frame at or above max(4 floor, 5 % of the loudest); zeros if none is."""
    threshold = F.greatest(floor * 4, F.array_max(levels) * 0.05)
    active = F.filter(F.transform(levels, lambda v, i: F.when(v >= threshold, i)), lambda i: i.isNotNull())
    lead, tail = F.array_min(active) * frame_s, (F.size(levels) - 1 - F.array_max(active)) * frame_s
    return F.struct(F.coalesce(lead, F.lit(0.0)).alias("lead"), F.coalesce(tail, F.lit(0.0)).alias("tail"))


def take_report(takes: DataFrame, key: str, samples: str, rate: int, floor: Column, least_s: float = 0.5, least_db: float = 6.0, good_db: float = 15.0, margin_s: float = 0.2, clip: float = 0.999, most_clipped: int = 0) -> DataFrame:
    """Measures of each take with the failures and warnings they give."""
    width, frame_s = rate // 50, (rate // 50) / rate
    # a generator of one row keeps what it makes from being worked out again inside each later lambda
    once = lambda df, **made: df.select(*df.columns, F.inline(F.array(F.struct(*[v.alias(k) for k, v in made.items()]))))
    x = once(takes.select(key, F.col(samples).alias("raw"), floor.alias("floor")), x=signal.centred(F.col("raw")))
    x = once(x, levels=frame_levels(F.col("x"), width))
    x = once(x, threshold=F.greatest(F.col("floor") * 4, F.array_max("levels") * 0.05))
    loud = F.filter("levels", lambda v: v >= F.col("threshold"))
    active = F.sqrt(F.try_divide(F.aggregate(loud, F.lit(0.0), lambda a, v: a + v * v), F.nullif(F.size(loud), F.lit(0)).cast("double")))
    m = x.select(
        key, (F.size("raw") / rate).alias("seconds"), signal.dbfs(F.array_max(F.transform("x", lambda v: F.abs(v)))).alias("peak_dbfs"), F.coalesce(active, F.lit(0.0)).alias("active"),
        F.size(F.filter("raw", lambda v: F.abs(v) >= clip)).alias("clipped"), speech_bounds(F.col("levels"), F.col("floor"), frame_s).alias("b"), "floor",
    ).withColumn("snr_db", signal.dbfs(F.col("active")) - signal.dbfs(F.col("floor")))
    named = lambda *pairs: F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in pairs]), lambda v: v.isNotNull())
    failures = named(("too short", F.col("seconds") < least_s), ("clipped", F.col("clipped") > most_clipped), ("silence", F.col("active") <= 0), ("level too low", (F.col("active") > 0) & (F.col("snr_db") < least_db)))
    warnings = named(("close to the floor", (F.col("snr_db") >= least_db) & (F.col("snr_db") < good_db)), ("short lead", F.col("b.lead") < margin_s), ("short tail", F.col("b.tail") < margin_s))
    return m.select(key, "seconds", "peak_dbfs", signal.dbfs(F.col("active")).alias("active_dbfs"), "snr_db", "clipped", F.col("b.lead").alias("lead"), F.col("b.tail").alias("tail"), failures.alias("failures"), warnings.alias("warnings"))


def live_status(peak_dbfs: Column, floor_dbfs: Column, clipped: Column, quiet_db: float = 6.0, good_db: float = 15.0) -> Column:
    over = peak_dbfs - floor_dbfs
    return F.when(clipped > 0, "CLIP").when(over < quiet_db, "quiet").when(over < good_db, "low").otherwise("OK")


# ---------------------------------------------------------------- label passes, manifests, ordered lists


def agreement(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """n, label equality, intent agreement (from raw) and slot F1 (sets `pairs`) of two passes."""
    j = a.select(key, F.col("label").alias("l1"), F.col("raw").alias("r1"), F.col("pairs").alias("p1")).join(b.select(key, F.col("label").alias("l2"), F.col("raw").alias("r2"), F.col("pairs").alias("p2")), key)
    intent = lambda c: F.get_json_object(c, "$.intent")
    total = F.sum(F.size("p1") + F.size("p2"))
    return j.agg(F.count("*").alias("n"), F.avg((F.col("l1") == F.col("l2")).cast("double")).alias("exact"), F.avg(intent("r1").eqNullSafe(intent("r2")).cast("double")).alias("intent"), F.try_divide(2.0 * F.sum(F.size(F.array_intersect("p1", "p2"))), F.nullif(total, F.lit(0)).cast("double")).alias("slot_f1"))


def gap_days(sealed: Column, labelled: Column) -> Column:
    """Days between two moments, two decimals."""
    return F.round((F.unix_micros(labelled) - F.unix_micros(sealed)) / 86400e6, 2)


def nested_counts(df: DataFrame, key: str, inner: list[str], amount: str) -> DataFrame:
    """Per key: rows, summed amount and a map of counts for each inner column."""
    out = df.groupBy(key).agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))
    for c in inner:
        counts = df.groupBy(key, c).agg(F.count("*").alias("m")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "m")))).alias(f"by_{c}"))
        out = out.join(counts, key)
    return out


def distinct_then_fill(rows: DataFrame, fallback: DataFrame, text: str, order: str, size: int) -> DataFrame:
    """text, provenance: distinct texts in order, topped up from a fallback list to a size."""
    both = rows.select(text, F.lit(0).alias("_s"), F.col(order).alias("_o")).unionByName(fallback.select(text, F.lit(1).alias("_s"), F.col(order).alias("_o")))
    first = both.groupBy(text).agg(F.min(F.struct("_s", "_o")).alias("p"))
    return first.orderBy("p").limit(size).select(text, F.when(F.col("p._s") == 0, "harvested").otherwise("fallback").alias("provenance"))


def concatenated(df: DataFrame, key: str, order: str, samples: str) -> DataFrame:
    """The arrays of each key in order, end to end."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(samples).alias("s")))), lambda x: x["s"])
    return df.groupBy(key).agg(F.flatten(parts).alias(samples))


def by_fold(bank: DataFrame, key: str, order: str, share: float) -> DataFrame:
    """bank with `part`: the first share of each key's recordings train, the rest evaluate, so that none does both."""
    return placed(bank, key, [F.col(order)]).withColumn("part", F.when(F.col("place") <= F.floor(F.col("size") * share + 1e-9), "train").otherwise("eval")).drop("place", "size")


def spoken_ids(ids: Column) -> Column:
    """Drone numbers as they are said, counted from one."""
    return F.array_join(F.transform(ids, lambda i: (i + 1).cast("string")), " and ")


def draw_noise(items: DataFrame, bank: DataFrame, key: str, length: str, corpus: str, recording: str, samples: str, seed: int, silence: float = 1e-4, most: int = 24) -> DataFrame:
    """items with `recording` and `noise`, an excerpt of as many samples as the item has.

    The item's key draws a corpus, then a recording of it, so corpora are heard alike however many
    recordings they have, then a place; short recordings are repeated. Silent excerpts are drawn
    again, `most` times at most, then the item is an error. Each round is a join on the drawn number,
    and only items that are still without noise go on.
    """
    names = bank.groupBy(corpus).agg(F.count("*").alias("_size")).withColumn("_c", F.row_number().over(Window.orderBy(corpus)) - 1)
    numbered = placed(bank, corpus, [F.col(recording)]).join(F.broadcast(names), corpus).select("_c", (F.col("place") - 1).alias("_k"), F.col(recording).alias("recording"), F.col(samples).alias("_x"))
    corpora = [(r["_c"], r["_size"]) for r in names.collect()]  # one row a corpus
    sizes = F.create_map(*[F.lit(v) for c, n in corpora for v in (int(c), int(n))])
    pending, done = items, None
    for attempt in range(most):
        unit = lambda what: F.pmod(F.xxhash64(F.lit(seed), F.lit(attempt), F.lit(what), F.col(key)), F.lit(1 << 52)) / float(1 << 52)  # noqa: B023, E731
        drawn = pending.withColumn("_c", F.floor(unit("corpus") * len(corpora)).cast("int"))
        drawn = drawn.withColumn("_k", F.floor(unit("recording") * F.element_at(sizes, F.col("_c"))).cast("int")).join(numbered, ["_c", "_k"])
        reach = F.greatest(F.size("_x") - F.col(length), F.lit(0)) + 1
        cut = drawn.withColumn("noise", signal.tiled(F.col("_x"), F.floor(unit("place") * reach), F.col(length))).drop("_c", "_k", "_x")
        judged = stored(cut.withColumn("_ok", signal.rms(F.col("noise")) >= silence), "noise")
        good = judged.where("_ok").drop("_ok")
        done = good if done is None else done.unionByName(good)
        pending = judged.where(~F.coalesce("_ok", F.lit(False))).select(*items.columns)
        if pending.isEmpty():
            return done
    raise ValueError(f"no sound in {most} draws for some items")
