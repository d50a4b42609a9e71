"""Ordered computations in batch: debounce, high-water mark, state folds, endpointing, first events.

A key's rows are put in order by a window or folded as one sorted array, and the streaming
operators give the same results row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.command import outcome, step_state


def debounced(df: DataFrame, keys: list[str], index: str, score: str, threshold: float, gap: float) -> DataFrame:
    """Rows that fire: at or above threshold, and the key's row before it that was is more than gap back (or there is none)."""
    above = df.where(F.col(score) >= threshold)
    before = F.lag(index).over(Window.partitionBy(*keys).orderBy(index))
    return above.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(index) - F.col("_before") > gap)).drop("_before")


def event_counts(df: DataFrame, keys: list[str], index: str, score: str, threshold: float, gap: float) -> DataFrame:
    return debounced(df, keys, index, score, threshold, gap).groupBy(*keys).agg(F.count("*").alias("n_events"))


def high_water(df: DataFrame, keys: list[str], arrival: str, seq: str, branch: str) -> DataFrame:
    """df with `stale`: a B message below the highest sequence number of the A messages that have arrived; A is never stale, equality passes."""
    before = Window.partitionBy(*keys).orderBy(arrival).rowsBetween(Window.unboundedPreceding, 0)
    mark = F.max(F.when(F.col(branch) == "A", F.col(seq)).otherwise(F.lit(-1))).over(before)
    return df.withColumn("stale", (F.col(branch) == "B") & (F.col(seq) < mark))


def fold_states(df: DataFrame, keys: list[str], order: str, intent: str, start: str = "LANDED") -> DataFrame:
    """keys, final_state, n_dispatched: one fold of each key's ordered intents through the flight states."""
    acc = "struct<state:string,n:bigint>"

    def step(a: Column, x: Column) -> Column:
        sent = outcome(a["state"], x["intent"]).isNotNull()
        return F.struct(step_state(a["state"], x["intent"]).alias("state"), (a["n"] + sent.cast("bigint")).alias("n")).cast(acc)

    first = F.struct(F.lit(start).alias("state"), F.lit(0).cast("bigint").alias("n")).cast(acc)
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(intent).alias("intent")))).alias("xs"))
    return rows.withColumn("f", F.aggregate("xs", first, step)).select(*keys, F.col("f.state").alias("final_state"), F.col("f.n").alias("n_dispatched"))


def endpoints(df: DataFrame, keys: list[str], index: str, prob: str, onset: float = 0.5, hysteresis: float = 0.15, silence: int = 14, pad: int = 6, longest: int = 468) -> DataFrame:
    """Utterances (start, end, t0, forced; in windows) of each key's ordered speech probabilities.

    Speech opens at onset; windows below onset - hysteresis count as silence, and any at onset
    resets it. After `silence` windows of it the utterance ends `pad` after its last speech; one
    of `longest` windows is cut by force. A pad never reaches into delivered audio. One that is
    still open at the end isn't emitted.
    """
    utterance = "struct<start:bigint,end:bigint,t0:bigint,forced:boolean>"
    acc = f"struct<free:bigint,open:boolean,start:bigint,quiet:bigint,out:array<{utterance}>>"
    no = F.lit(-1).cast("bigint")

    def step(a: Column, x: Column) -> Column:
        # windows are counted by rank within the key, so after window i the stream is i + 1 long
        i, p = x["i"], x["p"]
        done = i + 1
        speech = p >= onset
        low = F.coalesce(a["open"] & (p < onset - hysteresis), F.lit(False))
        start = F.when(speech & ~a["open"], F.greatest(a["free"], i - pad)).otherwise(a["start"])
        opened = a["open"] | speech
        quiet = F.when(speech, no).when(low & (a["quiet"] < 0), i).otherwise(a["quiet"])
        ends = low & (done - quiet >= silence)
        forced = ~ends & opened & (done - start >= longest)
        emitted = F.struct(start.alias("start"), F.when(ends, F.least(quiet + pad, done)).otherwise(done).alias("end"), done.alias("t0"), forced.alias("forced")).cast(utterance)
        over = ends | forced
        # an idle stream keeps what a later pad may reach back to: always pad windows, so only delivered audio limits it
        return F.struct(
            F.when(over, done).otherwise(a["free"]).alias("free"), (opened & ~over).alias("open"), F.when(over, F.lit(0).cast("bigint")).otherwise(start).alias("start"),
            F.when(over, no).otherwise(quiet).alias("quiet"), F.when(over, F.concat(a["out"], F.array(emitted))).otherwise(a["out"]).alias("out"),
        ).cast(acc)

    zero = F.lit(0).cast("bigint")
    first = F.struct(zero.alias("free"), F.lit(False).alias("open"), zero.alias("start"), no.alias("quiet"), F.array().cast(f"array<{utterance}>").alias("out")).cast(acc)
    ranked = df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(index)).cast("bigint") - 1)
    rows = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(prob).cast("double").alias("p")))).alias("xs"))
    return rows.withColumn("u", F.explode(F.aggregate("xs", first, step)["out"])).select(*keys, "u.*")


def with_tail(df: DataFrame, keys: list[str], index: str, prob: str, windows: int) -> DataFrame:
    """df (keys, index, prob) with so many silent windows after each key's last one, so that what is still open at the end of a recording ends."""
    last = df.groupBy(*keys).agg(F.max(index).alias("_last"))
    tail = last.select(*keys, F.explode(F.sequence(F.col("_last") + 1, F.col("_last") + windows)).alias(index), F.lit(0.0).alias(prob))
    return df.select(*keys, index, F.col(prob).cast("double").alias(prob)).unionByName(tail)


def first_of_kind(df: DataFrame, key: str, order: str, condition: Column) -> DataFrame:
    """The first row of each key that meets a condition."""
    row = F.struct(*df.columns)
    return df.where(condition).groupBy(key).agg(F.min_by(row, order).alias("r")).select("r.*")


def first_in_array(events: Column, condition) -> Column:
    return F.try_element_at(F.filter(events, condition), F.lit(1))


def trailing_mean(df: DataFrame, keys: list[str], order: str, value: str, rows: int) -> DataFrame:
    return df.withColumn("trailing", F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-(rows - 1), 0)))


def overlap_label(start: Column, end: Column, span_start: Column, span_end: Column) -> Column:
    """1 if a window holds the span, 0 if they are disjoint, null (drop) if they overlap in part."""
    return F.when((start <= span_start) & (end >= span_end), 1).when((end <= span_start) | (start >= span_end), 0)
