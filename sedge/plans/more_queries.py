"""Queries of grammars, conflict resolution, assignment, perturbation and targets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import grammar, overlap
from ..operators import corpus, link, sampling, swarm
from .registry import QUERIES, SEED, query, read

__all__ = ["QUERIES"]

# ---------------------------------------------------------------- grammars


@query("""WITH t AS (SELECT event_id, event_id % 4 AS a, CASE event_id % 7 WHEN 0 THEN (event_id + 1) % 4 ELSE event_id % 4 END AS b, props FROM events)
SELECT event_id, json_valid(repeat('[', a::INT) || CASE event_id % 3 WHEN 0 THEN props ELSE '{"in": [' || props || ', null], "at": ' || event_id || '}' END || repeat(']', b::INT)) AS ok FROM t""")
def nested_json_accepted(spark, d):
    """Whether a JSON grammar accepts the events' props, nested in lists and objects that are not always closed."""
    k = F.col("event_id")
    inner = F.when(k % 3 == 0, F.col("props")).otherwise(F.concat(F.lit('{"in": ['), "props", F.lit(', null], "at": '), k.cast("string"), F.lit("}")))
    closers = F.when(k % 7 == 0, (k + 1) % 4).otherwise(k % 4).cast("int")
    text = F.concat(F.repeat(F.lit("["), (k % 4).cast("int")), inner, F.repeat(F.lit("]"), closers))
    return read(spark, d, "events").select("event_id", grammar.accepted_by(grammar.JSON, text).alias("ok"))


@query("""WITH t AS (SELECT event_id, user_id % 6 AS a, length(event_type) % 4 AS b FROM events)
SELECT event_id, (CASE event_id % 5 WHEN 0 THEN (a + 1) % 6 ELSE a END = a AND CASE event_id % 3 WHEN 0 THEN (b + 1) % 4 ELSE b END = b) AS ok FROM t""")
def balanced_brackets(spark, d):
    """Two kinds of brackets of each event, nested, closed in turn where a recursive grammar says so."""
    a, b, k = F.col("user_id") % 6, F.length("event_type") % 4, F.col("event_id")
    times = lambda c, n: F.repeat(F.lit(c), n.cast("int"))
    text = F.concat(times("(", a), times("[", b), F.lit("x"), times("]", F.when(k % 3 == 0, (b + 1) % 4).otherwise(b)), times(")", F.when(k % 5 == 0, (a + 1) % 6).otherwise(a)))
    return read(spark, d, "events").select("event_id", grammar.accepted_by('root ::= "(" root ")" | "[" root "]" | root root | "x"', text).alias("ok"))


# ---------------------------------------------------------------- corpora


def conflicting_records(docs):
    """Documents as records whose clean form is the text of the document before: (records, clean)."""
    records = docs.select("doc_id", "text", F.col("source").alias("label"))
    return records, docs.select((F.col("doc_id") + 1).alias("doc_id"), "text").where("doc_id % 3 <> 0")


@query()
def resolved_conflicts(spark, d):
    """Documents after conflicts of equal texts with different sources: kept or dropped, and why; tested against a sequential loop."""
    records, clean = conflicting_records(read(spark, d, "documents"))
    kept, dropped = corpus.dedup_resolved(records, clean, "doc_id", "text", "label", "doc_id")
    out = kept.withColumn("reason", F.lit("kept")).unionByName(dropped)
    return out.select("doc_id", "reason", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"))


@query()
def perturbed_text(spark, d):
    """Each turn with one or two text changes chosen by its place; tested against a direct loop."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    return turns.withColumn("p", corpus.perturb(F.col("text"), F.concat_ws("/", "conv_id", "turn"))).select("conv_id", "turn", "p.text", "p.ops")


@query()
def turn_similarity(spark, d):
    """Each turn against the one after it in its conversation: their Ratcliff-Obershelp ratio, and whether it reaches 0.6; tested against the definition."""
    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    pairs = turns.join(after, ["conv_id", "turn"])
    return pairs.select("conv_id", "turn", F.round(overlap.overlap_ratio(F.col("text"), F.col("next")), 9).alias("ratio"), overlap.overlaps(F.col("text"), F.col("next"), F.lit(0.6)).alias("alike"))


@query()
def composed_records(spark, d):
    """Turns as records of variants by quota, with a recognised text (the turn without its first word) joined in; tested row by row."""
    t = read(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("transcript"))
    rows = t.where("transcript is not null").withColumn("id", F.concat_ws("/", "conv_id", "turn"))
    g = sampling.assign_by_quota(rows, "id", "role", [("clean", 0.4), ("tts_clean", 0.4), ("tts_noise", 0.2)], SEED).withColumnRenamed("assigned", "variant")
    heard = g.where(F.col("variant") != "clean").select("id", F.regexp_replace("transcript", r"^\s*\S+\s*", "").alias("asr_transcript"), F.lit(True).alias("asr_ok"))
    return corpus.compose(g.select("id", "variant", "transcript"), heard, 0.5).select("id", "variant", "action", "transcript", F.round("asr_similarity", 9).alias("asr_similarity"))


# ---------------------------------------------------------------- formations


@query("""WITH m AS (SELECT l_orderkey, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT l_orderkey, n, sum((x - 7.0 * r) * (x - 7.0 * r)) AS cost FROM m GROUP BY l_orderkey, n""")
def assigned_slots(spark, d):
    """Lines of an order sent to as many slots on a line, at the least sum of squared distances; along a line the order of places is the best, which SQL can say."""
    size = F.size("m")
    slots = F.transform(F.sequence(F.lit(1), size), lambda k: F.array(k * 7.0))
    return swarm.assigned(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_quantity"], slots).select("l_orderkey", F.col("n").cast("bigint").alias("n"), "cost")


@query("""WITH o AS (SELECT o_orderkey, (['takeoff', 'land', 'altitude', 'hover', 'move'])[o_orderkey % 5 + 1] AS intent, (['LANDED', 'FLYING', 'FLYING', 'LANDING'])[o_custkey % 4 + 1] AS state FROM orders),
l AS (SELECT o_orderkey, intent, state, count(*) AS n, avg(l_quantity) AS z FROM o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
g AS (SELECT *, CASE intent WHEN 'takeoff' THEN state = 'LANDED' ELSE state = 'FLYING' END AS legal FROM l)
SELECT o_orderkey, CASE WHEN legal THEN n END AS n, CASE WHEN legal THEN CASE intent WHEN 'takeoff' THEN 3.0 WHEN 'land' THEN 0.0 WHEN 'altitude' THEN 3.0 WHEN 'hover' THEN z ELSE z + 2.5 END END AS z FROM g""")
def retargeted(spark, d):
    """Where an order's lines, as drones, are sent by a command: heights of the targets, none where the state forbids it."""
    at = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (F.col(k) % len(xs)).cast("int"))
    point = F.struct(F.col("l_discount").alias("x"), F.col("l_tax").alias("y"), F.col("l_quantity").cast("double").alias("z"))
    places = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(point).alias("p"))
    none = lambda t: F.lit(None).cast(t)
    command = F.struct(
        at(["takeoff", "land", "altitude", "hover", "move"], "o_orderkey").alias("intent"), F.lit(3.0).alias("z"), none("array<double>").alias("pos"), F.lit("up").alias("dir"), F.lit(2.5).alias("dist"),
        none("string").alias("shape"), none("double").alias("radius"), none("double").alias("spacing"), none("array<int>").alias("ids"),
    )
    state = at(["LANDED", "FLYING", "FLYING", "LANDING"], "o_custkey")
    rows = read(spark, d, "orders").select("o_orderkey", command.alias("c"), state.alias("s")).join(places, "o_orderkey")
    sent = rows.withColumn("t", link.retarget(F.col("p"), F.array().cast("array<struct<x:double,y:double,z:double>>"), F.col("c"), F.col("s"), F.lit(True)))
    mean = F.aggregate("t", F.lit(0.0), lambda a, x: a + x["z"]) / F.size("t")
    return sent.select("o_orderkey", F.when(F.col("t").isNotNull(), F.size("t").cast("bigint")).alias("n"), F.when(F.col("t").isNotNull(), mean).alias("z"))


# ---------------------------------------------------------------- streams with event time


def closed_events(spark, d):
    """The events as a stream of files, with a last row of each type for a user of its own, a thousand days on, so that every watermark passes."""
    from ..sources.shared import shared_folder
    from ..streaming import messages

    e = read(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    end = e.groupBy("event_type").agg(F.max("ts").alias("ts")).select(F.lit(-1).alias("user_id"), F.lit(-1).alias("event_id"), (F.col("ts") + F.expr("INTERVAL 1000 DAYS")).alias("ts"), "event_type", F.lit(0.0).alias("value"))
    path = shared_folder(spark, "closed-events")
    e.unionByName(end).write.parquet(path)
    return messages.file_source(spark, path, "user_id bigint, event_id bigint, ts timestamp, event_type string, value double", 10_000, "parquet")


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS at FROM events)
SELECT u.user_id, u.event_id, min(r.at) AS reflex FROM e u LEFT JOIN e r ON r.user_id = u.user_id AND r.event_type = 'click' AND r.at BETWEEN u.at - 1800000000 AND u.at + 1800000000 WHERE u.event_type = 'view' GROUP BY ALL""")
def stream_suppression(spark, d):
    """Views that start half an hour before they arrive, with the first click of their user within an hour of that: two watermarked streams."""
    from ..streaming import messages, timed

    views = closed_events(spark, d).where("event_type = 'view'").withColumn("start", F.col("ts") - F.expr("INTERVAL 30 MINUTES"))
    clicks = closed_events(spark, d).where("event_type = 'click'").withColumnRenamed("ts", "fired")
    out = messages.run_available(timed.suppressed(views, clicks, "user_id", "event_id", "start", "fired", "1 HOUR"), "suppression")
    return out.where("user_id >= 0").select("user_id", "event_id", F.unix_micros("reflex").alias("reflex"))


@query()
def stream_timed_endpoints(spark, d):
    """Utterances of each user's events, those still open at the end closed by a timer; equal to the batch fold with a tail, by test."""
    from ..streaming import messages, timed

    e = closed_events(spark, d).withColumn("p", F.least(F.abs("value") / 100, F.lit(1.0)))
    out = messages.run_available(timed.timed_endpoints(e, "user_id", "event_id", "ts", "p", 60_000, silence=3, pad=1, longest=12), "timed")
    return out.where("user_id >= 0").select("user_id", "start", "end", "t0", "forced", "timer")


@query("""WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT vec_id, i // 24 AS frame_index, count(*) AS n, max(v) AS loudest FROM s GROUP BY ALL""")
def stream_frames(spark, d):
    """Embeddings as samples, in whole frames from a streaming source with offsets: the loudest sample of each frame, and how many aren't padding."""
    from ..streaming import messages, timed

    stream = timed.frame_stream(spark, f"{d}/embeddings.parquet", width=24, idColumn="vec_id", samplesColumn="embedding")
    out = messages.run_available(stream, "frames")
    n = F.when(F.col("frame_index") == 2, 64 - 48).otherwise(24).cast("bigint")
    real = F.slice("samples", F.lit(1), n.cast("int"))
    return out.select(F.col("id").alias("vec_id"), F.col("frame_index"), n.alias("n"), F.array_max(real).alias("loudest"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (try_cast(replace(substr(props, 7), '}', '') AS BIGINT) IS NULL) AS n_noted FROM events GROUP BY event_type")
def replayed_batches(spark, d):
    """Every micro-batch given to the sink twice: its rows are there once, those that fail with a note."""
    from ..sources.shared import shared_folder
    from ..streaming import messages, timed

    root = shared_folder(spark, "sink")
    sink = timed.BatchSink(spark, f"{root}/data")
    guarded = {"k": F.expr("try_cast(get_json_object(props, '$.k') AS BIGINT)")}
    source = read(spark, d, "events")
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)

    def twice(batch, number):
        sink.put(batch, number, guarded)
        if sink.put(batch, number, guarded):
            raise RuntimeError(f"batch {number} was written twice")

    messages.file_source(spark, f"{d}/events*.parquet", ddl, fmt="parquet").writeStream.foreachBatch(twice).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sink.read().groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("note") != "").alias("n_noted"))
