"""Streams with watermarks, timers and restarts against their batch forms."""

import json
import random

import pytest
from pyspark.sql import functions as F

from sedge.operators import ordered, relational
from sedge.plans.more_queries import QUERIES
from sedge.streaming import messages, timed


def put(folder, k, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{k:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def second(t):
    return f"2024-01-01T{t // 3600:02d}:{t // 60 % 60:02d}:{t % 60:02d}Z"


def test_suppression_over_two_streams_and_a_restart(spark, tmp_path):
    """Files come in turn over two runs of the query; what is given equals the batch join, but for rows that came too late."""
    rng = random.Random(4)
    spoken = [(k, i, rng.randrange(0, 3000)) for i, k in enumerate(rng.choices(range(4), k=60))]
    heard = [(k, rng.randrange(0, 3000)) for k in rng.choices(range(4), k=40)]
    stream = lambda name, ddl: messages.file_source(spark, str(tmp_path / name), ddl)
    utterances = lambda: stream("u", "k bigint, id bigint, t timestamp")
    reflexes = lambda: stream("r", "k bigint, f timestamp")
    joined = lambda: timed.suppressed(utterances(), reflexes(), "k", "id", "t", "f", "5 MINUTES", "10 seconds")
    for part, (lo, hi) in enumerate([(0, 1500), (1500, 3000)]):
        put(tmp_path / "u", part, [{"k": k, "id": i, "t": second(t)} for k, i, t in spoken if lo <= t < hi])
        put(tmp_path / "r", part, [{"k": k, "f": second(t)} for k, t in heard if lo <= t < hi])
        run(joined(), tmp_path / "out", tmp_path / "cp")
    # a reflex an hour late is dropped by the watermark; a row far on closes all intervals
    put(tmp_path / "r", 8, [{"k": 0, "f": second(1)}])
    put(tmp_path / "u", 9, [{"k": 99, "id": -1, "t": second(20_000)}])
    put(tmp_path / "r", 9, [{"k": 99, "f": second(20_000)}])
    run(joined(), tmp_path / "out", tmp_path / "cp")
    got = {(r["id"], r["reflex"]) for r in spark.read.parquet(str(tmp_path / "out")).where("id >= 0").select("id", F.unix_seconds("reflex").alias("reflex")).collect()}
    base = 1704067200
    u = spark.createDataFrame([(k, i, float(t)) for k, i, t in spoken], "k bigint, id bigint, t double")
    r = spark.createDataFrame([(k, float(t)) for k, t in heard], "k bigint, f double")
    batch = relational.suppressed(u, r, "k", "t", "f").select("id", F.when(F.col("reflex") <= F.col("t") + 300, F.col("reflex")).alias("reflex")).collect()
    assert got == {(x["id"], None if x["reflex"] is None else base + int(x["reflex"])) for x in batch} and len(got) == 60


def test_a_timer_ends_what_is_open_and_the_state_goes(spark, tmp_path):
    ddl = "k bigint, i bigint, t timestamp, p double"
    stream = lambda: timed.timed_endpoints(messages.file_source(spark, str(tmp_path / "in"), ddl), "k", "i", "t", "p", 10_000, silence=3, pad=1, longest=100)
    put(tmp_path / "in", 0, [{"k": 1, "i": i, "t": second(i), "p": 0.9} for i in range(5)])
    run(stream(), tmp_path / "out", tmp_path / "cp")
    assert spark.read.schema("k bigint").parquet(str(tmp_path / "out")).count() == 0
    put(tmp_path / "in", 1, [{"k": 2, "i": 0, "t": second(100), "p": 0.1}])
    query = run(stream(), tmp_path / "out", tmp_path / "cp")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    df = spark.createDataFrame([(1, i, 0.9) for i in range(5)], "k int, i int, p double")
    want = ordered.endpoints(ordered.with_tail(df, ["k"], "i", "p", 3), ["k"], "i", "p", silence=3, pad=1, longest=100).collect()
    assert [(r["start"], r["end"], r["forced"], r["timer"]) for r in got] == [(w["start"], w["end"], w["forced"], True) for w in want] and len(got) == 1
    states = [s["numRowsTotal"] for p in query.recentProgress for s in map(lambda o: json.loads(o.json), p.stateOperators)]
    assert states[-1] == 1  # key 1 is gone, key 2 waits
    # a key that speaks again starts anew
    put(tmp_path / "in", 2, [{"k": 1, "i": 9 + i, "t": second(200 + i), "p": (0.9, 0.1, 0.1, 0.1)[i]} for i in range(4)])
    run(stream(), tmp_path / "out", tmp_path / "cp")
    new = [r for r in spark.read.parquet(str(tmp_path / "out")).collect() if not r["timer"] and r["k"] == 1]
    assert [(r["start"], r["end"]) for r in new] == [(0, 2)]


def test_timed_query_equals_the_batch_fold(spark, small):
    e = spark.read.parquet(f"{small}/events.parquet").select("user_id", "event_id", F.least(F.abs("value") / 100, F.lit(1.0)).alias("p"))
    tail = ordered.with_tail(e, ["user_id"], "event_id", "p", 3)
    want = {tuple(r) for r in ordered.endpoints(tail, ["user_id"], "event_id", "p", silence=3, pad=1, longest=12).select("user_id", "start", "end", "t0", "forced").collect()}
    got = QUERIES["stream_timed_endpoints"](spark, small).collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want) and any(r["timer"] for r in got)


def test_frames_by_offsets_over_a_restart(spark, tmp_path):
    rows = [(k, [float(k * 100 + i) for i in range(k % 5 * 7)] if k != 3 else None) for k in range(12)]
    spark.createDataFrame(rows, "id bigint, samples array<double>").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda most: timed.frame_stream(spark, str(tmp_path / "in"), width=4, maxFramesPerTrigger=most)
    query = stream(6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        half = query.lastProgress.batchId
    finally:
        query.stop()
    again = stream(6).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        again.processAllAvailable()
    finally:
        again.stop()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {(k, i): [*x[i * 4 : i * 4 + 4], *[0.0] * (4 - len(x[i * 4 : i * 4 + 4]))] for k, x in rows if x for i in range(-(-len(x) // 4))}
    assert half > 1 and len(got) == len(want) and {(r["id"], r["frame_index"]): r["samples"] for r in got} == want
    assert sorted(r["frame"] for r in got) == list(range(len(want)))
    # one range of offsets read twice is the same
    reader = timed._Frames({"path": str(tmp_path / "in"), "width": "4"})
    parts = reader.partitions({"frame": 5}, {"frame": 15})
    twice = [[x for p in parts for x in reader.read(p)] for _ in range(2)]
    assert twice[0] == twice[1] and [x[0] for x in twice[0]] == list(range(5, 15))


def test_paced_frames_come_when_due(tmp_path, monkeypatch, spark):
    spark.createDataFrame([(1, [0.0] * 40)], "id bigint, samples array<double>").coalesce(1).write.parquet(str(tmp_path / "in"))
    now = [100.0]
    monkeypatch.setattr(timed.time, "monotonic", lambda: now[0])
    reader = timed._Frames({"path": str(tmp_path / "in"), "width": "4", "paced": "true", "frameMs": "30"})
    ends = []
    for t in (100.0, 100.031, 100.1, 101.0):
        now[0] = t
        ends.append(reader.latestOffset()["frame"])
    assert ends == [0, 1, 3, 10]


def test_a_batch_given_twice_is_there_once(spark, tmp_path):
    sink = timed.BatchSink(spark, f"file://{tmp_path}/sink")
    rows = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, n string")
    guarded = {"m": F.expr("try_cast(n AS INT)")}
    assert sink.put(rows, 0, guarded) and not sink.put(rows, 0, guarded) and sink.put(rows, 1, guarded)
    got = sorted((r["id"], r["m"], r["note"]) for r in sink.read().collect())
    assert [g for g in got if g[0] == 2] == [(2, None, "m")] * 2 and len(got) == 6 and (1, 5, "") in got
    # a writer that lost the race leaves nothing behind, and a trial folder isn't read
    rows.write.parquet(f"file://{tmp_path}/sink/_trial-000000002-x")
    assert sink.read().count() == 6
    with pytest.raises(Exception):
        sink.put(rows.select(F.raise_error(F.lit("broken")).alias("x")), 2)
    assert sink.put(rows, 2, guarded) and sink.read().count() == 9
