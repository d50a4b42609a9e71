"""Operators on literal relations, against direct loops, and streams against their batch forms."""

import json
import random
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.operators import corpus, metrics, ordered, relational, sampling, similarity, trials
from sedge.sources import readers, writers


def test_round_robin(spark):
    df = spark.createDataFrame([(f"k{i}", s) for i, s in enumerate("a" * 1 + "b" * 2 + "c" * 10)], "k string, s string")
    got = [r["s"] for r in sampling.round_robin(df, "s", "k", 7, 1).collect()]
    assert sorted(got) == ["a", "b", "b", "c", "c", "c", "c"]


def test_quota_and_ties(spark):
    w = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, w double")
    assert {r["k"]: r["quota"] for r in sampling.largest_remainder(w, "k", "w", 7).collect()} == {"a": 2, "b": 2, "c": 3}
    got = {r["k"]: r["quota"] for r in sampling.largest_remainder(w, "k", "w", 5).collect()}
    assert sum(got.values()) == 5 and got["c"] >= 2 and got["a"] >= got["b"]


def test_assignment_is_stable_under_reordering(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else "y") for i in range(50)], "i int, s string")
    shares = [("p", 0.5), ("q", 0.3), ("r", 0.2)]
    a = {r["i"]: r["assigned"] for r in sampling.assign_by_quota(df, "i", "s", shares, 1).collect()}
    b = {r["i"]: r["assigned"] for r in sampling.assign_by_quota(df.orderBy(F.desc("i")).repartition(3), "i", "s", shares, 1).collect()}
    assert a == b and set(a.values()) == {"p", "q", "r"}


def test_paired_needs_both_sides(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 3), (2, 4)], "k int, y int")
    pairs = relational.paired(a, b, "k")
    assert {r["k"]: r["side"] for r in pairs.collect()} == {1: "both", 2: "right"}
    with pytest.raises(Exception, match="only on one side"):
        relational.require_paired(pairs, "k").collect()


def test_pareto_keeps_equal_points(spark):
    rng = random.Random(1)
    points = [(i, rng.randrange(12), rng.randrange(12)) for i in range(60)] + [(60, 0, 11), (61, 0, 11)]
    want = {i for i, a, b in points if not any(x <= a and y >= b and (x < a or y > b) for _, x, y in points)}
    df = spark.createDataFrame(points, "i int, a int, b int")
    assert {r["i"] for r in relational.pareto(df, "a", "b").collect()} == want


def test_interval_join_with_open_ends(spark):
    points = spark.createDataFrame([(1, float(t)) for t in range(0, 50, 5)], "k int, t double")
    spans = spark.createDataFrame([(1, 2.0, 12.0, "a"), (1, 8.0, 9.0, "b"), (1, 30.0, None, "c"), (2, 0.0, None, "d")], "k int, s double, e double, p string")
    got = {r["t"]: r["p"] for r in relational.interval_latest(points, spans, ["k"], "t", "s", "e", "p", 7.0).collect()}
    assert got == {0: None, 5: "a", 10: "a", 15: None, 20: None, 25: None, 30: "c", 35: "c", 40: "c", 45: "c"}


def test_upsert_and_lost_keys(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    merged = relational.upsert(old, new, ["k"])
    assert {(r["k"], r["v"]) for r in merged.collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert relational.lost_keys(old, merged, ["k"]).count() == 0 and relational.lost_keys(old, new, ["k"]).count() == 1


def test_debounce_and_high_water(spark):
    df = spark.createDataFrame([("x", i, 0.9) for i in (0, 5, 17, 18, 31)] + [("x", 8, 0.1)], "k string, i int, s double")
    assert [r["i"] for r in ordered.debounced(df, ["k"], "i", "s", 0.5, 12).orderBy("i").collect()] == [0, 31]
    m = spark.createDataFrame([(1, n, s, b) for n, (b, s) in enumerate([("A", 5), ("B", 3), ("B", 5), ("B", 6), ("A", 2)])], "k int, n int, seq int, branch string")
    assert [r["stale"] for r in ordered.high_water(m, ["k"], "n", "seq", "branch").orderBy("n").collect()] == [False, True, False, False, False]


def endpoint_loop(probs, onset=0.5, hysteresis=0.15, silence=4, pad=2, longest=15):
    out, free, is_open, start, quiet = [], 0, False, 0, None
    for i, p in enumerate(probs):
        done = i + 1
        if p >= onset:
            quiet = None
            if not is_open:
                is_open, start = True, max(free, i - pad)
        elif is_open and p < onset - hysteresis:
            quiet = i if quiet is None else quiet
            if done - quiet >= silence:
                out.append((start, min(quiet + pad, done), done, False))
                is_open, quiet, free = False, None, done
                continue
        if is_open and done - start >= longest:
            out.append((start, done, done, True))
            is_open, quiet, free = False, None, done
    return out


def test_endpoints_equal_a_loop(spark):
    rng = random.Random(6)
    traces = {k: [min(1.0, max(0.0, rng.choice((0.05, 0.4, 0.9)) + rng.uniform(-0.1, 0.1))) for _ in range(rng.randint(0, 90))] for k in range(60)}
    df = spark.createDataFrame([(k, i, p) for k, t in traces.items() for i, p in enumerate(t)], "k int, i int, p double")
    got = {}
    for r in ordered.endpoints(df, ["k"], "i", "p", silence=4, pad=2, longest=15).collect():
        got.setdefault(r["k"], []).append((r["start"], r["end"], r["t0"], r["forced"]))
    want = {k: endpoint_loop(t) for k, t in traces.items()}
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}
    assert any(f for v in want.values() for *_, f in v) and any(not f for v in want.values() for *_, f in v)


def test_streams_over_many_batches_equal_batch(spark, tmp_path):
    from sedge.streaming import messages, stateful

    rng = random.Random(8)
    rows = [{"user_id": rng.randrange(4), "event_id": n, "branch": rng.choice("AB"), "seq": rng.randrange(40), "p": rng.random(), "score": rng.random()} for n in range(300)]
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(6):
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k * 50 : (k + 1) * 50])))
        import os

        os.utime(folder / f"{k}.json", (1000 + k, 1000 + k))
    schema = "user_id bigint, event_id bigint, branch string, seq bigint, p double, score double"
    batch = spark.createDataFrame([tuple(r.values()) for r in rows], schema)
    source = lambda: messages.file_source(spark, str(folder), schema)
    got = {(r["event_id"], r["stale"]) for r in messages.run_available(stateful.high_water(source(), "user_id"), "a").collect()}
    assert got == {(r["event_id"], r["stale"]) for r in ordered.high_water(batch, ["user_id"], "event_id", "seq", "branch").collect()}
    got = {r["event_id"] for r in messages.run_available(stateful.debounced(source(), "user_id", "event_id", "score", 0.7, 9), "b").collect()}
    assert got == {r["event_id"] for r in ordered.debounced(batch, ["user_id"], "event_id", "score", 0.7, 9).collect()}
    got = {tuple(r) for r in messages.run_available(stateful.endpoints(source(), "user_id", "event_id", "p", silence=3, pad=1, longest=12), "c").collect()}
    assert got == {tuple(r) for r in ordered.endpoints(batch, ["user_id"], "event_id", "p", silence=3, pad=1, longest=12).collect()}


def test_frames_are_padded(spark):
    from sedge.streaming.messages import frames

    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (2, [])], "k int, x array<int>")
    assert [(r["frame_index"], r["frame"]) for r in frames(df, "x", 2).orderBy("frame_index").collect()] == [(0, [1, 2]), (1, [3, 4]), (2, [5, 0])]


def test_compose_actions(spark):
    train = spark.createDataFrame([("1", "clean", "go up"), ("2", "tts_clean", "go up now"), ("3", "tts_noise", "go up now"), ("4", "tts_noise", "go up now"), ("5", "tts_clean", "Go up"), ("6", "tts_clean", "x")], "id string, variant string, transcript string")
    heard = spark.createDataFrame([("2", "go up know", True), ("3", "zzz qqq", True), ("4", "", True), ("5", "go up!", True)], "id string, asr_transcript string, asr_ok boolean")
    got = {r["id"]: r["action"] for r in corpus.compose(train, heard, 0.7).collect()}
    assert got == {"1": "kept", "2": "replaced", "3": "rejected", "4": "failed", "5": "identical", "6": "missing"}


def test_generation_is_the_same_however_dealt(spark):
    a = corpus.generate(spark, 200, 1, parts=1).collect()
    assert sorted(a) == sorted(corpus.generate(spark, 200, 1, parts=7).collect())
    from sedge.functions.command import canonical, validated

    assert all(canonical(validated(r["target"])) == r["target"] for r in a)


def test_jaccard_join_is_exact(spark):
    rng = random.Random(3)
    sets = [(i, sorted({rng.randrange(40) for _ in range(rng.randint(1, 12))})) for i in range(80)]
    sets += [(100 + i, s[:-1] or s) for i, s in sets[:40]]
    df = spark.createDataFrame([(i, [f"w{x}" for x in s]) for i, s in sets], "i int, xs array<string>")
    for t in (0.5, 0.85):
        want = {(a, b) for a, x in sets for b, y in sets if a < b and len(set(x) & set(y)) / len(set(x) | set(y)) >= t}
        assert {(r["a"], r["b"]) for r in similarity.jaccard_self_join(df, "i", "xs", t).collect()} == want


def test_leaks_at_the_threshold(spark):
    ref = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q"), (2, "take off"), (3, "")], "k int, t string")
    held = spark.createDataFrame([(10, "a b c d e f g h i j k l m n o p q r s t"), (11, "Take off!"), (12, "something else"), (13, "")], "k int, t string")
    assert {(r["held"], r["ref"], round(r["score"], 2)) for r in similarity.leaks(ref, held, "k", "t").collect()} == {(10, 1, 0.85), (11, 2, 1.0)}


def _leaks_by_hand(ref, held, t):
    def sets(w):
        return set(w), set(zip(w, w[1:])) or {tuple(w)}

    out = {}
    for k, x in held:
        for r, y in sorted(ref):
            score = max(len(a & b) / len(a | b) for a, b in zip(sets(x.split()), sets(y.split())))
            if score >= t:
                out[k] = (r, score)
                break
    return out


@pytest.mark.parametrize("frequent", [1 << 20, 5])
def test_leaks_equal_all_pairs_whatever_words_are_known(spark, monkeypatch, frequent):
    monkeypatch.setattr(similarity, "FREQUENT", frequent)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(400)]
    texts = [[rng.choice(words) for _ in range(rng.choice((1, 2, 7, 13, 30)))] for _ in range(60)]
    for base in texts[:40]:
        copy = list(base)
        copy[rng.randrange(len(copy))] = "x"
        texts += [copy, list(base)]
    rows = list(enumerate(" ".join(w) for w in texts))
    rng.shuffle(rows)
    ref, held = rows[::2], rows[1::2]
    for t in (0.85, 0.7):
        got = similarity.leaks(spark.createDataFrame(ref, "k bigint, t string"), spark.createDataFrame(held, "k bigint, t string"), "k", "t", t).collect()
        assert {r["held"]: (r["ref"], r["score"]) for r in got} == _leaks_by_hand(ref, held, t)


def test_leaks_normalise_each_text_once(spark, monkeypatch):
    """Normalising is most of the work: of each side's two replacements none is planned again for the filter or the digest."""
    plans = []
    write = similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    odd = spark.createDataFrame([(0, "A\t\u00a0b \u2003 c,\u0085--d_e\u3000 \u0661\u00bd! "), (1, "a b c d_e \u0661\u00bd"), (2, " \t "), (3, None)], "k bigint, t string")
    got = similarity.leaks(odd.where("k % 2 = 0"), odd.where("k % 2 = 1"), "k", "t").collect()
    assert [tuple(r) for r in got] == [(1, 0, 1.0)]
    assert plans[0].count("regexp_replace") == 4


def test_leaks_work_on_pieces_of_a_batch(monkeypatch):
    """A task's memory follows PIECE and its longest text, not the rows of a batch."""
    import pyarrow as pa

    lists = [[1, 2, 3], [], [4] * 9, [5], [], [6, 7], [8]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(lists, pa.list_(pa.int64()))], ["k", "w"])
    for most in (1, 2, 4, 100):
        monkeypatch.setattr(similarity, "PIECE", most)
        pieces = list(similarity._pieces(batch, 1))
        assert [x for p in pieces for x in p.to_pylist()] == batch.to_pylist()
        assert all(sum(map(len, p.column(1).to_pylist()[:-1])) < most and p.num_rows for p in pieces)
        assert (len(pieces) == 1) == (most == 100)
    assert list(similarity._pieces(batch.slice(0, 0), 1)) == []


def test_leaks_of_a_group_of_near_copies_try_few_pairs(spark, monkeypatch):
    """Words that aren't in a prefix are never written, and near copies don't meet all pairs."""
    written, stored = {}, similarity.stored

    def counted(df, name):
        out = stored(df, name)
        written[name] = written.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(similarity, "stored", counted)
    base = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(200)]
    df = spark.createDataFrame(rows, "k bigint, t string")
    got = similarity.leaks(df.where("k % 2 = 0"), df.where("k % 2 = 1"), "k", "t").collect()
    assert sorted((r["held"], r["ref"]) for r in got) == [(k, 0) for k in range(1, 200, 2)]
    assert written["pairs"] < 4 * 100 + 100 and written["prefixes"] < 0.2 * 200 * 401


@pytest.mark.parametrize("within", [None, "g"])
def test_leaks_move_no_texts_of_pairs_that_only_meet(spark, monkeypatch, within):
    """One shared rare word isn't enough, nor are some common ones: marks tell such pairs without their texts."""
    written, stored = {}, similarity.stored
    monkeypatch.setattr(similarity, "stored", lambda df, name: written.setdefault(name, []).append(df.count()) or stored(df, name))
    rng = random.Random(5)
    rows = [(k, " ".join([f"rare{k // 2}", *(f"w{rng.randrange(300)}" for _ in range(150))])) for k in range(80)]
    near = " ".join(f"v{k}" for k in range(150))
    rows += [(100, near), (101, near + " end")]
    df = spark.createDataFrame(rows, "k bigint, t string").selectExpr("*", "k % 4 div 2 as g")
    got = similarity.leaks(df.where("k % 2 = 0"), df.where("k % 2 = 1"), "k", "t", within=within).collect()
    assert [(r["held"], r["ref"]) for r in got] == [(101, 100)]
    assert sum(written["pairs"]) <= 2


def test_marks_never_say_more_than_sets_differ():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 65, 200, 3000):
        for extra in (0, 1, n // 3, 2 * n):
            one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            two = np.concatenate([one[extra // 2 :], rng.integers(0, 1 << 63, extra, dtype=np.uint64)])
            apart, least = len(np.setxor1d(one, two)), similarity._apart(similarity._marks(one), similarity._marks(two))
            assert least <= apart and (apart - least) % 2 == 0


def test_leaks_leave_neither_texts_nor_shuffles(spark, monkeypatch):
    from pathlib import Path

    kept, write = {}, similarity.stored
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|")
    shuffled = lambda: {f for f in files() if "/shuffle_" in f}

    def noted(df, name):
        before = shuffled()
        out = write(df, name)
        assert not shuffled() - before, name
        kept.setdefault(name, []).extend(out.inputFiles())
        return out

    monkeypatch.setattr(similarity, "stored", noted)
    rows = [(k, " ".join(f"w{k // 3 + j}" for j in range(60))) for k in range(60)]
    df = spark.createDataFrame(rows, "k bigint, t string").repartition(4)
    got = similarity.leaks(df.where("k % 2 = 0"), df.where("k % 2 = 1"), "k", "t")
    there = {name for name, files in kept.items() if any(Path(f.removeprefix("file:")).exists() for f in files)}
    assert {"sources", "texts", "prefixes", "first"} <= kept.keys() and there <= {"asked", "first", "pairs", "nodes"}
    assert got.count() == 30


def test_metrics_on_empty_and_degenerate_groups(spark):
    empty = spark.createDataFrame([], "correct boolean, dispatched string, parsed_ok boolean")
    r = metrics.summary(empty).first()
    assert r["n"] == 0 and r["exact_match"] is None and r["safe_failure_rate"] is None
    same = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert metrics.anova(same, "g", "v").first()["f"] is None
    ones = spark.createDataFrame([(1, 1, 1)] * 3, "x int, y int, z int")
    assert metrics.cochran_q(ones, ["x", "y", "z"]).first()["q"] == 0.0


def test_thresholds_and_gains(spark):
    s = spark.createDataFrame([("a", 0.9), ("a", 0.6), ("b", 0.7), ("b", 0.8)], "g string, s double")
    assert trials.highest_threshold(s, "g", "s", [0.5, 0.65, 0.75], 0.0).first()["threshold"] == 0.5
    assert trials.highest_threshold(s, "g", "s", [0.5, 0.65, 0.75], 0.5).first()["threshold"] == 0.75
    g = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 5.0), ("b", 1, 1.0)], "k string, o int, v double")
    assert {r["k"]: r["gain"] for r in trials.last_gain(g, "k", "o", "v").collect()} == {"a": 3.0, "b": None}


def test_readers_and_writers(spark, tmp_path):
    schema = "id string, v int"
    assert readers.json_lines(spark, str(tmp_path / "none.jsonl"), schema).count() == 0
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "none.jsonl"), schema, missing_ok=False).count()
    (tmp_path / "a.jsonl").write_text('{"id":"x","v":1}\n\n{"id":"y","v":2}\n{"id":"x","v":3}\n')
    assert {(r["id"], r["v"]) for r in readers.json_lines_keyed(spark, str(tmp_path / "a.jsonl"), schema, "id").collect()} == {("x", 3), ("y", 2)}
    (tmp_path / "b.csv").write_text("n,v\n a ,1\nb,\n")
    assert [tuple(r) for r in readers.csv_strings(spark, str(tmp_path / "b.csv"), ["n", "v"]).collect()] == [("a", "1"), ("b", None)]
    (tmp_path / "c.tsv").write_text('p\tq\nx\t"y\n')
    assert readers.tsv(spark, str(tmp_path / "c.tsv")).first()["q"] == '"y'
    (tmp_path / "d.txt").write_text("k1\tone\ttwo\n\nk2\tthree\n")
    assert [tuple(r) for r in readers.key_text(spark, str(tmp_path / "d.txt")).collect()] == [("k1", "one\ttwo"), ("k2", "three")]
    (tmp_path / "e.jsonl").write_text('{"target":"t1"}\n{"id":"q","target":"t2"}\n')
    assert [tuple(r) for r in readers.labels(spark, str(tmp_path / "e.jsonl")).collect()] == [("1", "t1"), ("q", "t2")]
    (tmp_path / "f.md").write_text("rate 3.5 and rate 4.5")
    assert readers.scrape(spark, str(tmp_path / "f.md"), r"rate ([0-9.]+)", 2) == ["3.5", "4.5"]
    with pytest.raises(ValueError):
        readers.scrape(spark, str(tmp_path / "f.md"), r"rate ([0-9.]+)", 1)
    (tmp_path / "m.json").write_text(json.dumps({"clips": [{"path": "p", "seconds": 1.5}], "takes": {"k1": {"seconds": 2.0}}}))
    assert readers.manifest_clips(spark, str(tmp_path / "m.json"), "path string, seconds double").first()["seconds"] == 1.5
    assert {r["id"]: r["seconds"] for r in readers.take_seconds(spark, readers.key_text(spark, str(tmp_path / "d.txt")), str(tmp_path / "m.json")).collect()} == {"k1": 2.0, "k2": 0.0}
    with wave.open(str(tmp_path / "s.wav"), "wb") as f:
        f.setnchannels(1), f.setsampwidth(2), f.setframerate(100)
        f.writeframes(np.full(250, 16384, "<i2").tobytes())
    clips = readers.audio(spark, str(tmp_path))
    assert clips.first()["rate"] == 100 and len(clips.first()["samples"]) == 250
    assert [r["window"] for r in readers.windows(clips, 1.0).orderBy("window").collect()] == [0, 1]

    df = spark.createDataFrame([("b", None, float("nan")), ("a", 1, 2.0)], "k string, v int, x double")
    writers.json_lines(df.drop("x"), str(tmp_path / "out"), "k", single=True)
    (part,) = (tmp_path / "out").glob("part-*")
    assert part.read_text().splitlines() == ['{"k":"a","v":1}', '{"k":"b","v":null}']
    writers.csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).where("k = 'a'").first()["x"] == "2.0000"
    digest, same = writers.seal(df, 2, str(tmp_path / "seal"))
    assert same and writers.seal(df.orderBy("k"), 2, str(tmp_path / "seal")) == (digest, True)
    assert writers.seal(df.withColumn("v", F.lit(7)), 2, str(tmp_path / "seal"))[1] is False
    with pytest.raises(ValueError):
        writers.seal(df, 3, str(tmp_path / "seal"))
    assert writers.replace_block("x <!-- a --> old <!-- b --> y", "new", "<!-- a -->", "<!-- b -->") == ("x <!-- a -->\nnew\n<!-- b --> y", True)
    assert writers.replace_block("x", "new", "<a>", "<b>") == ("x", False)
    assert readers.verify(spark.createDataFrame([("s.wav", "0")], "name string, sha256 string"), readers.digests(spark, str(tmp_path / "s.wav"))).count() == 1
    assert "| a | 1 |" in writers.markdown(df.select("k", "v"))


def test_item_outcomes(spark):
    from sedge.operators import experiments

    seg = "array<struct<correct:boolean,dispatched:string>>"
    df = spark.createDataFrame([(1, []), (2, [(True, "move")]), (3, [(True, "move"), (False, "hover")]), (4, [(False, "hover"), (False, "unknown")])], f"k int, s {seg}")
    got = {r["k"]: tuple(r["o"]) for r in df.select("k", experiments.outcome(F.col("s")).alias("o")).collect()}
    assert got == {1: (False, False, True, 0), 2: (True, True, False, 1), 3: (False, False, False, 2), 4: (False, False, True, 2)}


def test_take_reports(spark):
    from sedge.operators import experiments

    rate = 1000
    quiet, loud = [0.001, -0.001] * 200, [0.3, -0.3] * 300
    rows = [("good", quiet + loud + quiet), ("short", loud[:200]), ("clipped", quiet + [1.0, -1.0] * 300 + quiet), ("silent", [0.0] * 1000), ("faint", [0.0011, -0.0011] * 500)]
    df = spark.createDataFrame(rows, "k string, x array<double>")
    got = {r["k"]: (r["failures"], r["warnings"], round(r["lead"], 2), round(r["tail"], 2)) for r in experiments.take_report(df, "k", "x", rate, F.lit(0.001)).collect()}
    assert got["good"] == ([], [], 0.4, 0.4)
    assert got["short"][0] == ["too short"] and got["clipped"][0] == ["clipped"]
    assert "silence" in got["silent"][0] and got["faint"][0] == ["silence"]
    floors = {r["k"]: r["floor"] for r in experiments.noise_floor(df, "k", "x", 20).collect()}
    assert floors["good"] == pytest.approx(0.001) and floors["silent"] == 0.0


def test_latex_tables():
    from sedge.plans import reports

    out = reports.latex("# Table of *x*\n\nwords\n\n| a_b | n |\n|---|---:|\n| `c_d` | 5 % |\n\nnote", "t")
    assert r"\begin{tabular}{lr}" in out and r"a\_b & n \\" in out and r"\texttt{c\_d} & 5 \% \\" in out and r"\emph{x}" in out
    with pytest.raises(ValueError, match="ragged|cells"):
        reports.latex("| a | b |\n|---|---|\n| 1 |", "t")
    assert reports.run_names("results/exp 2-raw/") == ("exp_2_raw.csv", "exp_2_raw_analysis.md")


def test_registered_trials_and_resamples_are_the_whole_protocol(spark, small):
    from sedge.plans.catalogue import QUERIES, SEED

    g = spark.read.parquet(f"{small}/events.parquet").groupBy("event_type", "user_id").agg(F.sum("value").alias("num"), F.count("*").alias("den"))
    want = metrics.bootstrap(g, "event_type", "num", "den", seed=SEED, unit="user_id", resamples=10_000).collect()
    assert sorted(map(tuple, QUERIES["bootstrap_interval"](spark, small).collect())) == sorted(map(tuple, want))
