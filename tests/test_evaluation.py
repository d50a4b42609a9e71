"""Evaluation, integrity and link operators on literal cases and direct loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions import formats, stats
from sedge.operators import evaluation, integrity, link


@pytest.mark.parametrize("q,k,df,p", [(3.877, 3, 10, 0.05), (3.958, 4, 20, 0.05), (4.818, 5, 60, 0.01), (3.314, 3, 1e6, 0.05)])
def test_studentised_range_against_tables(q, k, df, p):
    assert stats.studentised_range_sf(q, k, df) == pytest.approx(p, abs=0.001)


def test_tukey_of_two_groups_is_the_t_test(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(0, 1, 12), rng.normal(0.9, 1, 12)
    df = spark.createDataFrame([("a", float(v)) for v in a] + [("b", float(v)) for v in b], "g string, v double")
    r = evaluation.tukey(df, "g", "v").first()
    t = abs(a.mean() - b.mean()) / math.sqrt((a.var(ddof=1) + b.var(ddof=1)) / 12)
    assert r["q"] == pytest.approx(t * math.sqrt(2))
    assert r["p"] == pytest.approx(stats.f_sf(t * t, 1, 22), abs=0.002)


def test_anova_says_why_it_does_not_apply(spark):
    frame = lambda rows: spark.createDataFrame(rows, "g string, v double")
    reasons = [evaluation.anova_guarded(frame(rows), "g", "v").first() for rows in ([("a", 1.0), ("b", 2.0), ("b", 3.0)], [("a", 1.0)] * 2 + [("b", 1.0)] * 2, [("a", 1.0)] * 2 + [("b", 2.0)] * 2, [("a", 1.0), ("a", 2.0), ("b", 2.0), ("b", 5.0)])]
    assert [r["reason"] for r in reasons] == ["a group has fewer than two values", "all values are equal", "every group is constant", None]
    assert [r["f"] is None for r in reasons] == [True, True, True, False]


def test_ratio_intervals_cover(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "c", float(x)) for k, x in enumerate(rng.integers(0, 2, 300))]
    df = spark.createDataFrame(rows, "id int, g string, ok double").withColumn("w", F.col("id") % 5)
    got = {r["measure"]: r for r in evaluation.ratio_intervals(df, "g", "id", {"crr": (F.col("ok"), F.lit(1)), "wer": (F.col("ok"), F.col("w"))}, 3, 2000).collect()}
    share = sum(r[2] for r in rows) / 300
    assert got["crr"]["ratio"] == pytest.approx(share) and got["crr"]["lo"] < share < got["crr"]["hi"]
    half = 1.96 * (share * (1 - share) / 300) ** 0.5
    assert got["crr"]["hi"] - got["crr"]["lo"] == pytest.approx(2 * half, rel=0.15)
    assert got["wer"]["n"] == 240


def test_units_of_equal_sums_are_one_draw(spark):
    seeds = np.array([7, 8, 9], np.uint64)
    drawn = stats.poisson_sums(seeds, np.array([1, 400, 1]), 10_000)
    assert (drawn[[0, 2]] == stats.poisson_counts(seeds[[0, 2]], 10_000)).all()
    assert drawn[1].mean() == pytest.approx(400, rel=0.01) and drawn[1].var() == pytest.approx(400, rel=0.05)
    df = spark.range(100_000).select("id", F.lit("c").alias("g"), (F.col("id") % 4 == 0).cast("int").alias("ok"))
    got = evaluation.ratio_intervals(df, "g", "id", {"crr": (F.col("ok"), F.lit(1))}, 3).first()
    half = 1.96 * (0.25 * 0.75 / 100_000) ** 0.5
    assert (got["n"], got["ratio"]) == (100_000, 0.25)
    assert (got["lo"], got["hi"]) == (pytest.approx(0.25 - half, abs=half / 10), pytest.approx(0.25 + half, abs=half / 10))


def test_operating_point_must_be_one_row(spark):
    curve = spark.createDataFrame([(0.1, 1), (0.2, 2), (0.2, 3)], "t double, n int")
    assert evaluation.operating_point(curve, "t", 0.1).first()["n"] == 1
    for at in (0.2, 0.3):
        with pytest.raises(Exception, match="operating threshold"):
            evaluation.operating_point(curve, "t", at).collect()


def test_empty_sides_are_findings(spark):
    empty = spark.createDataFrame([], "k string, f string, t string")
    some = spark.createDataFrame([("a", "x", "one two three")], "k string, f string, t string")
    assert {r["check"] for r in integrity.partition_findings(some, empty, some, "k").collect()} == {"empty side"}
    assert [tuple(r) for r in integrity.split_leakage(some, empty, "k", "t", "f").collect()] == [("empty side", "held out")]
    with pytest.raises(Exception, match="empty side: evaluate"):
        integrity.raise_on_findings(integrity.partition_findings(some, empty, some, "k")).collect()


def test_split_leakage_names_families_and_texts(spark):
    left = spark.createDataFrame([(1, "f1", "go north two metres now"), (2, "f2", "land")], "k int, f string, t string")
    right = spark.createDataFrame([(7, "f2", "Go north two metres, now!"), (8, "f3", "something else altogether")], "k int, f string, t string")
    assert sorted(tuple(r) for r in integrity.split_leakage(left, right, "k", "t", "f").collect()) == [("family", "f2"), ("text", "7 equal or same words")]


def test_merge_refuses_drift(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, fixed int")
    new = spark.createDataFrame([(2, "c", 6), (3, "d", 7)], "k int, v string, fixed int")
    assert sorted(map(tuple, integrity.merge_without_drift(old, new, ["k"], ["fixed"]).collect())) == [(1, "a", 5), (2, "c", 6), (3, "d", 7)]
    with pytest.raises(Exception, match="drift at 2"):
        integrity.merge_without_drift(old, new.withColumn("fixed", F.lit(0)), ["k"], ["fixed"]).collect()


def test_patterns_refuse_unknown_values(spark):
    df = spark.createDataFrame([("shape:circle,ids",), ("dir:up",)], "p string")
    assert df.select(integrity.checked_pattern(F.col("p")).alias("m")).first()["m"] == {"shape": "circle", "ids": None}
    with pytest.raises(Exception, match="no such value"):
        spark.createDataFrame([("shape:heart",)], "p string").select(integrity.checked_pattern(F.col("p"))).collect()


def test_unique_across_keeps_the_first_place(spark):
    rows = [(1, "val", "Go up!"), (2, "train", "go up"), (3, "train", "go  up"), (4, "test", "go down"), (5, "val", "go down.")]
    got = integrity.unique_across(spark.createDataFrame(rows, "k int, s string, t string"), "k", "t", "s", ["train", "val", "test"]).collect()
    assert sorted(r["k"] for r in got) == [2, 5]


def test_retarget(spark):
    xyz = "array<struct<x:double,y:double,z:double>>"
    schema = f"i int, p {xyz}, t {xyz}, c struct<intent:string,z:double,pos:array<double>,dir:string,dist:double,shape:string,radius:double,spacing:double,ids:array<int>>, s string, f boolean"
    p = [(0.0, 0.0, 1.0), (2.0, 0.0, 1.0)]
    command = lambda intent, **x: (intent, *[x.get(k) for k in ("z", "pos", "dir", "dist", "shape", "radius", "spacing", "ids")])
    cases = [
        (command("takeoff", z=4.0), "LANDED", False, [(0, 0, 4), (2, 0, 4)]), (command("takeoff"), "LANDED", False, [(0, 0, 2), (2, 0, 2)]), (command("takeoff"), "FLYING", True, None),
        (command("move", dir="north", dist=3.0), "FLYING", True, [(0, 3, 1), (2, 3, 1)]), (command("move", pos=[5.0, 5.0, 2.0]), "FLYING", True, [(4, 5, 2), (6, 5, 2)]), (command("move", dir="down", dist=9.0), "FLYING", True, [(0, 0, 0.5), (2, 0, 0.5)]),
        (command("altitude", z=7.0), "FLYING", True, [(0, 0, 7), (2, 0, 7)]), (command("land", ids=[1]), "FLYING", True, [(0, 0, 0), (2, 0, 0)]), (command("altitude", z=7.0, ids=[1]), "FLYING", True, p),
        (command("formation", shape="line", spacing=4.0), "FLYING", True, [(1, -2, 1), (1, 2, 1)]), (command("formation", shape="grid"), "FLYING", True, p), (command("formation", shape="grid"), "FLYING", False, []),
    ]
    df = spark.createDataFrame([(i, p, [], c, s, f) for i, (c, s, f, _) in enumerate(cases)], schema)
    got = {r["i"]: r["o"] for r in df.select("i", link.retarget(F.col("p"), F.col("t"), F.col("c"), F.col("s"), F.col("f")).alias("o")).collect()}
    for i, (*_, want) in enumerate(cases):
        assert (got[i] is None) == (want is None), cases[i]
        if want is not None:
            assert [tuple(x) for x in got[i]] == [pytest.approx(w) for w in want], cases[i]


def test_fixed_rounds_half_to_even(spark):
    df = spark.createDataFrame([(0.25,), (0.15,), (2.675,), (float("nan"),)], "x double")
    assert [r["s"] for r in df.select(formats.fixed(F.col("x"), 1).alias("s")).collect()] == ["0.2", "0.1", "2.7", None]
    p = spark.createDataFrame([(0.00012345,), (0.05,), (1.0,), (None,)], "p double")
    assert [r["s"] for r in p.select(formats.p_value(F.col("p")).alias("s")).collect()] == ["0.00012", "0.05", "1.0", "--"]


def test_noise_is_drawn_by_corpus_and_never_silent(spark):
    from sedge.functions import signal
    from sedge.operators import experiments

    bank = [("long", "l0", [0.1 * (-1) ** k for k in range(400)])] + [("short", f"s{i}", [0.0] * 30 if i % 2 else [0.2, -0.2, 0.1]) for i in range(20)]
    bank = spark.createDataFrame(bank, "corpus string, recording string, x array<double>")
    items = spark.createDataFrame([(i, 50) for i in range(200)], "id int, n int")
    rows = experiments.draw_noise(items, bank, "id", "n", "corpus", "recording", "x", 7).collect()
    assert len(rows) == 200 and all(len(r["noise"]) == 50 and any(r["noise"]) for r in rows)
    assert 60 < sum(r["recording"] == "l0" for r in rows) < 170  # one recording is heard as often as the others together, or more where those are silent
    again = {r["id"]: r["recording"] for r in experiments.draw_noise(items.repartition(3), bank, "id", "n", "corpus", "recording", "x", 7).collect()}
    assert again == {r["id"]: r["recording"] for r in rows}
    with pytest.raises(ValueError, match="no sound"):
        experiments.draw_noise(items.limit(1), bank.where("recording = 's1'"), "id", "n", "corpus", "recording", "x", 7, most=2)
    rng = np.random.default_rng(2)
    speech = (np.sin(np.arange(1600) / 7) * 0.4).tolist()
    df = spark.createDataFrame([(k, speech, rng.normal(0, 0.1, 1600).tolist(), [1.0, 0.5, 0.25], 1000) for k in range(40)], "k int, s array<double>, n array<double>, h array<double>, r int")
    mixed = df.select("n", "r", signal.mix_at_snr("s", "n", F.lit(12.0), "r").alias("m"))
    part = F.transform("n", lambda v: v * F.col("m.gain") * F.col("m.attenuation"))
    assert [r["x"] for r in mixed.select(signal.measured_snr("m.samples", part, "r").alias("x")).limit(3).collect()] == pytest.approx([12.0] * 3, abs=0.5)
    out = df.select(signal.augmented("s", "k", "h", "n", "r").alias("a")).select("a.*").collect()
    assert all(len(r["samples"]) == 1600 and max(map(abs, r["samples"])) <= 0.999 for r in out)
    assert 15 < sum(r["room"] for r in out) < 38 and 20 < sum(r["snr_db"] is not None for r in out) <= 40
    windows = df.select(signal.placed_in_window("s", "k", F.lit(2000)).alias("w"), signal.placed_in_window("s", "k", F.lit(900)).alias("c")).collect()
    assert all(len(r["w"]["samples"]) == 2000 and r["w"]["samples"][r["w"]["offset"] : r["w"]["offset"] + 1600] == pytest.approx(speech) for r in windows)
    assert all(len(r["c"]["samples"]) == 900 and r["c"]["offset"] == 0 for r in windows) and len({r["w"]["offset"] for r in windows}) > 5


def test_tail_ends_what_is_open(spark):
    from sedge.operators import ordered

    df = spark.createDataFrame([(1, i, 0.9) for i in range(5)], "k int, i int, p double")
    run = lambda d: ordered.endpoints(d, ["k"], "i", "p", silence=3, pad=1, longest=100).collect()
    assert run(df) == [] and [(r["start"], r["end"], r["forced"]) for r in run(ordered.with_tail(df, ["k"], "i", "p", 4))] == [(0, 6, False)]


def test_best_frame_breaks_ties_by_priority(spark):
    from sedge.streaming import stateful

    rows = [(1, "hold", 0.5), (1, "abort", 0.5), (2, "hold", 0.9), (2, "abort", 0.1)]
    got = {r["f"]: r["c"] for r in stateful.best_frame(spark.createDataFrame(rows, "f int, c string, s double"), ["f"], "c", "s", ["abort", "hold"]).collect()}
    assert got == {1: "abort", 2: "hold"}


def test_ranges_give_the_places_of_one_sort(spark):
    import random

    from sedge.operators import relational, sampling

    rng = random.Random(3)
    rows = [(i, "a" if i % 9 else "b", rng.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "i int, s string, x double").repartition(5)
    got = {r["i"]: (r["place"], r["size"]) for r in sampling.placed(df, "s", [F.col("x")]).collect()}
    for s in "ab":
        mine = sorted((x, i) for i, t, x in rows if t == s)
        assert all(got[i] == (k, len(mine)) for k, (_, i) in enumerate(mine, 1))
    points = [(f"n{i:04d}", rng.choice("ab") if i % 50 else "c", 1 + rng.random() * (1 if i < 500 else 1000)) for i in range(800)]
    best = min(((y - x) / y, a, b) for a, f, x in points for b, g, y in points if f != g and (x, a) < (y, b))
    r = relational.closest_pair(spark.createDataFrame(points, "n string, f string, v double"), "n", "f", "v").first()
    assert (r["a"], r["b"]) == best[1:] and r["gap"] == pytest.approx(best[0])


def test_more_sources(spark, tmp_path):
    import io
    import tarfile
    import wave

    from sedge.functions import command, signal
    from sedge.sources import readers, writers

    (tmp_path / "t.txt").write_text("a1\tswarm hold\n\na2\tgo now\tplease\n")
    assert [tuple(r) for r in readers.class_labels(spark, str(tmp_path / "t.txt")).orderBy("id").collect()] == [("a1", "swarm hold", "swarm_hold"), ("a2", "go now\tplease", "go_now\tplease")]
    df = spark.createDataFrame([("a/b.wav",), ("/c.wav",), ("s3://d/e.wav",)], "p string")
    assert [r["p"] for r in readers.absolute(df, "p", "/root/x/").collect()] == ["/root/x/a/b.wav", "/c.wav", "s3://d/e.wav"]
    (tmp_path / "m.yaml").write_text('models:\n  - name: one\n    params: 0.5B   # small\n    family: "q"\n  - name: two\n    params: 1B\n    family: l\n')
    assert sorted(map(tuple, readers.yaml_entries(spark, str(tmp_path / "m.yaml"), "name", ["params", "family"]).collect())) == [("one", "0.5B", "q"), ("two", "1B", "l")]
    (tmp_path / "bad.yaml").write_text("- name: one\n  family: q\n")
    with pytest.raises(Exception, match="no params"):
        readers.yaml_entries(spark, str(tmp_path / "bad.yaml"), "name", ["params"]).collect()
    (tmp_path / "g.gbnf").write_text(command.command_grammar())
    assert readers.grammar(spark, str(tmp_path / "g.gbnf")) == command.grammar_regex(command.command_grammar())
    assert readers.relation(spark, "items", str(tmp_path / "none.jsonl")).count() == 0

    def wav(x, rate):
        out = io.BytesIO()
        with wave.open(out, "wb") as f:
            f.setnchannels(1), f.setsampwidth(2), f.setframerate(rate), f.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
        return out.getvalue()

    tone = np.sin(2 * np.pi * 50 * np.arange(800) / 800) * 0.5
    with tarfile.open(tmp_path / "x.tar", "w") as t:
        for name in ("a.wav", "b.txt"):
            info = tarfile.TarInfo(name)
            info.size = len(wav(tone, 800))
            t.addfile(info, io.BytesIO(wav(tone, 800)))
    (r,) = readers.tar_members(spark, str(tmp_path / "x.tar")).select("member", "rate", "samples", signal.resampled("samples", "rate", F.lit(400)).alias("half")).collect()
    assert (r["member"], r["rate"], len(r["samples"]), len(r["half"])) == ("a.wav", 800, 800, 400)
    assert np.allclose(r["half"], np.sin(2 * np.pi * 50 * np.arange(400) / 400) * 0.5, atol=1e-3)
    clips = spark.createDataFrame([("s", i, [float(i)] * n) for i, n in enumerate((3, 4, 5, 12, 2))], "speaker string, i int, x array<double>")
    got = {r["window"]: r["x"] for r in readers.packed_words(clips, "speaker", "i", "x", 10).collect()}
    assert got == {0: [0.0] * 3 + [1.0] * 4, 1: [2.0] * 5, 2: [3.0] * 10, 3: [4.0] * 2}
    source = tmp_path / "in"
    spark.createDataFrame([("1",), ("x",), ("3",)], "v string").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("v string").json(str(source))
    writers.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp"), {"n": F.col("v").try_cast("int")}).trigger(availableNow=True).start().awaitTermination()
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect())
    assert lines == ["1,1,\"\"", "3,3,\"\"", "v,n,note", "x,,n"] or lines == ["1,1,", "3,3,", "v,n,note", "x,,n"]


def test_alignment_is_all_or_nothing(spark):
    from sedge.functions import command

    rows = [("<s>a\nToday Date: 1 May\nb", "a\nToday Date: 2 June\nb", "<s>"), ("<s>a", "a", "<s>"), ("<s>a", "b", "<s>"), ("a", "a", "")]
    df = spark.createDataFrame(rows, "x string, y string, b string").select(command.aligned(F.col("x"), F.col("y"), F.col("b")).alias("o"))
    assert [(r["o"]["text"], r["o"]["notes"]) for r in df.collect()] == [(rows[0][0], ["bos-prefix", "today-date"]), ("<s>a", ["bos-prefix"]), ("b", []), ("a", [])]
    same = spark.createDataFrame([('{"intent":"move","dir":"up","dist":1}', '{"dist":1.04,"dir":"up","intent":"move"}'), ("{", "{")], "x string, y string")
    assert [r["s"] for r in same.select(command.same_command(F.col("x"), F.col("y")).alias("s")).collect()] == [True, False]
