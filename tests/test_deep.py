"""Grammars, conflicts, assignment and ranks against definitions and direct loops."""

import itertools
import json
import math
import random
import re
import time
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedge.functions import assignment, grammar
from sedge.operators import corpus, ranks, swarm
from sedge.plans.more_queries import QUERIES

# ---------------------------------------------------------------- grammars


def json_ok(text):
    try:
        json.loads(text, parse_constant=lambda c: 1 / 0)
        return True
    except (ValueError, ZeroDivisionError):
        return False


def test_json_grammar_equals_a_parser():
    graph = grammar.compile_grammar(grammar.JSON)
    rng = random.Random(1)
    marks = [*'[]{}:,"\\ 01-.eEtu/', "true", "null", '"a"', "\\u12ab", "\n"]

    def made(depth):
        k = rng.random()
        if depth <= 0 or k < 0.3:
            return rng.choice(("1", "-0.5e3", '"x\\n"', "true", "null", '""'))
        inner = [made(depth - 1) for _ in range(rng.randint(0, 3))]
        return f"[{','.join(inner)}]" if k < 0.65 else "{" + ",".join(f'"k":{x}' for x in inner) + "}"

    good = 0
    for _ in range(6000):
        t = made(4) if rng.random() < 0.5 else "".join(rng.choices(marks, k=rng.randint(0, 8)))
        if t and rng.random() < 0.4:
            j = rng.randrange(len(t))
            t = t[:j] + rng.choice(marks) + t[j + rng.randint(0, 1) :]
        good += json_ok(t)
        assert grammar.accepts(graph, t) == json_ok(t), t
    assert good > 1000


@pytest.mark.parametrize(
    "source,yes,no",
    [
        ('root ::= root "+" root | "n" | root "-" "n"', ["n", "n+n-n+n"], ["", "n+", "+n"]),  # left recursion, ambiguous
        ('root ::= "" | "(" root ")" root', ["", "()", "(()())"], ["(", "())"]),
        ('root ::= a b\na ::= "x"? # optional\nb ::= ("y" | a)*', ["", "x", "xyxy", "yyx"], ["z", "xz"]),
        ('root ::= "a"{2,3} [b-d]? .+', ["aab", "aaab", "aabx", "aaaaaa"], ["ab", "aa"]),
        ('root ::= [^\\]a-c\\n]{2}', ["zz", "dé"], ["az", "z", "]]", "\nz"]),
        ('root ::= x{0}"k"\nx ::= "v"', ["k"], ["vk"]),
        ('root ::= "a"{2,} | "b"{3}', ["aa", "aaaaa", "bbb"], ["a", "bb", "bbbb"]),
    ],
)
def test_grammar_forms(source, yes, no):
    graph = grammar.compile_grammar(source)
    assert all(grammar.accepts(graph, t) for t in yes) and not any(grammar.accepts(graph, t) for t in no)


@pytest.mark.parametrize("source", ["root ::= x", 'root ::= ( "a"', '"a"', "root ::= [z-a]", 'root ::= "a" )', 'root ::= "a"{3,1}', "root ::= *"])
def test_broken_grammars_are_refused(source):
    with pytest.raises(grammar.GrammarError):
        grammar.compile_grammar(source)


def test_wire_grammar_equals_its_regular_expression():
    from sedge.functions.command import command_grammar, grammar_regex

    graph, pattern = grammar.compile_grammar(command_grammar()), re.compile(grammar_regex(command_grammar()))
    rng = random.Random(2)
    some = ['{"intent":"hover"}', '{"intent":"land","ids":[1,2]}', '{"intent":"move","dir":"east","dist":1.5}', '{"intent":"formation","shape":"circle","radius":5.0,"ids":[0]}', '{"intent":"set_param","speed":1.0,"alt":2.0}']
    for _ in range(2000):
        t = list(rng.choice(some))
        for _ in range(rng.randint(0, 2)):
            t[rng.randrange(len(t))] = rng.choice('0123456789.,"{}[]:-x')
        assert grammar.accepts(graph, "".join(t)) == bool(pattern.fullmatch("".join(t)))


def test_long_and_deep_texts_take_linear_time():
    graph = grammar.compile_grammar('root ::= [a-z]+ ( " " [a-z]+ )*')
    seconds = []
    for n in (20_000, 80_000):
        began = time.process_time()
        assert grammar.accepts(graph, "word " * n + "end")
        seconds.append(time.process_time() - began)
    assert seconds[1] < 9 * seconds[0] + 0.5
    assert grammar.accepts(grammar.compile_grammar(grammar.JSON), "[" * 5000 + "]" * 5000)


def test_grammar_column(spark):
    df = spark.createDataFrame([("[1]",), ("[1",), (None,), ("",), ("[1]",)], "t string")
    assert [r["ok"] for r in df.select(grammar.accepted_by(grammar.JSON, F.col("t")).alias("ok")).collect()] == [True, False, None, False, True]


# ---------------------------------------------------------------- conflicts


def norm(t):
    return " ".join(re.sub(r"[^\w\s]", "", (t or "").lower()).split())


def resolved_by_loop(records, clean):
    """One row after the other: (kept {id: text}, dropped {id: reason})."""
    queue, held, dropped = deque((i, t, label, i in clean and norm(clean[i]) != norm(t)) for i, t, label in records), {}, {}
    while queue:
        row = queue.popleft()
        key = norm(row[1])
        if key not in held:
            held[key] = row
        elif held[key][2] == row[2]:
            dropped[row[0]] = "duplicate"
        elif row[3]:
            queue.appendleft((row[0], clean[row[0]], row[2], False))
        elif held[key][3]:
            old, held[key] = held[key], row
            queue.appendleft((old[0], clean[old[0]], old[2], False))
        else:
            dropped[row[0]] = "conflict"
    return {i: t for i, t, *_ in held.values()}, dropped


@pytest.mark.parametrize("seed", range(6))
def test_conflicts_equal_a_sequential_loop(spark, seed):
    rng = random.Random(seed)
    texts = ["", None, "a", "A!", "b", "c d", "C  d", "e", "f", "g"]
    records = [(i, rng.choice(texts), rng.choice("xyz")) for i in range(120)]
    clean = {i: rng.choice(texts) for i in range(120) if rng.random() < 0.8}
    kept, dropped = corpus.dedup_resolved(
        spark.createDataFrame(records, "id bigint, text string, label string").repartition(5), spark.createDataFrame(list(clean.items()), "id bigint, text string"), "id", "text", "label", "id"
    )
    got = {r["id"]: r["text"] for r in kept.collect()}, {r["id"]: r["reason"] for r in dropped.collect()}
    want = resolved_by_loop(records, {i: t for i, t in clean.items() if t is not None})
    assert got == want


def test_conflict_query_equals_a_sequential_loop(spark, small):

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    clean = {i + 1: r["text"] for i, r in docs.items() if (i + 1) % 3 and r["text"] is not None}
    kept, dropped = resolved_by_loop([(i, docs[i]["text"], docs[i]["source"]) for i in sorted(docs)], clean)
    got = QUERIES["resolved_conflicts"](spark, small).collect()
    assert {r["doc_id"]: r["reason"] for r in got} == dict.fromkeys(kept, "kept") | dropped


# ---------------------------------------------------------------- assignment


@pytest.mark.parametrize("n,m", [(1, 1), (2, 2), (3, 5), (5, 5), (6, 7)])
def test_assignment_equals_all_orders(n, m):
    rng = np.random.default_rng(n * 10 + m)
    cost = np.concatenate([rng.normal(size=(30, n, m)), rng.integers(0, 3, (30, n, m)).astype(float), np.zeros((2, n, m))])
    slots, u, v = assignment.least_cost(cost)
    for c, s, a, b in zip(cost, slots, u, v):
        best = min(sum(c[i, o[i]] for i in range(n)) for o in itertools.permutations(range(m), n))
        assert len(set(s.tolist())) == n and sum(c[i, s[i]] for i in range(n)) == pytest.approx(best)
        assert (c - a[:, None] - b[None] >= -1e-9).all() and (b <= 1e-9).all() and a.sum() + b.sum() == pytest.approx(best)


def test_large_assignments_meet_their_bound():
    cost = np.random.default_rng(3).random((4, 60, 80))
    slots, u, v = assignment.least_cost(cost)
    assert np.take_along_axis(cost, slots[:, :, None], 2).sum(axis=(1, 2)) == pytest.approx(u.sum(axis=1) + v.sum(axis=1))
    with pytest.raises(ValueError, match="more rows"):
        assignment.least_cost(cost.transpose(0, 2, 1))


def test_assigned_rows_in_space(spark):
    rng = random.Random(5)
    rows = [(g, k, rng.random(), rng.random(), rng.random()) for g in range(25) for k in range(1 + g % 6)]
    df = spark.createDataFrame(rows, "g int, k int, x double, y double, z double").repartition(3)
    slots = F.transform(F.sequence(F.lit(0), F.size("m")), lambda i: F.array(i / 5.0, i / 7.0, F.lit(0.5)))
    for r in swarm.assigned(df, ["g"], "k", ["x", "y", "z"], slots).collect():
        mine = [p[2:] for p in rows if p[0] == r["g"]]
        at = [(i / 5, i / 7, 0.5) for i in range(len(mine) + 1)]
        total = lambda o: sum(math.dist(p, at[s]) ** 2 for p, s in zip(mine, o))  # noqa: E731, B023
        assert r["cost"] == pytest.approx(min(map(total, itertools.permutations(range(len(at)), len(mine))))) and total(r["slots"]) == pytest.approx(r["cost"])


def test_assignment_of_nothing(spark):
    df = spark.createDataFrame([(None, [[1.0]]), ([[1.0], [2.0]], [[1.0]]), ([], [])], "p array<array<double>>, s array<array<double>>")
    got = [r["a"] for r in df.select(assignment.nearest_slots("p", "s").alias("a")).collect()]
    assert [(a["slots"], a["cost"]) if a else None for a in got][:2] in ([None, None], [(None, None), (None, None)]) and got[2]["slots"] == []


# ---------------------------------------------------------------- ranks


@pytest.mark.parametrize("small_groups", [6, 100_000])
def test_order_statistics_equal_sorting(spark, small_groups):
    rng = random.Random(11)
    values = {
        "even": [rng.uniform(-1, 1) for _ in range(700)], "equal": [2.5] * 300, "two": [1.0] * 250 + [9.0], "steep": [10.0 ** rng.uniform(-300, 300) * rng.choice((-1, 1)) for _ in range(400)],
        "odd": [float("inf"), float("-inf"), 0.0, -0.0, 5e-324, float("nan"), 1.0, 2.0] * 9, "one": [4.0], None: [float(i % 17) for i in range(200)],
    }
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("even", None), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    points = {"p50": (0.5, False), "p95": (0.95, False), "p0": (0.0, False), "top": (1.0, False), "mid": (0.5, True), "q3": (0.75, True)}
    got = {r["g"]: r for r in ranks.order_statistics(df, ["g"], "v", points, small=small_groups).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        vs = sorted(vs, key=lambda v: (math.isnan(v), v))
        for name, (p, between) in points.items():
            if between:
                h = p * (len(vs) - 1)
                low, high = vs[math.floor(h)], vs[math.ceil(h)]
                want = low if low == high or h == math.floor(h) else low + (h - math.floor(h)) * (high - low)
            else:
                want = vs[max(math.ceil(round(p * len(vs), 9)), 1) - 1]
            assert got[g][name] == pytest.approx(want, rel=1e-12, nan_ok=True), (g, name)


def test_perturbed_query_equals_a_loop(spark, small):

    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    for r in QUERIES["perturbed_text"](spark, small).collect():
        t = texts[r["conv_id"], r["turn"]]
        want = (None, []) if t is None else corpus._perturbed(t, random.Random(f"perturb\x1f{r['conv_id']}/{r['turn']}"))
        assert (r["text"], r["ops"]) == want


# ---------------------------------------------------------------- overlap


@pytest.mark.parametrize("meetings", [1 << 22, -1])
def test_overlap_equals_its_definition(meetings):
    """By lists of runs and by automata, with popular characters too."""
    import difflib

    from sedge.functions import overlap

    rng = random.Random(1)
    for _ in range(700):
        n, letters = rng.choice((3, 20, 60, 250, 320)), "abcdefgh "[: rng.randint(2, 9)]
        a, b = ("".join(rng.choices(letters + x, k=rng.randint(0, n))) for x in ("", "xyzuvw"))
        if rng.random() < 0.5 and a:
            j = rng.randrange(len(a))
            b = a[:j] + rng.choice(letters) + a[j + rng.randint(0, 5) :]
        want = difflib.SequenceMatcher(None, a, b).ratio()
        got = 2.0 * overlap.matched(a, b, meetings) / (len(a) + len(b)) if a or b else 1.0
        assert got == pytest.approx(want, abs=1e-12)
        assert all(overlap.reaches(a, b, t) == (want >= t) for t in (0.3, 0.6, 0.9))


def test_turn_queries_equal_their_definitions(spark, small):
    import difflib

    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    got = {(r["conv_id"], r["turn"]): (r["ratio"], r["alike"]) for r in QUERIES["turn_similarity"](spark, small).collect()}
    pairs = {(c, t): (x, texts[c, t + 1]) for (c, t), x in texts.items() if (c, t + 1) in texts}
    assert set(got) == set(pairs)
    for k, (x, y) in pairs.items():
        want = None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio()
        assert got[k] == ((None, None) if want is None else (pytest.approx(want, abs=1e-9), want >= 0.6))


def test_composed_query_row_by_row(spark, small):
    from sedge.functions.numbers import digits_of

    plain = lambda t: " ".join(re.sub(r"[^\w\s]", "", t.lower()).split())
    texts = {f"{r['conv_id']}/{r['turn']}": r["text"] for r in spark.read.parquet(f"{small}/conversations.parquet").collect()}
    rows = QUERIES["composed_records"](spark, small).collect()
    assert len(rows) == sum(t is not None for t in texts.values())
    import difflib

    for r in rows:
        text = texts[r["id"]]
        heard = re.sub(r"^\s*\S+\s*", "", text)
        if r["variant"] == "clean":
            assert (r["action"], r["transcript"]) == ("kept", text)
            continue
        alike = max(difflib.SequenceMatcher(None, plain(f(text)), plain(f(heard))).ratio() for f in (str.lower, lambda t: digits_of(t.lower())))
        assert r["asr_similarity"] == pytest.approx(alike, abs=1e-9)
        want = "failed" if not heard.strip() else "rejected" if alike < 0.5 else "identical" if plain(heard) == plain(text) else "replaced"
        assert r["action"] == want and r["transcript"] == (heard if want in ("replaced", "identical") else text)


# ---------------------------------------------------------------- commands on VARIANT


def random_command(rng):
    from sedge.functions import command

    def value():
        if rng.random() < 0.55:
            return rng.choice([rng.randint(-60, 60), round(rng.uniform(-60, 60), 2), rng.uniform(-300, 300), 0.25, 2.675, 400, -180, 180, 181.26])
        return rng.choice([True, False, None, "1.5", " 2 ", "x", "1_0", "nan", "inf", "1e1", [], [1], {}, {"a": 1}, 'é"\\\n\x01😀', 1e25, 12345678901234567890, "east"])

    intent = rng.choice([*command.SLOTS] * 3 + ["sing", None, 5, []])
    slots = command.SLOTS.get(intent, ()) if isinstance(intent, str) else ()
    out = {"intent": intent}
    for k in {*slots, *rng.choices(["z", "yaw", "x", "ids", "pos", "dir"], k=int(rng.random() < 0.25))}:
        if rng.random() < 0.3:
            continue
        if k == "ids":
            out[k] = rng.choice([[0], [1, 3, 1], [7], [], ["2", True, None, 2.7, [1]], None, "12", 5, {"1": 2}] if rng.random() < 0.5 else [[0, 1], [4]])
        elif k == "shape":
            out[k] = rng.choice([*command.SHAPES] * 4 + ["blob", 3])
        elif k == "dir":
            out[k] = rng.choice([*command.DIRECTIONS] * 3 + ["sideways", 3, ["east"]])
        elif k == "pos":
            out[k] = rng.choice([[rng.uniform(-80, 80) for _ in range(3)], [rng.randint(-60, 60) for _ in range(3)], [round(rng.uniform(-50, 50), 1) for _ in range(3)], [1, 2], [1, None, 2], ["1", 2, 3], 5])
        else:
            out[k] = value() if rng.random() < 0.4 else round(rng.uniform(-5, 60), rng.choice((0, 1, 2, 3)))
    items = list(out.items())
    rng.shuffle(items)
    return dict(items)


def test_commands_on_variants_equal_the_plain_rules(spark):
    from sedge.functions import command
    from sedge.functions.command_variant import parse_commands

    rng = random.Random(21)
    texts = []
    for _ in range(5000):
        t = json.dumps(random_command(rng), ensure_ascii=rng.random() < 0.5, separators=rng.choice([(",", ":"), (", ", ": ")]))
        if rng.random() < 0.1:
            j = rng.randrange(len(t))
            t = t[:j] + rng.choice('{}[]",: x1') + t[j + rng.randint(0, 1) :]
        texts.append(t)
    texts += ["", "null", "[1]", "5", '"a"', ' {"intent":"hover"} ', '{"intent":"hover"} x', '{"intent":"hover"}],[', '{"intent":"hover","intent":"land"}', None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").repartition(4)
    made = parse_commands(df, "raw")
    assert "Python" not in made._jdf.queryExecution().executedPlan().toString()
    fields = lambda r: (r["canonical"], r["parsed_ok"], r["dispatched"], r["validated"], r["reason"] is None)
    got = {r["i"]: fields(r) for r in made.collect()}
    want = {r["i"]: fields(r) for r in df.select("i", command.parse_command("raw").alias("c")).select("i", "c.*").collect()}
    assert {i: (texts[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(w[4] for w in want.values()) > 1500


def test_one_decimal_is_half_even_on_the_binary_value(spark):
    from sedge.functions import command
    from sedge.functions.command_variant import one_decimal

    rng = random.Random(3)
    xs = [0.25, 0.15, 2.675, -0.05, 0.05, -0.25, 0.75, 0.35, 1e-9, -1e-300, 49.95, 99.95, 0.95, 1e14 + 0.25, 0.0, -0.0, 5e-324, 1e20, 2.0**70 + 2.0**20, 9.949999999999999, 0.9499999999999998]
    xs += [rng.uniform(-200, 200) for _ in range(3000)] + [round(rng.uniform(-50, 50), 2) for _ in range(3000)]
    got = [r["s"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(one_decimal(F.col("x")).alias("s")).collect()]
    assert got == [command.number(x) for x in xs]
