"""Commands from raw text inside the JVM: canonical form, validation and fallback on VARIANT values.

The same results as command.parse_command, which stays the plain statement of the rules; no Python
worker takes part. Numbers are rounded half to even on their exact binary value by splitting them into parts
whose tenfolds are exact. Reasons are short fixed texts. Left out: the literals NaN and Infinity, which are
no JSON here, and numbers of 2**93 or more, which have no form. Of keys that repeat in an object the last
counts (the session's setting spark.sql.variant.allowDuplicateKeys, else such texts are no JSON).
"""

from __future__ import annotations

import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .command import DIRECTIONS, DRONES, HOVER, LIMITS, REACH, SHAPE_DROPS, SHAPE_NEEDS, SHAPES, SLOTS

#: What may be read as a whole number and as a number out of a string.
_WHOLE = r"^\s*[+-]?\d+(_\d+)*\s*$"
_NUMBER = r"^\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_ENDLESS = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
_BIG, _MOST, _PART = 2.0**62, 2.0**93, 2.0**40
_NAMED = (*LIMITS, "yaw")


def _let(value: Column, body) -> Column:
    """body(value), worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def tenths(x: Column) -> Column:
    """A finite number below 2**62 in tenths, as a bigint: half to even on the exact binary value."""
    whole = F.floor(F.abs(x))

    def split(f: Column) -> Column:
        high = F.floor(f * (1 << 26)) / float(1 << 26)

        def rounded(p: Column) -> Column:
            k, over = F.floor(p["t"]), p["t"] - F.floor(p["t"]) - 0.5 + p["l"]  # exact but for the last sum, whose sign is
            up = (over > 0) & (over < 0.5) | (over == 0) & (k % 2 == 1)
            return F.when(over >= 0.5, k + 1 + F.when((over - 0.5 > 0.5) | (over - 0.5 == 0.5) & ((k + 1) % 2 == 1), 1).otherwise(0)).otherwise(k + F.when(up, 1).otherwise(0))

        return _let(F.struct((high * 10.0).alias("t"), ((f - high) * 10.0).alias("l")), rounded)

    return (whole * 10 + _let(F.abs(x) - whole.cast("double"), split)) * F.when(x < 0, -1).otherwise(1)


def one_decimal(x: Column) -> Column:
    """A number with one decimal; no negative zero."""

    def text(n: Column) -> Column:
        return F.concat(F.when(n < 0, "-").otherwise(""), (F.abs(n) - F.abs(n) % 10).cast("decimal(20,0)").__truediv__(10).cast("bigint").cast("string"), F.lit("."), (F.abs(n) % 10).cast("string"))

    return F.when(F.abs(x) < _BIG / 16, _let(tenths(x), text)).when(F.abs(x) < _MOST, _let(F.floor(F.abs(x) / _PART), lambda high: F.concat(F.when(x < 0, "-").otherwise(""), (high.cast("decimal(20,0)") * F.lit(int(_PART)).cast("decimal(17,0)") + (F.abs(x) - high.cast("double") * _PART).cast("bigint").cast("decimal(19,0)")).cast("string"), F.lit(".0"))))


def _one_place(x: Column) -> Column:
    """The nearest double with one decimal."""
    return tenths(x).cast("double") / 10.0


def quoted(s: Column) -> Column:
    """A JSON string of ASCII characters only."""
    hexes = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(c: Column) -> Column:
        n = F.ascii(c)
        pair = F.concat(hexes(F.shiftright(n - 0x10000, 10) + 0xD800), hexes((n - 0x10000) % 1024 + 0xDC00))
        return F.when(c == '"', '\\"').when(c == "\\", "\\\\").when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t").when(c == "\b", "\\b").when(c == "\f", "\\f").when((n >= 32) & (n < 127), c).when(n < 0x10000, hexes(n)).otherwise(pair)

    plain = s.rlike(r'^[ !#-\[\]-~]*$')
    return F.when(plain, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(s, ""), lambda c: c != ""), one), ""), F.lit('"')))


def _kind(v: Column) -> Column:
    """number, bool, text, list, object or null; null where there is no value."""
    t = F.schema_of_variant(v)
    return F.when(t.startswith("ARRAY"), "list").when(t.startswith("OBJECT"), "object").when(t == "STRING", "text").when(t == "BOOLEAN", "bool").when(t == "VOID", "null").when(t.isNotNull(), "number")


def _get(v: Column, t: str) -> Column:
    return F.try_variant_get(v, "$", t)


def _float(v: Column) -> Column:
    """A value read as a number: null if it can't be, NaN if it isn't finite."""
    s = _get(v, "string")
    number = _get(v, "double")
    read = F.when(s.rlike(_NUMBER), F.regexp_replace(F.trim(F.regexp_replace(s, r"\s", " ")), "_", "").try_cast("double")).when(s.rlike(_ENDLESS), F.lit(float("nan")))
    x = F.when(_kind(v) == "text", read).when(_kind(v).isin("number", "bool"), number)
    return F.when(F.abs(x) == float("inf"), F.lit(float("nan"))).otherwise(x)


def _whole_text(s: Column) -> Column:
    return F.when(s.rlike(_WHOLE), F.regexp_replace(F.trim(F.regexp_replace(s, r"\s", " ")), "_", "").try_cast("decimal(38,0)"))


def _distinct(numbers: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull())))


def _integers(items: Column) -> Column:
    """The distinct whole numbers that a list's values stand for, ascending."""

    def whole(v: Column) -> Column:
        size = F.floor(F.abs(F.coalesce(_get(v, "decimal(38,18)"), _get(v, "double").try_cast("decimal(38,18)"))))
        return F.when(_kind(v) == "text", _whole_text(_get(v, "string"))).when(_kind(v).isin("number", "bool"), F.signum(_get(v, "double")).cast("int") * size.cast("decimal(38,0)"))

    return _distinct(F.transform(items, whole))


def _joined(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def canonical_form(m: Column) -> Column:
    """The canonical form of an object (a map of variants); null if a value has none."""
    intent = F.when(_kind(F.try_element_at(m, F.lit("intent"))) == "text", _get(F.try_element_at(m, F.lit("intent")), "string"))
    table = F.create_map(*[x for k, v in SLOTS.items() for x in (F.lit(k), F.array(F.lit("intent"), *map(F.lit, v)))])
    order = F.coalesce(F.try_element_at(table, intent), F.array(F.lit("intent")))

    def value(k: Column, v: Column) -> Column:
        kind = _kind(v)
        items = _get(v, "array<variant>")
        read = lambda x: _let(_float(x), lambda f: F.when(F.abs(f) < _MOST, one_decimal(f)))
        numbers = F.transform(F.when(kind == "list", items).when(kind == "number", F.array(v)), lambda x: F.when(_kind(x).isin("number", "text"), read(x)))
        chars = F.filter(F.split(_get(v, "string"), ""), lambda c: c != "")
        ids = F.when(kind == "list", _integers(items)).when(kind == "text", _distinct(F.transform(chars, _whole_text))).when(kind == "object", _distinct(F.transform(F.map_keys(_get(v, "map<string,variant>")), _whole_text)))
        other = F.when(kind == "text", quoted(_get(v, "string"))).when(kind == "number", F.get(numbers, F.lit(0))).when((kind == "list") & ~F.exists(numbers, lambda x: x.isNull()), _joined(numbers))
        return F.when(k == "ids", _joined(F.transform(ids, lambda i: i.cast("string")))).otherwise(other)

    empty = lambda v: F.coalesce(F.when(_kind(v) == "list", F.size(_get(v, "array<variant>")) == 0).when(_kind(v) == "text", _get(v, "string") == "").when(_kind(v) == "object", F.size(_get(v, "map<string,variant>")) == 0), F.lit(False))
    held = F.filter(F.map_entries(m), lambda e: (_kind(e["value"]) != "null") & ~((e["key"] == "ids") & empty(e["value"])))
    placed = F.transform(held, lambda e: F.struct(_let(F.array_position(order, e["key"]), lambda p: F.when(p == 0, F.size(order) + 1).otherwise(p)).alias("p"), e["key"].alias("k"), F.concat(quoted(e["key"]), F.lit(":"), value(e["key"], e["value"])).alias("t")))
    texts = F.transform(F.array_sort(placed), lambda x: x["t"])
    return _let(texts, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), F.concat(F.lit("{"), F.array_join(t, ","), F.lit("}"))))


def _drawn_in(x: Column, y: Column, z: Column) -> Column:
    """struct(x, y, z): a point of the 0.1 grid within REACH, as command.clamp_position chooses it."""
    lo, hi = LIMITS["z"]
    height = F.least(F.greatest(z, F.lit(lo)), F.lit(hi))
    away = F.hypot(x, y)
    shrink = F.when(away > 0, F.least(F.lit(1.0), F.sqrt(REACH**2 - height * height) / away)).otherwise(F.lit(1.0))

    def near(p: Column) -> Column:
        """p: the drawn-in point in tenths."""
        # a step past zero goes on to the other side
        inward = lambda t, n: F.when(t > 0, t - n).when(t < 0, t + n).otherwise(t)

        def candidate(k: Column) -> Column:
            i, j = F.floor(k / 4), k % 4
            a, b = inward(p[0], i), inward(p[1], j)
            far = F.sqrt(a / 10.0 * (a / 10.0) + b / 10.0 * (b / 10.0) + p[2] / 10.0 * (p[2] / 10.0))
            return F.when(_one_place(far) <= REACH, F.struct((i + j).alias("n"), F.greatest(F.abs(a), F.abs(b)).alias("far"), j.alias("j"), (a / 10.0).alias("x"), (b / 10.0).alias("y")))

        best = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(15)), candidate), lambda c: c.isNotNull()))
        return _let(best, lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (p[2] / 10.0).alias("z")))

    return _let(F.transform(F.array(x * shrink, y * shrink, height), tenths), near)


def parse_commands(df: DataFrame, raw: str) -> DataFrame:
    """df with canonical (null if there is none), parsed_ok, dispatched, validated and reason of the raw text, as command.parse_command has them."""
    end = uuid.uuid4().hex  # what follows the text in a list tells whether all of it was one value
    pair = _get(F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{end}"]'))), "array<variant>")
    value = F.when((F.size(pair) == 2) & (_get(F.get(pair, F.lit(1)), "string") == end), F.get(pair, F.lit(0)))
    out = df.select("*", value.alias("_v"))
    out = out.select("*", _kind(F.col("_v")).alias("_kind"), F.when(_kind(F.col("_v")) == "object", _get(F.col("_v"), "map<string,variant>")).alias("_m"))
    at = lambda s: F.try_element_at("_m", F.lit(s))
    kind = lambda s: _kind(at(s))
    text = lambda s: F.when(kind(s) == "text", _get(at(s), "string"))
    has = lambda s: F.coalesce(kind(s) != "null", F.lit(False))
    intent, shape = F.col("_intent"), F.col("_shape")
    points = F.transform(_get(at("pos"), "array<variant>"), _float)
    ids = F.filter(_integers(_get(at("ids"), "array<variant>")), lambda i: (i >= 0) & (i < DRONES))
    out = out.select(
        "*", canonical_form(F.col("_m")).alias("canonical"), text("intent").alias("_intent"), text("shape").alias("_shape"), text("dir").alias("_dir"), F.nullif(ids, F.array().cast("array<decimal(38,0)>")).alias("_ids"),
        F.transform(F.array(*[at(s) for s in _NAMED]), _float).alias("_floats"), F.when(kind("pos") == "list", points).alias("_pos"), *[has(s).alias(f"_has_{s}") for s in (*_NAMED, "pos", "dir", "shape")], kind("ids").alias("_ids_kind"), F.map_filter("_m", lambda k, v: _kind(v) != "null").alias("_held"),
    )
    out = out.select("*", *[F.get("_floats", F.lit(k)).alias(f"_{s}") for k, s in enumerate(_NAMED)])
    there = lambda s: F.col(f"_has_{s}")
    table = lambda of: F.create_map(*[x for k, v in of.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    dropped = lambda s: (intent == "formation") & F.coalesce(F.array_contains(F.try_element_at(table(SHAPE_DROPS), shape), s), F.lit(False))
    used = {s: there(s) & ~dropped(s) for s in _NAMED}
    needs = F.filter(F.try_element_at(table(SHAPE_NEEDS), shape), lambda s: ~F.array_contains(F.map_keys("_held"), s))
    declared = F.concat(F.array(F.lit("intent")), F.coalesce(F.try_element_at(table(SLOTS), intent), F.array().cast("array<string>")), F.when(intent == "formation", F.try_element_at(table(SHAPE_DROPS), shape)).otherwise(F.array().cast("array<string>")))
    # ids that name no known drone count as left out
    stray = F.size(F.array_except(F.map_keys("_held"), F.concat(declared, F.when(F.col("_ids").isNull(), F.array(F.lit("ids"))).otherwise(F.array().cast("array<string>"))))) > 0
    way = there("dir") & there("dist")
    number = [(used[s] & F.col(f"_{s}").isNull(), f"{s} is not a number") for s in _NAMED] + [(used[s] & F.isnan(F.col(f"_{s}")), f"{s} is not finite") for s in _NAMED]
    rules: list[tuple[Column, str | Column]] = [
        (F.col("_v").isNull(), "not JSON"), (F.col("_m").isNull(), "not an object"), (intent.isNull() | ~intent.isin(*SLOTS), "no such intent"),
        ((intent != "abort") & F.coalesce(~F.col("_ids_kind").isin("list", "null"), F.lit(False)), "ids is not a list"),
        (intent.isin("abort", "unknown"), F.lit(None).cast("string")),
        ((intent == "formation") & (shape.isNull() | ~shape.isin(*SHAPES)), "no such shape"), ((intent == "formation") & (F.size(needs) > 0), F.concat(shape, F.lit(" needs "), F.get(needs, F.lit(0)))),
        ((intent == "move") & ((there("pos") == way) | there("pos") & (there("dir") | there("dist"))), "move needs pos, or dir and dist"),
        ((intent == "move") & there("dir") & ~F.coalesce(F.col("_dir").isin(*DIRECTIONS), F.lit(False)), "no such direction"),
        ((intent == "move") & there("pos") & ~F.coalesce(F.size("_pos") == 3, F.lit(False)), "pos needs three numbers"),
        ((intent == "altitude") & ~there("z"), "altitude needs z"), ((intent == "rotate") & ~there("yaw"), "rotate needs yaw"), ((intent == "set_param") & ~reduce(or_, [there(s) for s in SLOTS["set_param"]]), "set_param needs a slot"),
        *number, (there("pos") & (F.col("_pos").isNull() | F.exists("_pos", lambda x: x.isNull())), "pos is not of numbers"), (there("pos") & F.exists("_pos", F.isnan), "pos is not finite"), (stray, "undeclared slots"),
    ]
    reason = F.lit(None).cast("string")
    for broken, why in reversed(rules):
        reason = F.when(broken, F.lit(why) if isinstance(why, str) else why).otherwise(reason)
    out = out.select("*", reason.alias("reason"))
    yaw = F.col("_yaw")
    turned = F.transform(F.array(F.when(F.abs(yaw) <= 180, yaw), F.pmod(yaw + 180.0, F.lit(360.0)) - 180.0), _one_place)
    wrapped = _let(turned, lambda t: F.when(F.abs(yaw) <= 180, t[0]).when((t[1] == -180) & (yaw > 0), F.lit(180.0)).otherwise(t[1]))
    ready = F.col("reason").isNull()
    place = F.when(ready & there("pos"), _drawn_in(F.get("_pos", F.lit(0)), F.get("_pos", F.lit(1)), F.get("_pos", F.lit(2))))
    out = out.select("*", place.alias("_place"))
    limited = [F.when(ready & used[s], F.least(F.greatest(f"_{s}", F.lit(LIMITS[s][0])), F.lit(LIMITS[s][1])) if s in LIMITS else wrapped) for s in _NAMED]
    out = out.select("*", F.transform(F.array(*limited, *[F.col("_place")[c] for c in "xyz"]), one_decimal).alias("_texts"))

    def part(s: str) -> Column:
        if s in ("shape", "dir"):
            body = F.concat(F.lit('"'), F.col(f"_{s}"), F.lit('"'))
        elif s == "ids":
            body = _joined(F.transform("_ids", lambda i: i.cast("string")))
        elif s == "pos":
            body = F.when(F.col("_place").isNotNull(), _joined(F.slice("_texts", len(_NAMED) + 1, 3)))
        else:
            body = F.get("_texts", F.lit(_NAMED.index(s)))
        return F.concat(F.lit(f'"{s}":'), body)

    made = F.lit(None).cast("string")
    for name, slots in reversed(SLOTS.items()):
        made = F.when(intent == name, F.concat(F.lit("{"), F.concat_ws(",", F.lit(f'"intent":"{name}"'), *[part(s) for s in slots if name not in ("abort", "unknown")]), F.lit("}"))).otherwise(made)
    return out.select(*df.columns, "canonical", F.col("canonical").isNotNull().alias("parsed_ok"), F.when(ready, intent).otherwise("hover").alias("dispatched"), F.when(ready, made).otherwise(F.lit(HOVER)).alias("validated"), "reason")
