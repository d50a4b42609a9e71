"""Corpus building: generation, perturbation, composition, deduplication and integrity gates."""

from __future__ import annotations

import random
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.command import DIRECTIONS, DRONES, LIMITS, SHAPES, SLOTS, canonical, canonical_column
from ..functions.numbers import digits_of, spell
from ..functions.overlap import ratio
from ..functions.text import normalise_transcript
from ..schemas import RECORD_COLUMNS
from ..sources.shared import stored


def to_record(df: DataFrame, **overrides: Column) -> DataFrame:
    """The declared record columns in order (overrides replace them, missing ones are null), then overrides that aren't declared; a generation variant is kept as source_variant."""
    have = set(df.columns)
    declared = [overrides.get(c, F.col(c) if c in have else F.lit(None)).alias(c) for c in RECORD_COLUMNS]
    extra = [v.alias(k) for k, v in overrides.items() if k not in RECORD_COLUMNS]
    source = [F.col("variant").alias("source_variant")] if "variant" in have and "variant" in overrides else []
    return df.select(*declared, *source, *extra)


# ---------------------------------------------------------------- deduplication


def dedup_first(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each normalised text."""
    row = F.struct(*df.columns)
    return df.withColumn("_k", normalise_transcript(F.col(text))).groupBy("_k").agg(F.min_by(row, order).alias("r")).select("r.*")


def dedup_conflicts(df: DataFrame, text: str, label: str, order: str) -> DataFrame:
    """Texts that carry more than one label: key, first label, number of labels and rows."""
    keyed = df.withColumn("norm", normalise_transcript(F.col(text)))
    return keyed.groupBy("norm").agg(F.count("*").alias("n_rows"), F.countDistinct(label).alias("n_labels"), F.min_by(label, order).alias("first_label")).where("n_labels > 1")


def dedup_resolved(records: DataFrame, clean: DataFrame, key: str, text: str, label: str, order: str, rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): rows taken in order, each text kept once. A row whose text is held with the same label is dropped as a duplicate. On another label the newcomer goes back to its clean text, if it has one that differs, and is judged at once in that text's group; else the holder does so, and the newcomer holds the text; else the newcomer is dropped as a conflict.

    What a sequential loop decides row by row follows from few minima of each group: who comes first,
    and the first clean row with another label, which takes over from an augmented first one. Each
    arrival has a time (the row in whose turn it comes, and how many reverts it took), so groups
    are judged independently. Only groups whose arrivals changed are judged again: at first those
    with two labels, then those that rows newly went back to. Rounds number the longest chain of
    reverts. Groups meet by digests of their normalised texts; a null text is an empty one. `order` must be unique.
    """
    spark = records.sparkSession
    digest = lambda c: F.md5(normalise_transcript(F.coalesce(c, F.lit(""))).cast("binary"))
    back = clean.select(F.col(key).alias("_key"), F.col(text).alias("_clean"))
    joined = records.join(back, records[key] == back["_key"], "left").drop("_key")
    held = F.struct(*[F.col(c) for c in records.columns]).alias("row")
    base = joined.select(F.col(order).cast("bigint").alias("id"), digest(F.col(text)).alias("g"), digest(F.coalesce("_clean", text)).alias("c"), F.xxhash64(label).alias("label"), F.col("_clean").alias("clean"), held)
    base = stored(base.withColumn("aug", F.col("g") != F.col("c")), "records")
    rows = base.select("id", "g", "c", "label", "aug")

    def arrivals(groups: DataFrame | None, reverted: DataFrame) -> DataFrame:
        """id, g, c, label, aug, at (turn, reverts) of all that enters the groups (all, if none are named)."""
        first = rows.withColumn("at", F.struct(F.col("id").alias("turn"), F.lit(0).alias("step")))
        later = reverted.select("id", F.col("c").alias("g"), "c", "label", F.lit(False).alias("aug"), "at")
        both = first.unionByName(later)
        return both if groups is None else both.join(groups, "g", "left_semi")

    def judged(entered: DataFrame) -> DataFrame:
        """Arrivals with who holds their group from when: first, and taker (null if none takes over), as structs at, id, label."""
        who = F.struct("at", "id", "label", "aug")
        first = entered.groupBy("g").agg(F.min(who).alias("first"))
        # per label the first clean arrival, so that a group of any size is a few rows
        taker = entered.where("not aug").groupBy("g", "label").agg(F.min(F.struct("at", "id", "label")).alias("t")).join(first, "g").where("first.aug and label <> first.label").groupBy("g").agg(F.min("t").alias("taker"))
        return entered.join(first.join(taker, "g", "left"), "g")

    def reverts(groups: DataFrame | None, reverted: DataFrame) -> DataFrame:
        """id, source group, clean group, label and arrival there of what the groups send back."""
        j = judged(arrivals(groups, reverted))
        in_force = F.when(F.col("taker").isNotNull() & (F.col("taker.at") < F.col("at")), F.col("taker.label")).otherwise(F.col("first.label"))
        newcomer = F.col("aug") & (F.col("id") != F.col("first.id")) & (F.col("label") != in_force)
        ousted = F.col("aug") & (F.col("id") == F.col("first.id")) & F.col("taker").isNotNull()
        since = F.when(ousted, F.col("taker.at")).otherwise(F.col("at"))
        return j.where(newcomer | ousted).select("id", F.col("g").alias("source"), "c", "label", F.struct(since["turn"].alias("turn"), (since["step"] + 1).alias("step")).alias("at"))

    reverted = spark.createDataFrame([], "id bigint, source string, c string, label bigint, at struct<turn:bigint,step:int>")
    touched = rows.groupBy("g").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("g")
    for _ in range(rounds):
        touched = stored(touched, "touched")
        now = stored(reverts(touched, reverted), "reverts")
        kept_before = reverted.join(touched, reverted["source"] == touched["g"], "left_anti")
        before = reverted.join(touched, reverted["source"] == touched["g"], "left_semi")
        moved = lambda df: df.select("id", "c", "at")
        changed = stored(moved(now).exceptAll(moved(before)).unionByName(moved(before).exceptAll(moved(now))), "changed")
        reverted = stored(kept_before.unionByName(now), "reverted")
        if not changed.limit(1).count():
            break
        touched = changed.select(F.col("c").alias("g")).distinct()
    else:
        raise RuntimeError("conflicts did not settle")
    final = judged(arrivals(None, reverted))
    gone = reverted.select("id", F.col("at").alias("went"))
    final = final.join(gone, "id", "left").where(F.col("went").isNull() | (F.col("at") == F.col("went")))
    holder = F.coalesce("taker.id", "first.id")
    label_then = F.when(F.col("taker").isNotNull() & (F.col("taker.at") < F.col("at")), F.col("taker.label")).otherwise(F.col("first.label"))
    final = final.select("id", F.col("went").isNotNull().alias("back"), (F.col("id") == holder).alias("holds"), F.when(F.col("label") == label_then, "duplicate").otherwise("conflict").alias("reason"))
    out = stored(base.join(final, "id").select(*[(F.when(F.col("back"), F.col("clean")).otherwise(F.col(f"row.`{c}`")) if c == text else F.col(f"row.`{c}`")).alias(c) for c in records.columns], F.col("holds").alias("_holds"), "reason"), "resolved")
    return out.where("_holds").select(*records.columns), out.where("not _holds").select(*records.columns, "reason")


# ---------------------------------------------------------------- composition


@F.pandas_udf(T.DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The larger Ratcliff-Obershelp ratio of two texts, as they are and with numbers as digits."""

    def one(x, y):
        plain = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t.lower())).strip()
        pairs = [(plain(x), plain(y)), (plain(digits_of(x.lower())), plain(digits_of(y.lower())))]
        return max(ratio(p, q) for p, q in dict.fromkeys(pairs))

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def compose(train: DataFrame, roundtrip: DataFrame, least: float) -> DataFrame:
    """Train rows with `action` and their final transcript: clean ones stay; recognised ones replace the text if they are similar enough, else the row is rejected; missing or failed ones stay clean."""
    last = roundtrip.groupBy("id").agg(F.max_by(F.struct("asr_transcript", "asr_ok"), "pos").alias("r")) if "pos" in roundtrip.columns else roundtrip.groupBy("id").agg(F.max(F.struct("asr_transcript", "asr_ok")).alias("r"))
    joined = train.join(last, "id", "left").withColumn("asr_similarity", text_similarity(F.col("transcript"), F.col("r.asr_transcript")))
    action = (
        F.when(~F.col("variant").isin("tts_clean", "tts_noise"), "kept").when(F.col("r").isNull(), "missing").when(~F.coalesce(F.col("r.asr_ok"), F.lit(False)) | (F.trim(F.col("r.asr_transcript")) == ""), "failed")
        .when(F.col("asr_similarity") < least, "rejected").when(normalise_transcript(F.col("r.asr_transcript")) == normalise_transcript(F.col("transcript")), "identical").otherwise("replaced")
    )
    return joined.withColumn("action", action).withColumn("transcript", F.when(F.col("action").isin("replaced", "identical"), F.col("r.asr_transcript")).otherwise(F.col("transcript"))).drop("r")


# ---------------------------------------------------------------- perturbation and generation

#: Words that sound alike, in pairs.
HOMOPHONES = {"two": "to", "to": "two", "four": "for", "for": "four", "right": "write", "write": "right", "eight": "ate", "ate": "eight", "one": "won", "won": "one"}


def _perturbed(text: str, rng: random.Random) -> tuple[str, list[str]]:
    def swap(t: str) -> str:
        found = [w for w in re.findall(r"\w+", t.lower()) if w in HOMOPHONES]
        return re.sub(rf"\b{(w := rng.choice(found))}\b", HOMOPHONES[w], t, count=1, flags=re.I) if found else t

    operations = {
        "strip_punctuation": lambda t: re.sub(r"\s+", " ", re.sub(r"(?<!\d)\.|\.(?!\d)|[^\w\s.]", "", t)).strip(),
        "drop_article": lambda t: re.sub(r"\b(?:the|a|an) ", "", t, count=1, flags=re.I),
        "swap_homophone": swap,
        "digitise_number": digits_of,
        "lowercase": str.lower,
    }
    done = []
    for name in rng.sample(sorted(operations), rng.choice((1, 2))):
        after = operations[name](text)
        if after != text:
            text, done = after, [*done, name]
    return text, done


@F.pandas_udf(T.StructType().add("text", "string").add("ops", T.ArrayType(T.StringType())))
def perturb(text: pd.Series, key: pd.Series) -> pd.DataFrame:
    """One or two of five text changes, chosen by the row's key; ops names those that changed anything."""
    return pd.DataFrame([(None, []) if t is None else _perturbed(t, random.Random(f"perturb\x1f{k}")) for t, k in zip(text, key, strict=True)], columns=["text", "ops"])


def sample_command(intent: str, rng: random.Random) -> dict:
    """A valid command of an intent with values on the 0.1 grid."""
    grid = lambda lo, hi: rng.randrange(round(lo * 10), round(hi * 10) + 1) / 10
    out: dict = {"intent": intent}
    if intent == "formation":
        out["shape"] = shape = rng.choice(SHAPES)
        if shape == "circle":
            out["radius"] = grid(*LIMITS["radius"])
        elif shape != "flock":
            out["spacing"] = grid(*LIMITS["spacing"])
    elif intent == "move":
        if rng.random() < 0.5:
            out["pos"] = [grid(-25, 25), grid(-25, 25), grid(*LIMITS["z"])]
        else:
            out |= {"dir": rng.choice(DIRECTIONS), "dist": grid(0.5, LIMITS["dist"][1])}
    elif intent in ("altitude", "takeoff"):
        out["z"] = grid(*LIMITS["z"])
    elif intent == "rotate":
        out["yaw"] = grid(-180, 180)
    elif intent == "set_param":
        slot = rng.choice(SLOTS["set_param"])
        out[slot] = grid(*LIMITS[slot])
    if "ids" in SLOTS[intent] and rng.random() < 0.4:
        out["ids"] = sorted(rng.sample(range(DRONES), rng.randrange(1, DRONES)))
    return out


def realise(command: dict, rng: random.Random) -> str:
    """A transcript that asks for the command."""
    c = command
    words = {
        "formation": lambda: f"form a {c['shape']}" + (f" with radius {spell(c['radius'])}" if "radius" in c else "") + (f" with spacing {spell(c['spacing'])}" if "spacing" in c else ""),
        "move": lambda: f"go {c['dir']} {spell(c['dist'])} meters" if "dir" in c else "move to " + " ".join(spell(v) for v in c["pos"]),
        "altitude": lambda: f"climb to {spell(c['z'])} meters",
        "takeoff": lambda: f"take off to {spell(c['z'])} meters",
        "land": lambda: rng.choice(("land now", "set down")),
        "hover": lambda: rng.choice(("hold position", "hover")),
        "abort": lambda: rng.choice(("abort", "abort the mission")),
        "rotate": lambda: f"turn to {spell(c['yaw'])} degrees",
        "set_param": lambda: "set " + " and ".join(f"{k} to {spell(v)}" for k, v in c.items() if k not in ("intent", "ids")),
        "unknown": lambda: rng.choice(("what time is it", "play some music", "how is the weather")),
    }[c["intent"]]()
    if "ids" in c:
        words = f"drone {' and '.join(spell(i + 1) for i in c['ids'])} {words}"
    return f"{rng.choice(('', 'please ', 'okay '))}{words}"


def generate(spark: SparkSession, n: int, seed: int = 42, parts: int | None = None) -> DataFrame:
    """n rows (id, gold_intent, transcript, target): each depends on its own number and the seed only, so parts may be made anywhere, in any order, again."""
    intents = sorted(SLOTS)

    def make(it):
        for pdf in it:
            rows = []
            for i in pdf["id"]:
                rng = random.Random(f"{seed}\x1f{i}")
                command = sample_command(intents[i % len(intents)], rng)
                rows.append((f"g{i:08d}", command["intent"], realise(command, rng), canonical(command)))
            yield pd.DataFrame(rows, columns=["id", "gold_intent", "transcript", "target"])

    return spark.range(0, n, 1, parts).mapInPandas(make, "id string, gold_intent string, transcript string, target string")


# ---------------------------------------------------------------- gates


def row_violations(df: DataFrame, grammar_ok: Column, canonical_ok: Column) -> DataFrame:
    """Rows that break an invariant, with the names of those broken."""
    checks = {
        "grammar": grammar_ok,
        "canonical": canonical_ok,
        "intent": F.get_json_object("target", "$.intent") == F.col("gold_intent"),
        "blank": F.trim("transcript") != "",
        "case": F.col("transcript") == F.lower("transcript"),
        "terminal": ~F.col("transcript").rlike(r"[.!?]$"),
    }
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("broken", broken).where(F.size("broken") > 0)


def missing_values(df: DataFrame, expected: dict[str, list[str]]) -> DataFrame:
    """axis, value pairs that should occur and don't."""
    spark = df.sparkSession
    want = spark.createDataFrame([(a, v) for a, vs in expected.items() for v in vs], "axis string, value string")
    seen = df.select(*[F.col(a).cast("string").alias(a) for a in expected]).unpivot([], list(expected), "axis", "value").distinct()
    return want.join(seen, ["axis", "value"], "left_anti")


def axis_histogram(df: DataFrame, axes: list[str]) -> DataFrame:
    return df.select(*[F.col(a).cast("string").alias(a) for a in axes]).unpivot([], axes, "axis", "value").groupBy("axis", "value").agg(F.count("*").alias("n"))


def budget_breaches(df: DataFrame, group: str, least: int, authored: DataFrame) -> DataFrame:
    """Groups whose count isn't max(least, authored), among all that either side has."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    want = authored.select(group, F.greatest(F.lit(least), F.col("authored")).alias("want"))
    return counts.join(want, group, "full_outer").where(~F.col("n").eqNullSafe(F.col("want")))


def canonical_ok(target: Column) -> Column:
    """Whether a target is its own canonical form (typed path)."""
    from ..schemas import COMMAND

    return canonical_column(F.from_json(target, COMMAND)) == target


