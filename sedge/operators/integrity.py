"""Gates and filters over corpora: what must hold is a relation of findings, empty if it does."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.command import DIRECTIONS, SHAPES
from ..functions.text import normalise_transcript, parse_pattern
from . import similarity

_FINDING = "check string, detail string"


def _finding(check: str, rows: DataFrame, detail: Column) -> DataFrame:
    return rows.select(F.lit(check).alias("check"), detail.cast("string").alias("detail"))


def raise_on_findings(findings: DataFrame) -> DataFrame:
    """The findings, if read at all, as an error."""
    return findings.withColumn("check", F.when(F.col("check").isNotNull(), F.raise_error(F.concat_ws(": ", "check", "detail")).cast("string")))


# ---------------------------------------------------------------- cardinalities and sets


def cardinality_findings(df: DataFrame, key: str, split: str, total: int, per_split: dict[str, int]) -> DataFrame:
    """A total that isn't `total`, keys that occur twice, and splits without their number of rows (declared splits that don't occur have none)."""
    want = df.sparkSession.createDataFrame(list(per_split.items()), "_split string, want bigint")
    counts = df.groupBy(F.col(split).alias("_split")).agg(F.count("*").alias("n"))
    n = df.agg(F.count("*").alias("n")).where(F.col("n") != total)
    twice = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    off = want.join(counts, "_split", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> want")
    return (
        _finding("total", n, F.col("n")).unionByName(_finding("duplicate", twice, F.col(key)))
        .unionByName(_finding("split", off, F.concat_ws(" ", "_split", F.col("n").cast("string"), F.lit("of"), F.col("want").cast("string"))))
    )


def coverage_findings(df: DataFrame, column: str, expected: list[str]) -> DataFrame:
    """Values that should occur and don't (missing), and values that do and shouldn't (unexpected)."""
    want = df.sparkSession.createDataFrame([(v,) for v in expected], "v string")
    seen = df.where(F.col(column).isNotNull()).select(F.col(column).cast("string").alias("v")).distinct()
    return _finding("missing", want.join(seen, "v", "left_anti"), F.col("v")).unionByName(_finding("unexpected", seen.join(want, "v", "left_anti"), F.col("v")))


def empty_side(name: str, rows: DataFrame) -> DataFrame:
    """A finding if rows is empty: a check that compares nothing can't fail."""
    return _finding("empty side", rows.agg(F.count("*").alias("n")).where("n = 0"), F.lit(name))


# ---------------------------------------------------------------- isolation


def split_leakage(reference: DataFrame, held_out: DataFrame, key: str, text: str, family: str | None, threshold: float = 0.85, most: int | None = 10) -> DataFrame:
    """Families on both sides (or a side without any), then held-out texts with an equal or similar reference text, the first `most` by key."""
    found = None
    if family:
        left, right = (d.where(F.col(family).isNotNull()).select(F.col(family).alias("f")).distinct() for d in (reference, held_out))
        found = empty_side("reference", left).unionByName(empty_side("held out", right)).unionByName(_finding("family", left.intersect(right), F.col("f")))
    leaks = similarity.leaks(reference, held_out, key, text, threshold).select("held", F.when(F.col("score") == 1, "equal or same words").otherwise("near").alias("how"))
    first = leaks.orderBy("held").limit(most) if most is not None else leaks
    texts = _finding("text", first, F.concat_ws(" ", F.col("held").cast("string"), "how"))
    return texts if found is None else found.unionByName(texts)


def partition_findings(augment: DataFrame, evaluate: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Resources in both partitions, used ones that aren't the augmenting partition's, and sides without any."""
    a, e, u = (d.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct() for d in (augment, evaluate, used))
    found = [empty_side(name, d) for name, d in (("augment", a), ("evaluate", e), ("used", u))]
    found += [_finding("shared", a.intersect(e), F.col("k")), _finding("strayed", u.join(a, "k", "left_anti"), F.col("k"))]
    return reduce(DataFrame.unionByName, found)


def clip_findings(clips: DataFrame, base: str, split: str, resources: list[str], partition: str, declared: dict[str, str], held_out: str, seconds: str, least_hours: float) -> DataFrame:
    """Bases in several splits, resources heard on both sides of the held-out split (or on one side only), clips whose partition isn't their split's, and too few hours in all.

    Each resource column is compared by itself; nulls are no resource. The partition is checked only
    of clips that have a first resource.
    """
    straddling = clips.groupBy(base).agg(F.countDistinct(split).alias("n")).where("n > 1")
    found = [_finding("straddling", straddling, F.col(base))]
    for r in resources:
        known = clips.where(F.col(r).isNotNull())
        trained, held = (known.where(c).select(F.col(r).alias("k")).distinct() for c in (F.col(split) != held_out, F.col(split) == held_out))
        found += [empty_side(f"{r} trained", trained), empty_side(f"{r} held out", held), _finding(f"shared {r}", trained.intersect(held), F.col("k"))]
    names = F.create_map(*[F.lit(x) for kv in declared.items() for x in kv])
    off = clips.where(F.col(resources[0]).isNotNull() & ~F.col(partition).eqNullSafe(F.try_element_at(names, F.col(split))))
    hours = clips.agg(F.coalesce(F.sum(seconds), F.lit(0.0)).alias("s")).where(F.col("s") / 3600 < least_hours)
    found += [_finding("partition", off.groupBy(split, partition).agg(F.count("*").alias("n")), F.concat_ws(" ", split, partition, F.col("n").cast("string"))), _finding("hours", hours, F.round(F.col("s") / 3600, 2))]
    return reduce(DataFrame.unionByName, found)


# ---------------------------------------------------------------- filters


def eligible(clips: DataFrame, accents: str = "accents", up: str = "up_votes", down: str = "down_votes") -> DataFrame:
    """Clips with an accent, two up votes or more and no down votes; votes that are missing or no numbers drop the clip."""
    return clips.where((F.trim(accents) != "") & (F.col(up).try_cast("int") >= 2) & (F.col(down).try_cast("int") <= 0))


def members_in_range(members: DataFrame, sample: DataFrame, path: str, seconds: str, lo: float, hi: float, most: int, order: str) -> DataFrame:
    """Members whose path is in the sample and whose length is in the range (ends included), the first `most` by order."""
    return members.join(sample.select(path).distinct(), path, "left_semi").where(F.col(seconds).between(lo, hi)).orderBy(order).limit(most)


#: Variants that go through speech, with their noise level in dB.
VARIANT_SNR = {"asr_20db": 20, "asr_10db": 10, "asr_5db": 5}


def needs_roundtrip(variant: Column, levels: dict[str, int] = VARIANT_SNR) -> Column:
    return F.coalesce(variant.isin(*levels), F.lit(False))


def noise_level(variant: Column, levels: dict[str, int] = VARIANT_SNR) -> Column:
    """The signal-to-noise ratio of a variant; null for variants without sound."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), variant)


def roundtrip_plan(rows: DataFrame, variants: DataFrame, key: str, split: str, first: int | None = None) -> DataFrame:
    """Train rows with their variant, those that go through speech, the first few by key if a number is given."""
    plan = rows.where(F.col(split) == "train").join(variants, key).where(needs_roundtrip(F.col("variant")))
    return plan if first is None else plan.orderBy(key).limit(first)


def merge_without_drift(old: DataFrame, new: DataFrame, keys: list[str], fixed: list[str]) -> DataFrame:
    """old with new rows put in their keys' place; an error if a fixed column of a key in both has changed."""
    kept = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in fixed])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in fixed], F.lit(True))
    there = new.join(kept.withColumn("_was", F.lit(True)), keys, "left")
    checked = there.where(F.when(F.col("_was").isNull() | same, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("drift at "), F.concat_ws(", ", *keys))).cast("boolean"))).select(*new.columns)
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(checked)


def pooled(df: DataFrame, label: str, least: int, other: str = "Other") -> DataFrame:
    """df with labels of fewer than `least` rows as `other`; the list of those that stay is as long as rows / least at most."""
    common = df.groupBy(label).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(label).withColumn("_common", F.lit(True))
    return df.join(common, label, "left").withColumn(label, F.when(F.col("_common"), F.col(label)).when(F.col(label).isNotNull(), F.lit(other))).drop("_common")


# ---------------------------------------------------------------- labels and patterns


def rounded(value: Column, kind: str) -> Column:
    """An authored number, or list of numbers, on the grid of one decimal."""
    return F.transform(value, lambda x: F.round(x, 1)) if kind.startswith("array") else F.round(value, 1)


def round_floats(df: DataFrame) -> DataFrame:
    """df with every double and list of doubles rounded to one decimal."""
    kinds = dict(df.dtypes)
    return df.select(*[rounded(F.col(c), k).alias(c) if k in ("double", "float", "array<double>", "array<float>") else F.col(c) for c, k in kinds.items()])


def checked_pattern(pattern: Column) -> Column:
    """parse_pattern() with an error for a shape or direction that isn't one."""
    entries = parse_pattern(pattern)
    bad = lambda k, known: F.map_contains_key(entries, F.lit(k)) & F.try_element_at(entries, F.lit(k)).isNotNull() & ~F.coalesce(F.try_element_at(entries, F.lit(k)).isin(*known), F.lit(False))
    wrong = bad("shape", SHAPES) | bad("dir", DIRECTIONS)
    return F.when(wrong, F.raise_error(F.concat(F.lit("no such value in "), pattern)).cast("map<string,string>")).otherwise(entries)


def pattern_within(pattern: Column, slots: Column) -> Column:
    """Whether a pattern names no slot beyond those given."""
    return F.size(F.array_except(F.map_keys(parse_pattern(pattern)), slots)) == 0


def grammar_report(labels: DataFrame, label: str, ok: Column) -> tuple[DataFrame, DataFrame]:
    """(distinct labels that the grammar rejects, one row with rows, distinct labels and rejects)."""
    distinct = labels.groupBy(label).agg(F.count("*").alias("n")).withColumn("ok", F.coalesce(ok, F.lit(False)))
    return distinct.where(~F.col("ok")).select(label), distinct.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_labels"), F.count_if(~F.col("ok")).alias("n_rejected"))


def unique_across(rows: DataFrame, key: str, text: str, split: str, order: list[str]) -> DataFrame:
    """Rows whose normalised text no row of an earlier split (in the order given) or smaller key has: a corpus whose texts are unique and cross no split.

    Each text's first place is found by partial aggregation, so a text of any frequency is one row per task.
    """
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(split))
    placed = rows.withColumn("_t", normalise_transcript(F.col(text))).withColumn("_p", F.struct(rank.alias("rank"), F.col(key).alias("key")))
    first = placed.groupBy("_t").agg(F.min("_p").alias("_first"))
    return placed.join(first, "_t").where(F.col("_p") == F.col("_first")).select(*rows.columns)
