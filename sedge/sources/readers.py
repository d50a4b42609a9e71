"""Sources: JSON lines, CSV, TSV, tab files, manifests, reports and audio, with declared schemas."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.command import grammar_regex
from ..functions.signal import decode_wav
from ..schemas import RELATIONS


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path of any file system that Spark reads is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: str, missing_ok: bool = True) -> DataFrame:
    """Records of a JSON-lines file; blank lines are skipped. A missing file is an empty relation, or an error if missing_ok is false; a malformed line is always one."""
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def relation(spark: SparkSession, name: str, path: str, missing_ok: bool = True) -> DataFrame:
    """A relation of schemas.RELATIONS from a JSON-lines file."""
    return json_lines(spark, path, RELATIONS[name], missing_ok)


def json_lines_keyed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Of records with one key the last in file order."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("_pos", F.monotonically_increasing_id())
    rows = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r"), "_pos")
    return rows.groupBy(F.col(f"r.{key}")).agg(F.max_by("r", "_pos").alias("r")).select("r.*")


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with a header; every column a string, blanks null. Columns are taken by name."""
    raw = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return raw.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns])


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated file with a header and no quoting."""
    return spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)


def key_text(spark: SparkSession, path: str) -> DataFrame:
    """id, text of a file with one tab a line; blank lines dropped, only the first tab splits."""
    parts = F.split("value", "\t", 2)
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("id"), F.get(parts, F.lit(1)).alias("text"))


def class_labels(spark: SparkSession, path: str) -> DataFrame:
    """id, text of a tab file with the class that the text names: its blanks as underscores."""
    return key_text(spark, path).withColumn("class", F.regexp_replace(F.trim("text"), " ", "_"))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("id")).where("id <> ''")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """id, target of a JSON-lines file; a line without id is named by its number; one without target is an error."""
    from pyspark.sql import Window

    lines = spark.read.text(path).withColumn("_pos", F.monotonically_increasing_id())
    # numbers of lines need the count of each part of the file before them, not a window over all lines
    part = F.shiftright("_pos", 33)
    counts = lines.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    numbered = lines.withColumn("part", part).join(F.broadcast(counts.select("part", "before")), "part").withColumn("line", F.col("before") + F.col("_pos").bitwiseAND((1 << 33) - 1) + 1)
    row = F.from_json("value", "id string, target string", {"mode": "FAILFAST"})
    out = numbered.where(F.trim("value") != "").select(F.coalesce(row["id"], F.col("line").cast("string")).alias("id"), row["target"].alias("target"), "line")
    return out.withColumn("target", F.coalesce("target", F.raise_error(F.concat(F.lit("no target in line "), F.col("line").cast("string"))).cast("string"))).drop("line")


def manifest_clips(spark: SparkSession, path: str, clip_schema: str) -> DataFrame:
    """Rows of the array `clips` in one JSON document."""
    return spark.read.schema(f"clips array<struct<{', '.join(f'{a}:{b}' for a, b in (c.split() for c in clip_schema.split(', ')))}>>").option("multiLine", True).json(path).select(F.explode("clips").alias("c")).select("c.*")


def absolute(df: DataFrame, column: str, root: str) -> DataFrame:
    """df with relative paths below root; those that are absolute already, by a slash or a scheme, stay."""
    path = F.col(column)
    return df.withColumn(column, F.when(path.rlike(r"^(/|[a-zA-Z][\w+.-]*:)"), path).otherwise(F.concat(F.lit(f"{root.rstrip('/')}/"), path)))


def yaml_entries(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """A row for each entry of a flat YAML list (`- key: value`, then `column: value` lines): key and columns as strings; an entry without one of them is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(rf"(?m)^\s*-\s+({key}:.*(?:\n(?!\s*-\s).*)*)"), F.lit(1))).alias("entry"))
    value = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_extract("entry", rf"(?m)^\s*{c}:[ \t]*(.*?)[ \t]*(?:#.*)?$", 1), "[\"']", "")), F.lit(""))
    needed = lambda c: F.coalesce(value(c), F.raise_error(F.concat(F.lit(f"no {c} in "), "entry")).cast("string"))
    return whole.select(needed(key).alias(key), *[needed(c).alias(c) for c in columns])


def grammar(spark: SparkSession, path: str) -> str:
    """A grammar file as a regular expression of whole strings; one small file, read by the driver."""
    return grammar_regex(spark.read.text(path, wholetext=True).first()[0])


def take_seconds(spark: SparkSession, transcripts: DataFrame, path: str) -> DataFrame:
    """transcripts (id, text) with the seconds of each take in a JSON document's map `takes`; 0.0 for an unknown one."""
    takes = spark.read.schema("takes map<string,struct<seconds:double>>").option("multiLine", True).json(path).select(F.explode("takes").alias("id", "take"))
    return transcripts.join(takes.select("id", F.col("take.seconds").alias("seconds")), "id", "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))


def scrape(spark: SparkSession, path: str, pattern: str, times: int) -> list[str]:
    """The first group of a pattern wherever a report has it; an error unless that is `times` times."""
    found = spark.read.text(path, wholetext=True).select(F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("x"))
    hits = [h for r in found.collect() for h in r["x"]]  # one report
    if len(hits) != times:
        raise ValueError(f"{path}: {len(hits)} matches of {pattern!r}, expected {times}")
    return hits


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction files with model, quant, grammar and split from names like model__quant__grammar__split.jsonl."""
    from ..schemas import PREDICTION

    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.jsonl)?$", 1)
    parts = F.split(name, "__")
    return spark.read.schema(PREDICTION).json(path).select("*", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(("model", "quant", "grammar", "split"))])


def audio(spark: SparkSession, path: str) -> DataFrame:
    """path, rate, samples of WAV files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").option("recursiveFileLookup", True).load(path)
    return files.select("path", decode_wav(F.col("content")).alias("a")).select("path", "a.rate", "a.samples")


def tar_members(spark: SparkSession, path: str, suffix: str = ".wav") -> DataFrame:
    """path, member, rate, samples of the WAV members of tar archives; a task unpacks an archive member by member."""

    def unpack(it):
        import io
        import tarfile

        for pdf in it:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for m in archive:
                        if m.isfile() and m.name.endswith(suffix):
                            yield pd.DataFrame({"path": [where], "member": [m.name], "content": [archive.extractfile(m).read()]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar*").load(path).select("path", "content")
    members = files.mapInPandas(unpack, "path string, member string, content binary")
    return members.select("path", "member", decode_wav(F.col("content")).alias("a")).select("path", "member", "a.rate", "a.samples")


def packed_words(clips: DataFrame, speaker: str, order: str, samples: str, width: int) -> DataFrame:
    """speaker, window, samples: the clips of a speaker in order, end to end, as many to a window as fit whole in `width` samples; longer ones stand alone, cut to it.

    Each clip's window follows from the clips before it, so a speaker's sizes (not samples) are folded once.
    """
    sized = clips.select(speaker, F.col(order).alias("o"), F.least(F.size(samples), F.lit(width)).alias("n"))
    acc = "struct<window:int,room:int,out:array<struct<o:{0},window:int>>>".format(dict(clips.dtypes)[order])
    start = F.struct(F.lit(-1).alias("window"), F.lit(0).alias("room"), F.array().cast(acc[acc.index("out:") + 4 : -1]).alias("out")).cast(acc)

    def step(a, x):
        fits = a["room"] >= x["n"]
        window = F.when(fits, a["window"]).otherwise(a["window"] + 1)
        room = F.when(fits, a["room"]).otherwise(F.lit(width)) - x["n"]
        return F.struct(window.alias("window"), room.alias("room"), F.concat(a["out"], F.array(F.struct(x["o"].alias("o"), window.alias("window")))).alias("out")).cast(acc)

    places = sized.groupBy(speaker).agg(F.array_sort(F.collect_list(F.struct("o", "n"))).alias("xs")).select(speaker, F.inline(F.aggregate("xs", start, step)["out"]))
    dealt = clips.join(places.withColumnRenamed("o", order), [speaker, order])
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.slice(samples, 1, width).alias("s")))), lambda x: x["s"])
    return dealt.groupBy(speaker, "window").agg(F.flatten(parts).alias(samples))


def windows(clips: DataFrame, seconds: float) -> DataFrame:
    """Consecutive windows of whole length of each clip's samples: path, window, rate, samples."""
    width = F.floor(F.col("rate") * seconds).cast("int")
    n = F.floor(F.size("samples") / width).cast("int")
    at = clips.where(n > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("window"))
    return at.withColumn("samples", F.slice("samples", F.col("window") * width + 1, width)).select("path", "window", "rate", "samples")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest entries (name, sha256) whose file is missing or differs."""
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("sha256").alias("found"))
    return manifest.join(have, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("found"))).select("name", "sha256", "found")


def table_counts(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    out = None
    for name, path in paths.items():
        one = spark.read.parquet(path).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out
