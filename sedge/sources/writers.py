"""Sinks: JSON lines, CSV, ordered files, seals, versioned folders and report blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import csv_cell


def json_lines(df: DataFrame, path: str, order: str | None = None, single: bool = False) -> None:
    """Records with explicit nulls. `single` gives one file in `order`; leave it out for relations of any size, whose parts are then ordered by range."""
    out = df
    if single:
        out = df.orderBy(order).coalesce(1) if order else df.coalesce(1)
    elif order:
        out = df.orderBy(order)
    out.write.option("ignoreNullFields", False).mode("overwrite").json(path)


def in_given_order(df: DataFrame, order: DataFrame, key: str, position: str, path: str) -> None:
    """Labelled rows in an order given elsewhere; ids without a row are left out."""
    rows = df.join(order.select(key, position), key).orderBy(position).drop(position)
    rows.coalesce(1).write.option("ignoreNullFields", False).mode("overwrite").json(path)


def csv(df: DataFrame, path: str) -> None:
    """A CSV with a header; doubles with four decimals, null and NaN blank."""
    cells = [csv_cell(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cells).write.option("header", True).option("emptyValue", "").mode("overwrite").csv(path)


def append_batches(stream: DataFrame, path: str, checkpoint: str, guarded: dict[str, Column] | None = None):
    """Append each micro-batch of a stream to a folder of CSV files as it comes; the header is one file's, the first.

    guarded: columns to work out that may fail on a row, as try_ expressions (null where they do); such
    a row stays, and its column `note` names what failed.
    """

    def put(batch: DataFrame, number: int) -> None:
        made = guarded or {}
        failed = F.filter(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in made.items()]).cast("array<string>"), lambda x: x.isNotNull())
        out = batch.select("*", *[c.alias(name) for name, c in made.items()], F.concat_ws(", ", failed).alias("note")) if made else batch
        if number == 0:
            batch.sparkSession.createDataFrame([(",".join(out.columns),)], "value string").coalesce(1).write.mode("append").text(path)
        out.write.mode("append").csv(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)


def seal(df: DataFrame, expected: int, path: str) -> tuple[str, bool]:
    """(digest, unchanged) of a relation of exactly `expected` rows. The first call writes the digest; later ones compare and never overwrite. Row digests are summed, so order doesn't matter and nothing is collected."""
    spark = df.sparkSession
    row = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    got = df.agg(F.count("*").alias("n"), F.sum(row).alias("s")).first()
    if got["n"] != expected:
        raise ValueError(f"{got['n']} rows, expected {expected}")
    digest = f"{int(got['s']):x}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return digest, spark.read.json(path).first()["digest"] == digest
    spark.createDataFrame([(digest, expected)], "digest string, items int").withColumn("sealed", F.current_timestamp()).coalesce(1).write.json(path)
    return digest, True


def replace_block(text: str, block: str, begin: str, end: str) -> tuple[str, bool]:
    """text with what stands between two marks replaced; unchanged (and False) if a mark is missing."""
    a = text.find(begin)
    b = text.find(end, a + len(begin)) if a >= 0 else -1
    if b < 0:
        return text, False
    return f"{text[: a + len(begin)]}\n{block}\n{text[b:]}", True


def compact(row: Column) -> Column:
    """A struct as JSON without blanks, nulls written out."""
    return F.to_json(row, {"ignoreNullFields": "false"})


def log_records(df: DataFrame) -> DataFrame:
    """One JSON line a row, nulls included."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A report table of at most `limit` rows; more are an error, as a report is for reading."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda v: "--" if v is None else str(v)
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)])


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
