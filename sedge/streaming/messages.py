"""The message envelope, triggers, and running a stream over what has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import MESSAGE
from ..sources.shared import shared_folder

#: Bytes that a message may have, and how long a drain waits for more once one has come.
MOST_BYTES = 4096
DRAIN = "50 milliseconds"
RING = 500


def to_wire(seq: Column, branch: Column, command: Column, t_publish: Column) -> Column:
    return F.to_json(F.struct(seq.alias("seq"), branch.alias("branch"), command.alias("command"), t_publish.alias("t_publish")))


def from_wire(df: DataFrame, column: str = "value") -> DataFrame:
    """Messages of known branches within the size limit; anything else is dropped."""
    fits = F.octet_length(column) <= MOST_BYTES
    return df.where(fits).select(F.from_json(column, MESSAGE).alias("m")).where(F.col("m.seq").isNotNull() & F.col("m.branch").isin("A", "B")).select("m.*")


def file_source(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1, fmt: str = "json") -> DataFrame:
    """Files of a folder as a stream, a few to a batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def frames(df: DataFrame, samples: str, width: int) -> DataFrame:
    """Rows of whole frames of `width` samples, the last one padded with zeros, with their index."""
    n = F.ceil(F.size(samples) / width).cast("int")
    rows = df.where(F.size(samples) > 0).select("*", F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_index"))
    part = F.slice(samples, F.col("frame_index") * width + 1, width)
    zero = F.array_repeat(F.get(part, F.lit(0)) * 0, width - F.size(part))
    return rows.withColumn("frame", F.concat(part, zero)).drop(samples)


def run_available(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all that has arrived, in micro-batches, and give what it wrote."""
    spark = stream.sparkSession
    out = shared_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def fan_out(stream: DataFrame, consumers: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """One stream, each micro-batch given to several consumers; it is computed once."""

    def both(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for consume in consumers:
                consume(batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)


def ring(df: DataFrame, key: str, order: str, most: int = RING) -> DataFrame:
    """The last `most` rows of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_r") <= most).drop("_r")


def durations(df: DataFrame, marks: list[str]) -> DataFrame:
    """Milliseconds between successive time marks; 0 where either is null."""
    steps = [F.coalesce((F.col(b) - F.col(a)) * 1000, F.lit(0.0)).alias(f"{b}_ms") for a, b in zip(marks, marks[1:], strict=False)]
    return df.select("*", *steps)
