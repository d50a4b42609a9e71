"""A bounded, reproducible sample of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, words_of

#: Min-hashes of three-word runs by which near copies in the sample are told; one in common is enough.
SKETCHES = 4


def training_rows(docs: DataFrame, labels: DataFrame, column: str, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most per_class labelled documents of each class.

    The documents of smallest hash win, so the choice is fixed and doesn't lean on their order.
    Held-out documents (crc32 of doc_id mod 3 = 1) are never chosen; of copies and near copies with one label one stays;
    null labels, ids and texts and ids whose labels disagree are left out. The id list is bounded
    by 2 * per_class rows, which is what makes it safe to broadcast.
    """
    clean = (
        labels.select("doc_id", F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most").drop("most")
        .withColumn("h", F.xxhash64("doc_id"))
    )
    chosen = None
    for value in (0, 1):
        part = clean.where(F.col("label") == value).orderBy("h", "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen.drop("h")), "doc_id")
    runs = F.when(F.size("w") < 3, F.array(F.col("w"))).otherwise(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.slice("w", i, 3)))
    rows = rows.withColumn("w", words_of(F.col("text"))).withColumn("runs", runs)
    for k in range(SKETCHES):
        rows = rows.withColumn(f"m{k}", F.array_min(F.transform("runs", lambda r, k=k: F.xxhash64(F.lit(k), r))))
    rows = rows.drop("w", "runs")
    for k in range(SKETCHES):
        rows = rows.groupBy(f"m{k}", "label").agg(F.min_by(F.struct(*rows.columns), F.struct("doc_id", F.xxhash64("text"))).alias("r")).select("r.*")
    return rows.select("doc_id", "text", "label")
