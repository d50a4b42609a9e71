import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs, with a column whose name an operator might use."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            from pyspark.sql import functions as F

            for name in ("label", "th", "marks", "fp", "score", "piece", "cells", "w", "h", "kept", "tier", "arrival", "_arrival", "starts", "first", "sha", "u", "v", "component_id", "row", "node", "band", "plain", "lines", "unit", "toxic", "quality"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make
