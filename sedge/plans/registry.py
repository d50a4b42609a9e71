"""Where queries and their SQL are listed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SEED = 42
#: Stable hash in DuckDB, as functions.hashing.stable_key.
HASH = "substr(sha256(concat_ws(chr(31), '{seed}', '{salt}', {key}::VARCHAR)), 1, 16)"
#: functions.text.normalise_transcript and tokens in DuckDB.
NORM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g'))"
TOKENS = "list_filter(string_split({0}, ' '), lambda t: t <> '')"


def query(sql: str | None = None):
    """Register a query by its function's name, with SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
