"""Size-tiered shards with an atomically versioned manifest.

Arrivals are appended as runs: folders of small immutable Parquet shards, each written by the
task that read the rows, without a shuffle. A manifest version lists the live runs with their
rows, bytes and tier; a version is one file, renamed into place, and a rename onto an existing
version fails. The writer that lost then works its change out again on the newest version: an append
is made again, a merge is dropped if another writer has merged one of its runs. Readers take the
newest version, so they see all of a commit or nothing.

Compaction takes runs of similar size (within a factor of their mean, as many as `fan_in` at
least) and merges them into one run of files of about the target size: the scan packs the small
shards into partitions of that size and every partition writes one file, again without a shuffle.
Each merge is a commit of its own. Superseded runs stay readable for `keep` versions more and are
deleted by the commit after that. What a lost executor was writing is written again by its task's next
attempt; an uncommitted run is no version's run.

Only runs are handled on the driver (one per arrival), never files or rows. Nulls, repeated rows and
extra columns of any name are stored as they are; texts of any length are one value; rows of one size
tie by path; an empty table gives no runs.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, unused

TARGET_BYTES = 128 << 20
FAN_IN = 4
#: Runs whose bytes lie within these factors of their group's mean are of similar size.
LOW, HIGH = 0.5, 1.5
ARRIVALS = 8
#: Versions for which superseded runs stay readable, and commits tried before giving up.
KEEP, ATTEMPTS = 2, 20


class LostCommit(RuntimeError):
    """Another writer has made the version."""


@dataclass
class Run:
    path: str
    rows: int
    bytes: int
    files: int
    tier: int


class ShardStore:
    """Runs and manifest versions below one folder of a store that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, keep: int = KEEP):
        self.spark, self.root, self.target_bytes, self.fan_in, self.keep = spark, root, target_bytes, fan_in, keep
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    # ---- manifest

    def version(self) -> int:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return 0
        return max((int(s.getPath().getName()[1:-5]) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v")), default=0)

    def _manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "runs": [], "retired": []}
        return json.loads(self.spark.read.text(f"{self.root}/manifest/v{version:08d}.json", wholetext=True).first()[0])

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**r) for r in self._manifest(version)["runs"]]

    def commit(self, runs: list[Run], base: int) -> int:
        """Make runs the version after base; LostCommit if another writer has made that version."""
        before = self._manifest(base)
        live = {r.path for r in runs}
        retired = [*before["retired"], *({"path": r["path"], "version": base + 1} for r in before["runs"] if r["path"] not in live)]
        over = [r for r in retired if r["version"] <= base + 1 - self.keep]
        target = f"{self.root}/manifest/v{base + 1:08d}.json"
        temporary = f"{self.root}/manifest/.{uuid.uuid4().hex}"
        out = self._fs.create(self._path(temporary), False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "runs": [asdict(r) for r in runs], "retired": [r for r in retired if r not in over]}).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(temporary), self._path(target), options)
        except Py4JJavaError as e:
            self._fs.delete(self._path(temporary), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                raise LostCommit(target) from None
            raise
        for r in over:
            self._fs.delete(self._path(r["path"]), True)
        return base + 1

    def _changed(self, change: Callable[[list[Run]], list[Run] | None]) -> int | None:
        """Commit change(runs of the newest version), again on a newer one if another writer was first; None if change gives None."""
        for _ in range(ATTEMPTS):
            base = self.version()
            runs = change(self.runs(base))
            if runs is None:
                return None
            try:
                return self.commit(runs, base)
            except LostCommit:
                continue
        raise LostCommit(f"{ATTEMPTS} commits were lost in a row")

    # ---- data

    def _measured(self, path: str, schema, tier: int) -> Run:
        summary = self._fs.getContentSummary(self._path(path))
        files = sum(1 for s in self._fs.listStatus(self._path(path)) if s.getPath().getName().startswith("part-"))
        rows = self.spark.read.schema(schema).parquet(path).count()
        return Run(path, rows, int(summary.getLength()), files, tier)

    def append(self, df: DataFrame, arrival: Column, arrivals: int) -> list[Run]:
        """Write each arrival (a number below `arrivals`) as a run of small shards and commit them in order."""
        stage = f"{self.root}/data/{uuid.uuid4().hex}"
        column = unused("arrival", df)
        df.withColumn(column, arrival).write.partitionBy(column).option("compression", "zstd").parquet(stage)
        runs = []
        for k in range(arrivals):
            path = f"{stage}/{column}={k}"
            if self._fs.exists(self._path(path)):
                run = self._measured(path, df.schema, 0)
                self._changed(lambda now, run=run: [*now, run])
                runs.append(run)
        return runs

    def similar(self, runs: list[Run]) -> list[Run]:
        """The largest group of at least fan_in runs of similar size, smallest sizes first."""
        best: list[Run] = []
        group: list[Run] = []
        for run in sorted(runs, key=lambda r: (r.bytes, r.path)):
            mean = sum(r.bytes for r in group) / len(group) if group else run.bytes
            if group and not LOW * mean <= run.bytes <= HIGH * mean:
                best, group = max(best, group, key=len), []
            group.append(run)
        best = max(best, group, key=len)
        return best if len(best) >= self.fan_in else []

    def compact(self, schema) -> int:
        """Merge similar runs until no group is large enough; returns the newest version."""
        while group := self.similar(self.runs()):
            # a session of its own: its scan settings are nobody else's
            own = self.spark.newSession()
            for key, value in (("spark.sql.files.maxPartitionBytes", str(self.target_bytes)), ("spark.sql.files.openCostInBytes", "0"), ("spark.sql.files.minPartitionNum", "1")):
                own.conf.set(key, value)
            path = f"{self.root}/data/{uuid.uuid4().hex}"
            parts = max(1, math.ceil(sum(r.bytes for r in group) / self.target_bytes))
            scan = own.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[r.path for r in group])
            scan.coalesce(parts).write.option("compression", "zstd").parquet(path)
            merged = self._measured(path, schema, max(r.tier for r in group) + 1)
            if merged.rows != sum(r.rows for r in group):
                raise RuntimeError(f"merge of {len(group)} runs kept {merged.rows} rows")
            gone = {r.path for r in group}

            def replaced(now: list[Run], gone=gone, merged=merged) -> list[Run] | None:
                return [*(r for r in now if r.path not in gone), merged] if gone <= {r.path for r in now} else None

            if self._changed(replaced) is None:  # another writer has merged some of them
                self._fs.delete(self._path(path), True)
        return self.version()

    def read(self, schema, version: int | None = None, tier: str | None = None) -> DataFrame:
        """The rows of a version, with the tier of their run in a column of that name if one is given."""
        if version is not None and version < self.version() - self.keep:
            raise ValueError(f"version {version} is no longer kept")
        if tier is not None and tier.lower() in map(str.lower, schema.names):
            raise ValueError(f"the rows have a column {tier} of their own")
        with_tier = lambda df, t: df if tier is None else df.withColumn(tier, F.lit(t))
        out = with_tier(self.spark.createDataFrame([], schema), 0)
        runs = self.runs(version)
        for t in sorted({r.tier for r in runs}):
            out = out.unionByName(with_tier(self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*[r.path for r in runs if r.tier == t]), t))
        return out


def arrival_of(doc_id: Column, arrivals: int = ARRIVALS) -> Column:
    return F.coalesce(F.pmod(doc_id, F.lit(arrivals)), F.lit(0)).cast("int")


def shard(docs: DataFrame, arrivals: int = ARRIVALS, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Append docs in arrivals, compact, and read the committed version: doc_id, tier, text_md5 of every row."""
    store = ShardStore(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}", target_bytes)
    store.append(docs, arrival_of(F.col("doc_id"), arrivals), arrivals)
    store.compact(docs.schema)
    tier = unused("tier", docs)
    return store.read(docs.schema, tier=tier).select("doc_id", F.col(tier).alias("tier"), F.md5("text").alias("text_md5"))


SHARD_SQL = "SELECT doc_id, 1::INTEGER AS tier, md5(text) AS text_md5 FROM documents"
