"""Streams with event time: suppression by a joined stream, utterances that a timer ends, a paced source of frames, a sink that survives replays."""

from __future__ import annotations

import json
import sys
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# ---------------------------------------------------------------- two streams


def suppressed(utterances: DataFrame, reflexes: DataFrame, key: str, name: str, start: str, fired: str, within: str, late: str = "0 seconds") -> DataFrame:
    """Utterances (key, name, start: a timestamp) with the earliest reflex (key, fired: a timestamp) at or after their start and within an interval of it; null where there is none.

    Both streams carry a watermark of `late`: rows that come later than that are dropped, and an
    utterance is given once both watermarks have passed the end of its interval, so the state holds the
    rows of `within` plus `late` and no more. Equal to relational.suppressed for reflexes that aren't later than `within`.
    """
    spoken = utterances.select(F.col(key).alias("_key"), F.col(name).alias("_name"), F.col(start).alias("_start")).withWatermark("_start", late)
    heard = reflexes.select(F.col(key).alias("_other"), F.col(fired).alias("_fired")).withWatermark("_fired", late)
    near = (F.col("_key") == F.col("_other")) & (F.col("_fired") >= F.col("_start")) & (F.col("_fired") <= F.col("_start") + F.expr(f"INTERVAL {within}"))
    pairs = spoken.join(heard, near, "leftOuter")
    first = pairs.groupBy("_key", "_name", "_start").agg(F.min("_fired").alias("reflex"))
    return first.select(F.col("_key").alias(key), F.col("_name").alias(name), F.col("_start").alias(start), "reflex")


# ---------------------------------------------------------------- timers


def timed_endpoints(stream: DataFrame, key: str, order: str, at: str, prob: str, idle_ms: int, late: str = "0 seconds", onset: float = 0.5, hysteresis: float = 0.15, silence: int = 14, pad: int = 6, longest: int = 468) -> DataFrame:
    """Utterances as stateful.endpoints gives them, and one that is still open when its key has been silent for idle_ms of event time: a timer ends it as `silence` more quiet frames would have (`timer` true), and the key's state goes.

    A key's state is five numbers; the timer is set from the latest event time of its rows, and fires when the
    watermark, `late` behind the newest row of all keys, has passed it. A key that speaks again starts anew.
    """
    quiet = onset - hysteresis

    def advance(state: tuple, p: float) -> tuple[tuple, tuple | None]:
        free, is_open, start, low_since, i = state
        done = i + 1
        if p >= onset:
            low_since = -1
            if not is_open:
                is_open, start = True, max(free, i - pad)
        low = is_open and p < quiet
        if low and low_since < 0:
            low_since = i
        ends = low and done - low_since >= silence
        if not ends and not (is_open and done - start >= longest):
            return (free, is_open, start, low_since, done), None
        return (done, False, 0, -1, done), (start, min(low_since + pad, done) if ends else done, done, not ends)

    def run(k: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, made = held.get if held.exists else (0, False, 0, -1, 0), []
        if held.hasTimedOut:
            for _ in range(silence):
                state, out = advance(state, 0.0)
                if out is not None:
                    made.append((k[0], *out, True))
            held.remove()
        else:
            rows = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")
            for p in rows[prob].tolist():
                state, out = advance(state, p)
                if out is not None:
                    made.append((k[0], *out, False))
            held.update(state)
            held.setTimeoutTimestamp(max(int(rows["_ms"].max()), held.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame(made, columns=[key, "start", "end", "t0", "forced", "timer"])

    rows = stream.select(key, order, prob, F.col(at).alias("_at"), F.unix_millis(at).alias("_ms")).withWatermark("_at", late)
    out = f"{key} bigint, start bigint, end bigint, t0 bigint, forced boolean, timer boolean"
    return rows.groupBy(key).applyInPandasWithState(run, out, "free bigint, open boolean, start bigint, quiet bigint, i bigint", "append", GroupStateTimeout.EventTimeTimeout)


# ---------------------------------------------------------------- a source of frames


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        super().__init__((path, first, last))
        self.path, self.first, self.last = path, first, last


class _Frames(DataSourceStreamReader):
    """Offsets count frames over all files, in name order; a frame is due `frame_ms` after the one before."""

    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", 16))
        self.columns = [options.get("idColumn", "id"), options.get("samplesColumn", "samples")]
        self.paced = options.get("paced", "false").lower() == "true"
        self.frame_ms = float(options.get("frameMs", 30))
        self.most = int(options.get("maxFramesPerTrigger", 1_000_000))
        self.began = time.monotonic()
        self.given = 0
        self.sizes = self._sizes()

    def _files(self) -> list[Path]:
        root = Path(self.path)
        return sorted(root.glob("*.parquet")) if root.is_dir() else [root]

    def _sizes(self) -> list[tuple[str, int]]:
        """(file, frames in it): of each array of samples its whole frames, the last one padded."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        out = []
        for f in self._files():
            n = sum(pc.sum(pc.divide(pc.add(pc.list_value_length(b.column(0)), self.width - 1), self.width)).as_py() or 0 for b in pq.ParquetFile(f).iter_batches(columns=self.columns[1:]))
            out.append((str(f), n))
        return out

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def latestOffset(self) -> dict:
        end = sum(n for _, n in self.sizes)
        if self.paced:
            end = min(end, int((time.monotonic() - self.began) * 1000 / self.frame_ms))
        self.given = max(self.given, min(end, self.given + self.most))
        return {"frame": self.given}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        out, at = [], 0
        self.given = max(self.given, end["frame"])  # a restart goes on from what was planned
        for path, n in self.sizes:
            first, last = max(start["frame"], at), min(end["frame"], at + n)
            if first < last:
                out.append(_Range(json.dumps([path, at]), first, last))
            at += n
        return out

    def commit(self, end: dict) -> None:
        """Nothing is held for frames that are done: files stay, and offsets are Spark's to keep."""

    def read(self, part: _Range) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        path, at = json.loads(part.path)
        for batch in pq.ParquetFile(path).iter_batches(columns=self.columns):
            for key, samples in zip(batch.column(self.columns[0]).to_pylist(), batch.column(self.columns[1]).to_pylist(), strict=True):
                n = -(-len(samples or ()) // self.width)
                for k in range(max(0, part.first - at), min(n, part.last - at)):
                    frame = [float(x) for x in samples[k * self.width : (k + 1) * self.width]]
                    yield at + k, key, k, frame + [0.0] * (self.width - len(frame)), (at + k) * self.frame_ms / 1000
                at += n


class FrameSource(DataSource):
    """Whole frames of the arrays in Parquet files (id bigint, samples array; idColumn and samplesColumn name them otherwise): `spark.readStream.format("frames")`.

    Options: path (a file or folder that driver and executors share), width (samples a frame, the last one padded
    with zeros), frameMs (a frame's length), paced (true: a frame is given once it is due, counted from the start
    of the query; false: all at once), maxFramesPerTrigger. One partition a file and batch, read from its offset:
    a batch that is run again gives the same frames. Files must be there before the stream starts.
    """

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "frame bigint, id bigint, frame_index bigint, samples array<double>, due_s double"

    def streamReader(self, schema) -> _Frames:
        return _Frames(self.options)


def frame_stream(spark: SparkSession, path: str, **options: object) -> DataFrame:
    # the process that plans a stream's batches doesn't see files added to the session, so the source goes there whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(FrameSource)
    return spark.readStream.format("frames").option("path", path).options(**{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}).load()


# ---------------------------------------------------------------- a sink


class BatchSink:
    """Micro-batches as folders named by their number: each is there once, whole, however often it is run.

    A batch is written beside the others under a name of its own and then renamed into place, which one
    writer of a number can do; a later run of a number that is in place writes nothing. Readers see folders in place only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def put(self, batch: DataFrame, number: int, guarded: dict[str, Column] | None = None) -> bool:
        """Write a batch; False if it was there already. guarded: columns to work out that may fail on a row, as try_ expressions; such a row stays, and its `note` names what failed."""
        place = self._hadoop(f"{self.path}/batch={number:09d}")
        if self._files.exists(place):
            return False
        out = batch
        if guarded:
            failed = F.filter(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in guarded.items()]).cast("array<string>"), lambda x: x.isNotNull())
            out = batch.select("*", *[c.alias(name) for name, c in guarded.items()], F.concat_ws(", ", failed).alias("note"))
        trial = self._hadoop(f"{self.path}/_trial-{number:09d}-{uuid.uuid4().hex}")
        out.write.parquet(trial.toString())
        # renaming a folder onto one that is there would move it inside, so a lost race shows as a folder within
        if not self._files.exists(place) and self._files.rename(trial, place):
            inner = self._hadoop(place, trial.getName())
            if not self._files.exists(inner):
                return True
            self._files.delete(inner, True)
            return False
        self._files.delete(trial, True)
        return False

    def stream(self, stream: DataFrame, checkpoint: str, guarded: dict[str, Column] | None = None):
        """A writer of the stream's micro-batches."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.put(batch, number, guarded) and None).option("checkpointLocation", checkpoint)

    def read(self) -> DataFrame:
        """All rows in place, without the batches' numbers."""
        return self.spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*").drop("batch")
