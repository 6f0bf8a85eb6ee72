"""Staging of time-ordered input, and running a stream to completion over it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_path

EPOCH = "1970-01-01 00:00:00"


def run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run (input files, sink, checkpoint) in the shared checkpoint area."""
    return checkpoint_path(spark, f"streams/{name}-{uuid.uuid4().hex}")


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since 1970-01-01 of a TIMESTAMP_NTZ, with no zone involved."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(EPOCH)), ts)


class Replay:
    """Recorded streams, delivered slice by slice in event-time order.

    Each stream is derived and written once.  Slices are cut at shared approximate
    quantiles of all the streams' times (a few numbers on the driver); rows without an
    event time are the first slice.  ``deliver`` appends one slice of every stream to its
    source folder, by as many tasks as the slice needs, so a query restarted after it
    sees new files only and all streams advance together.
    """

    def __init__(self, streams: list[tuple[DataFrame, str]], base: str, slices: int = 4):
        spark = streams[0][0].sparkSession
        self.paths = [f"{base}/in{i}" for i in range(len(streams))]
        self.rows = []
        for i, (df, ts) in enumerate(streams):
            df.withColumn("_us", epoch_micros(ts)).write.parquet(f"{base}/recorded{i}")
            self.rows.append(spark.read.parquet(f"{base}/recorded{i}"))
        times = self.rows[0].select("_us")
        for r in self.rows[1:]:
            times = times.unionByName(r.select("_us"))
        cuts = times.approxQuantile("_us", [i / slices for i in range(1, slices)], 0.001) if slices > 1 else []
        edges = sorted({int(c) for c in cuts})
        bounds = list(zip([None, *edges], [*edges, None]))
        self.slices = [F.col("_us").isNull()] + [self._between(lo, hi) for lo, hi in bounds]
        if not times.where(F.col("_us").isNull()).limit(1).count():
            self.slices = self.slices[1:]

    @staticmethod
    def _between(lo: int | None, hi: int | None) -> Column:
        cond = F.col("_us").isNotNull()
        if lo is not None:
            cond = cond & (F.col("_us") > F.lit(lo))
        if hi is not None:
            cond = cond & (F.col("_us") <= F.lit(hi))
        return cond

    def deliver(self, k: int) -> None:
        for rows, path in zip(self.rows, self.paths):
            rows.where(self.slices[k]).drop("_us").write.mode("append").parquet(path)

    def drain(self, run: Callable[[], object]) -> None:
        """Deliver every slice, calling ``run`` (a query over what is available) after each."""
        for k in range(len(self.slices)):
            self.deliver(k)
            run()


def read_files(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """A file stream; without ``files_per_batch`` everything available is one micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def to_event_time(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Watermarks need TIMESTAMP (with zone); the session zone is UTC, so the instant is the NTZ value."""
    return df.withColumn(name or col, F.col(col).cast("timestamp"))


def run_to_parquet(stream: DataFrame, base: str, mode: str = "append") -> str:
    """Run ``stream`` over everything available, into a parquet file sink; return the sink path."""
    out, ck = f"{base}/out", f"{base}/checkpoint"
    q = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def run_foreach_batch(stream: DataFrame, base: str, fn, processing_time: str | None = None):
    """Run ``stream`` with ``fn(batch_df, batch_id)``.

    Without ``processing_time``: drain everything available, then return.  With it
    (e.g. ``"60 seconds"``): start a long-running query on that trigger and return
    its handle."""
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{base}/checkpoint")
    if processing_time:
        return w.trigger(processingTime=processing_time).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def batch_before(spark: SparkSession, path: str, batch_id: int, schema: str) -> DataFrame:
    """Rows that the micro-batch before this one wrote into its ``batch_id=`` folder (none: an empty table).

    Only that folder is opened, however many batches there were.  A replayed batch reads what
    was there when it first ran."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(f"{path}/batch_id={batch_id - 1}")
    except AnalysisException:  # the first batch
        return spark.createDataFrame([], schema)
