"""T6 stats_tick: one stats row (A8) appended per trigger, computed incrementally.

The input is a change feed: each row is a session's newest state, and the last row of a
session in a batch (by ``ended_at``, open states first, then by its bytes) is the one that
counts.  A session closes once: rows for a session that is not open are new sessions.  A
tick never rescans the session store.  Each micro-batch leaves small pieces of state, each
in its own ``batch_id=`` folder (a replayed batch rewrites the same folder):

* ``open``: the newest state of the sessions without an end, bounded by live sessions;
  the active count is taken from it, so it falls when a session expires or is cut off;
* ``totals``: one row, the sum and count of closed sessions' durations, added at close;
* ``recent``: bytes of the sessions started in the last hour, the newest state of each;
* ``today``: the distinct users who started a session today, as bitmaps (operators/distinct.py),
  which merge by OR and do not grow with the sessions.

``start_ticks`` runs it on a ``processingTime='60 seconds'`` trigger; tests drain the
input with ``availableNow``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..columns import micros_between
from ..operators.aggregates import stats_columns
from ..operators.distinct import day_bitmaps, merged
from . import runner

OPEN_SCHEMA = "session_id bigint, status string"
TOTALS_SCHEMA = "dur_us decimal(38,0), dur_n bigint"
RECENT_SCHEMA = "session_id bigint, started_at timestamp_ntz, bytes decimal(38,0)"
TODAY_SCHEMA = "day date, bucket bigint, bitmap binary"


def _newest(batch: DataFrame) -> DataFrame:
    """One row per session: its last state in the batch."""
    cols = ["user_id", "started_at", "ended_at", "status", "bytes_downloaded", "bytes_uploaded"]
    last = F.max_by(F.struct(*cols), F.struct(F.col("ended_at").isNotNull(), "ended_at", "bytes_downloaded", "bytes_uploaded"))
    return batch.groupBy("session_id").agg(last.alias("s")).select("session_id", "s.*")


def _tick_fn(spark: SparkSession, base: str, at: str | None):
    def previous(name: str, batch_id: int, schema: str) -> DataFrame:
        """What the batch before wrote; nothing before the first."""
        return runner.batch_before(spark, f"{base}/{name}", batch_id, schema)

    def leave(rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{base}/{name}/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    def tick(batch: DataFrame, batch_id: int) -> None:
        # a fixed clock in tests; a deployment stamps each tick with its own trigger time
        now_s = at or datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        hour_ago, today = clock.minus(now_s, hours=1), clock.day_start(now_s)
        tomorrow = F.timestamp_add("DAY", F.lit(1), today)
        new = _newest(batch).persist()
        ended = F.col("ended_at").isNotNull()

        still = previous("open", batch_id, OPEN_SCHEMA).join(new.select("session_id"), "session_id", "left_anti")
        opened = new.where(~ended).select("session_id", "status")
        live = leave(still.unionByName(opened), "open", batch_id)

        closed = new.where(ended).agg(F.sum(micros_between("started_at", "ended_at").cast("decimal(38,0)")).cast("decimal(38,0)").alias("dur_us"),
                                      F.count(F.lit(1)).alias("dur_n"))
        sums = previous("totals", batch_id, TOTALS_SCHEMA).unionByName(closed)
        totals = leave(sums.agg(F.sum("dur_us").cast("decimal(38,0)").alias("dur_us"), F.coalesce(F.sum("dur_n"), F.lit(0)).cast("bigint").alias("dur_n")),
                       "totals", batch_id)

        bytes_ = (F.coalesce(F.col("bytes_downloaded"), F.lit(0)).cast("decimal(38,0)") + F.coalesce(F.col("bytes_uploaded"), F.lit(0))).cast("decimal(38,0)")
        hour = new.select("session_id", "started_at", bytes_.alias("bytes"))
        kept = previous("recent", batch_id, RECENT_SCHEMA).join(new.select("session_id"), "session_id", "left_anti")
        recent = leave(kept.unionByName(hour).where(F.col("started_at") > hour_ago), "recent", batch_id)

        mine = day_bitmaps(new.where((F.col("started_at") >= today) & (F.col("started_at") < tomorrow)), "started_at")
        users = previous("today", batch_id, TODAY_SCHEMA).where(F.col("day") == F.to_date(today)).unionByName(mine)
        day = leave(merged(users, "day"), "today", batch_id)

        row = totals.select("*", F.coalesce(live.agg(F.count_if(F.col("status") == "active")).scalar(), F.lit(0)).alias("active_sessions_count"),
                            F.coalesce(recent.agg(F.sum("bytes")).scalar(), F.lit(0)).cast("decimal(38,0)").alias("total_bytes_hour"),
                            F.coalesce(day.agg(F.sum(F.bitmap_count("bitmap"))).scalar(), F.lit(0)).alias("unique_users_today"))
        row.select(*stats_columns(), clock.at(now_s).alias("recorded_at")).write.mode("overwrite") \
            .parquet(f"{base}/stats/batch_id={batch_id}")
        new.unpersist()
    return tick


def start_ticks(spark: SparkSession, source_path: str, schema, base: str, every: str = "60 seconds"):
    """Deployment form: a long-running query appending one stats row per ``every`` trigger."""
    stream = runner.read_files(spark, source_path, schema, files_per_batch=1000)
    return runner.run_foreach_batch(stream, base, _tick_fn(spark, base, None), processing_time=every)


def run_ticks(spark: SparkSession, sessions: DataFrame, at: str, slices: int = 3) -> DataFrame:
    """Test form: replay ``sessions`` in time order, one tick per slice; all tick rows with batch ids."""
    base = runner.run_folder(spark, "stats_tick")
    replay = runner.Replay([(sessions, "started_at")], base, slices)
    replay.drain(lambda: runner.run_foreach_batch(runner.read_files(spark, replay.paths[0], sessions.schema), base, _tick_fn(spark, base, at)))
    return spark.read.parquet(f"{base}/stats")


def latest_tick(ticks: DataFrame) -> DataFrame:
    """The newest tick (largest batch id) without its batch id."""
    cols = [c for c in ticks.columns if c != "batch_id"]
    return ticks.agg(F.max_by(F.struct(*cols), "batch_id").alias("t")).select("t.*")
