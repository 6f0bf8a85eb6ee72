"""T3 expiry_stream: a session emits ``expired`` once event time passes its expires_at;
a disconnect before that cancels it.

Built from Spark's own stream-stream join, no custom state code: each session start is an
event stamped at its ``expires_at``; it is left-outer-joined to the disconnect events of
the same session with ``started_at <= disconnect.ts <= expires_at``, the session's own
span.  A start that no disconnect can match any more -- the watermark has passed its
expires_at -- comes out unmatched, i.e. expired, at that moment, and leaves the state.
The global watermark is the minimum of the two streams, so it follows the
disconnect/clock stream, ``lateness`` behind the newest event: rows that are late by less
than that are joined like any other.

Disconnects stay in the state as long as a session they might belong to can still come.
``longest_hours`` bounds that by the longest session; ``run_expiry`` takes it from the data
(one aggregate), so that the state is bounded by default.  The form with timers, whose state
is the open sessions alone, is in timers.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from . import runner

START_SCHEMA = "session_id bigint, user_id bigint, started_at timestamp_ntz, expires_at timestamp_ntz"
STOP_SCHEMA = "session_id bigint, ts timestamp_ntz"
OUT_SCHEMA = "session_id bigint, user_id bigint, expired_at timestamp"
LATENESS_MINUTES = 15


def expiry_stream(starts: DataFrame, stops: DataFrame, lateness_minutes: int = LATENESS_MINUTES,
                  longest_hours: int | None = None) -> DataFrame:
    late = f"{int(lateness_minutes)} minutes"
    s = runner.to_event_time(starts, "expires_at", "s_exp").withWatermark("s_exp", late)
    d = (runner.to_event_time(stops, "ts", "d_ts").withWatermark("d_ts", late)
         .select(F.col("session_id").alias("d_id"), "d_ts"))
    cond = ((F.col("session_id") == F.col("d_id")) & (F.col("d_ts") <= F.col("s_exp"))
            & (F.col("d_ts") >= F.col("started_at").cast("timestamp")))
    if longest_hours is not None:
        cond = cond & (F.col("d_ts") >= F.col("s_exp") - F.expr(f"INTERVAL {int(longest_hours)} HOURS"))
    j = s.join(d, cond, "leftOuter")
    return j.where(F.col("d_id").isNull()).select("session_id", "user_id", F.col("s_exp").alias("expired_at"))


def run_expiry(spark: SparkSession, sessions: DataFrame, at: str, slices: int = 3,
               lateness_minutes: int = LATENESS_MINUTES) -> DataFrame:
    """Starts and disconnects up to the clock, replayed in time order; event time ends at the clock."""
    base = runner.run_folder(spark, "expiry_stream")
    now = clock.at(at)
    starts = sessions.where(F.col("started_at") <= now).select("session_id", "user_id", "started_at", "expires_at")
    stops = sessions.where((F.col("status") == "disconnected") & (F.col("ended_at") <= now)).select(
        "session_id", F.col("ended_at").alias("ts"))
    # the clock's marker brings the watermark to ``at``.  Its key is not NULL: the join infers
    # IS NOT NULL on the key, and that filter would run below the watermark and swallow it
    end = F.timestamp_add("MINUTE", F.lit(int(lateness_minutes)), now)
    starts = starts.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("session_id"), F.lit(None).cast("bigint").alias("user_id"),
                                                      end.alias("started_at"), end.alias("expires_at")))
    stops = stops.unionByName(spark.range(1).select(F.lit(-1).cast("bigint").alias("session_id"), end.alias("ts")))
    longest = sessions.agg(F.max(F.timestamp_diff("SECOND", F.col("started_at"), F.col("expires_at")))).first()[0] or 0
    replay = runner.Replay([(starts, "started_at"), (stops, "ts")], base, slices)
    replay.drain(lambda: runner.run_to_parquet(expiry_stream(
        runner.read_files(spark, replay.paths[0], START_SCHEMA), runner.read_files(spark, replay.paths[1], STOP_SCHEMA),
        lateness_minutes, -(-longest // 3600)), base))
    # marker rows (session -1) are dropped here, after the stream
    return (spark.read.schema(OUT_SCHEMA).parquet(f"{base}/out").where(F.col("session_id") >= 0)
            .withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz")))
