"""T4 rate_limit: the limiter counts as streaming aggregations, one stream per limiter.

Each limiter has its own windows, so each gets its own query and its own watermark: a
payment minute that ends says nothing about a login quarter of an hour.  The watermark
stands on the request's own time, ``lateness`` behind the newest one (a documented
argument; at least one window by default), so a window is final once no request for it is
still expected.  Requests without a time belong to no window.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.limits import LIMITS, attempts, summarise
from . import runner

SCHEMA = ("limiter string, key string, ts timestamp_ntz, window_start timestamp_ntz, window_seconds int, "
          "max_allowed int")
TICK = "tick"


def limit_stream(requests: DataFrame, seconds: int, lateness: str | None = None) -> DataFrame:
    """Requests of one limiter, counted per key and window of ``seconds``."""
    s = runner.to_event_time(requests, "ts", "wm").withWatermark("wm", lateness or f"{seconds} seconds")
    c = s.groupBy("limiter", "key", F.window("wm", f"{seconds} seconds").alias("w"), "window_seconds",
                  "max_allowed").agg(F.count(F.lit(1)).alias("attempts"))
    # tick rows are dropped when the sink is read: a filter here could be pushed
    # below the watermark and the tick would no longer move event time
    return c.select("limiter", "key", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    "window_seconds", "max_allowed", "attempts")


def _closing_tick(requests: DataFrame, seconds: int) -> DataFrame:
    """One row three windows after the last request: it closes every window."""
    return requests.agg(F.max("ts").alias("m")).where(F.col("m").isNotNull()).select(
        F.lit(TICK).alias("limiter"), F.lit("").alias("key"),
        F.timestamp_add("SECOND", F.lit(3 * seconds), F.col("m")).alias("ts"),
        F.lit(None).cast("timestamp_ntz").alias("window_start"), F.lit(seconds).alias("window_seconds"),
        F.lit(0).alias("max_allowed"))


def run_rate_limit(spark: SparkSession, events: DataFrame, logins: DataFrame, payments: DataFrame,
                   slices: int = 2) -> DataFrame:
    """T4 over recorded requests: every limiter's stream drained, all windows closed."""
    requests = attempts(events, logins, payments)

    def counted(limiter: tuple[str, int, int]) -> DataFrame:
        name, seconds, _ = limiter
        base = runner.run_folder(spark, f"rate_limit_{name}")
        mine = requests.where(F.col("limiter") == name)
        replay = runner.Replay([(mine.unionByName(_closing_tick(mine, seconds)), "ts")], base, slices)
        replay.drain(lambda: runner.run_to_parquet(limit_stream(runner.read_files(spark, replay.paths[0], SCHEMA), seconds), base))
        return spark.read.parquet(f"{base}/out").where(F.col("limiter") != TICK)

    with ThreadPoolExecutor(len(LIMITS)) as pool:  # the limiters' queries share nothing, so they run side by side
        outs = list(pool.map(counted, LIMITS))
    return summarise(reduce(DataFrame.unionByName, outs))
