"""T5 poll_deadline: a payment with no callback within 5 minutes times out.

A left-outer stream-stream join of payment creations with callbacks on the
checkout id and ``received_at`` within [created_at, created_at + 5 min].  The
watermarks, ``lateness`` behind each stream's newest event, bound both join
states; unmatched payments come out once no callback for them can be in time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..functions.callbacks import parse_callbacks
from . import runner

PAY_SCHEMA = "checkout_request_id string, payment_id bigint, created_at timestamp_ntz"
CB_SCHEMA = "event_id bigint, received_at timestamp_ntz, body string"
LATENESS_MINUTES = 15


def timeouts(pay: DataFrame, cbs: DataFrame, minutes: int = 5, lateness_minutes: int = LATENESS_MINUTES) -> DataFrame:
    late = f"{int(lateness_minutes)} minutes"
    p = runner.to_event_time(pay, "created_at", "p_ts").withWatermark("p_ts", late)
    c = (runner.to_event_time(parse_callbacks(cbs), "received_at", "c_ts").withWatermark("c_ts", late)
         .select(F.col("checkout_request_id").alias("c_checkout"), "c_ts"))
    cond = ((F.col("checkout_request_id") == F.col("c_checkout")) & (F.col("c_ts") >= F.col("p_ts"))
            & (F.col("c_ts") <= F.col("p_ts") + F.expr(f"INTERVAL {minutes} MINUTES")))
    j = p.join(c, cond, "leftOuter")
    return j.where(F.col("c_checkout").isNull()).select(
        "payment_id", "checkout_request_id", "created_at",
        F.timestamp_add("MINUTE", F.lit(minutes), F.col("created_at")).alias("deadline"))


def run_deadline(spark: SparkSession, payments: DataFrame, callbacks: DataFrame, at: str,
                 slices: int = 3, lateness_minutes: int = LATENESS_MINUTES) -> DataFrame:
    """Payments and callbacks up to the clock, replayed in time order; event time ends at the clock."""
    base = runner.run_folder(spark, "poll_deadline")
    now = clock.at(at)
    end = F.timestamp_add("MINUTE", F.lit(int(lateness_minutes)), now)
    tick_p = spark.range(1).select(F.lit("").alias("checkout_request_id"), F.lit(-1).cast("bigint").alias("payment_id"),
                                   end.alias("created_at"))
    pay = payments.where(F.col("created_at") <= now).select("checkout_request_id", "payment_id", "created_at")
    tick_c = spark.range(1).select(F.lit(-1).cast("bigint").alias("event_id"), end.alias("received_at"),
                                   F.lit('{"Body":{"stkCallback":{"CheckoutRequestID":""}}}').alias("body"))
    cbs = callbacks.where(F.col("received_at") <= now).select("event_id", "received_at", "body")
    replay = runner.Replay([(pay.unionByName(tick_p), "created_at"), (cbs.unionByName(tick_c), "received_at")], base, slices)
    replay.drain(lambda: runner.run_to_parquet(timeouts(
        runner.read_files(spark, replay.paths[0], PAY_SCHEMA), runner.read_files(spark, replay.paths[1], CB_SCHEMA),
        lateness_minutes=lateness_minutes), base))
    # the marker rows are removed only here, after the stream: inside it a filter
    # could be pushed below the watermark and keep event time from advancing
    return spark.read.parquet(f"{base}/out").where(F.col("payment_id").isNotNull() & (F.col("payment_id") >= 0))
