"""Request limits counted over whole tables in fixed windows (epoch-aligned)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phones

EPOCH = "1970-01-01 00:00:00"

# Fixed values: (limiter, window seconds, max requests per window) as the service configures them.
LIMITS = [("general", 900, 100), ("login", 900, 5), ("payment", 60, 10)]


def bucket_start(ts: Column | str, seconds: int) -> Column:
    """Start of the epoch-aligned window of ``seconds`` containing ``ts`` (NTZ arithmetic)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    us = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(EPOCH)), ts)
    return F.timestamp_add("MICROSECOND", -(us % F.lit(seconds * 1_000_000)), ts)


def attempts(events: DataFrame, logins: DataFrame, payments: DataFrame) -> DataFrame:
    """Every request that has a time, with its limiter, key, window start, window length and allowance."""
    spec = {name: (secs, mx) for name, secs, mx in LIMITS}

    def keyed(df, name, key, ts):
        secs, mx = spec[name]
        return df.where(F.col(ts).isNotNull()).select(
            F.lit(name).alias("limiter"), key.alias("key"), F.col(ts).alias("ts"),
            bucket_start(ts, secs).alias("window_start"), F.lit(secs).alias("window_seconds"),
            F.lit(mx).alias("max_allowed"))

    login_key = F.coalesce(phones.normalise("raw_phone"), F.col("raw_phone"))
    return (keyed(events, "general", F.col("user_id").cast("string"), "ts")
            .unionByName(keyed(logins, "login", login_key, "ts"))
            .unionByName(keyed(payments, "payment", F.col("user_id").cast("string"), "created_at")))


def summarise(counted: DataFrame) -> DataFrame:
    return counted.select(
        "limiter", "key", "window_start",
        F.timestamp_add("SECOND", F.col("window_seconds"), F.col("window_start")).alias("window_end"),
        "attempts", "max_allowed", F.greatest(F.col("attempts") - F.col("max_allowed"), F.lit(0)).alias("refused"))


def rate_limit_batch(events: DataFrame, logins: DataFrame, payments: DataFrame) -> DataFrame:
    """Attempts per (limiter, key, window); ``refused`` = attempts beyond the allowance."""
    a = attempts(events, logins, payments)
    c = a.groupBy("limiter", "key", "window_start", "window_seconds", "max_allowed").agg(
        F.count(F.lit(1)).alias("attempts"))
    return summarise(c)
