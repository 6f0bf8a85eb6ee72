"""Exact distinct users as mergeable bitmaps.

``bitmap_construct_agg`` sets one bit per user; a bucket covers 32,768 consecutive ids and its
bitmap is at most 4 KB, however many sessions the user has.  Bitmaps of two days, batches or partitions
merge by OR, so a distinct count over any set of days reads the days' bitmaps and never
the sessions again, and it is exact.  The partial aggregate runs before the shuffle: a hot user is one bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_bitmaps(rows: DataFrame, ts_col: str, id_col: str = "user_id") -> DataFrame:
    """(day, bucket, bitmap) of the ids in ``rows``; a NULL id is no one."""
    known = rows.where(F.col(id_col).isNotNull())
    return (known.groupBy(F.to_date(ts_col).alias("day"), F.bitmap_bucket_number(id_col).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(id_col)).alias("bitmap")))


def merged(bitmaps: DataFrame, *keys: str) -> DataFrame:
    """One bitmap per keys and bucket."""
    return bitmaps.groupBy(*keys, "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def distinct_counts(bitmaps: DataFrame, *keys: str, name: str = "unique_users") -> DataFrame:
    """Exact distinct ids per keys."""
    per = merged(bitmaps, *keys).select(*keys, F.bitmap_count("bitmap").alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias(name))


def trailing_distinct(bitmaps: DataFrame, days: int) -> DataFrame:
    """Per day with sessions: distinct users that day and over the ``days`` days that end with it.

    Each day's bitmaps take part in the ``days`` windows that hold it (a constant number)."""
    seen = bitmaps.select(F.col("day").alias("end_day")).distinct()
    ends: Column = F.sequence(F.col("day"), F.date_add("day", days - 1))
    window = bitmaps.withColumn("end_day", F.explode(ends)).join(seen, "end_day", "left_semi")
    over = distinct_counts(window, "end_day", name="users_in_window")
    own = distinct_counts(bitmaps.withColumnRenamed("day", "end_day"), "end_day", name="users_on_day")
    return own.join(over, "end_day").select(F.col("end_day").alias("day"), "users_on_day", "users_in_window")
