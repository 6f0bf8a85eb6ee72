"""Facts partitioned by day, and the calendar that prunes them while a query runs.

``write_daily`` stores a fact table with one folder a day.  A report over some days joins it to
a filtered calendar, one row a day: Spark broadcasts those few rows anyway and uses them to
read the matching folders only (dynamic partition pruning), also where the days are not literals
in the query but come from the calendar's own columns (a week, weekends, a list of closing days).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..columns import money

CALENDAR = "day date, week_start date, day_name string"


def write_daily(rows: DataFrame, ts_col: str, path: str) -> str:
    """Store ``rows`` by the day of ``ts_col`` (column ``day``); rows without a time are day NULL.

    Rows are dealt by day, a file or a few each; AQE splits a busy day and puts quiet ones together."""
    rows.withColumn("day", F.to_date(ts_col)).hint("rebalance", F.col("day")).write.partitionBy("day").parquet(path)
    return path


def read_daily(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table at ``path``; ``like``: rows as they were before (their declared schema)."""
    schema = like.withColumn("day", F.to_date(F.lit(None).cast("string"))).schema
    return spark.read.schema(schema).parquet(path)


def write_calendar(spark: SparkSession, first: str, last: str, path: str) -> str:
    """One row for every day from ``first`` to ``last``."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))
    days.select("day", F.to_date(F.date_trunc("week", "day")).alias("week_start"), F.date_format("day", "E").alias("day_name")).coalesce(1).write.parquet(path)
    return path


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CALENDAR).parquet(path)


def revenue_series(payments_by_day: DataFrame, calendar: DataFrame, at: str, days: int = 30) -> DataFrame:
    """A16 over the day layout: completed revenue of the last ``days`` days, zero-filled, with weekly totals."""
    from pyspark.sql import Window
    today = F.to_date(clock.at(at))
    spine = calendar.where((F.col("day") > F.date_sub(today, days)) & (F.col("day") <= today)).select("day", "week_start")
    paid = payments_by_day.where(F.col("status") == "completed").select("day", "amount_kes")
    daily = spine.join(paid, "day", "left").groupBy("day", "week_start").agg(money(F.coalesce(F.sum("amount_kes"), F.lit(0))).alias("revenue_kes"))
    return daily.select("day", "revenue_kes", "week_start", money(F.sum("revenue_kes").over(Window.partitionBy("week_start"))).alias("week_revenue_kes"))


def weekly_spend(users: DataFrame, payments_by_day: DataFrame, calendar: DataFrame, at: str) -> DataFrame:
    """A9 over the day layout: per user the 7 days that end on the clock's, zero-filled."""
    today = F.to_date(clock.at(at))
    week = calendar.where((F.col("day") > F.date_sub(today, 7)) & (F.col("day") <= today)).select("day")
    paid = payments_by_day.where(F.col("status") == "completed").select("user_id", "day", "amount_kes")
    spend = paid.join(week, "day").groupBy("user_id", F.col("day").alias("day_date")).agg(F.sum("amount_kes").alias("spent"))
    first = F.date_sub(today, 6)
    spine = users.select("user_id", F.explode(F.sequence(first, today)).alias("day_date"))
    return spine.join(spend, ["user_id", "day_date"], "left").select(
        "user_id", "day_date", F.date_format("day_date", "E").alias("day_name"), money(F.coalesce("spent", F.lit(0))).alias("total_spent"))
