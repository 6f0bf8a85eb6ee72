"""Seed rows inserted only where their key is absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import clock

# The service's seed catalogue (name, hours, price, speed, sort order) and seed accounts.
SEED_PACKAGES = [
    ("Student Package", 24, 20, 5, 1),
    ("30 Minutes Unlimited", 0.5, 5, 3, 2),
    ("1 Hour Unlimited", 1, 10, 5, 3),
    ("2 Hours Unlimited", 2, 15, 8, 4),
    ("3 Hours Unlimited", 3, 20, 10, 5),
    ("12 Hours Unlimited", 12, 55, 15, 6),
    ("1 Day Unlimited", 24, 80, 20, 7),
    ("1 Week Unlimited", 168, 200, 25, 8),
    ("2 Weeks Unlimited", 336, 350, 30, 9),
    ("1 Month Unlimited", 720, 600, 40, 10),
]
SEED_USERS = [
    ("254700000000", "Service Admin", "admin"),
    ("254712345678", "Demo User", "user"),
]


def seed_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "seed_ord int, " + schema)


def insert_absent(target: DataFrame, seeds: DataFrame, key: str) -> DataFrame:
    """Rows of ``seeds`` whose ``key`` is not in ``target`` (first seed row per key), appended.

    The seed side is a constant-size table; the anti-join only reads the key column of the target."""
    first = seeds.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("seed_ord"))) \
        .where(F.col("_r") == 1).drop("_r")
    new = first.join(target.select(key), key, "left_anti")
    return target.unionByName(new.drop("seed_ord"), allowMissingColumns=False)


def seed_users(spark: SparkSession, users: DataFrame, at: str) -> DataFrame:
    s = seed_table(spark, SEED_USERS, "phone_number string, name string, role string")
    s = s.select("seed_ord", (-F.col("seed_ord")).cast("bigint").alias("user_id"), "phone_number", "name", "role",
                 F.lit(True).alias("is_active"), clock.at(at).alias("created_at"))
    return insert_absent(users, s, "phone_number")


def seed_packages(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """Packages keyed by name; fractional hours are rounded as the INTEGER column does (0.5 -> 1)."""
    s = seed_table(spark, [(n, float(h), float(p), sp, so) for n, h, p, sp, so in SEED_PACKAGES],
                   "package_name string, hours double, price double, speed_mbps int, sort_order bigint")
    s = s.select("seed_ord", (-F.col("seed_ord")).cast("bigint").alias("package_id"), "package_name",
                 F.round("hours").cast("int").alias("duration_hours"),
                 F.col("price").cast("decimal(10,2)").alias("price_kes"), "speed_mbps",
                 F.lit(True).alias("is_active"), "sort_order")
    return insert_absent(packages, s, "package_name")
