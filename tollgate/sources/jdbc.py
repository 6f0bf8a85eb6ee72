"""The same tables from a relational database over JDBC.

A partitioned read: ``numPartitions`` parallel range queries over a time (or numeric)
column, so no single connection reads the whole table.  The keys themselves are UUIDs,
which Spark cannot split into ranges.  The service's pool of
20 connections caps sensible parallelism per database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The service's tables and the columns to split them on.
TABLE_KEYS = {"users": "created_at", "packages": "sort_order", "payments": "created_at", "sessions": "started_at"}


def jdbc_options(url: str, table: str, column: str, lower: int | str, upper: int | str, partitions: int = 20,
                 user: str | None = None, password: str | None = None, fetchsize: int = 10_000) -> dict:
    """Options for a range-partitioned JDBC read (at most ``partitions`` connections)."""
    if partitions < 1:
        raise ValueError("partitions must be >= 1")
    opts = {"url": url, "dbtable": table, "partitionColumn": column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions), "fetchsize": str(fetchsize)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    return opts


def read_jdbc(spark: SparkSession, **kw) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**kw)).load()
