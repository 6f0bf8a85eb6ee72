"""Tables stored in buckets of one key, so that joins and groupings by it need no shuffle.

``write_bucketed`` writes users, sessions and payments with ``bucketBy(user_id)``, sorted by it:
one file a bucket, dealt by the hash Spark itself groups by.  A per-user report (A7, A12, J5,
U9) then reads bucket i of each table in task i and never exchanges rows by user.

A bucket is read by one task, so a user who holds much of a table makes that task long.  The
largest bucket's share is measured when the table is written; a table above ``max_share`` is
opened as plain files, whose joins AQE can split.  Either way the rows are the same.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables

BUCKETED = {"users": "user_id", "sessions": "user_id", "payments": "user_id", "sessions_live": "user_id", "payments_live": "user_id"}
MAX_SHARE = 8.0  # times the mean bucket


def write_bucketed(tables: Tables, path: str, buckets: int, names: list[str] | None = None, keys: dict[str, str] | None = None) -> dict[str, str]:
    """Write the tables under ``path`` as catalogue tables; returns name -> catalogue name."""
    made, prefix = {}, "tollgate_" + uuid.uuid4().hex[:12]
    for name in names or list(BUCKETED):
        key = (keys or BUCKETED)[name]
        made[name] = f"{prefix}_{re.sub('[^a-z_]', '_', name)}"
        # repartition deals rows by the hash of the buckets, so each task writes one bucket, one file
        (getattr(tables, name).repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
         .option("path", f"{path}/{name}").format("parquet").saveAsTable(made[name]))
    return made


def largest_bucket(table: DataFrame, key: str, buckets: int) -> float:
    """Rows of the largest bucket over the mean bucket's."""
    per = table.groupBy(F.pmod(F.hash(key), F.lit(buckets)).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    r = per.agg(F.max("n").alias("top"), F.sum("n").alias("all")).first()
    return (r.top or 0) * buckets / max(r["all"] or 0, 1)


class BucketedTables(Tables):
    """``Tables`` whose per-user tables come from a bucketed layout."""

    def __init__(self, spark: SparkSession, sf_dir: str, path: str, made: dict[str, str], buckets: int, max_share: float = MAX_SHARE):
        super().__init__(spark, sf_dir)
        # joins on (user, more) may use the buckets of the user alone
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        for name, table in made.items():
            stored = spark.table(table)
            if largest_bucket(stored, BUCKETED[name], buckets) > max_share:
                stored = spark.read.schema(stored.schema).parquet(f"{path}/{name}")
            self.__dict__[name] = stored
