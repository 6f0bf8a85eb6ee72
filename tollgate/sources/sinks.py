"""Report sink -- append rows to a parquet table in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_path


def append_parquet(df: DataFrame, path: str) -> None:
    """Append ``df`` to the parquet table at ``path`` (created on first write)."""
    df.write.mode("append").parquet(path)


def fresh_table_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir`` for one run's output table."""
    return checkpoint_path(spark, f"tables/{name}-{uuid.uuid4().hex}")


def append_and_read(spark: SparkSession, df: DataFrame, name: str, times: int = 1) -> DataFrame:
    path = fresh_table_path(spark, name)
    for _ in range(times):
        append_parquet(df, path)
    return spark.read.parquet(path)
