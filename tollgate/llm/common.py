"""Helpers shared by the operators: written intermediate tables, columns, Arrow access."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_query_conf, checkpoint_path

LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, once per context (as --py-files would)."""
    sc = spark.sparkContext
    if getattr(sc, "_tollgate_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="tollgate-py-"), "tollgate.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(path)
    sc._tollgate_shipped = True


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on; they change batch sizes and plans, not results."""
    apply_query_conf(spark)
    ship_package(spark)
    # a batch of whole texts must fit a Python worker also when every text is long
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared checkpoint folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = checkpoint_path(spark, f"llm/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tasks_for(spark: SparkSession, total_bytes: int, per_task: int) -> int:
    """Partition count: the session's shuffle partitions, or more where the bytes ask for it."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total_bytes or 0) // per_task), 1)


def hashed_sample(rows: DataFrame, n: int, total: int, *keys: str) -> DataFrame:
    """About ``n`` of ``total`` rows, those with the lowest hash of the keys, and never more than 2n.

    A filter on each row's own hash: no sort, and no task hands on more than its share."""
    share = (1.2 * n + 20) / max(total, 1)
    if share < 1:
        rows = rows.filter(F.xxhash64(*keys) < F.lit(int(share * (1 << 64)) - (1 << 63)))
    return rows.limit(2 * n)


def null_safe_text(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value of an Arrow string column; null counts as empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def as_int64(column: pa.Array, null: int) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(null).to_numpy(zero_copy_only=False)


def signed(h: int) -> int:
    """The 64 bits of ``h`` as a signed long."""
    return h - (1 << 64) if h >> 63 else h
