"""Materialised business tables, laid out for the reports.

In production the business tables are stored, not re-derived per query.
``write_layout`` writes each one once under a folder (on a cluster: in the
shared storage), arranged so the reports' predicates prune files:

* time-stamped facts are range-partitioned on their time column, so every file
  covers a disjoint time range and parquet min/max statistics skip whole files
  for "last hour", "today", "last 7 days" predicates;
* inside each file rows are sorted by (user_id, time), so per-user reads and
  the per-user aggregates see runs of the same key;
* dimensions (users, packages, hotspot users) are sorted by their key.

``LaidOutTables`` reads them back with the same attribute names as ``Tables``,
so every operator runs unchanged on either.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import Tables

# table -> (time column or None, sort columns)
LAYOUT = {
    "users": (None, ["user_id"]),
    "packages": (None, ["package_id"]),
    "hotspot_users": (None, ["hotspot_user_id"]),
    "payments": ("created_at", ["user_id", "created_at"]),
    "payments_live": ("created_at", ["user_id", "created_at"]),
    "sessions": ("started_at", ["user_id", "started_at"]),
    "sessions_live": ("started_at", ["user_id", "started_at"]),
    "bandwidth_logs": ("period_start", ["user_id", "period_start"]),
    "callbacks": ("received_at", ["received_at"]),
    "logins": ("ts", ["ts"]),
}


def _laid_out(df: DataFrame, time_col: str | None, sort_cols: list[str], files: int) -> DataFrame:
    if time_col is None:
        return df.repartitionByRange(files, *sort_cols).sortWithinPartitions(*sort_cols)
    return df.repartitionByRange(files, time_col).sortWithinPartitions(*sort_cols)


def write_layout(tables: Tables, path: str, files: int, names: list[str] | None = None) -> str:
    """Write the business tables under ``path`` (one parquet folder each), ``files`` files
    each: give about the table's bytes over 256 MB."""
    for name in names or list(LAYOUT):
        time_col, sort_cols = LAYOUT[name]
        _laid_out(getattr(tables, name), time_col, sort_cols, files).write.mode("overwrite").parquet(f"{path}/{name}")
    return path


class LaidOutTables(Tables):
    """``Tables`` whose business tables come from a written layout (raw tables still available)."""

    def __init__(self, spark: SparkSession, sf_dir: str, layout_path: str):
        super().__init__(spark, sf_dir)
        self.layout_path = layout_path
        derived = Tables(spark, sf_dir)
        for name in LAYOUT:
            # declared schema (from the derivation's analysed plan, no job): no footer inference;
            # instance attributes shadow the derived (cached) properties of Tables
            schema = getattr(derived, name).schema
            self.__dict__[name] = spark.read.schema(schema).parquet(f"{layout_path}/{name}")


def time_range_files(df: DataFrame, time_col: str) -> DataFrame:
    """Per input file: min and max of ``time_col`` (shows the layout's disjoint ranges)."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.min(time_col).alias("lo"),
                                                              F.max(time_col).alias("hi"))
