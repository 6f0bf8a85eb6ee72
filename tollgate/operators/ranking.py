"""Distributed row numbering for orderings with few groups.

A window ``row_number() over (partition by g order by k)`` puts each group in
one task; with a handful of groups (price-list categories) that is a handful
of tasks, whatever the data size.  Instead: range-partition and sort by
(g, k) -- the sampled range bounds split even a huge group across tasks --
checkpoint so partitions are stable, then number rows as the offset of their
partition within the group plus their position inside the partition.  Only a
(partition x group) table of counts is ever small-joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable

ROWS_PER_TASK = 2_000_000


def tagged_ranges(df: DataFrame, order_cols: list, n_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order_cols``, checkpointed, with ``_pid`` and ``_pos``.

    By default the partition count follows the rows: the session's shuffle partitions, or
    one per ROWS_PER_TASK rows."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    n = n_partitions or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS_PER_TASK))
    ordered = stable(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys))
    return ordered.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_pos"))


def numbered(df: DataFrame, group_cols: list[str], order_cols: list, n_partitions: int | None = None,
             name: str = "rn", count_name: str | None = "n_in_group") -> DataFrame:
    """Add ``name`` = 1-based row number within ``group_cols`` by ``order_cols``.

    ``order_cols`` must make the order unique (end with a key).  Also adds the
    group size as ``count_name`` when given.
    """
    # the checkpoint (in spark.checkpoint.dir) fixes partition contents for both passes
    tagged = tagged_ranges(df, [*group_cols, *order_cols], n_partitions)
    stats = tagged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group_cols)
    stats = stats.select("_pid", *group_cols, "_first",
                         F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
                         F.sum("_n").over(whole).alias("_total"))
    # stats has at most (partitions x groups) rows: a bounded broadcast; NULL groups
    # are groups too, so the group columns are matched null-safely
    st = stats.select(F.col("_pid").alias("_s_pid"), *[F.col(c).alias("_s_" + c) for c in group_cols],
                      "_first", "_offset", "_total")
    cond = F.col("_pid") == F.col("_s_pid")
    for c in group_cols:
        cond = cond & F.col(c).eqNullSafe(F.col("_s_" + c))
    j = tagged.join(F.broadcast(st), cond, "inner").drop("_s_pid", *["_s_" + c for c in group_cols])
    out = j.withColumn(name, (F.col("_offset") + F.col("_pos") - F.col("_first") + 1).cast("bigint"))
    if count_name:
        out = out.withColumn(count_name, F.col("_total").cast("bigint"))
    return out.drop("_pid", "_pos", "_first", "_offset", "_total")
