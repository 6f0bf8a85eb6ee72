"""L1 for deep pages: a rank directory over an ordered layout.

``orderBy().offset().limit()`` makes every task sort and ship offset + limit rows.  Here the list
is laid out once in its order, in ranges of a bounded number of rows, with a directory of one
count per range.  The ranges before a page add up to its offset, so the page reads the one or
two ranges that hold it, numbers their rows and ships at most ``limit`` of them.

The directory has one row per range and is the only thing that reaches the driver.  Rows equal in the whole
order would be cut anywhere, so the order ends in a unique key, as everywhere in ordering.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import clamp_page

ROWS_PER_RANGE = 100_000
RANGE = "_range"


class RankedList:
    """An ordered list stored at ``path``; ``order``: its columns, newest first and the like."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, order: list[Column]):
        self.spark, self.path, self.order = spark, path, order
        self.schema = T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])

    @classmethod
    def write(cls, rows: DataFrame, order: list[Column], path: str, rows_per_range: int = ROWS_PER_RANGE, total: int | None = None) -> RankedList:
        """Lay out ``rows`` and write the directory; ``total``: their number, if known."""
        spark = rows.sparkSession
        ranges = max(-(-(rows.count() if total is None else total) // rows_per_range), 1)
        laid = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        laid.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(f"{path}/rows")
        made = cls(spark, path, rows.schema, order)
        made.rows().groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/directory")
        return made

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def directory(self) -> list[tuple[int, int, int]]:
        """(range, rank of its first row from 0, rows) in order."""
        counts = sorted((r[RANGE], r.n) for r in self.spark.read.schema(f"{RANGE} int, n bigint").parquet(f"{self.path}/directory").collect())
        out, first = [], 0
        for r, n in counts:
            out.append((r, first, n))
            first += n
        return out

    def page(self, page_no=1, limit=20, max_limit: int = 100) -> DataFrame:
        """Page ``page_no`` of the list: the rows ``orderBy().offset().limit()`` would give."""
        p, lim = clamp_page(page_no, limit, max_limit)
        lo, hi = (p - 1) * lim, p * lim
        held = [(r, first) for r, first, n in self.directory() if first < hi and first + n > lo]
        rows = self.rows().where(F.col(RANGE).isin(*[r for r, _ in held]) if held else F.lit(False))
        start = F.lit(0)
        for r, first in held:  # the ranges of one page: a handful
            start = F.when(F.col(RANGE) == r, F.lit(first)).otherwise(start)
        place = F.row_number().over(Window.partitionBy(RANGE).orderBy(*self.order))
        ranked = rows.withColumn("_rank", start + place - 1).where((F.col("_rank") >= lo) & (F.col("_rank") < hi))
        return ranked.orderBy("_rank").drop("_rank", RANGE)
