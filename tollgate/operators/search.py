"""F6 over an index: substring search by trigram postings, then verified.

``build`` writes, once, the three-character pieces of each searched column (lower case) with
the ids of the rows that hold them, sorted by piece, and a count per piece.  ``search`` takes
the pieces of the text, reads the postings of the rarest few (a pushed-down ``gram IN``: only row
groups whose range holds one are read), keeps the rows that hold them all in one column, and
verifies those with the very predicate of the full scan.  So the answer is the full scan's.

A text of fewer than three characters between wildcards has no pieces; it falls back to the scan.
Postings are range-partitioned by (gram, id), so a piece that every phone starts with is many
files and no task's burden, and being the commonest it is the last one a search would read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filters import user_search

GRAM = 3
RAREST = 4  # postings read per search
ROWS_PER_FILE = 2_000_000
COLUMNS = ("phone_number", "name")


def grams_of(text: str) -> list[str]:
    """The pieces that any match of ``%text%`` must hold; none if the text has an escape, whose meaning LIKE alone knows."""
    if "\\" in text:
        return []
    return sorted({run[i:i + GRAM] for run in re.split("[%_]", text) for i in range(len(run) - GRAM + 1)})


def build(users: DataFrame, path: str, id_col: str = "user_id", columns: tuple[str, ...] = COLUMNS) -> str:
    """Write the index of ``users`` under ``path``: ``postings`` (gram, field, id) and ``counts`` (gram, n)."""
    spark = users.sparkSession
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.lower(F.col(c)).alias("text")) for c in columns])).alias("f")
    texts = users.select(F.col(id_col).alias("id"), fields).select("id", "f.field", "f.text").where(F.length("text") >= GRAM)
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - (GRAM - 1)), lambda i: F.substring(F.col("text"), i, F.lit(GRAM))))
    postings = texts.select(F.explode(pieces).alias("gram"), "field", "id")
    rough = users.count() * len(columns) * 10  # pieces a row, about
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rough // ROWS_PER_FILE)
    postings.repartitionByRange(files, "gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{path}/postings")
    stored = spark.read.schema(postings.schema).parquet(f"{path}/postings")
    counts = stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return path


def postings_for(spark: SparkSession, path: str, chosen: list[str]) -> DataFrame:
    """The postings of the pieces ``chosen`` alone."""
    return spark.read.schema("gram string, field string, id bigint").parquet(f"{path}/postings").where(F.col("gram").isin(*chosen))


def search(users: DataFrame, path: str, text: str, id_col: str = "user_id") -> DataFrame:
    """Users whose phone or name contains ``text``: :func:`filters.user_search` by way of the index at ``path``."""
    spark = users.sparkSession
    # lower-cased by Spark, as the index and ILIKE are; ASCII needs no job for it
    low = text.lower() if text.isascii() else spark.range(1).select(F.lower(F.lit(text))).first()[0]
    grams = grams_of(low)
    if not grams:
        return user_search(users, text)
    counts = spark.read.schema("gram string, n bigint").parquet(f"{path}/counts").where(F.col("gram").isin(*grams)).collect()
    if len(counts) < len(grams):  # a piece that no row holds
        return users.limit(0)
    chosen = [r.gram for r in sorted(counts, key=lambda r: (r.n, r.gram))[:RAREST]]
    hits = postings_for(spark, path, chosen).groupBy("id", "field").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen))
    found = users.join(hits.select(F.col("id").alias(id_col)), id_col, "left_semi")
    return user_search(found, text)
