"""Connected components of a link table, by alternating large and small stars.

Each round rewrites the links so that every node hangs on a smaller one; the rounds end
when the links no longer change.  Minima are partial aggregates, and each round's links
are written to the shared folder, so that a lost executor costs at most one round.  Of
many links the minima are written too: between an aggregate and its join AQE could not
split a hub.  That changes the plan, not the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MANY = 1_000_000



def _fingerprint(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _minima(links: DataFrame, many: bool) -> DataFrame:
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    return written(low, "cc-low") if many else low


def _large_star(links: DataFrame, many: bool) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _minima(both, many).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame, many: bool) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _minima(down, many)
    moved = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u long, v long), any direction, repeats allowed; returns (node, component): every linked
    node with the smallest node it reaches.  Loops (u = v) and rows with a null are ignored; no links, no rows."""
    links = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc-links")
    seen = _fingerprint(links)
    while seen[0]:
        many = seen[0] > MANY
        large = _large_star(links, many)
        links = written(_small_star(written(large, "cc-large") if many else large, many), "cc-links")
        now = _fingerprint(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        links.select(F.col("v"), F.col("v")).distinct())
