"""L: pages, per-user pages and top-k.  Every ORDER BY ends in a unique key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clamp_page(page, limit, max_limit: int = 100, default_limit: int = 20) -> tuple[int, int]:
    """page >= 1; 1 <= limit <= max_limit; unparsable values fall back to defaults."""
    try:
        p = int(page)
    except (TypeError, ValueError):
        p = 1
    try:
        lim = int(limit)
    except (TypeError, ValueError):
        lim = default_limit
    if lim == 0:
        lim = default_limit
    return max(1, p), min(max_limit, max(1, lim))


def page(df: DataFrame, order: list, page_no=1, limit=20, max_limit: int = 100) -> DataFrame:
    """L1: one page of an ordered list (a bounded top-k: TakeOrderedAndProject)."""
    p, lim = clamp_page(page_no, limit, max_limit)
    return df.orderBy(*order).offset((p - 1) * lim).limit(lim)


def history_pages(history: DataFrame, totals: DataFrame, page_no=1, limit=10, max_limit: int = 50) -> DataFrame:
    """L2: rows of page ``page_no`` of every user's history, newest first, with page counts.

    The filter bounds row_number from above, so Spark inserts a partial
    WindowGroupLimit before the shuffle: each user ships at most page*limit
    rows per map task, whatever its history size.
    """
    p, lim = clamp_page(page_no, limit, max_limit, default_limit=10)
    w = Window.partitionBy("user_id").orderBy(F.col("started_at").desc(), F.col("session_id"))
    lo, hi = (p - 1) * lim + 1, p * lim
    r = history.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= hi).where(F.col("rn") >= lo)
    return r.join(totals, "user_id").withColumn("pages", F.ceil(F.col("total") / F.lit(lim)).cast("bigint"))


def cheapest(packages: DataFrame, k: int = 3) -> DataFrame:
    """L4: the k cheapest active packages (price, then id)."""
    return packages.where(F.col("is_active")).orderBy("price_kes", "package_id").limit(k) \
        .select("package_id", "package_name", "price_kes", "duration_hours", "speed_mbps")
