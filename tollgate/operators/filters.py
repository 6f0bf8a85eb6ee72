"""F: filters and predicates.  All are plain ``where`` clauses that Catalyst
pushes into the parquet scan (clock bounds are literals, ranges not functions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import clock
from ..functions.labels import category

SESSION_COLS = ["session_id", "user_id", "package_id", "payment_id", "hotspot_user_id", "started_at", "expires_at",
                "status", "ended_at", "bytes_downloaded", "bytes_uploaded", "data_used_mb"]


def enum_filter(df: DataFrame, column: str, value: str | None) -> DataFrame:
    """optional equality filter; ``None`` means all rows."""
    return df if value is None else df.where(F.col(column) == F.lit(value))


def unexpired(sessions: DataFrame, at: str) -> DataFrame:
    """status active AND expires_at > now."""
    return sessions.where((F.col("status") == "active") & (F.col("expires_at") > clock.at(at)))


def rolling_window(df: DataFrame, ts_col: str, at: str, **interval) -> DataFrame:
    """``ts >= now - interval`` (no upper bound, as the service writes it)."""
    return df.where(F.col(ts_col) >= clock.minus(at, **interval))


def today(df: DataFrame, ts_col: str, at: str) -> DataFrame:
    """``ts >= midnight of the clock's day`` as a range, so it pushes down."""
    return df.where(F.col(ts_col) >= clock.day_start(at))


def status_in(df: DataFrame, statuses: list[str]) -> DataFrame:
    """status in a list."""
    return df.where(F.col("status").isin(*statuses))


def user_search(users: DataFrame, text: str | None) -> DataFrame:
    """phone or name contains ``text``, case-insensitive (LIKE wildcards kept, as written)."""
    if not text:
        return users
    pat = f"%{text}%"
    return users.where(F.col("phone_number").ilike(pat) | F.col("name").ilike(pat))


CATALOGUE_COLS = ["package_id", "package_name", "duration_hours", "price_kes", "speed_mbps", "sort_order"]


def active_catalogue(packages: DataFrame) -> DataFrame:
    """F7 + L3: active packages, fixed column list, by sort_order then price (id breaks ties)."""
    return packages.where(F.col("is_active")).select(*CATALOGUE_COLS) \
        .orderBy("sort_order", "price_kes", "package_id")


def package_category(packages: DataFrame, wanted: str | None) -> DataFrame:
    """F8: active packages with their category; keep one category or all."""
    p = packages.where(F.col("is_active")).select(*CATALOGUE_COLS, category("duration_hours").alias("category"))
    return p if wanted in (None, "all") else p.where(F.col("category") == wanted)


def paid_rows(payments: DataFrame) -> DataFrame:
    """status completed OR amount > 0."""
    return payments.where((F.col("status") == "completed") | (F.col("amount_kes") > 0))


def reconcile_due(payments: DataFrame, at: str, min_age_s: int = 15) -> DataFrame:
    """unsettled payments created more than ``min_age_s`` seconds before now."""
    return payments.where(~F.col("status").isin("completed", "failed")
                          & (F.col("created_at") < clock.minus(at, seconds=min_age_s)))
