"""U transitions published as table versions, writing only the partitions that change.

Sessions are partitioned by the day they started, payments by the day they were created;
neither column is ever changed by a transition, so a changed row stays in its partition and
the days that hold changed rows are all that has to be rewritten.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..sources.versioned import VersionedTable
from . import transitions as U
from .filters import reconcile_due
from .joins import unused_payments


def _period(column: str, unit: str) -> Column:
    return F.to_date(column) if unit == "day" else F.date_format(column, "yyyy-MM")


def sessions_table(spark: SparkSession, path: str, unit: str = "day") -> VersionedTable:
    """Sessions by the day they started (``unit="month"`` where a day is only a few rows)."""
    return VersionedTable(spark, path, _period("started_at", unit))


def payments_table(spark: SparkSession, path: str, unit: str = "day") -> VersionedTable:
    """Payments by the day they were created (or the month)."""
    return VersionedTable(spark, path, _period("created_at", unit))


def publish_changes(table: VersionedTable, candidates: DataFrame, transition: Callable[[DataFrame], DataFrame],
                    batch: tuple[str, int] | None = None) -> int:
    """Apply ``transition`` (rows -> rows with ``changed``) to the newest version, in the days it changes.

    ``candidates``: rows of the table that may change, found by a narrow filter that the scan
    pushes down; their days are few and reach the driver, their rows do not.  Only those days
    are read in full, and of them only the ones that hold a changed row are written."""
    base = table.manifest()
    if table.done(base, batch):
        return base["version"]
    days = table.partitions_of(candidates)
    if not days:
        return base["version"]
    after = transition(table.read(base["version"], only=days))
    changed = table.partitions_of(after.where("changed"))
    if not changed:
        return base["version"]
    rows = transition(table.read(base["version"], only=changed)).select(*table.read(base["version"], only=[]).columns)
    return table.rewrite(rows, changed, batch)


def expire(table: VersionedTable, at: str, batch: tuple[str, int] | None = None) -> int:
    """U1 as the next version of the sessions table."""
    due = table.read().where((F.col("status") == "active") & (F.col("expires_at") <= clock.at(at)))
    return publish_changes(table, due, lambda s: U.expire_sessions(s, at), batch)


def publish_after(table: VersionedTable, after: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """Publish ``after`` (all rows of the newest version after a transition, with ``changed``), writing only the days that change.

    For transitions whose rows can be anywhere in the table: every row is looked at, but
    only the days that hold a changed one are written."""
    base = table.manifest()
    if table.done(base, batch):
        return base["version"]
    changed = table.partitions_of(after.where("changed"))
    if not changed:
        return base["version"]
    rows = after.where(table.partition.isin(*changed)).select(*table.read(base["version"], only=[]).columns)
    return table.rewrite(rows, changed, batch)


def disconnect(table: VersionedTable, requests: DataFrame, admin_requests: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
    """U2 as the next version: the first open session of a user may be of any day."""
    return publish_after(table, U.disconnect(table.read(), requests, admin_requests), batch)


def attach_credentials(table: VersionedTable, payments: DataFrame, hotspot_users: DataFrame, users: DataFrame, packages: DataFrame,
                       batch: tuple[str, int] | None = None) -> int:
    """U9 as the next version of the sessions table; accounts and speed limits go to the router, not into it."""
    now = table.read()
    return publish_after(table, U.attach_credentials(now, unused_payments(payments, now), hotspot_users, users, packages), batch)


def open_sessions(table: VersionedTable, payments: DataFrame, packages: DataFrame, at: str, batch: tuple[str, int] | None = None) -> int:
    """U3 as the next version: new sessions are appended, no file is rewritten."""
    now = table.read()
    return table.append(U.new_sessions(now, payments, packages, at).select(*now.columns), batch)


def open_payments(table: VersionedTable, requests: DataFrame, packages: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """U10 as the next version: priced requests are appended as pending payments (refused ones are the caller's to answer).

    A payment's id and checkout id follow from its request, so a request that is there already is not added again."""
    now = table.read()
    priced = U.open_payments(requests, packages).where(F.col("status") == "pending")
    new = priced.select((-F.col("request_id")).alias("payment_id"), "user_id", "package_id", "amount_kes", "status",
                        F.concat(F.lit("ws_CO_R"), F.col("request_id").cast("string")).alias("checkout_request_id"),
                        F.col("requested_at").alias("created_at"), F.col("requested_at").alias("updated_at"))
    new = new.join(now.select("payment_id"), "payment_id", "left_anti")
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in now.schema.fields if f.name not in new.columns]
    return table.append(new.select("*", *rest).select(*now.columns), batch)


def catalogue_table(spark: SparkSession, path: str) -> VersionedTable:
    """Packages are few: one partition."""
    return VersionedTable(spark, path, F.lit("all"))


def patch_packages(table: VersionedTable, patches: DataFrame, at: str, batch: tuple[str, int] | None = None) -> int:
    """U4 as the next version of the catalogue (a table with ``updated_at``)."""
    now = table.read()
    after = U.patch_packages(now.drop("updated_at"), patches, at).withColumnRenamed("updated_at", "_new")
    kept = after.join(now.select("package_id", "updated_at"), "package_id").withColumn("updated_at", F.coalesce("_new", "updated_at"))
    return publish_after(table, kept.withColumn("changed", F.col("_new").isNotNull()), batch)


SETTLED_COLS = ["receipt_number", "transaction_date", "failure_reason"]


def with_settlement(payments: DataFrame) -> DataFrame:
    """Payments with the columns that a settlement fills (null until then)."""
    return payments.select("*", *[F.lit(None).cast("string").alias(c) for c in SETTLED_COLS if c not in payments.columns])


def settle(table: VersionedTable, first: DataFrame, batch: tuple[str, int] | None = None) -> int:
    """U5 as the next version: the days of the payments that the callbacks answer."""
    answered = (table.read().select("checkout_request_id", "created_at", "status").where(~F.col("status").isin("completed", "failed"))
                .join(first.select("checkout_request_id"), "checkout_request_id", "left_semi"))
    return publish_changes(table, answered, lambda p: keep_settled(p, U.settle_payments(p.drop(*SETTLED_COLS), first)), batch)


def reconcile(table: VersionedTable, polls: DataFrame, at: str, batch: tuple[str, int] | None = None) -> int:
    """U11 as the next version: the days of the unsettled payments that a poll has answered."""
    due = reconcile_due(table.read().select("checkout_request_id", "created_at", "status"), at).join(polls.select("checkout_request_id"), "checkout_request_id", "left_semi")

    def transition(p: DataFrame) -> DataFrame:
        after = U.reconcile_payments(p.drop("failure_reason"), polls, at).withColumnRenamed("failure_reason", "_why")
        return after.join(p.select("payment_id", "failure_reason"), "payment_id").withColumn("failure_reason", F.coalesce("_why", "failure_reason"))
    return publish_changes(table, due, transition, batch)


def keep_settled(before: DataFrame, after: DataFrame) -> DataFrame:
    """``after`` with what earlier settlements wrote kept in the rows this one leaves alone."""
    old = before.select("payment_id", *[F.col(c).alias(f"_{c}") for c in SETTLED_COLS])
    kept = [F.when(F.col("changed"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in SETTLED_COLS]
    rest = [c for c in after.columns if c not in SETTLED_COLS]
    return after.join(old, "payment_id").select(*rest, *kept)
