"""W: per-group picks and positional numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import clock
from ..columns import floor_div, micros_between, round_half_up_div
from ..functions.labels import category
from .ranking import numbered


def current_session(sessions: DataFrame, packages: DataFrame, payments: DataFrame, at: str, receipts: DataFrame | None = None,
                    devices: DataFrame | None = None) -> DataFrame:
    """Each user's newest unexpired paid session (started_at desc, id asc), seconds left.

    The inner joins come first (the service's LIMIT 1 applies after them); the
    pick is a ``max_by`` aggregate, partial per partition, so hot users are cheap.  ``receipts``
    (first callbacks) and ``devices`` add the payment's receipt and the session's address to
    the one row that is picked, not to the rows it is picked from."""
    now = clock.at(at)
    s = sessions.where((F.col("status") == "active") & (F.col("expires_at") > now))
    j = (s.join(packages.select("package_id", "package_name", "speed_mbps", "duration_hours"), "package_id")
         .join(payments.select("payment_id", "amount_kes", "checkout_request_id"), "payment_id"))
    cols = ["session_id", "started_at", "expires_at", "data_used_mb", "package_name", "speed_mbps",
            "duration_hours", "amount_kes", "checkout_request_id"]
    best = j.groupBy("user_id").agg(
        F.max_by(F.struct(*cols), F.struct("started_at", (-F.col("session_id")).alias("k"))).alias("b"))
    best = best.select("user_id", *[F.col("b")[c].alias(c) for c in cols],
                       floor_div(micros_between(now, F.col("b.expires_at")), 1_000_000).alias("seconds_remaining"))
    if receipts is not None:
        paid = receipts.where(F.col("result_code") == 0).select("checkout_request_id", "receipt_number")
        best = best.join(paid, "checkout_request_id", "left")
    if devices is not None:
        best = best.join(devices.select("session_id", "ip_address"), "session_id", "left")
    return best.drop("checkout_request_id")


def price_list(packages: DataFrame, n_partitions: int | None = None) -> DataFrame:
    """Active packages in price order, per category and overall ('all'):
    serial number, middle-of-list 'most booked' flag, price per hour (hours >= 1).

    Numbering is distributed (see ranking.numbered): categories are few and large.
    """
    p = packages.where(F.col("is_active")).select("package_id", "package_name", "duration_hours", "price_kes",
                                                  "sort_order")
    both = p.select("*", F.explode(F.array(F.lit("all"), category("duration_hours"))).alias("category"))
    r = numbered(both, ["category"], ["price_kes", "sort_order", "package_id"], n_partitions,
                 name="serial", count_name="n_in_list")
    cents = (F.col("price_kes") * 100).cast("bigint")
    hours = F.greatest(F.col("duration_hours"), F.lit(1))
    return r.select("category", "package_id", "package_name", "price_kes", "duration_hours", "serial", "n_in_list",
                    ((F.col("serial") - 1 == floor_div("n_in_list", 2)) & (F.col("n_in_list") > 1))
                    .alias("most_booked"),
                    round_half_up_div(cents, hours * 100).alias("price_per_hour"))


def latest_plan(sessions: DataFrame, packages: DataFrame) -> DataFrame:
    """The package of each user's newest session (``max_by``)."""
    best = sessions.groupBy("user_id").agg(
        F.max_by(F.struct("package_id", "session_id", "started_at"),
                 F.struct("started_at", "session_id")).alias("b"))
    best = best.select("user_id", "b.package_id", "b.session_id", "b.started_at")
    return best.join(packages.select("package_id", "package_name"), "package_id", "left") \
        .select("user_id", "package_id", "package_name", "session_id", "started_at")
