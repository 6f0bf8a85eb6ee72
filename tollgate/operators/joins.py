"""J: joins of the service, re-aimed at whole tables.

Join strategy is left to Catalyst + AQE: dimension sides are broadcast only
when their measured size is under the broadcast threshold (AQE re-plans from
real shuffle sizes); everything else is a sort-merge join on the key, with
AQE splitting skewed partitions.  Only constant lookup tables are hinted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import clock
from ..columns import seconds_between
from ..functions import phones
from ..session import small_tasks, stable
from .ranking import tagged_ranges


def payment_terms(payments: DataFrame, packages: DataFrame) -> DataFrame:
    """Completed payments with their package's duration."""
    return (payments.where(F.col("status") == "completed").select("payment_id", "user_id", "package_id")
            .join(packages.select("package_id", "duration_hours"), "package_id"))


def transactions(payments: DataFrame, users: DataFrame, packages: DataFrame, status: str | None = None) -> DataFrame:
    """Payments with user and package (admin transactions list), optional status."""
    p = payments if status is None else payments.where(F.col("status") == status)
    j = (p.join(users.select("user_id", "name", F.col("phone_number").alias("user_phone")), "user_id")
         .join(packages.select("package_id", "package_name"), "package_id"))
    return j.select("payment_id", "status", "amount_kes", "checkout_request_id", "created_at", "name", "user_phone",
                    "package_name")


def session_list(sessions: DataFrame, users: DataFrame, packages: DataFrame, payments: DataFrame,
                 status: str | None = None) -> DataFrame:
    """Sessions with user, package and payment (inner joins: manual sessions drop),
    plus the unjoined row total for the same filter (a scalar subquery)."""
    s = sessions if status is None else sessions.where(F.col("status") == status)
    j = (s.join(users.select("user_id", "phone_number", "name"), "user_id")
         .join(packages.select("package_id", "package_name", "speed_mbps"), "package_id")
         .join(payments.select("payment_id", "amount_kes"), "payment_id"))
    total = s.agg(F.count(F.lit(1))).scalar()
    return j.select("session_id", "status", "started_at", "expires_at", "data_used_mb", "phone_number", "name",
                    "package_name", "speed_mbps", "amount_kes", total.alias("total_sessions"))


def active_with_hotspot(sessions: DataFrame, hotspot_users: DataFrame, at: str) -> DataFrame:
    """Unexpired active sessions with the optional hotspot username."""
    s = sessions.where((F.col("status") == "active") & (F.col("expires_at") > clock.at(at)))
    j = s.join(hotspot_users.select("hotspot_user_id", F.col("username").alias("hotspot_username")),
               "hotspot_user_id", "left")
    return j.select("session_id", "user_id", "hotspot_user_id", "hotspot_username", "expires_at")


def unused_payments(payments: DataFrame, sessions: DataFrame, same_user: bool = False) -> DataFrame:
    """Per (user, package), the newest completed payment with no session, or whose
    session is active but has no credentials yet.  ``max_by`` is map-side partial.

    ``same_user``: a session belongs to its payment's user, so the join may go by user as well
    and, over tables bucketed by user, needs no shuffle."""
    on = ["user_id", "payment_id"] if same_user else ["payment_id"]
    s = sessions.select(*on, F.col("session_id").alias("active_session_id"), F.col("status").alias("s_status"),
                        F.col("hotspot_user_id").alias("s_hotspot"))
    p = payments.where(F.col("status") == "completed").select("payment_id", "user_id", "package_id", "updated_at")
    j = p.join(s, on, "left").where(
        F.col("active_session_id").isNull() | ((F.col("s_status") == "active") & F.col("s_hotspot").isNull()))
    best = j.groupBy("user_id", "package_id").agg(
        F.max_by(F.struct("payment_id", "updated_at", "active_session_id"),
                 F.struct("updated_at", "payment_id")).alias("b"))
    return best.select("user_id", "package_id", "b.payment_id", "b.updated_at", "b.active_session_id")


def payment_status(payments: DataFrame, sessions: DataFrame, packages: DataFrame) -> DataFrame:
    """Every payment with its session (if any) and package name (if any)."""
    j = (payments.join(sessions.select("payment_id", "session_id").where(F.col("payment_id").isNotNull()),
                       "payment_id", "left")
         .join(packages.select("package_id", "package_name"), "package_id", "left"))
    return j.select("payment_id", "checkout_request_id", "status", "amount_kes", "created_at", "session_id",
                    "package_name")


def latest_completed_payment(payments: DataFrame) -> DataFrame:
    """Newest completed payment per (user, package): updated_at desc, then id desc."""
    return (payments.where(F.col("status") == "completed")
            .groupBy("user_id", "package_id")
            .agg(F.max_by(F.struct("payment_id", "amount_kes"), F.struct("updated_at", "payment_id")).alias("b"))
            .select("user_id", "package_id", F.col("b.payment_id").alias("latest_payment_id"),
                    F.col("b.amount_kes").alias("amount_kes")))


def hotspot_sessions(sessions: DataFrame, users: DataFrame, packages: DataFrame, payments: DataFrame,
                     status: str = "active") -> DataFrame:
    """Sessions of a status with the newest completed payment of their (user, package).

    The correlated LIMIT-1 subquery becomes a per-key ``max_by`` aggregate and an
    equi-join on (user, package); sessions with no such payment drop (inner join).  The
    aggregate is checkpointed, so both sides of the join are shuffled by the join alone
    and AQE can split a hot (user, package).
    """
    s = sessions.where(F.col("status") == status)
    j = (s.join(stable(latest_completed_payment(payments)), ["user_id", "package_id"])
         .join(users.select("user_id", "phone_number", "name"), "user_id")
         .join(packages.select("package_id", "package_name", "speed_mbps"), "package_id"))
    return j.select("session_id", "status", "started_at", "expires_at", "hotspot_user_id", "bytes_downloaded",
                    "bytes_uploaded", "phone_number", "name", "package_name", "speed_mbps", "latest_payment_id",
                    "amount_kes")


def hotspot_sessions_live(sessions: DataFrame, users: DataFrame, packages: DataFrame, payments: DataFrame,
                          hotspot_users: DataFrame, feed: DataFrame, at: str) -> DataFrame:
    """J8 + J10: the admin hotspot list -- sessions with their latest payment, time left
    (floored at 0) and the router's live state looked up through the hotspot username."""
    now = clock.at(at)
    base = hotspot_sessions(sessions, users, packages, payments, "active")
    snap = latest_snapshot(feed, at)
    j = (base.join(hotspot_users.select("hotspot_user_id", "username"), "hotspot_user_id", "left")
         .join(snap, "username", "left"))
    return j.select(
        "session_id", "status", "started_at", "expires_at", "hotspot_user_id", "phone_number", "name",
        "package_name", "speed_mbps", "amount_kes",
        F.greatest(seconds_between(now, "expires_at"), F.lit(0)).alias("time_remaining_s"),
        F.when(F.col("bytes_in").isNotNull(), "online").otherwise("offline").alias("hotstatus"),
        F.coalesce("bytes_in", F.lit(0)).alias("bytes_in"), F.coalesce("bytes_out", F.lit(0)).alias("bytes_out"))


def first_callbacks(parsed: DataFrame) -> DataFrame:
    """The first callback per checkout id by (received_at, event_id); later ones ignored."""
    cols = [c for c in parsed.columns if c != "checkout_request_id"]
    first = parsed.groupBy("checkout_request_id").agg(
        F.min_by(F.struct(*cols), F.struct("received_at", "event_id")).alias("f"))
    return first.select("checkout_request_id", *[F.col("f")[c].alias(c) for c in cols])


def settle_join(first: DataFrame, payments: DataFrame, packages: DataFrame) -> DataFrame:
    """Successful first callbacks matched to their payment and package (UPDATE..FROM).

    Amount comes from the callback when present, else the payment's own."""
    ok = first.where(F.col("result_code") == 0).select(
        "checkout_request_id", "receipt_number", "transaction_date", F.col("amount_kes").alias("cb_amount"))
    j = (ok.join(payments.select("payment_id", "user_id", "package_id", "checkout_request_id", "amount_kes"),
                 "checkout_request_id")
         .join(packages.select("package_id", "duration_hours"), "package_id"))
    return j.select("payment_id", "user_id", "package_id", "duration_hours", "checkout_request_id",
                    F.lit("completed").alias("status"), "receipt_number", "transaction_date",
                    F.coalesce("cb_amount", "amount_kes").alias("amount_kes"))


def clean_feed(feed: DataFrame) -> DataFrame:
    """Router rows with blank counters as 0 and rows without a user dropped."""
    def num(c):
        return F.coalesce(F.col(c).try_cast("bigint"), F.lit(0)).alias(c)
    return feed.where(F.col("user").isNotNull()).select(
        "polled_at", "user", "address", num("bytes_in"), num("bytes_out"), "uptime")


def latest_snapshot(feed: DataFrame, at: str) -> DataFrame:
    """Who the newest poll up to the clock lists, one cleaned row per username.

    The poll's time is the newest in the whole feed, rows without a user included; a
    user it does not list is not there, however recently an earlier poll saw them."""
    newest = feed.where(F.col("polled_at") <= clock.at(at)).agg(F.max("polled_at")).scalar()
    f = clean_feed(feed.where(F.col("polled_at") == newest))
    return f.groupBy(F.col("user").alias("username")).agg(
        F.max(F.struct("address", "bytes_in", "bytes_out")).alias("s")
    ).select("username", "s.bytes_in", "s.bytes_out", "s.address")


def online_enrich(sessions: DataFrame, hotspot_users: DataFrame, feed: DataFrame, at: str) -> DataFrame:
    """Active sessions with live router stats; default offline and 0 bytes.

    Stats are keyed by username, so the session's hotspot user is resolved to
    its username first (the lookup the service meant to do)."""
    now = clock.at(at)
    snap = latest_snapshot(feed, at)
    s = sessions.where(F.col("status") == "active").join(
        hotspot_users.select("hotspot_user_id", "username"), "hotspot_user_id", "left")
    j = s.join(snap, "username", "left")
    return j.select(
        "session_id", "user_id", "hotspot_user_id", "expires_at",
        F.greatest(seconds_between(now, "expires_at"), F.lit(0)).alias("time_remaining_s"),
        F.when(F.col("bytes_in").isNotNull(), "online").otherwise("offline").alias("hotstatus"),
        F.coalesce("bytes_in", F.lit(0)).alias("bytes_in"), F.coalesce("bytes_out", F.lit(0)).alias("bytes_out"))


# Display metadata per catalogue name, and the entry used for unknown names.
PACKAGE_METADATA = [
    # (name, key, type, badge, icon, data_gb)
    ("Student Package", "student", "data", "STUDENT OFFER", "school", 2),
    ("30 Minutes Unlimited", "p30min", "unlimited", None, "timer", None),
    ("1 Hour Unlimited", "p1hr", "unlimited", None, "timer", None),
    ("2 Hours Unlimited", "p2hr", "unlimited", None, "bolt", None),
    ("3 Hours Unlimited", "p3hr", "unlimited", None, "bolt", None),
    ("12 Hours Unlimited", "p12hr", "unlimited", None, "brightness_4", None),
    ("1 Day Unlimited", "p1day", "unlimited", None, "calendar_today", None),
    ("1 Week Unlimited", "p1week", "unlimited", None, "calendar_month", None),
    ("2 Weeks Unlimited", "p2week", "unlimited", "MOST POPULAR", "calendar_month", None),
    ("1 Month Unlimited", "p1month", "unlimited", "BEST VALUE", "calendar_month", None),
]
DEFAULT_METADATA_KEY = "p1day"


def metadata_table(spark: SparkSession) -> DataFrame:
    schema = "name string, meta_key string, type string, badge string, icon string, data_gb int"
    return spark.createDataFrame(PACKAGE_METADATA, schema)


def metadata_lookup(spark: SparkSession, packages: DataFrame) -> DataFrame:
    """Package display metadata by name; unknown names get the default entry.

    The lookup is a constant 10-row table, so broadcasting it is size-safe; the
    default entry is a fixed value and enters as literals."""
    meta = F.broadcast(metadata_table(spark))
    default = next(r for r in PACKAGE_METADATA if r[1] == DEFAULT_METADATA_KEY)
    j = packages.join(meta, packages.package_name == meta.name, "left")
    known = F.col("meta_key").isNotNull()

    def pick(col: str, value, typ: str):
        return F.when(known, F.col(col)).otherwise(F.lit(value).cast(typ)).alias(col)

    return j.select("package_id", "package_name", pick("meta_key", default[1], "string"),
                    pick("type", default[2], "string"), pick("badge", default[3], "string"),
                    pick("icon", default[4], "string"), pick("data_gb", default[5], "int"))


def concurrent_sessions(sessions: DataFrame) -> DataFrame:
    """Active sessions with credentials whose user holds another such session.

    As written: status only, no time test.  A per-user count (partial aggregate)
    joined back on user_id replaces a window.  The counts are checkpointed: an aggregate
    between the shuffle and the join would keep AQE from splitting a hot user."""
    s = sessions.where((F.col("status") == "active") & F.col("hotspot_user_id").isNotNull()) \
        .select("session_id", "user_id", "hotspot_user_id", "expires_at")
    n = stable(s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_active")).where(F.col("n_active") > 1))
    return s.join(n, "user_id") \
        .select("session_id", "user_id", "hotspot_user_id", "expires_at",
                (F.col("n_active") - 1).alias("n_other_active"))


def overlapping_sessions(sessions: DataFrame) -> DataFrame:
    """J12t: a session that starts before the user's earlier sessions have expired.

    prev_max_expires is the running max of expires_at over the user's earlier
    sessions in (started_at, session_id) order.  Sessions are range-partitioned and
    sorted in that order and checkpointed, so a hot user, or a hot day of one, is spread
    over tasks; a window runs inside each (partition, user), and the maximum of a user's
    earlier partitions comes from a table of one row per (partition, user).  A NULL user
    is a user of its own (matched null-safely).
    """
    s = sessions.select("session_id", "user_id", "started_at", "expires_at")
    parts = tagged_ranges(s, ["user_id", "started_at", "session_id"])
    inside = Window.partitionBy("_pid", "user_id").orderBy("started_at", "session_id") \
        .rowsBetween(Window.unboundedPreceding, -1)
    seen = parts.withColumn("_in", F.max("expires_at").over(inside))
    tops = parts.groupBy("_pid", "user_id").agg(F.max("expires_at").alias("_top"))
    before = Window.partitionBy("user_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    tops = stable(tops.withColumn("_before", F.max("_top").over(before)).where(F.col("_before").isNotNull())
                  .select(F.col("_pid").alias("_t_pid"), F.col("user_id").alias("_t_user"), "_before"))
    # only a user that goes on from an earlier partition has a row there: at most one user per partition
    j = seen.join(tops, (F.col("_pid") == F.col("_t_pid")) & F.col("user_id").eqNullSafe(F.col("_t_user")), "left")
    prev = F.greatest("_in", "_before")
    return j.select("session_id", "user_id", "started_at", "expires_at", prev.alias("prev_max_expires"),
                    F.coalesce(F.col("started_at") < prev, F.lit(False)).alias("overlaps"))


PAYMENTS_PER_TASK = 1_000_000


def session_exists(payments: DataFrame, sessions: DataFrame) -> DataFrame:
    """Completed payments split by whether a session already exists (semi / anti join).

    Both inputs are derived once, in tasks of a fixed size, into checkpoints that both joins read; the
    joins have a task for every million rows at least."""
    spark = payments.sparkSession
    with small_tasks(spark):
        p = stable(payments.where(F.col("status") == "completed").select("payment_id", "user_id", "package_id"))
        s = stable(sessions.select("payment_id").where(F.col("payment_id").isNotNull()))
    tasks = -(-max(p.count(), s.count()) // PAYMENTS_PER_TASK)
    if tasks > 1:  # a number given here is not merged again
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        p, s = p.repartition(tasks, "payment_id"), s.repartition(tasks, "payment_id")
    has = p.join(s, "payment_id", "left_semi").withColumn("has_session", F.lit(True))
    hasnt = p.join(s, "payment_id", "left_anti").withColumn("has_session", F.lit(False))
    return has.unionByName(hasnt)


def duplicate_phones(attempts: DataFrame, raw_col: str = "raw_phone") -> DataFrame:
    """Attempts whose normalised phone was used more than once.

    Phones are normalised once, into a checkpoint that is counted and joined.  The counts per
    phone (partial aggregate) are checkpointed too, so that AQE can split a hot phone in the join back."""
    a = stable(attempts.select("event_id", raw_col, phones.normalise(raw_col).alias("phone")).where(F.col("phone").isNotNull()))
    dup = stable(a.groupBy("phone").agg(F.count(F.lit(1)).alias("n_attempts")).where(F.col("n_attempts") > 1))
    return a.join(dup, "phone").select("event_id", raw_col, "phone", "n_attempts")
