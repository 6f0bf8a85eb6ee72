"""U: state transitions as pure functions ``old table + changes -> new table``.

Parquet tables are immutable, so every write-path of the service becomes a
join/projection that returns the whole next version (written to a new path
by the caller).  Each is idempotent: applying it to its own output changes
nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import clock
from ..functions import callbacks, phones

SESSION_COLS = ["session_id", "user_id", "package_id", "payment_id", "hotspot_user_id", "started_at", "expires_at",
                "status", "ended_at", "bytes_downloaded", "bytes_uploaded", "data_used_mb"]


def expire_sessions(sessions: DataFrame, at: str) -> DataFrame:
    """Active sessions with expires_at <= now become expired with ended_at = now.

    One projection replaces the row-at-a-time sweep; ``changed`` marks the set
    the sweep would have returned."""
    now = clock.at(at)
    due = (F.col("status") == "active") & (F.col("expires_at") <= now)
    return sessions.select(*[c for c in SESSION_COLS if c not in ("status", "ended_at")],
                           F.when(due, F.lit("expired")).otherwise(F.col("status")).alias("status"),
                           F.when(due, now).otherwise(F.col("ended_at")).alias("ended_at"),
                           due.alias("changed")).select(*SESSION_COLS, "changed")


def disconnect(sessions: DataFrame, requests: DataFrame, admin_requests: DataFrame | None = None) -> DataFrame:
    """Disconnect requests applied as one batch.

    * ``requests`` (user_id, requested_at): the user's first open session (oldest
      start, then id) becomes disconnected at the user's latest request time;
    * ``admin_requests`` (session_id, requested_at): that session becomes
      disconnected whatever its status, as the admin UPDATE has no status test.

    When several requests touch one session the latest one's time is kept, as the
    last UPDATE would."""
    req = requests.groupBy("user_id").agg(F.max("requested_at").alias("requested_at"))
    first_open = (sessions.where(F.col("status") == "active").groupBy("user_id")
                  .agg(F.min_by("session_id", F.struct("started_at", "session_id")).alias("target")))
    targets = first_open.join(req, "user_id").select(F.col("target").alias("session_id"), "requested_at")
    if admin_requests is not None:
        targets = targets.unionByName(admin_requests.select("session_id", "requested_at"))
    targets = targets.groupBy("session_id").agg(F.max("requested_at").alias("requested_at"))
    j = sessions.join(targets, "session_id", "left")
    hit = F.col("requested_at").isNotNull()
    return j.select(*[c for c in SESSION_COLS if c not in ("status", "ended_at")],
                    F.when(hit, F.lit("disconnected")).otherwise(F.col("status")).alias("status"),
                    F.when(hit, F.col("requested_at")).otherwise(F.col("ended_at")).alias("ended_at"),
                    hit.alias("changed")).select(*SESSION_COLS, "changed")


def open_sessions(sessions: DataFrame, payments: DataFrame, packages: DataFrame, at: str) -> DataFrame:
    """Each completed payment without a session gets one, expiring after the package's hours.

    New ids are ``-payment_id`` (deterministic, so re-running inserts nothing:
    the anti-join on payment_id plays ON CONFLICT DO NOTHING)."""
    return sessions.select(*SESSION_COLS).unionByName(new_sessions(sessions, payments, packages, at))


def new_sessions(sessions: DataFrame, payments: DataFrame, packages: DataFrame, at: str) -> DataFrame:
    """The rows that U3 inserts."""
    now = clock.at(at)
    have = sessions.select("payment_id").where(F.col("payment_id").isNotNull())
    todo = (payments.where((F.col("status") == "completed") & (F.col("updated_at") <= now))
            .select("payment_id", "user_id", "package_id")
            .join(have, "payment_id", "left_anti")
            .join(packages.select("package_id", "duration_hours"), "package_id"))
    return todo.select(
        (-F.col("payment_id")).alias("session_id"), "user_id", "package_id", "payment_id",
        F.lit(None).cast("bigint").alias("hotspot_user_id"), now.alias("started_at"),
        F.timestamp_add("HOUR", F.col("duration_hours"), now).alias("expires_at"), F.lit("active").alias("status"),
        F.lit(None).cast("timestamp_ntz").alias("ended_at"), F.lit(0).cast("bigint").alias("bytes_downloaded"),
        F.lit(0).cast("bigint").alias("bytes_uploaded"), F.lit(0).cast("decimal(12,2)").alias("data_used_mb"))


PACKAGE_FIELDS = ["package_name", "duration_hours", "price_kes", "speed_mbps", "is_active", "sort_order"]


def patch_packages(packages: DataFrame, patches: DataFrame, at: str) -> DataFrame:
    """U4: non-null patch fields overwrite; every patched row gets updated_at = now
    (the UPDATE matches the row and its trigger fires even when all fields are NULL)."""
    p = patches.select("package_id", F.lit(True).alias("_hit"), *[F.col(c).alias("_p_" + c) for c in PACKAGE_FIELDS])
    j = packages.join(p, "package_id", "left")
    cols = [F.coalesce(F.col("_p_" + c), F.col(c)).alias(c) for c in PACKAGE_FIELDS]
    return j.select("package_id", *cols,
                    F.when(F.col("_hit"), clock.at(at)).otherwise(F.lit(None).cast("timestamp_ntz"))
                    .alias("updated_at"))


def settle_payments(payments: DataFrame, first: DataFrame) -> DataFrame:
    """Apply each checkout's first callback to its payment, unless already settled.

    Success: completed, receipt, transaction date, amount if given.  Any other code, and
    a callback without a code: failed with the result text as reason.  updated_at = callback time."""
    cb = first.select("checkout_request_id", "result_code", "result_desc", "receipt_number", "transaction_date",
                      F.col("amount_kes").alias("cb_amount"), "received_at", F.lit(True).alias("_answered"))
    j = payments.join(cb, "checkout_request_id", "left")
    open_ = ~F.col("status").isin("completed", "failed") & F.coalesce("_answered", F.lit(False))
    ok = open_ & F.col("result_code").eqNullSafe(F.lit(0))
    bad = open_ & ~F.col("result_code").eqNullSafe(F.lit(0))
    return j.select(
        "payment_id", "user_id", "package_id", "checkout_request_id",
        F.when(ok, F.coalesce("cb_amount", "amount_kes")).otherwise(F.col("amount_kes")).alias("amount_kes"),
        F.when(ok, F.lit("completed")).when(bad, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.when(ok, F.col("receipt_number")).alias("receipt_number"),
        F.when(ok, F.col("transaction_date")).alias("transaction_date"),
        F.when(bad, F.col("result_desc")).alias("failure_reason"),
        "created_at",
        F.when(open_, F.col("received_at")).otherwise(F.col("updated_at")).alias("updated_at"),
        open_.alias("changed"))


def touch_changed(old: DataFrame, new: DataFrame, key: str, cols: list[str], at: str) -> DataFrame:
    """Rows whose values changed (null-safe) get updated_at = now; others keep theirs."""
    o = old.select(key, *[F.col(c).alias("_o_" + c) for c in cols])
    j = new.join(o, key, "left")
    changed = F.lit(False)
    for c in cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col("_o_" + c))
    keep = [c for c in new.columns if c != "updated_at"]
    prev = F.col("updated_at") if "updated_at" in new.columns else F.lit(None).cast("timestamp_ntz")
    return j.select(*keep, F.when(changed, clock.at(at)).otherwise(prev).alias("updated_at"),
                    changed.alias("changed"))


def audit_diff(old: DataFrame, new: DataFrame, key: str, cols: list[str], target_type: str, at: str) -> DataFrame:
    """One audit row per changed target: old and new values of the changed columns as JSON."""
    o = old.select(key, *[F.col(c).cast("string").alias("_o_" + c) for c in cols])
    j = new.select(key, *[F.col(c).cast("string").alias(c) for c in cols]).join(o, key)
    entries = F.array(*[F.struct(F.lit(c).alias("k"), F.col("_o_" + c).alias("o"), F.col(c).alias("n"))
                        for c in cols])
    diff = F.filter(entries, lambda e: ~e["o"].eqNullSafe(e["n"]))
    j = j.select(key, diff.alias("d")).where(F.size("d") > 0)
    return j.select(F.lit("update").alias("action"), F.lit(target_type).alias("target_type"),
                    F.col(key).alias("target_id"),
                    F.to_json(F.map_from_entries(F.transform("d", lambda e: F.struct(e["k"], e["o"])))).alias("old_values"),
                    F.to_json(F.map_from_entries(F.transform("d", lambda e: F.struct(e["k"], e["n"])))).alias("new_values"),
                    clock.at(at).alias("created_at"))


def last_login(users: DataFrame, logins: DataFrame) -> DataFrame:
    """U8: newest successful login per user (phone normalised, matched to the user) merged in."""
    l = logins.select(phones.normalise("raw_phone").alias("phone_number"), "ts").where(F.col("phone_number").isNotNull())
    newest = l.groupBy("phone_number").agg(F.max("ts").alias("_last"))
    j = users.join(newest, "phone_number", "left")
    prev = F.col("last_login_at") if "last_login_at" in users.columns else F.lit(None).cast("timestamp_ntz")
    keep = [c for c in users.columns if c != "last_login_at"]
    return j.select(*keep, F.greatest(prev, F.col("_last")).alias("last_login_at"))


def attach_credentials(sessions: DataFrame, eligible: DataFrame, hotspot_users: DataFrame, users: DataFrame,
                       packages: DataFrame, same_user: bool = False) -> DataFrame:
    """Eligible payments' active sessions without credentials get the user's hotspot
    account (existing by phone, else a new id ``-user_id``), plus its speed limits.
    ``same_user``: as in J5, the eligible payment's user is the session's."""
    on = ["user_id", "session_id"] if same_user else ["session_id"]
    acct = (users.select("user_id", "phone_number")
            .join(hotspot_users.select("phone_number", "hotspot_user_id"), "phone_number", "left")
            .select("user_id", F.coalesce("hotspot_user_id", -F.col("user_id")).alias("_hid"),
                    phones.hotspot_username("phone_number").alias("hotspot_username")))
    e = (eligible.where(F.col("active_session_id").isNotNull())
         .withColumn("session_id", F.col("active_session_id")).select(*on, F.lit(True).alias("_e")))
    j = sessions.join(e, on, "left").join(acct, "user_id", "left") \
        .join(packages.select("package_id", "speed_mbps"), "package_id", "left")
    hit = F.coalesce("_e", F.lit(False)) & F.col("hotspot_user_id").isNull() & (F.col("status") == "active")
    out = [F.when(hit, F.col("_hid")).otherwise(F.col("hotspot_user_id")).alias("hotspot_user_id")
           if c == "hotspot_user_id" else F.col(c) for c in SESSION_COLS]
    return j.select(*out, F.when(hit, F.col("hotspot_username")).alias("hotspot_username"),
                    F.when(hit, F.col("speed_mbps")).alias("downlink_mbps"),
                    F.when(hit, (F.col("speed_mbps") / 2).cast("decimal(10,1)")).alias("uplink_mbps"),
                    hit.alias("changed"))


def open_payments(requests: DataFrame, packages: DataFrame) -> DataFrame:
    """Purchase requests become pending payments priced from the active package;
    requests for missing or inactive packages are rejected with a reason."""
    active = packages.where(F.col("is_active")).select("package_id", "price_kes")
    j = requests.join(active, "package_id", "left")
    ok = F.col("price_kes").isNotNull()
    return j.select("request_id", "user_id", "package_id", "phone_number",
                    F.when(ok, F.col("price_kes")).alias("amount_kes"),
                    F.when(ok, F.lit("pending")).otherwise(F.lit("rejected")).alias("status"),
                    F.when(~ok, F.lit("Package not found or inactive.")).alias("failure_reason"),
                    "requested_at")


def reconcile_payments(payments: DataFrame, polls: DataFrame, at: str, min_age_s: int = 15) -> DataFrame:
    """Unsettled payments older than ``min_age_s`` take the outcome of their newest status poll (F10 + C10).

    Code 0 completes the payment, the listed codes fail it with the poll's text, any other code
    (or no answer) leaves it as it is.  Unlike a callback a poll brings no receipt, date or amount.
    Polls count per checkout before the join (``max_by``), so a payment polled without end is one row."""
    due = ~F.col("status").isin("completed", "failed") & (F.col("created_at") < clock.minus(at, seconds=min_age_s))
    known = polls.where(F.col("result_code").isNotNull() & (F.col("polled_at") <= clock.at(at)))
    newest = known.groupBy("checkout_request_id").agg(F.max_by(F.struct("result_code", "result_desc", "polled_at"), F.struct("polled_at", "result_code")).alias("_p"))
    j = payments.join(newest, "checkout_request_id", "left")
    outcome = callbacks.poll_outcome(F.col("_p.result_code"))
    hit = F.coalesce(due & F.col("_p").isNotNull() & (outcome != "pending"), F.lit(False))
    keep = [c for c in payments.columns if c not in ("status", "updated_at")]
    return j.select(*keep, F.when(hit, outcome).otherwise(F.col("status")).alias("status"),
                    F.when(hit & (outcome == "failed"), F.col("_p.result_desc")).alias("failure_reason"),
                    F.when(hit, F.col("_p.polled_at")).otherwise(F.col("updated_at")).alias("updated_at"), hit.alias("changed"))


def _package_rules() -> list[tuple[str, Column]]:
    """The rules of a package request, in the order they are checked."""
    def whole(c: str) -> Column:
        return F.col(c).rlike("^[0-9]+$") & (F.col(c).try_cast("int") >= 1)
    return [("name_not_empty", F.length(F.trim(F.col("package_name"))) > 0), ("duration_int_ge_1", whole("duration_hours")),
            ("price_ge_1", F.col("price_kes").try_cast("decimal(10,2)") >= 1), ("speed_int_ge_1", whole("speed_mbps"))]


def create_packages(packages: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(packages with the valid requests inserted, the refused requests with the rules they break).

    Fields arrive as typed text.  New ids are ``-request_id`` (deterministic; a request whose package
    is there already inserts nothing), new packages are active, a missing sort order is 0."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in _package_rules()]), lambda r: r.isNotNull())
    r = requests.withColumn("broken_rules", broken)
    new = r.where(F.size("broken_rules") == 0).select(
        (-F.col("request_id")).alias("package_id"), "package_name", F.col("duration_hours").cast("int").alias("duration_hours"),
        F.col("price_kes").cast("decimal(10,2)").alias("price_kes"), F.col("speed_mbps").cast("int").alias("speed_mbps"), F.lit(True).alias("is_active"),
        F.coalesce("sort_order", F.lit(0)).cast("bigint").alias("sort_order"))
    new = new.join(packages.select("package_id"), "package_id", "left_anti").select(*packages.columns)
    return packages.unionByName(new), r.where(F.size("broken_rules") > 0).select("request_id", "package_name", F.array_join("broken_rules", ",").alias("broken_rules"))


def start_session(sessions: DataFrame, requests: DataFrame, payments: DataFrame, packages: DataFrame) -> DataFrame:
    """U13, the manual path: (request_id, user_id, payment_id, ip_address, requested_at) to sessions, or refusals.

    The payment must be the user's own and completed, and have no session yet.  Of several
    requests for one payment the first by (requested_at, request_id) wins, the others find its session.
    Returns one row per request: session_id (``-payment_id``), times, address and ``refusal``."""
    paid = payments.where(F.col("status") == "completed").select("payment_id", "user_id", "package_id").join(
        packages.select("package_id", "duration_hours"), "package_id")
    taken = sessions.select("payment_id", F.lit(True).alias("_taken")).where(F.col("payment_id").isNotNull())
    first = requests.groupBy("payment_id", "user_id").agg(F.min(F.struct("requested_at", "request_id")).alias("_first"))
    j = (requests.join(paid, ["payment_id", "user_id"], "left").join(taken, "payment_id", "left")
         .join(first, ["payment_id", "user_id"], "left"))
    refusal = (F.when(F.col("package_id").isNull(), "Completed payment not found.")
               .when(F.col("_taken") | (F.col("_first.request_id") != F.col("request_id")), "Session already exists for this payment."))
    ok = refusal.isNull()
    return j.select("request_id", "user_id", "payment_id", F.when(ok, -F.col("payment_id")).alias("session_id"), F.when(ok, F.col("package_id")).alias("package_id"),
                    F.when(ok, F.col("ip_address")).alias("ip_address"), F.when(ok, F.col("requested_at")).alias("started_at"),
                    F.when(ok, F.timestamp_add("HOUR", F.col("duration_hours"), F.col("requested_at"))).alias("expires_at"), refusal.alias("refusal"))
