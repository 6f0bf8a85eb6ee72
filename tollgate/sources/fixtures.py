"""The business tables, derived from the driver's parquet tables.

The mapping is the one written down in FIXTURES.md: ``customer`` becomes
``users``, ``part`` becomes ``packages``, ``orders`` + ``lineitem`` become the
long-history ``payments``, ``events`` becomes the 30-day ``payments_live``,
callbacks and logins; sessions follow from completed payments.  Everything is a
lazy projection or join over the scans, so Catalyst prunes and pushes filters
straight through to parquet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from .tables import read_table


POLL_SECONDS = 6 * 3600


def bucket_end(ts: str, seconds: int) -> Column:
    """End of the epoch-aligned window of ``seconds`` that holds ``ts``."""
    us = F.timestamp_diff("MICROSECOND", _ntz("1970-01-01 00:00:00"), F.col(ts))
    return F.timestamp_add("MICROSECOND", F.lit(seconds * 1_000_000) - us % F.lit(seconds * 1_000_000), F.col(ts))


def _ntz(s: str) -> Column:
    return F.to_timestamp_ntz(F.lit(s))


def _phone(key: Column) -> Column:
    return F.concat(F.lit("2547"), F.lpad(key.cast("string"), 8, "0"))


def users_from(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        k.alias("user_id"),
        _phone(k).alias("phone_number"),
        F.col("c_name").alias("name"),
        F.when(k % 50 == 0, "admin").otherwise("user").alias("role"),
        (F.col("c_acctbal") >= 0).alias("is_active"),
        F.timestamp_add("HOUR", k, _ntz("1995-01-01 00:00:00")).alias("created_at"),
    )


def packages_from(part: DataFrame) -> DataFrame:
    size = F.col("p_size")
    return part.select(
        F.col("p_partkey").alias("package_id"),
        F.col("p_name").alias("package_name"),
        F.when(size <= 4, size).when(size <= 6, 12).when(size <= 15, 24).when(size <= 25, 168)
         .when(size <= 35, 336).otherwise(720).alias("duration_hours"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price_kes"),
        F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("")).cast("int").alias("speed_mbps"),
        (F.col("p_type") != "SMALL").alias("is_active"),
        (F.col("p_partkey") % 10).alias("sort_order"),
    )


def payments_from(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # one package per order: the smallest part key of its line items
    first_part = lineitem.groupBy("l_orderkey").agg(F.min("l_partkey").alias("package_id"))
    o = orders.join(first_part, orders.o_orderkey == first_part.l_orderkey, "inner")
    k = F.col("o_orderkey")
    offset = (k * 7919) % 86400
    return o.select(
        k.alias("payment_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("package_id"),
        F.col("o_totalprice").cast("decimal(10,2)").alias("amount_kes"),
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending")
         .when(F.col("o_orderpriority") == "5-LOW", "cancelled").otherwise("failed").alias("status"),
        F.concat(F.lit("ws_CO_"), k.cast("string")).alias("checkout_request_id"),
        F.timestamp_add("SECOND", offset, F.col("o_orderdate")).alias("created_at"),
        F.timestamp_add("SECOND", offset + k % 3600, F.col("o_orderdate")).alias("updated_at"),
    )


def payments_live_from(events: DataFrame) -> DataFrame:
    e = events.where(F.col("event_type").isin("purchase", "error", "signup"))
    k = F.col("event_id")
    return e.select(
        k.alias("payment_id"),
        F.col("user_id"),
        (k % 200).alias("package_id"),
        F.col("value").cast("decimal(10,2)").alias("amount_kes"),
        F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
         .otherwise("pending").alias("status"),
        F.concat(F.lit("ws_CO_"), k.cast("string")).alias("checkout_request_id"),
        F.col("ts").alias("created_at"),
        F.timestamp_add("SECOND", k % 600, F.col("ts")).alias("updated_at"),
    )


def sessions_from(payments: DataFrame, packages: DataFrame, at: str) -> DataFrame:
    """One session per completed payment, opened at its settlement time."""
    now = clock.at(at)
    pid = F.col("payment_id")
    p = payments.where((F.col("status") == "completed") & (pid % 13 != 0) & (F.col("updated_at") <= now))
    b = p.join(packages.select("package_id", "duration_hours"), "package_id", "inner")
    expires = F.timestamp_add("HOUR", F.col("duration_hours"), F.col("updated_at"))
    cents = F.floor(F.col("amount_kes") * 100).cast("bigint")
    b = b.select(
        pid.alias("session_id"), "user_id", "package_id",
        F.when(pid % 29 == 0, F.lit(None).cast("bigint")).otherwise(pid).alias("payment_id"),
        F.when(pid % 4 == 0, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("hotspot_user_id"),
        F.col("updated_at").alias("started_at"),
        expires.alias("expires_at"),
        "duration_hours",
        F.when(pid % 11 == 0, "disconnected").when((pid % 3 == 0) & (expires <= now), "expired")
         .otherwise("active").alias("status"),
        (cents * 10486).alias("bytes_downloaded"),
        (cents * 2621).alias("bytes_uploaded"),
    )
    ended = (F.when(F.col("status") == "disconnected",
                    F.timestamp_add("MINUTE", F.col("duration_hours") * 30, F.col("started_at")))
             .when(F.col("status") == "expired", F.col("expires_at")))
    used_mb = ((F.col("bytes_downloaded") + F.col("bytes_uploaded")).cast("decimal(20,2)") / F.lit(1048576)) \
        .cast("decimal(12,2)")
    return b.select("session_id", "user_id", "package_id", "payment_id", "hotspot_user_id", "started_at",
                    "expires_at", "status", ended.alias("ended_at"), "bytes_downloaded", "bytes_uploaded",
                    used_mb.alias("data_used_mb"))


def hotspot_users_from(users: DataFrame) -> DataFrame:
    return users.where(F.col("user_id") % 5 != 0).select(
        F.col("user_id").alias("hotspot_user_id"), "phone_number", F.col("phone_number").alias("username"))


def bandwidth_logs_from(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    l = lineitem.join(orders.select("o_orderkey", "o_custkey"), lineitem.l_orderkey == orders.o_orderkey)
    q = F.col("l_quantity").cast("bigint")
    start = F.timestamp_add("MINUTE", F.col("l_linenumber") * 10, F.col("l_shipdate"))
    end = F.timestamp_add("MINUTE", F.col("l_linenumber") * 10 + 10, F.col("l_shipdate"))
    return l.select(
        F.col("l_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"),
        (q * 1048576).alias("bytes_downloaded"), (q * 262144).alias("bytes_uploaded"),
        (q * 1000).alias("packets_in"), (q * 250).alias("packets_out"),
        start.alias("period_start"), end.alias("period_end"))


def callbacks_from(events: DataFrame) -> DataFrame:
    """Settlement callbacks as raw JSON text; every tenth one is delivered twice."""
    e = events.where(F.col("event_type").isin("purchase", "error"))
    k = F.col("event_id")
    e = e.select("*", F.explode(F.when(k % 10 == 0, F.array(F.lit(0), F.lit(1)))
                                 .otherwise(F.array(F.lit(0)))).alias("n"))
    body = F.concat(
        F.lit('{"Body":{"stkCallback":{"CheckoutRequestID":"ws_CO_'), k.cast("string"),
        F.lit('","ResultCode":'), F.when(F.col("event_type") == "purchase", "0").otherwise("1032"),
        F.lit(',"ResultDesc":"r","CallbackMetadata":{"Item":[{"Name":"Amount","Value":'),
        F.col("value").cast("decimal(10,2)").cast("string"),
        F.lit('},{"Name":"MpesaReceiptNumber","Value":"R'), k.cast("string"), F.lit('"}]}}}}'))
    return e.select(k.alias("event_id"),
                    F.timestamp_add("SECOND", F.col("n") * 60, F.col("ts")).alias("received_at"),
                    body.alias("body"))


def callback_deliveries_from(callbacks: DataFrame) -> DataFrame:
    """What the webhook really receives: the callbacks, some of them cut short or wrongly typed."""
    k, body = F.col("event_id") % 40, F.col("body")
    broken = (F.when(k == 1, F.substring(body, 1, 30)).when(k == 2, F.lit('{"unexpected":true}'))
              .when(k == 3, F.regexp_replace(body, '"Value":[0-9.-]+', '"Value":"n/a"'))
              .when(k == 4, F.regexp_replace(body, '"Value":[0-9.-]+', '"Value":123456789012.5'))
              .when(k == 5, F.regexp_replace(body, '"ResultCode":[0-9]+', '"ResultCode":"zero"'))
              .when(k == 6, F.regexp_replace(body, '"Value":[0-9.-]+', '"Value":""')).otherwise(body))
    return callbacks.withColumn("body", broken)


def poll_results_from(events: DataFrame) -> DataFrame:
    """Answers of the payment status poll for sign-up payments: paid, refused, or still in progress."""
    e = events.where(F.col("event_type") == "signup")
    k = F.col("event_id") % 5
    return e.where(k != 4).select(
        F.concat(F.lit("ws_CO_"), F.col("event_id").cast("string")).alias("checkout_request_id"),
        F.when(k == 0, 0).when(k == 1, 1032).when(k == 2, 4999).cast("bigint").alias("result_code"),
        F.when(k == 1, "Request cancelled by user").when(k == 2, "In progress").alias("result_desc"),
        F.timestamp_add("SECOND", F.lit(20), F.col("ts")).alias("polled_at"))


def package_requests_from(part: DataFrame) -> DataFrame:
    """Requests to create packages, as typed into the admin form: some with a field that the rules refuse."""
    k = F.col("p_partkey")
    return part.where(k % 3 == 0).select(
        k.alias("request_id"), F.when(k % 21 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("package_name"),
        F.when(k % 15 == 0, F.lit("0.5")).when(k % 33 == 0, F.lit("a day")).otherwise(F.col("p_size").cast("string")).alias("duration_hours"),
        F.when(k % 12 == 0, F.lit("0.99")).otherwise(F.col("p_retailprice").cast("decimal(10,2)").cast("string")).alias("price_kes"),
        F.when(k % 27 == 0, F.lit(None).cast("string")).otherwise((k % 40).cast("string")).alias("speed_mbps"),
        F.when(k % 9 == 0, F.lit(None).cast("bigint")).otherwise(k % 10).alias("sort_order"))


def session_devices_from(events: DataFrame) -> DataFrame:
    """Addresses of the devices that sessions were opened from (a purchase opens a session); some are unknown."""
    k = F.col("event_id")
    h = F.lpad(F.lower(F.hex(k)), 6, "0")
    mac = F.concat_ws(":", F.lit("02"), F.lit("00"), F.lit("5e"), *[F.substring(h, i, 2) for i in (1, 3, 5)])
    ip = F.concat_ws(".", F.lit("10"), F.lit("5"), (F.col("user_id") % 256).cast("string"), (k % 256).cast("string"))
    return events.where((F.col("event_type") == "purchase") & (k % 6 != 0)).select(
        k.alias("session_id"), ip.alias("ip_address"), F.when(k % 7 != 0, mac).alias("mac_address"))


def start_requests_from(events: DataFrame) -> DataFrame:
    """Requests to start a session by hand: for one's own payment, some twice, some for another's."""
    e = events.where(F.col("event_type").isin("purchase", "error"))
    k = F.col("event_id")
    e = e.select("*", F.explode(F.when(k % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("n"))
    return e.select((k * 2 + F.col("n")).alias("request_id"), F.when(k % 8 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("user_id"),
                    k.alias("payment_id"), F.concat(F.lit("10.5.0."), (k % 256).cast("string")).alias("ip_address"),
                    F.timestamp_add("MINUTE", F.lit(10) + F.col("n"), F.col("ts")).alias("requested_at"))


def path_ids_from(events: DataFrame) -> DataFrame:
    """Ids typed into request paths: a UUID, in either case, cut short, or a plain number."""
    k = F.col("event_id")
    h = F.md5(k.cast("string"))
    u = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return events.where(F.col("event_type") == "click").select(
        "event_id", F.when(k % 10 == 0, k.cast("string")).when(k % 10 == 1, F.substring(u, 1, 30)).when(k % 10 == 2, F.upper(u)).otherwise(u).alias("path_id"))


def logins_from(events: DataFrame) -> DataFrame:
    """Login attempts with the phone typed five ways (one of them invalid)."""
    e = events.where(F.col("event_type").isin("click", "view"))
    k, u = F.col("event_id"), F.col("user_id").cast("string")
    pad = F.lpad(u, 8, "0")
    raw = (F.when(k % 5 == 0, F.concat(F.lit("07"), pad))
           .when(k % 5 == 1, F.concat(F.lit("+254 7"), pad))
           .when(k % 5 == 2, F.concat(F.lit("7"), pad))
           .when(k % 5 == 3, F.concat(F.lit("2547"), pad))
           .otherwise(F.concat(F.lit("99"), u)))
    return e.select("event_id", "ts", raw.alias("raw_phone"))


def activity_feed_from(events: DataFrame) -> DataFrame:
    """Router poll rows (user, address, bytes-in, bytes-out, uptime) as text.

    One row per 'view' event, listed by the next six-hourly poll; some counters are
    blank or missing and some rows carry no user, as router output does.
    """
    e = events.where(F.col("event_type") == "view")
    k = F.col("event_id")
    return e.select(
        bucket_end("ts", POLL_SECONDS).alias("polled_at"),
        F.when(k % 17 == 0, F.lit(None).cast("string")).otherwise(_phone(F.col("user_id"))).alias("user"),
        F.concat(F.lit("10.5."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                 (k % 256).cast("string")).alias("address"),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.floor(F.col("value") * 1000).cast("bigint").cast("string"))
         .alias("bytes_in"),
        F.when(k % 11 == 0, F.lit(None).cast("string")).otherwise((k * 13).cast("string")).alias("bytes_out"),
        F.concat(F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":00:00")).alias("uptime"),
    )


def disconnect_requests_from(events: DataFrame, at: str) -> DataFrame:
    """Disconnect requests: every click up to the clock."""
    e = events.where((F.col("event_type") == "click") & (F.col("ts") <= clock.at(at)))
    return e.select("user_id", F.col("ts").alias("requested_at"))


def admin_disconnects_from(events: DataFrame, at: str) -> DataFrame:
    """Admin disconnects by session id: dear purchases (value of 150 or more), cut off
    30 minutes after purchase, up to the clock."""
    e = events.where((F.col("event_type") == "purchase") & (F.col("value") >= 150)
                     & (F.col("ts") <= clock.minus(at, minutes=30)))
    return e.select(F.col("event_id").alias("session_id"),
                    F.timestamp_add("MINUTE", F.lit(30), F.col("ts")).alias("requested_at"))


def package_patches_from(part: DataFrame) -> DataFrame:
    """Admin edits to the catalogue: a price change and some other fields, NULL = keep."""
    k = F.col("p_partkey")
    p = part.where(k % 7 == 0)
    return p.select(
        k.alias("package_id"), F.lit(None).cast("string").alias("package_name"),
        F.lit(None).cast("int").alias("duration_hours"),
        (F.col("p_retailprice") + 1).cast("decimal(10,2)").alias("price_kes"),
        F.when(F.col("p_size") % 2 == 1, F.col("p_size")).alias("speed_mbps"),
        F.when(k % 14 == 0, F.lit(False)).alias("is_active"),
        F.when(k % 3 == 0, F.lit(99).cast("bigint")).alias("sort_order"))


def payments_pending_from(payments_live: DataFrame) -> DataFrame:
    """Payments before their callbacks arrive: three in four settled ones still pending."""
    k = F.col("payment_id")
    unsettled = (k % 4 != 0) & F.col("status").isin("completed", "failed")
    return payments_live.withColumn("status", F.when(unsettled, F.lit("pending")).otherwise(F.col("status")))


def purchase_requests_from(events: DataFrame) -> DataFrame:
    """Purchase requests: (user, package, phone) per click event."""
    e = events.where(F.col("event_type") == "click")
    return e.select(F.col("event_id").alias("request_id"), "user_id", (F.col("event_id") % 250).alias("package_id"),
                    _phone(F.col("user_id")).alias("phone_number"), F.col("ts").alias("requested_at"))


class Tables:
    """Lazily built business tables over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def users(self) -> DataFrame:
        return users_from(self.raw("customer"))

    @cached_property
    def packages(self) -> DataFrame:
        return packages_from(self.raw("part"))

    @cached_property
    def payments(self) -> DataFrame:
        return payments_from(self.raw("orders"), self.raw("lineitem"))

    @cached_property
    def payments_live(self) -> DataFrame:
        return payments_live_from(self.raw("events"))

    @cached_property
    def sessions(self) -> DataFrame:
        return sessions_from(self.payments, self.packages, clock.LONG)

    @cached_property
    def sessions_live(self) -> DataFrame:
        return sessions_from(self.payments_live, self.packages, clock.LIVE)

    @cached_property
    def hotspot_users(self) -> DataFrame:
        return hotspot_users_from(self.users)

    @cached_property
    def bandwidth_logs(self) -> DataFrame:
        return bandwidth_logs_from(self.raw("lineitem"), self.raw("orders"))

    @cached_property
    def callbacks(self) -> DataFrame:
        return callbacks_from(self.raw("events"))

    @cached_property
    def callback_deliveries(self) -> DataFrame:
        return callback_deliveries_from(self.callbacks)

    @cached_property
    def poll_results(self) -> DataFrame:
        return poll_results_from(self.raw("events"))

    @cached_property
    def package_requests(self) -> DataFrame:
        return package_requests_from(self.raw("part"))

    @cached_property
    def session_devices(self) -> DataFrame:
        return session_devices_from(self.raw("events"))

    @cached_property
    def start_requests(self) -> DataFrame:
        return start_requests_from(self.raw("events"))

    @cached_property
    def path_ids(self) -> DataFrame:
        return path_ids_from(self.raw("events"))

    @cached_property
    def logins(self) -> DataFrame:
        return logins_from(self.raw("events"))

    @cached_property
    def activity_feed(self) -> DataFrame:
        return activity_feed_from(self.raw("events"))

    @cached_property
    def disconnect_requests(self) -> DataFrame:
        return disconnect_requests_from(self.raw("events"), clock.LIVE)

    @cached_property
    def admin_disconnects(self) -> DataFrame:
        return admin_disconnects_from(self.raw("events"), clock.LIVE)

    @cached_property
    def package_patches(self) -> DataFrame:
        return package_patches_from(self.raw("part"))

    @cached_property
    def payments_pending(self) -> DataFrame:
        return payments_pending_from(self.payments_live)

    @cached_property
    def purchase_requests(self) -> DataFrame:
        return purchase_requests_from(self.raw("events"))

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents")
