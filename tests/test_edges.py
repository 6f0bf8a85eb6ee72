"""Hand-made rows for the edges the fixture tables do not reach."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tollgate.functions import labels, masking, phones
from tollgate.operators import aggregates as A
from tollgate.operators import filters as Fl
from tollgate.operators import joins as J
from tollgate.operators import ordering as L
from tollgate.operators import transitions as U
from tollgate.operators import windows as W
from util import packages, payments, rows, sessions, users

NOW = "2024-01-20 12:00:00"


@pytest.fixture()
def pk(spark):
    return packages(spark, [(1, "1 Hour Unlimited", 1, 10, 5, True, 3), (2, "1 Day Unlimited", 24, 80, 20, True, 7),
                            (3, "Old", 2, 15, 8, False, 4)])


def test_expire_boundary_and_idempotent(spark):
    s = sessions(spark, [
        (1, 1, 1, 1, None, "2024-01-20 11:00:00", "2024-01-20 12:00:00", "active", None, 1, 1),  # = now: due
        (2, 1, 1, 2, None, "2024-01-20 11:30:00", "2024-01-20 12:00:01", "active", None, 1, 1),  # later: not due
        (3, 2, 1, 3, None, "2024-01-20 10:00:00", "2024-01-20 11:00:00", "disconnected", "2024-01-20 10:30:00", 1, 1),
    ])
    out = U.expire_sessions(s, NOW)
    got = {r.session_id: (r.status, r.ended_at, r.changed) for r in out.collect()}
    assert got[1] == ("expired", dt.datetime(2024, 1, 20, 12), True)
    assert got[2] == ("active", None, False)
    assert got[3][0] == "disconnected" and not got[3][2]
    again = U.expire_sessions(out.drop("changed"), NOW)
    assert again.where("changed").count() == 0


def test_session_list_drops_manual_but_counts_them(spark, pk):
    s = sessions(spark, [(1, 1, 1, 10, None, "2024-01-20 11:00:00", "2024-01-20 12:30:00", "active", None, 0, 0),
                         (2, 1, 1, None, None, "2024-01-20 11:10:00", "2024-01-20 12:40:00", "active", None, 0, 0)])
    p = payments(spark, [(10, 1, 1, 10, "completed", "c10", "2024-01-20 10:59:00", "2024-01-20 11:00:00")])
    u = users(spark, [(1, "254700000001", "A", "user", True, "2024-01-01 00:00:00")])
    out = J.session_list(s, u, pk, p).collect()
    assert [r.session_id for r in out] == [1]
    assert out[0].total_sessions == 2


def test_daily_stats_null_ended_and_fanout(spark):
    s = sessions(spark, [
        (1, 1, 1, 1, None, "2024-01-20 08:00:00", "2024-01-20 09:00:00", "expired", "2024-01-20 09:00:00", 10, 0),
        (2, 1, 1, 2, None, "2024-01-20 10:00:00", "2024-01-20 11:00:00", "active", None, None, 5),
    ])
    p = payments(spark, [(1, 1, 1, 10, "completed", "c1", "2024-01-20 07:00:00", "2024-01-20 07:59:00"),
                         (2, 1, 1, 5, "failed", "c2", "2024-01-20 07:00:00", "2024-01-20 09:59:00")])
    written = A.daily_stats(s, p).collect()[0]
    safe = A.daily_stats_safe(s, p).collect()[0]
    # as written: 2 sessions x 2 payments = 4 rows; avg over the 2 rows with an end; revenue 10 x 2 sessions
    assert (written.total_sessions, written.avg_session_seconds, written.revenue_kes) == (4, 3600, decimal.Decimal("20.00"))
    assert (safe.total_sessions, safe.avg_session_seconds, safe.revenue_kes) == (2, 3600, decimal.Decimal("10.00"))
    assert safe.unique_users == written.unique_users == 1


def test_daily_stats_null_keys_never_match(spark):
    s = sessions(spark, [(1, None, 1, 1, None, "2024-01-20 08:00:00", "2024-01-20 09:00:00", "active", None, 1, 1)])
    p = payments(spark, [(1, None, 1, 10, "completed", "c1", "2024-01-20 07:00:00", "2024-01-20 07:59:00")])
    r = A.daily_stats(s, p).collect()[0]
    assert (r.total_sessions, r.revenue_kes, r.unique_users) == (1, 0, 0)


def test_current_session_ties_break_on_id(spark, pk):
    s = sessions(spark, [(5, 1, 1, 5, None, "2024-01-20 11:00:00", "2024-01-20 13:00:00", "active", None, 0, 0),
                         (4, 1, 2, 4, None, "2024-01-20 11:00:00", "2024-01-20 14:00:00", "active", None, 0, 0)])
    p = payments(spark, [(4, 1, 2, 80, "completed", "c4", "2024-01-20 10:00:00", "2024-01-20 11:00:00"),
                         (5, 1, 1, 10, "completed", "c5", "2024-01-20 10:00:00", "2024-01-20 11:00:00")])
    r = W.current_session(s, pk, p, NOW).collect()[0]
    assert r.session_id == 4 and r.seconds_remaining == 7200


def test_favourite_package_tie_by_name(spark, pk):
    s = sessions(spark, [(1, 1, 2, 1, None, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "expired", None, 0, 0),
                         (2, 1, 1, 2, None, "2024-01-03 00:00:00", "2024-01-03 01:00:00", "expired", None, 0, 0)])
    r = A.favourite_package(s, pk).collect()[0]
    assert (r.package_name, r.n_sessions) == ("1 Day Unlimited", 1)


def test_weekly_spend_zero_days(spark):
    u = users(spark, [(1, "254700000001", "A", "user", True, "2024-01-01 00:00:00")])
    p = payments(spark, [(1, 1, 1, 30, "completed", "c1", "2024-01-20 18:00:00", "2024-01-20 18:00:00"),
                         (2, 1, 1, 99, "completed", "c2", "2024-01-13 23:59:59", "2024-01-13 23:59:59")])
    w = A.weekly_spend(u, p, NOW).orderBy("day_date").collect()
    assert [r.day_date for r in w] == [dt.date(2024, 1, 14) + dt.timedelta(days=i) for i in range(7)]
    assert [float(r.total_spent) for r in w] == [0, 0, 0, 0, 0, 0, 30.0]
    assert w[-1].day_name == "Sat"
    m = A.weekly_total_max(u, p, NOW).orderBy("day_date").collect()
    assert m[-1].is_max and m[-1].bar_bp == 10000 and m[0].bar_bp == 200


def test_kpi_on_empty_tables(spark):
    u = users(spark, [])
    s = sessions(spark, [])
    p = payments(spark, [])
    r = A.kpi(u, s, p, NOW).collect()[0]
    assert (r.total_users, r.active_sessions, r.total_revenue_kes, r.today_revenue_kes) == (0, 0, 0, 0)


@pytest.mark.parametrize("raw,phone,shape", [
    ("0712345678", "254712345678", "local"), ("+254 712-345-678", "254712345678", "international"),
    ("712345678", "254712345678", "short"), ("(0)112345678", "254112345678", "local"), ("812345678", None, "other"),
    ("99123", None, "other"), ("254 7123 4567 8", "254712345678", "international"),
])
def test_phone_shapes(spark, raw, phone, shape):
    r = spark.createDataFrame([(raw,)], "raw string").select(
        phones.normalise("raw").alias("p"), phones.shape("raw").alias("s")).collect()[0]
    assert (r.p, r.s) == (phone, shape)


def test_payable_and_username(spark):
    df = spark.createDataFrame([("254712345678",), ("254212345678",), ("+254-712-345-678",)], "p string")
    got = df.select(phones.payable("p").alias("ok"), phones.hotspot_username("p").alias("u")).collect()
    assert [r.ok for r in got] == [True, False, False]
    assert got[2].u == "254712345678"


def test_masks(spark):
    df = spark.createDataFrame([("254712345678",), ("12345",), (None,)], "p string")
    got = df.select(masking.log_censor("p").alias("l"), masking.display_mask("p").alias("d")).collect()
    assert [r.l for r in got] == ["254****78", "[REDACTED]", "[REDACTED]"]
    assert got[0].d == "25471234****"
    t = spark.createDataFrame([("call +1 (555) 123-4567 or 4111111111111111, ref 12",)], "t string")
    r = t.select(masking.mask_numbers_in_text("t").alias("m"), masking.count_numbers_in_text("t").alias("n")).collect()[0]
    assert r.m == "call +1 (555) 123-**** or 411111111111****, ref 12" and r.n == 2


def test_labels(spark):
    df = spark.createDataFrame([(h,) for h in (1, 2, 12, 24, 36, 168, 336, 720)], "h int")
    got = df.select(labels.duration_label_server("h").alias("s"), labels.duration_label_catalogue("h").alias("c"),
                    labels.duration_label_card("h").alias("k"), labels.category("h").alias("g"),
                    labels.duration_label_history("h").alias("y")).collect()
    assert [r.s for r in got] == ["1 Hour", "2 Hours", "12 Hours", "1 Day", "1 Day", "1 Week", "2 Weeks", "4 Weeks"]
    assert [r.c for r in got] == ["1h", "2h", "12h", "24h", "2 days", "7 days", "14 days", "30 days"]
    assert [r.k for r in got] == ["1h", "2h", "12h", "24 Hours", "2d", "7d", "14d", "30d"]
    assert [r.g for r in got] == ["short", "short", "weekly", "daily", "weekly", "weekly", "weekly", "weekly"]
    assert [r.y for r in got] == ["1 Hour", "2 Hours", "12 Hours", "1 Day", "1.5 Days", "7 Days", "14 Days", "30 Days"]
    c = spark.createDataFrame([(0,), (59,), (3661,), (360000,)], "s long").select(
        labels.countdown("s").alias("c"), labels.time_label("s").alias("t")).collect()
    assert [r.c for r in c] == ["00:00:00", "00:00:59", "01:01:01", "100:00:00"]
    assert c[2].t == "1h 1m remaining" and c[1].t == "0m remaining"


def test_page_clamps():
    assert L.clamp_page(0, 1000) == (1, 100)
    assert L.clamp_page("x", None) == (1, 20)
    assert L.clamp_page(3, -5) == (3, 1)


def test_page_returns_requested_slice(spark):
    df = spark.range(250).withColumnRenamed("id", "k")
    got = [r.k for r in L.page(df, [F.col("k").desc()], page_no=2, limit=1000).collect()]
    assert got == list(range(149, 49, -1))


def test_user_search_optional(spark):
    u = users(spark, [(1, "254700000001", "Alice", "user", True, "2024-01-01 00:00:00"),
                      (2, "254700000002", "Bob", "user", True, "2024-01-01 00:00:00")])
    assert Fl.user_search(u, None).count() == 2
    assert [r.user_id for r in Fl.user_search(u, "aLi").collect()] == [1]
    assert Fl.enum_filter(u, "role", None).count() == 2


def test_settle_first_terminal_wins_and_idempotent(spark):
    from tollgate.functions.callbacks import parse_callbacks

    def body(code, amount):
        return ('{"Body":{"stkCallback":{"CheckoutRequestID":"c1","ResultCode":%d,"ResultDesc":"d%d",'
                '"CallbackMetadata":{"Item":[{"Name":"Amount","Value":%s},{"Name":"MpesaReceiptNumber",'
                '"Value":"R1"}]}}}}' % (code, code, amount))
    cb = spark.createDataFrame([(2, dt.datetime(2024, 1, 20, 11, 1), body(1032, "5")),
                                (1, dt.datetime(2024, 1, 20, 11, 0), body(0, "12.5")),
                                (3, dt.datetime(2024, 1, 20, 11, 2), '{"nothing": 1}')],
                               "event_id long, received_at timestamp_ntz, body string")
    first = J.first_callbacks(parse_callbacks(cb))
    assert first.count() == 1
    p = payments(spark, [(7, 1, 1, 10, "pending", "c1", "2024-01-20 10:59:00", "2024-01-20 10:59:00")])
    out = U.settle_payments(p, first).collect()[0]
    assert (out.status, out.amount_kes, out.receipt_number) == ("completed", decimal.Decimal("12.50"), "R1")
    again = U.settle_payments(U.settle_payments(p, first).drop("changed", "receipt_number", "transaction_date",
                                                               "failure_reason"), first)
    assert again.where("changed").count() == 0


def test_open_sessions_idempotent(spark, pk):
    s = sessions(spark, [(1, 1, 1, 1, None, "2024-01-20 11:00:00", "2024-01-20 12:00:00", "active", None, 0, 0)])
    p = payments(spark, [(1, 1, 1, 10, "completed", "c1", "2024-01-20 10:59:00", "2024-01-20 11:00:00"),
                         (2, 1, 2, 80, "completed", "c2", "2024-01-20 11:10:00", "2024-01-20 11:10:00"),
                         (3, 1, 2, 80, "pending", "c3", "2024-01-20 11:10:00", "2024-01-20 11:10:00")])
    once = U.open_sessions(s, p, pk, NOW)
    assert rows(once, "session_id", "payment_id") == [(-2, 2), (1, 1)]
    twice = U.open_sessions(once, p, pk, NOW)
    assert twice.count() == once.count()


def test_seed_if_absent_idempotent(spark):
    from tollgate.sources import seeds
    u = users(spark, [(1, "254712345678", "Existing", "user", True, "2024-01-01 00:00:00")])
    once = seeds.seed_users(spark, u, NOW)
    assert sorted(r.phone_number for r in once.collect()) == ["254700000000", "254712345678"]
    assert seeds.seed_users(spark, once, NOW).count() == 2
    k = seeds.seed_packages(spark, packages(spark, []))
    assert k.where("package_name = '30 Minutes Unlimited'").collect()[0].duration_hours == 1


def test_disconnect_first_open_session(spark):
    s = sessions(spark, [(1, 1, 1, 1, None, "2024-01-20 09:00:00", "2024-01-21 09:00:00", "active", None, 0, 0),
                         (2, 1, 1, 2, None, "2024-01-20 08:00:00", "2024-01-21 08:00:00", "active", None, 0, 0)])
    req = spark.createDataFrame([(1, dt.datetime(2024, 1, 20, 11, 0))], "user_id long, requested_at timestamp_ntz")
    got = {r.session_id: r.status for r in U.disconnect(s, req).collect()}
    assert got == {1: "active", 2: "disconnected"}
    admin = spark.createDataFrame([(1, dt.datetime(2024, 1, 20, 10, 0)), (2, dt.datetime(2024, 1, 20, 12, 0))],
                                  "session_id long, requested_at timestamp_ntz")
    both = {r.session_id: (r.status, r.ended_at) for r in U.disconnect(s, req, admin).collect()}
    assert both == {1: ("disconnected", dt.datetime(2024, 1, 20, 10, 0)),
                    2: ("disconnected", dt.datetime(2024, 1, 20, 12, 0))}


def test_concurrent_sessions_needs_two(spark):
    s = sessions(spark, [(1, 1, 1, 1, 11, "2024-01-20 09:00:00", "2024-01-21 09:00:00", "active", None, 0, 0),
                         (2, 1, 1, 2, 11, "2024-01-20 08:00:00", "2024-01-21 08:00:00", "active", None, 0, 0),
                         (3, 2, 1, 3, 12, "2024-01-20 08:00:00", "2024-01-21 08:00:00", "active", None, 0, 0),
                         (4, 2, 1, 4, None, "2024-01-20 08:00:00", "2024-01-21 08:00:00", "active", None, 0, 0)])
    assert rows(J.concurrent_sessions(s), "session_id", "n_other_active") == [(1, 1), (2, 1)]


def test_duplicate_phone_after_normalising(spark):
    a = spark.createDataFrame([(1, "0712345678"), (2, "+254 712 345 678"), (3, "0722000000"), (4, "bad")],
                              "event_id long, raw_phone string")
    assert rows(J.duplicate_phones(a), "event_id", "n_attempts") == [(1, 2), (2, 2)]


def test_sixth_login_refused(spark):
    from tollgate.operators import limits
    base = dt.datetime(2024, 1, 20, 10, 0)
    logins = spark.createDataFrame([(i, base + dt.timedelta(minutes=i), "0712345678") for i in range(6)],
                                   "event_id long, ts timestamp_ntz, raw_phone string")
    ev = spark.createDataFrame([], "event_id long, ts timestamp_ntz, user_id long, event_type string")
    pay = payments(spark, [])
    r = limits.rate_limit_batch(ev, logins, pay).collect()
    assert len(r) == 1 and r[0].attempts == 6 and r[0].refused == 1 and r[0].key == "254712345678"


def test_overlaps_keep_null_users(spark):
    s = sessions(spark, [(1, None, 1, 1, None, "2024-01-20 08:00:00", "2024-01-20 10:00:00", "active", None, 0, 0),
                         (2, None, 1, 2, None, "2024-01-20 09:00:00", "2024-01-20 11:00:00", "active", None, 0, 0)])
    got = {r.session_id: r.overlaps for r in J.overlapping_sessions(s).collect()}
    assert got == {1: False, 2: True}


def test_feed_blanks_and_live_state_defaults(spark):
    feed = spark.createDataFrame([
        (dt.datetime(2024, 1, 20, 11, 0), "254700000001", "10.5.1.1", "", None, "01:00:00"),     # blanks -> 0
        (dt.datetime(2024, 1, 20, 11, 30), "254700000001", "10.5.1.2", "500", "7", "01:30:00"),  # newest wins
        (dt.datetime(2024, 1, 20, 11, 30), None, "10.5.9.9", "9", "9", "00:10:00"),            # no user: dropped
        (dt.datetime(2024, 1, 20, 11, 0), "254700000002", "10.5.1.3", "5", "5", "00:10:00"),    # gone by the newest poll
        (dt.datetime(2024, 1, 20, 13, 0), "254700000002", "10.5.1.3", "5", "5", "00:10:00"),    # after the clock
    ], "polled_at timestamp_ntz, user string, address string, bytes_in string, bytes_out string, uptime string")
    clean = J.clean_feed(feed).collect()
    assert len(clean) == 4 and (clean[0].bytes_in, clean[0].bytes_out) == (0, 0)
    s = sessions(spark, [(1, 1, 1, 1, 101, "2024-01-20 10:00:00", "2024-01-20 13:00:00", "active", None, 0, 0),
                         (2, 2, 1, 2, 102, "2024-01-20 10:00:00", "2024-01-20 11:00:00", "active", None, 0, 0)])
    hu = spark.createDataFrame([(101, "254700000001", "254700000001"), (102, "254700000002", "254700000002")],
                               "hotspot_user_id long, phone_number string, username string")
    got = {r.session_id: (r.hotstatus, r.bytes_in, r.bytes_out, r.time_remaining_s)
           for r in J.online_enrich(s, hu, feed, NOW).collect()}
    assert got == {1: ("online", 500, 7, 3600), 2: ("offline", 0, 0, 0)}


def test_pay_amount_and_result_codes(spark):
    from tollgate.functions import callbacks as CB
    df = spark.createDataFrame([(decimal.Decimal("19.01"), dt.datetime(2024, 1, 20, 22, 30, 5))],
                               "price decimal(10,2), ts timestamp_ntz")
    r = df.select(labels.stk_amount("price").alias("a"), labels.eat_timestamp14("ts").alias("t")).collect()[0]
    assert (r.a, r.t) == (20, "20240121013005")
    codes = spark.createDataFrame([(0,), (1032,), (17,), (4999,)], "c long")
    got = [(r.p, r.k) for r in codes.select(CB.poll_outcome("c").alias("p"), CB.callback_outcome("c").alias("k"))
           .collect()]
    assert got == [("completed", "completed"), ("failed", "failed"), ("failed", "failed"), ("pending", "failed")]


@pytest.mark.parametrize("n,status,pct", [(750, "healthy", "75.0"), (751, "warning", "75.1"),
                                          (901, "critical", "90.1")])
def test_capacity_thresholds(spark, n, status, pct):
    s = sessions(spark, [(i, i, 1, i, None, "2024-01-20 10:00:00", "2024-01-20 13:00:00", "active", None, 0, 0)
                         for i in range(n)])
    r = A.capacity_health(s, 1000).collect()[0]
    assert (r.status, str(r.capacity_percent)) == (status, pct)


def test_online_means_in_the_latest_poll(spark):
    """Seen 23 hours ago and absent from later polls is offline; a poll without any user still counts."""
    cols = "polled_at timestamp_ntz, user string, address string, bytes_in string, bytes_out string, uptime string"
    s = sessions(spark, [(1, 1, 1, 1, 101, "2024-01-20 10:00:00", "2024-01-20 13:00:00", "active", None, 0, 0)])
    hu = spark.createDataFrame([(101, "254700000001", "254700000001")], "hotspot_user_id long, phone_number string, username string")
    old = (dt.datetime(2024, 1, 19, 13, 0), "254700000001", "10.5.1.1", "5", "5", "01:00:00")
    other = (dt.datetime(2024, 1, 20, 11, 0), "254700000009", "10.5.1.9", "5", "5", "01:00:00")
    nobody = (dt.datetime(2024, 1, 20, 11, 30), None, None, None, None, None)
    for feed in ([old, other], [old, (*other[:1], old[1], *other[2:]), nobody]):
        got = J.online_enrich(s, hu, spark.createDataFrame(feed, cols), NOW).collect()
        assert got[0].hotstatus == "offline"


def test_callback_without_a_code_fails_the_payment(spark):
    from tollgate.functions import callbacks as CB
    from tollgate.operators import transitions as U
    pay = payments(spark, [(1, 7, 3, 20, "pending", "a", "2024-01-20 09:59:00", "2024-01-20 09:59:00"),
                           (2, 7, 3, 20, "pending", "b", "2024-01-20 09:59:00", "2024-01-20 09:59:00")])
    raw = spark.createDataFrame([(1, dt.datetime(2024, 1, 20, 10, 0), '{"Body":{"stkCallback":{"CheckoutRequestID":"a"}}}')],
                                "event_id long, received_at timestamp_ntz, body string")
    got = {r.payment_id: (r.status, r.changed) for r in U.settle_payments(pay, J.first_callbacks(CB.parse_callbacks(raw))).collect()}
    assert got == {1: ("failed", True), 2: ("pending", False)}


def test_floor_division_of_negatives_and_large_sums(spark):
    from tollgate.columns import floor_div
    df = spark.createDataFrame([(-1,), (-4,), (5,), (None,)], "c long")
    assert [r[0] for r in df.select(floor_div("c", 2)).collect()] == [-1, -2, 2, None]
    big = 2 ** 62
    s = sessions(spark, [(i, i, 1, i, None, "2024-01-20 11:30:00", "2024-01-20 13:00:00", "active", None, big, 0) for i in range(4)])
    assert str(A.last_hour(s, NOW).collect()[0].total_data_gb) == "17179869184.00"
    back = sessions(spark, [(1, 1, 1, 1, None, "2024-01-20 11:30:00", "2024-01-20 13:00:00", "expired", "2024-01-20 11:29:30", 0, 0)])
    assert A.closed_last_hour(back, NOW).collect()[0].total_session_minutes == -1


def test_checkpoint_folder_is_required_on_a_cluster():
    from types import SimpleNamespace as N
    from tollgate import session
    remote = N(sparkContext=N(getCheckpointDir=lambda: None, master="spark://host:7077"), conf=N(get=lambda k, d: None))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(remote)
    with pytest.raises(ValueError):
        session.build_session("spark://host:7077", cluster=True)


@pytest.mark.parametrize("which", ["j12", "j14", "j8"])
def test_hot_keys_are_split(spark, which):
    """A third of the rows on one key: with low thresholds the executed plan splits the join."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = spark.range(60_000).repartition(8)
        key = F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 20_000 + 2)
        when = F.to_timestamp_ntz(F.lit("2024-01-20 10:00:00"))
        if which == "j12":
            df = J.concurrent_sessions(n.select(F.col("id").alias("session_id"), key.alias("user_id"), F.lit(1).alias("hotspot_user_id"),
                                                F.lit("active").alias("status"), when.alias("expires_at")))
        elif which == "j14":
            df = J.duplicate_phones(n.select(F.col("id").alias("event_id"), F.format_string("2547%08d", key).alias("raw_phone")))
        else:
            s = n.select(F.col("id").alias("session_id"), key.alias("user_id"), (key % 5).alias("package_id"), F.lit("active").alias("status"),
                         when.alias("started_at"), when.alias("expires_at"), F.lit(1).alias("hotspot_user_id"),
                         F.lit(1).alias("bytes_downloaded"), F.lit(1).alias("bytes_uploaded"))
            p = n.select(F.col("id").alias("payment_id"), key.alias("user_id"), (key % 5).alias("package_id"), F.lit("completed").alias("status"),
                         F.lit(1).alias("amount_kes"), when.alias("updated_at"))
            u = n.select(key.alias("user_id")).distinct().select("user_id", F.lit("p").alias("phone_number"), F.lit("n").alias("name"))
            pk = spark.range(5).select(F.col("id").alias("package_id"), F.lit("x").alias("package_name"), F.lit(1).alias("speed_mbps"))
            df = J.hotspot_sessions(s, u, pk, p)
        df = df.select("*")
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "skew=true" in plan
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_hot_day_is_spread(spark):
    """J12t: one user's one day in several range partitions gives the running maximum of the whole."""
    rows_ = [(i, 1 if i % 3 else 2, 1, i, None, f"2024-01-20 {8 + i // 60:02d}:{i % 60:02d}:00",
              f"2024-01-20 {9 + i // 60 + (i % 7 == 0):02d}:{i % 60:02d}:00", "active", None, 0, 0) for i in range(200)]
    got = {r.session_id: r.prev_max_expires for r in J.overlapping_sessions(sessions(spark, rows_)).collect()}
    top = {}
    for r in rows_:
        user, end = r[1], dt.datetime.fromisoformat(r[6])
        assert got[r[0]] == top.get(user)
        top[user] = max(top.get(user, end), end)
