"""Streams over hand-made input: several micro-batches, restart from checkpoint."""

import datetime as dt

from tollgate.streaming import callbacks as SC
from tollgate.streaming import runner


def _cb(spark, rows):
    body = ('{"Body":{"stkCallback":{"CheckoutRequestID":"%s","ResultCode":%d,"ResultDesc":"r",'
            '"CallbackMetadata":{"Item":[{"Name":"Amount","Value":1}]}}}}')
    return spark.createDataFrame([(i, t, body % (c, code)) for i, t, c, code in rows],
                                 "event_id long, received_at timestamp_ntz, body string")


def _deliver(spark, base, rows):
    _cb(spark, rows).write.mode("append").option("timestampNTZFormat", SC.TIME_FORMAT).json(f"{base}/in")


def test_dedup_across_batches_and_restart(spark):
    """A checkout's first delivery wins, however long after it a retry comes."""
    base = runner.run_folder(spark, "test-dedup")
    t0 = dt.datetime(2024, 1, 20, 10, 0)

    def drain():
        runner.run_foreach_batch(SC.callback_lines(spark, f"{base}/in"), base, SC.dedup_batches(spark, base))

    _deliver(spark, base, [(1, t0, "a", 0), (2, t0 + dt.timedelta(seconds=30), "b", 1032),
                           (6, t0 + dt.timedelta(seconds=40), "b", 0)])
    drain()
    _deliver(spark, base, [(3, t0 + dt.timedelta(hours=1), "a", 1), (4, t0 + dt.timedelta(seconds=90), "c", 0),
                           (7, t0 - dt.timedelta(hours=1), "b", 0)])  # earlier by its clock, but delivered later
    drain()
    got = sorted((r.checkout_request_id, r.event_id, r.result_code) for r in spark.read.parquet(f"{base}/first").collect())
    assert got == [("a", 1, 0), ("b", 2, 1032), ("c", 4, 0)]


def test_one_settlement_per_payment(spark):
    """A retry after an hour, one in a later batch and a replayed batch: one payment row, one session."""
    from util import packages, payments
    base = runner.run_folder(spark, "test-settle")
    t0 = dt.datetime(2024, 1, 20, 10, 0)
    pay = payments(spark, [(1, 7, 3, 20, "pending", "a", "2024-01-20 09:59:00", "2024-01-20 09:59:00"),
                           (2, 8, 3, 20, "pending", "b", "2024-01-20 09:59:00", "2024-01-20 09:59:00")])
    pk = packages(spark, [(3, "1 Hour", 1, 20, 5, True, 1)])
    step = SC.settle_batches(spark, base, pay, pk)

    def drain():
        runner.run_foreach_batch(SC.callback_lines(spark, f"{base}/in"), base, step)

    _deliver(spark, base, [(1, t0, "a", 0)])
    drain()
    _deliver(spark, base, [(2, t0 + dt.timedelta(hours=1), "a", 1032), (3, t0 + dt.timedelta(hours=2), "a", 0),
                           (4, t0 + dt.timedelta(hours=2), "b", 1032)])
    drain()
    step(SC.parse_callbacks(_cb(spark, [(2, t0 + dt.timedelta(hours=1), "a", 1032), (4, t0 + dt.timedelta(hours=2), "b", 1032)])), 1)
    rows = sorted((r.payment_id, r.status) for r in spark.read.parquet(f"{base}/payments").collect())
    assert rows == [(1, "completed"), (2, "failed")]
    assert [r.payment_id for r in spark.read.parquet(f"{base}/sessions").collect()] == [1]


def test_staging_keeps_rows_without_a_time(spark):
    base = runner.run_folder(spark, "test-staging")
    t0 = dt.datetime(2024, 1, 20, 10, 0)
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else t0 + dt.timedelta(minutes=i)) for i in range(400)],
                                 "id long, ts timestamp_ntz").repartition(8)
    replay = runner.Replay([(rows, "ts")], base, slices=2)
    assert len(replay.slices) == 3
    seen = 0
    for k in range(3):
        replay.deliver(k)
        got = spark.read.parquet(replay.paths[0])
        assert got.count() > seen
        seen = got.count()
    assert seen == 400 and got.where("ts IS NULL").count() == 80
    assert len(got.inputFiles()) > 6  # more than one file per slice


def test_no_request_is_lost(spark):
    """Six logins of one phone in one window, a trigger each minute or two, payments alongside."""
    from tollgate.streaming import limits
    t0 = dt.datetime(2024, 1, 20, 10, 0)
    m = dt.timedelta(minutes=1)
    logins = spark.createDataFrame([(i, t0 + 2 * i * m, "0712345678") for i in range(6)], "event_id long, ts timestamp_ntz, raw_phone string")
    events = spark.createDataFrame([(i, t0 + i * m) for i in range(15)], "user_id long, ts timestamp_ntz")
    pay = spark.createDataFrame([(1, t0 + i * m) for i in range(15)], "user_id long, created_at timestamp_ntz")
    got = {(r.limiter, r.key, str(r.window_start)): (r.attempts, r.refused)
           for r in limits.run_rate_limit(spark, events, logins, pay, slices=7).collect()}
    assert got[("login", "254712345678", "2024-01-20 10:00:00")] == (6, 1)
    assert sum(v[0] for k, v in got.items() if k[0] == "payment") == 15
    assert sum(v[0] for k, v in got.items() if k[0] == "general") == 15


def test_late_requests_within_the_delay_count(spark):
    from tollgate.streaming import limits
    base = runner.run_folder(spark, "test-late")
    t0 = dt.datetime(2024, 1, 20, 10, 0)

    def put(minutes):
        spark.createDataFrame([("login", "k", t0 + dt.timedelta(minutes=x), t0, 900, 5) for x in minutes], limits.SCHEMA).write.mode("append").parquet(f"{base}/in")
        runner.run_to_parquet(limits.limit_stream(runner.read_files(spark, f"{base}/in", limits.SCHEMA), 900), base)

    put([1, 14])
    put([25])
    put([3])       # behind the newest by 22 minutes, but its window is still open
    put([100])
    rows = {str(r.window_start): r.attempts for r in spark.read.parquet(f"{base}/out").collect()}
    assert rows == {"2024-01-20 10:00:00": 3, "2024-01-20 10:15:00": 1}


def test_active_count_falls(spark):
    """A session that arrives active and then expired counts once, then not; its length is in the mean."""
    from tollgate.streaming import ticks
    from util import sessions
    base = runner.run_folder(spark, "test-fall")

    def put(*rows):
        df = sessions(spark, rows)
        df.write.mode("append").parquet(f"{base}/in")
        runner.run_foreach_batch(runner.read_files(spark, f"{base}/in", df.schema), base, ticks._tick_fn(spark, base, "2024-01-20 12:00:00"))

    put((1, 7, 1, None, None, "2024-01-20 11:30:00", "2024-01-20 12:30:00", "active", None, 5, 5),
        (2, 8, 1, None, None, "2024-01-20 11:40:00", "2024-01-20 12:40:00", "active", None, 1, 1))
    put((1, 7, 1, None, None, "2024-01-20 11:30:00", "2024-01-20 11:50:00", "expired", "2024-01-20 11:50:00", 7, 7))
    rows = {r.batch_id: r for r in spark.read.parquet(f"{base}/stats").collect()}
    assert (rows[0].active_sessions_count, rows[0].avg_session_duration_seconds, rows[0].total_bytes_hour) == (2, None, 12)
    assert (rows[1].active_sessions_count, rows[1].avg_session_duration_seconds, rows[1].total_bytes_hour) == (1, 1200, 16)
    assert rows[1].unique_users_today == 2


def test_ticks_one_row_per_batch(spark, sf_small):
    from tollgate.sources.fixtures import Tables
    from tollgate.streaming import ticks
    t = Tables(spark, sf_small)
    all_ticks = ticks.run_ticks(spark, t.sessions_live, "2024-01-20 12:00:00", slices=3)
    assert all_ticks.count() == all_ticks.select("batch_id").distinct().count() >= 3
    assert ticks.latest_tick(all_ticks).count() == 1


def test_expiry_timers_cancel_and_survive_restart(spark):
    from tollgate.streaming import expiry
    d = dt.datetime(2024, 1, 20, 8, 0)
    h = dt.timedelta(hours=1)
    starts1 = spark.createDataFrame([
        (1, 10, d, d + h),                                    # expires at 09:00
        (2, 10, d + dt.timedelta(minutes=5), d + 3 * h),      # disconnected at 09:30: never expires
        (3, 11, d + dt.timedelta(minutes=10), d + 2 * h),     # expires at 10:00
    ], expiry.START_SCHEMA)
    stops1 = spark.createDataFrame([(-1, d + dt.timedelta(minutes=10))], expiry.STOP_SCHEMA)
    starts2 = spark.createDataFrame([(4, 12, d + dt.timedelta(minutes=95), d + 9 * h)], expiry.START_SCHEMA)
    stops2 = spark.createDataFrame([(2, d + dt.timedelta(minutes=90)), (-1, d + 5 * h)], expiry.STOP_SCHEMA)

    def run(base):
        s = runner.read_files(spark, f"{base}/s", expiry.START_SCHEMA)  # one micro-batch for what is there
        p = runner.read_files(spark, f"{base}/p", expiry.STOP_SCHEMA)
        return runner.run_to_parquet(expiry.expiry_stream(s, p), base)

    def got(out):
        return sorted((r.session_id, r.expired_at.replace(tzinfo=None)) for r in spark.read.parquet(out).collect()
                      if r.session_id >= 0)

    once = runner.run_folder(spark, "test-expiry-once")
    for part in ((starts1, stops1), (starts2, stops2)):
        part[0].coalesce(1).write.mode("append").parquet(f"{once}/s")
        part[1].coalesce(1).write.mode("append").parquet(f"{once}/p")
    restart = runner.run_folder(spark, "test-expiry-restart")
    starts1.coalesce(1).write.mode("append").parquet(f"{restart}/s")
    stops1.coalesce(1).write.mode("append").parquet(f"{restart}/p")
    run(restart)
    starts2.coalesce(1).write.mode("append").parquet(f"{restart}/s")
    stops2.coalesce(1).write.mode("append").parquet(f"{restart}/p")
    want = [(1, dt.datetime(2024, 1, 20, 9, 0)), (3, dt.datetime(2024, 1, 20, 10, 0))]
    assert got(run(once)) == want
    assert got(run(restart)) == want


def test_poll_deadline_only_unanswered(spark):
    from tollgate.streaming import deadline
    base = runner.run_folder(spark, "test-deadline")
    d = dt.datetime(2024, 1, 20, 8, 0)
    pay = spark.createDataFrame([("c1", 1, d), ("c2", 2, d), ("c3", 3, d + dt.timedelta(minutes=1)),
                                 ("", -1, d + dt.timedelta(hours=1))], deadline.PAY_SCHEMA)
    body = '{"Body":{"stkCallback":{"CheckoutRequestID":"%s","ResultCode":0}}}'
    cbs = spark.createDataFrame([(1, d + dt.timedelta(minutes=2), body % "c1"),          # in time
                                 (2, d + dt.timedelta(minutes=9), body % "c2"),          # too late
                                 (3, d + dt.timedelta(hours=1), body % "")], deadline.CB_SCHEMA)
    pay.coalesce(1).write.parquet(f"{base}/p")
    cbs.coalesce(1).write.parquet(f"{base}/c")
    stream = deadline.timeouts(runner.read_files(spark, f"{base}/p", deadline.PAY_SCHEMA),
                               runner.read_files(spark, f"{base}/c", deadline.CB_SCHEMA))
    got = sorted(r.checkout_request_id for r in spark.read.parquet(runner.run_to_parquet(stream, base)).collect()
                 if r.payment_id >= 0)
    assert got == ["c2", "c3"]


def test_ticks_deployment_trigger_starts_and_stops(spark, sf_small):
    from tollgate.sources.fixtures import Tables
    from tollgate.streaming import ticks
    t = Tables(spark, sf_small)
    base = runner.run_folder(spark, "test-ticks-deploy")
    t.sessions_live.coalesce(1).write.parquet(f"{base}/in")
    q = ticks.start_ticks(spark, f"{base}/in", t.sessions_live.schema, base, every="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(f"{base}/stats").count() >= 1


def test_callback_documents_from_json_files(spark):
    import os
    base = runner.run_folder(spark, "test-cb-docs")
    os.makedirs(f"{base}/in", exist_ok=True) if "://" not in base else None
    docs = ['{"Body":{"stkCallback":{"CheckoutRequestID":"ws_CO_1","ResultCode":0,"ResultDesc":"ok",'
            '"CallbackMetadata":{"Item":[{"Name":"Amount","Value":20},{"Name":"MpesaReceiptNumber","Value":"R1"},'
            '{"Name":"TransactionDate","Value":20240120110000}]}}}}',
            '{"Body":{"stkCallback":{"CheckoutRequestID":"ws_CO_2","ResultCode":1032,"ResultDesc":"cancelled"}}}',
            '{"unexpected": true}']
    for i, d in enumerate(docs):
        with open(f"{base}/in/cb-{i}.json", "w") as f:
            f.write(d)
    out = runner.run_to_parquet(SC.callback_documents(spark, f"{base}/in"), base)
    got = sorted((r.checkout_request_id, r.result_code, r.amount_kes, r.receipt_number, r.transaction_date)
                 for r in spark.read.parquet(out).collect())
    import decimal
    assert got == [("ws_CO_1", 0, decimal.Decimal("20.00"), "R1", "20240120110000"),
                   ("ws_CO_2", 1032, None, None, None)]
