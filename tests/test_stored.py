"""Published versions, indexes, layouts, maintained reports, timers: the properties behind the oracle rows."""

import contextlib
import datetime as dt
import io
import re

import pytest
from pyspark.sql import functions as F

from tollgate.functions import callbacks as CB
from tollgate.operators import distinct, incremental, ordering, paging, publishing, search
from tollgate.operators import joins as J
from tollgate.operators import transitions as U
from tollgate.plans import stored
from tollgate.sources import daily
from tollgate.sources.fixtures import Tables
from tollgate.sources.versioned import VersionedTable, VersionExists
from tollgate.streaming import callbacks as SC
from tollgate.streaming import runner, timers
from util import packages, payments, rows, sessions, users

NOW = "2024-01-20 12:00:00"


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


# -- versions --------------------------------------------------------------------------------------------------

def _sessions(spark):
    return sessions(spark, [
        (1, 7, 1, 11, None, "2024-01-18 08:00:00", "2024-01-19 08:00:00", "active", None, 5, 5),
        (2, 7, 1, 12, None, "2024-01-19 08:00:00", "2024-01-21 08:00:00", "active", None, 5, 5),
        (3, 8, 1, 13, None, "2024-01-17 08:00:00", "2024-01-18 08:00:00", "expired", "2024-01-18 08:00:00", 5, 5),
        (4, 8, 1, 14, None, "2024-01-20 08:00:00", "2024-01-20 12:00:00", "active", None, 5, 5)])


def test_versions_are_scoped_pinned_and_idempotent(spark):
    table = publishing.sessions_table(spark, runner.run_folder(spark, "test-versions"))
    s = _sessions(spark)
    assert table.version() is None
    assert table.replace(s) == 0
    assert publishing.expire(table, NOW, ("sweep", 1)) == 1
    assert publishing.expire(table, NOW, ("sweep", 1)) == 1      # a replayed batch
    assert publishing.expire(table, NOW, ("sweep", 2)) == 1      # nothing is due any more: no new version
    pay = payments(spark, [(20, 7, 1, 10, "completed", "c", "2024-01-20 09:00:00", "2024-01-20 09:00:00")])
    assert publishing.open_sessions(table, pay, packages(spark, [(1, "1 Hour", 1, 10, 5, True, 1)]), NOW, ("opened", 1)) == 2
    assert publishing.open_sessions(table, pay, packages(spark, [(1, "1 Hour", 1, 10, 5, True, 1)]), NOW, ("opened", 1)) == 2
    want = U.expire_sessions(s, NOW).drop("changed")
    assert rows(table.read(1)) == rows(want)
    assert rows(table.read(0)) == rows(s)                        # readers of the first version still see it
    assert rows(table.read().where("session_id > 0")) == rows(want) and table.read().where("session_id = -20").count() == 1
    old, new = table.manifest(0)["partitions"], table.manifest(1)["partitions"]
    assert {p for p in new if new[p] != old[p]} == {"2024-01-18", "2024-01-20"}  # the days with changed rows; all others keep their files
    appended = table.manifest(2)["partitions"]
    assert appended["2024-01-20"][0] == new["2024-01-20"][0] and len(appended["2024-01-20"]) == 2


def test_crash_between_data_and_manifest(spark, monkeypatch):
    table = publishing.sessions_table(spark, runner.run_folder(spark, "test-crash"))
    table.replace(_sessions(spark))

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "_commit", crash)
        with pytest.raises(RuntimeError):
            publishing.expire(table, NOW, ("sweep", 1))
    assert table.version() == 0 and rows(table.read()) == rows(_sessions(spark))  # the orphaned data is not seen
    assert publishing.expire(table, NOW, ("sweep", 1)) == 1
    assert rows(table.read()) == rows(U.expire_sessions(_sessions(spark), NOW).drop("changed"))


def test_two_writers_of_one_version(spark):
    table = publishing.sessions_table(spark, runner.run_folder(spark, "test-race"))
    table.replace(_sessions(spark))
    base = table.manifest()
    table.append(_sessions(spark).limit(1))
    with pytest.raises(VersionExists):
        table._commit(base, base["partitions"], base["schema"], None)
    assert table.version() == 1


def test_rewrite_refuses_stray_rows_and_null_partitions_are_kept(spark):
    table = VersionedTable(spark, runner.run_folder(spark, "test-stray"), F.col("k"))
    table.replace(spark.createDataFrame([(1, "a"), (2, None), (3, "x=y/z %")], "id long, k string"))
    assert sorted(table.manifest()["partitions"]) == ["a", "none", "x=y/z %"]
    assert rows(table.read(only=["x=y/z %"])) == [(3, "x=y/z %")] and table.read(only=["none"]).count() == 1
    with pytest.raises(ValueError):
        table.rewrite(spark.createDataFrame([(9, "b")], "id long, k string"), ["a"])


def test_settlements_in_sequence_keep_the_earlier_ones(spark):
    table = publishing.payments_table(spark, runner.run_folder(spark, "test-settle-versions"))
    table.replace(publishing.with_settlement(payments(spark, [
        (1, 7, 1, 10, "pending", "a", "2024-01-18 09:00:00", "2024-01-18 09:00:00"), (2, 7, 1, 10, "pending", "b", "2024-01-18 09:00:00", "2024-01-18 09:00:00"),
        (3, 7, 1, 10, "pending", "c", "2024-01-19 09:00:00", "2024-01-19 09:00:00")])))

    def first(*checkouts):
        body = '{"Body":{"stkCallback":{"CheckoutRequestID":"%s","ResultCode":0,"CallbackMetadata":{"Item":[{"Name":"MpesaReceiptNumber","Value":"R%s"}]}}}}'
        raw = spark.createDataFrame([(i, dt.datetime(2024, 1, 19, 10), body % (c, c)) for i, c in enumerate(checkouts)], "event_id long, received_at timestamp_ntz, body string")
        return J.first_callbacks(CB.parse_callbacks(raw))

    publishing.settle(table, first("a"), ("cb", 1))
    publishing.settle(table, first("b", "a"), ("cb", 2))
    assert rows(table.read(), "payment_id", "status") == [(1, "completed"), (2, "completed"), (3, "pending")]
    assert {r.payment_id: r.receipt_number for r in table.read().collect()} == {1: "Ra", 2: "Rb", 3: None}
    assert table.manifest(2)["partitions"]["2024-01-19"] == table.manifest(0)["partitions"]["2024-01-19"]


def test_every_transition_publishes_its_days_only(spark):
    """U2, U4, U9, U10 and U11 as versions: the rows of the full transition, other days' files untouched, replays without effect."""
    s, pk = _sessions(spark), packages(spark, [(1, "1 Hour", 1, 10, 5, True, 1), (2, "off", 1, 10, 5, False, 1)])
    table = publishing.sessions_table(spark, runner.run_folder(spark, "test-u2"))
    table.replace(s)
    req = spark.createDataFrame([(7, dt.datetime(2024, 1, 20, 11))], "user_id long, requested_at timestamp_ntz")
    for _ in range(2):
        assert publishing.disconnect(table, req, None, ("requests", 1)) == 1
    assert rows(table.read()) == rows(U.disconnect(s, req).drop("changed"))
    before, after = table.manifest(0)["partitions"], table.manifest(1)["partitions"]
    assert {p for p in after if after[p] != before[p]} == {"2024-01-18"}
    u = users(spark, [(7, "254700000007", "a", "user", True, None), (8, "254700000008", "b", "user", True, None)])
    pay = payments(spark, [(12, 7, 1, 10, "completed", "c", "2024-01-19 07:00:00", "2024-01-19 07:00:00")])
    hot = spark.createDataFrame([(70, "254700000007", "254700000007")], "hotspot_user_id long, phone_number string, username string")
    for _ in range(2):
        assert publishing.attach_credentials(table, pay, hot, u, pk, ("credentials", 1)) == 2
    assert dict(rows(table.read().where("hotspot_user_id is not null"), "session_id", "hotspot_user_id")) == {2: 70}

    catalogue = publishing.catalogue_table(spark, runner.run_folder(spark, "test-u4"))
    catalogue.replace(pk.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")))
    patch = spark.createDataFrame([(1, None, None, None, 9, None, None)], "package_id long, package_name string, duration_hours int, price_kes decimal(10,2), speed_mbps int, is_active boolean, sort_order long")
    for _ in range(2):
        assert publishing.patch_packages(catalogue, patch, NOW, ("patches", 1)) == 1
    assert [(r.package_id, r.speed_mbps, r.updated_at is not None) for r in catalogue.read().orderBy("package_id").collect()] == [(1, 9, True), (2, 5, False)]

    table = publishing.payments_table(spark, runner.run_folder(spark, "test-u10"))
    table.replace(publishing.with_settlement(payments(spark, [(1, 7, 1, 10, "pending", "a", "2024-01-18 09:00:00", "2024-01-18 09:00:00"), (2, 7, 1, 10, "failed", "b", "2024-01-19 09:00:00", "2024-01-19 09:00:00")])))
    wish = spark.createDataFrame([(5, 7, 1, "254", dt.datetime(2024, 1, 20, 9)), (6, 7, 2, "254", dt.datetime(2024, 1, 20, 9))],
                                 "request_id long, user_id long, package_id long, phone_number string, requested_at timestamp_ntz")
    assert [publishing.open_payments(table, wish, pk, ("wishes", n)) for n in (1, 1, 2)][:2] == [1, 1]
    assert rows(table.read(), "payment_id") == [(-5,), (1,), (2,)]
    polls = spark.createDataFrame([("a", 1032, "no", dt.datetime(2024, 1, 18, 9, 1)), ("ws_CO_R5", 0, None, dt.datetime(2024, 1, 20, 9, 1))],
                                  "checkout_request_id string, result_code long, result_desc string, polled_at timestamp_ntz")
    n = table.version()
    assert publishing.reconcile(table, polls, NOW, ("polls", 1)) == n + 1 and publishing.reconcile(table, polls, NOW, ("polls", 1)) == n + 1
    assert {r.payment_id: (r.status, r.failure_reason) for r in table.read().collect()} == {-5: ("completed", None), 1: ("failed", "no"), 2: ("failed", None)}
    assert table.manifest(n)["partitions"]["2024-01-19"] == table.manifest()["partitions"]["2024-01-19"]


# -- callbacks: side output and ledger ---------------------------------------------------------------------------

def test_every_delivery_is_parsed_or_rejected(spark):
    ok = '{"Body":{"stkCallback":{"CheckoutRequestID":"%s","ResultCode":0,"CallbackMetadata":{"Item":[{"Name":"Amount","Value":%s}]}}}}'
    docs = {1: ok % ("a", "10.5"), 2: ok % ("b", '"n/a"'), 3: ok % ("c", '""'), 4: ok % ("d", "123456789.00"), 5: None, 6: "", 7: "[1", 8: '{"x":1}',
            9: '{"Body":{"stkCallback":{"CheckoutRequestID":"e","ResultCode":"zero"}}}', 10: '{"Body":{"stkCallback":{"CheckoutRequestID":"f","ResultCode":1032}}}',
            11: '{"Body":{"stkCallback":{"CheckoutRequestID":"g","ResultCode":0,"CallbackMetadata":"none"}}}', 12: ok % ("h", "null"), 13: ok % ("i", '"7"')}
    raw = spark.createDataFrame([(i, dt.datetime(2024, 1, 20), b) for i, b in docs.items()], "event_id long, received_at timestamp_ntz, body string")
    parsed = {r.event_id: r.amount_kes for r in CB.parse_callbacks(raw).collect()}
    rejected = {r.event_id: (r.reason, r.body) for r in CB.rejected_callbacks(raw).collect()}
    assert sorted([*parsed, *rejected]) == sorted(docs) and not set(parsed) & set(rejected)
    assert {i: r for i, (r, _) in rejected.items()} == {2: "bad_amount", 3: "bad_amount", 4: "bad_amount", 5: "not_json", 6: "not_json", 7: "not_json", 8: "no_body",
                                                        9: "bad_result_code", 11: "bad_metadata"}
    assert all(body == docs[i] for i, (_, body) in rejected.items()) and float(parsed[1]) == 10.5 and parsed[10] is None


def test_side_output_stream_loses_nothing(spark, sf_small):
    t = Tables(spark, sf_small)
    parsed, rejected = SC.run_side_output(t.spark, t.callback_deliveries, slices=2)
    assert parsed.count() + rejected.count() == t.callback_deliveries.count() and rejected.count() > 0


def _cb(spark, items):
    body = '{"Body":{"stkCallback":{"CheckoutRequestID":"%s","ResultCode":0}}}'
    return CB.parse_callbacks(spark.createDataFrame([(i, dt.datetime(2024, 1, 20, 10) + dt.timedelta(seconds=i), body % c) for i, c in items],
                                                    "event_id long, received_at timestamp_ntz, body string"))


def test_ledger_reads_only_its_own_buckets(spark):
    """The tenth batch reads as many files as the second, and first deliveries still win over all batches."""
    base = runner.run_folder(spark, "test-ledger")
    seen, read = SC.ledger(spark, base, 64), []
    step = SC.dedup_batches(spark, base, 64)
    for n in range(10):
        batch = _cb(spark, [(100 * n + i, f"id{n}-{i}") for i in range(4)] + [(100 * n + 50, "id0-0")])
        before = seen.before((SC.WRITER, n))
        if before["schema"]:
            wanted = seen.partitions_of(J.first_callbacks(batch))
            read.append(sum(len(before["partitions"].get(p, [])) for p in wanted))
        step(batch, n)
    assert max(read) <= 5  # at most one file for each id of the batch, whatever came before
    got = spark.read.parquet(f"{base}/first")
    assert got.count() == 40 and got.where("checkout_request_id = 'id0-0'").select("event_id").first()[0] == 0
    again = spark.read.parquet(f"{base}/first/batch_id=4").count()
    step(_cb(spark, [(400 + i, f"id4-{i}") for i in range(4)] + [(450, "id0-0")]), 4)  # a replay gives the same rows
    assert spark.read.parquet(f"{base}/first/batch_id=4").count() == again == 4


def test_settlement_stream_publishes_each_batch_once(spark, monkeypatch):
    """A crash between the payments' version and the sessions': the replay adds what is missing and nothing twice."""
    base = runner.run_folder(spark, "test-t2v")
    pay, ses = publishing.payments_table(spark, f"{base}/p"), publishing.sessions_table(spark, f"{base}/s")
    pay.replace(publishing.with_settlement(payments(spark, [(i, 7, 1, 10, "pending", c, "2024-01-20 09:00:00", "2024-01-20 09:00:00") for i, c in enumerate("abc", 1)])))
    ses.replace(_sessions(spark))
    step = SC.publish_batches(spark, base, pay, ses, packages(spark, [(1, "1 Hour", 1, 10, 5, True, 1)]))

    def crash(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(VersionedTable, "append", crash)
        with pytest.raises(RuntimeError):
            step(_cb(spark, [(1, "a"), (2, "b"), (3, "a")]), 0)
    assert (pay.version(), ses.version()) == (1, 0)
    for _ in range(2):
        step(_cb(spark, [(1, "a"), (2, "b"), (3, "a")]), 0)
        assert (pay.version(), ses.version()) == (1, 1)
    step(_cb(spark, [(4, "a"), (5, "c")]), 1)
    assert rows(pay.read(), "payment_id", "status") == [(1, "completed"), (2, "completed"), (3, "completed")]
    assert rows(ses.read().where("session_id < 0"), "payment_id") == [(1,), (2,), (3,)]


def test_old_payments_are_found_in_the_second_step(spark):
    pay = payments(spark, [(1, 7, 1, 10, "pending", "a", "2024-01-20 09:00:00", "2024-01-20 09:00:00"), (2, 7, 1, 10, "pending", "b", "2023-06-01 09:00:00", "2023-06-01 09:00:00"),
                           (3, 7, 1, 10, "pending", "c", None, "2024-01-20 09:00:00"), (4, 7, 1, 10, "pending", "z", "2024-01-20 09:00:00", "2024-01-20 09:00:00")])
    assert rows(SC.answered_payments(pay, _cb(spark, [(1, "a")])), "payment_id") == [(1,)]
    assert rows(SC.answered_payments(pay, _cb(spark, [(1, "a"), (2, "b"), (3, "c"), (4, "none")])), "payment_id") == [(1,), (2,), (3,)]
    assert SC.answered_payments(pay, _cb(spark, [(1, "a")]).limit(0)).count() == 0


# -- timers ------------------------------------------------------------------------------------------------------

def _events(spark, base, items):
    """items: (key, kind, minute, deadline minute)"""
    t0 = dt.datetime(2024, 1, 20, 8)
    us = lambda m: None if m is None else int((t0 + dt.timedelta(minutes=m) - timers.EPOCH).total_seconds() * 1_000_000)
    data = [(k, kind, us(m), us(d), 5, (t0 + dt.timedelta(minutes=m)).replace(tzinfo=dt.timezone.utc)) for k, kind, m, d in items]
    spark.createDataFrame(data, timers.EVENT).coalesce(1).write.mode("append").parquet(f"{base}/in")


def test_timers_expire_cancel_and_survive_restart(spark):
    base, held = runner.run_folder(spark, "test-timers"), []

    def drain(items):
        _events(spark, base, items)
        with timers.rocksdb(spark):
            q = (timers.awaited(runner.read_files(spark, f"{base}/in", timers.EVENT), 15).writeStream.format("parquet").option("path", f"{base}/out")
                 .option("checkpointLocation", f"{base}/ck").outputMode("append").trigger(availableNow=True).start())
            q.awaitTermination()
        held.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])

    drain([("1", "start", 0, 60), ("2", "start", 5, 180), ("3", "start", 10, 120), ("4", "stop", 9, None), ("6", "stop", 9, None)])
    drain([("2", "stop", 90, None), ("4", "start", 8, 100), ("5", "start", 95, 540), ("6", "stop", 120, None), ("", "stop", 100, None)])  # a restart from the checkpoint
    drain([("6", "start", 118, 200), ("", "stop", 300, None)])  # its stop came before it, and an older one's timer in between
    drain([("5", "stop", 301, None), ("", "stop", 700, None)])
    got = sorted((r.key, r.deadline) for r in spark.read.schema(timers.OUT).parquet(f"{base}/out").collect())
    t0 = int((dt.datetime(2024, 1, 20, 8) - timers.EPOCH).total_seconds() * 1_000_000)
    assert got == [("1", t0 + 3_600_000_000), ("3", t0 + 7_200_000_000)]  # 2, 4, 5 and 6 were stopped in time
    assert held[-1] < held[0] and held[-1] <= 2  # state falls with the open sessions


# -- search, pages -----------------------------------------------------------------------------------------------

def test_indexed_search_equals_the_scan(spark):
    u = users(spark, [(i, f"2547{i:08d}", n, "user", True, None) for i, n in enumerate(
        ["Ann Ab", "ANNA", "bo", None, "50%_off", "a\\b", "Ängström", "abcabc", "xAbCx", "ab c"] * 4)])
    path = search.build(u, runner.run_folder(spark, "test-trigrams"))
    from tollgate.operators.filters import user_search
    for text in ("ann", "ANNA", "abc", "ab", "", "a", "%ann%", "a_c", "abc%bc", "_off", "50%", "\\%", "a\\\\b", "ängs", "ÄNGS", "zzz", "00003", "2547000", "b c", "None"):
        assert rows(search.search(u, path, text), "user_id") == rows(user_search(u, text), "user_id"), text
    used = plan(search.postings_for(spark, path, ["ann", "nna"]))
    assert re.search(r"PushedFilters: \[.*In\(gram,", used)


def test_deep_pages_equal_offset_limit(spark):
    df = spark.range(0, 2317).select((F.col("id") * 7919 % 2317).alias("k"), (F.col("id") % 50).alias("g")).repartition(6)
    order = [F.col("g").desc(), F.col("k")]
    ranked = paging.RankedList.write(df, order, runner.run_folder(spark, "test-ranked"), rows_per_range=100)
    assert sum(n for *_, n in ranked.directory()) == 2317 and len(ranked.directory()) > 10
    for page in (1, 2, 58, 59, 60, 116, 117):
        want = [tuple(r) for r in ordering.page(df, order, page, 20).collect()]
        assert [tuple(r) for r in ranked.page(page, 20).collect()] == want
    asked = plan(ranked.page(59, 20))
    assert re.search(r"PartitionFilters: \[.*_range", asked)
    empty = paging.RankedList.write(df.limit(0), order, runner.run_folder(spark, "test-ranked-empty"))
    assert empty.page(1, 20).collect() == []


# -- maintained facts, bitmaps ---------------------------------------------------------------------------------

def test_maintained_facts_equal_recomputation_step_by_step(spark):
    s = _sessions(spark)
    p = payments(spark, [(11, 7, 1, 10, "pending", "a", "2024-01-18 07:00:00", "2024-01-18 07:00:00"), (12, 7, 1, 20, "completed", "b", "2024-01-19 07:00:00", "2024-01-19 07:30:00"),
                         (13, None, 1, 5, "completed", "c", "2024-01-19 07:00:00", None)])
    m = incremental.Maintained(spark, runner.run_folder(spark, "test-facts"))
    m.build(s, p)

    def whole(s, p):
        return rows(incremental.merged(incremental.session_facts(s), incremental.payment_facts(p)))

    assert rows(m.facts()) == whole(s, p)
    after = U.expire_sessions(s, NOW)
    changed = after.where("changed")
    version = m.apply(incremental.delta(s.join(changed.select("session_id"), "session_id", "left_semi"), changed, incremental.session_facts), ("u1", 1))
    assert rows(m.facts()) == whole(after, p)
    assert m.apply(incremental.session_facts(s), ("u1", 1)) == version  # a replay changes nothing
    gone = s.where("session_id = 3")
    m.apply(incremental.session_facts(gone, -1), ("delete", 1))  # all measures of (8, 17th) return to 0
    assert rows(m.facts()) == whole(after.where("session_id <> 3"), p)
    assert m.facts().where("day = '2024-01-17'").count() == 0


def test_bitmaps_merge_exactly(spark):
    data = [(i % 97 * 40_000 - 5, dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)) for i in range(400)] + [(None, dt.datetime(2024, 1, 3))]
    df = spark.createDataFrame(data, "user_id long, started_at timestamp_ntz")
    b = distinct.day_bitmaps(df, "started_at")
    got = {r.day: (r.users_on_day, r.users_in_window) for r in distinct.trailing_distinct(b, 3).collect()}
    for day, (own, window) in got.items():
        on = {u for u, t in data if u is not None and t.date() == day}
        near = {u for u, t in data if u is not None and 0 <= (day - t.date()).days < 3}
        assert (own, window) == (len(on), len(near))
    halves = distinct.day_bitmaps(df.where("user_id > 1000000"), "started_at").unionByName(distinct.day_bitmaps(df.where("user_id <= 1000000"), "started_at"))
    assert rows(distinct.distinct_counts(halves, "day")) == rows(distinct.distinct_counts(b, "day"))


# -- layouts -----------------------------------------------------------------------------------------------------

def test_bucketed_reports_do_not_shuffle_by_user(spark, sf_small):
    from tollgate.operators import aggregates as A
    t = Tables(spark, sf_small)
    b = stored.bucketed_tables(t, 4)
    for df in (A.user_totals(b.users, b.sessions, b.payments), A.favourite_package(b.sessions, t.packages), J.unused_payments(b.payments, b.sessions, same_user=True)):
        exchanges = re.findall(r"Arguments: hashpartitioning\(([^)]*)\)?", plan(df))
        assert not [e for e in exchanges if e.startswith("user_id")], exchanges
    plain = A.user_totals(t.users, t.sessions, t.payments)
    assert re.search(r"hashpartitioning\(.*user_id", plan(plain))  # which the plain tables need
    assert rows(A.user_totals(b.users, b.sessions, b.payments)) == rows(plain)


def test_a_hot_bucket_is_opened_as_plain_files(spark, sf_small):
    from tollgate.sources import bucketed
    t = Tables(spark, sf_small)
    t.__dict__["sessions"] = t.sessions.withColumn("user_id", F.when(F.col("session_id") % 2 == 0, F.lit(7)).otherwise(F.col("user_id")).cast("bigint"))
    path = runner.run_folder(spark, "test-hot-bucket")
    made = bucketed.write_bucketed(t, path, 8, ["sessions"])
    hot = bucketed.BucketedTables(spark, sf_small, path, made, 8, max_share=2)
    assert "Bucketed: false" in plan(hot.sessions.groupBy("user_id").count()) or "SelectedBucketsCount" not in plan(hot.sessions.groupBy("user_id").count())
    assert rows(hot.sessions, "session_id", "user_id") == rows(t.sessions, "session_id", "user_id")


def test_day_folders_are_pruned_by_the_calendar(spark, sf_small):
    t = Tables(spark, sf_small)
    stored_by_day, calendar = stored._daily(t)
    for df in (daily.revenue_series(stored_by_day, calendar, NOW), daily.weekly_spend(t.users, stored_by_day, calendar, NOW)):
        df.collect()
        assert re.search(r"PartitionFilters: \[.*dynamicpruning", plan(df)), plan(df)


# -- U11 to U13 --------------------------------------------------------------------------------------------------

def test_reconcile_edges(spark):
    p = payments(spark, [(1, 7, 1, 10, "pending", "a", "2024-01-20 11:59:45", "2024-01-20 11:59:45"), (2, 7, 1, 10, "pending", "b", "2024-01-20 11:59:44", "2024-01-20 11:59:44"),
                         (3, 7, 1, 10, "failed", "c", "2024-01-20 11:00:00", "2024-01-20 11:00:00"), (4, 7, 1, 10, "pending", "d", "2024-01-20 11:00:00", "2024-01-20 11:00:00"),
                         (5, 7, 1, 10, "pending", "e", "2024-01-20 11:00:00", "2024-01-20 11:00:00"), (6, 7, 1, 10, "pending", "f", "2024-01-20 11:00:00", "2024-01-20 11:00:00")])
    t0 = dt.datetime(2024, 1, 20, 11, 59, 50)
    polls = spark.createDataFrame([(c, code, "why", t0 + dt.timedelta(seconds=s)) for c, code, s in
                                   [("a", 0, 0), ("b", 0, 0), ("c", 0, 0), ("d", 4999, 0), ("d", 1032, -5), ("e", None, 0), ("e", 17, -9), ("f", 0, 60)]],
                                  "checkout_request_id string, result_code long, result_desc string, polled_at timestamp_ntz")
    out = {r.payment_id: (r.status, r.failure_reason, r.changed) for r in U.reconcile_payments(p, polls, NOW).collect()}
    assert out == {1: ("pending", None, False), 2: ("completed", None, True), 3: ("failed", None, False), 4: ("pending", None, False),  # the newest poll counts
                   5: ("failed", "why", True), 6: ("pending", None, False)}
    again = U.reconcile_payments(U.reconcile_payments(p, polls, NOW).drop("failure_reason", "changed"), polls, NOW)
    assert again.where("changed").count() == 0


def test_package_requests_by_rule(spark):
    p = packages(spark, [(1, "1 Hour", 1, 10, 5, True, 1)])
    req = spark.createDataFrame([(1, "ok", "2", "5.5", "3", None), (2, " ", "0", "0.99", None, 1), (3, "x", "1.5", "abc", "4", 1), (4, None, "3", "1", "-1", 2)],
                                "request_id long, package_name string, duration_hours string, price_kes string, speed_mbps string, sort_order long")
    made, refused = U.create_packages(p, req)
    assert rows(made, "package_id", "sort_order") == [(-1, 0), (1, 1)]
    assert dict(rows(refused, "request_id", "broken_rules")) == {2: "name_not_empty,duration_int_ge_1,price_ge_1,speed_int_ge_1", 3: "duration_int_ge_1,price_ge_1", 4: "name_not_empty,speed_int_ge_1"}
    assert U.create_packages(made, req)[0].count() == made.count()  # created once


