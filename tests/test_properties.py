"""Properties: distributed algorithms equal their obvious (single-window) forms."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tollgate.operators import aggregates as A
from tollgate.operators import joins as J
from tollgate.operators.ranking import numbered
from util import sessions


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 5), st.integers(0, 10_000)),
                min_size=1, max_size=60))
def test_numbered_equals_row_number(spark, data):
    df = spark.createDataFrame([(i, g, p, k) for i, (g, p, k) in enumerate(data)], "id long, g int, p int, k int")
    got = numbered(df, ["g"], ["p", "k", "id"], n_partitions=3)
    w = Window.partitionBy("g").orderBy("p", "k", "id")
    want = df.withColumn("rn", F.row_number().over(w)).withColumn("n_in_group", F.count("*").over(
        Window.partitionBy("g")))
    assert sorted(got.select("id", "rn", "n_in_group").collect()) == sorted(
        want.select("id", "rn", "n_in_group").collect())


def test_overlaps_equal_self_join(spark):
    rnd = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(300):
        u = rnd.choice([1, 1, 1, 2, 3])  # user 1 holds most rows
        start = base + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 10))
        end = start + dt.timedelta(minutes=rnd.choice([30, 60, 600, 3000]))
        rows.append((i, u, 1, i, None, start.isoformat(" "), end.isoformat(" "), "active", None, 0, 0))
    s = sessions(spark, rows)
    got = {r.session_id: (r.prev_max_expires, r.overlaps) for r in J.overlapping_sessions(s).collect()}
    by_id = {r[0]: r for r in rows}
    for sid, (prev, over) in got.items():
        me = by_id[sid]
        earlier = [dt.datetime.fromisoformat(r[6]) for r in rows
                   if r[1] == me[1] and (r[5], r[0]) < (me[5], me[0])]
        want = max(earlier) if earlier else None
        assert prev == want
        assert over == (want is not None and dt.datetime.fromisoformat(me[5]) < want)


def test_safe_daily_revenue_sums_to_paid_by_session_users(spark, sf_small):
    from tollgate.sources.fixtures import Tables
    t = Tables(spark, sf_small)
    daily = A.daily_stats_safe(t.sessions, t.payments).agg(F.sum("revenue_kes")).collect()[0][0]
    ud = t.sessions.select("user_id", F.to_date("started_at").alias("d")).distinct()
    paid = (t.payments.where("status = 'completed'").select("user_id", F.to_date("updated_at").alias("d"),
                                                             "amount_kes")
            .join(ud, ["user_id", "d"], "left_semi").agg(F.sum("amount_kes")).collect()[0][0])
    assert daily == paid
    totals = A.user_totals(t.users, t.sessions, t.payments, safe=True).agg(F.sum("total_spent")).collect()[0][0]
    all_paid = t.payments.where("status = 'completed'").join(t.users.select("user_id"), "user_id", "left_semi") \
        .agg(F.sum("amount_kes")).collect()[0][0]
    assert totals == all_paid


def test_session_exists_partitions_completed_payments(spark, sf_small):
    from tollgate.sources.fixtures import Tables
    t = Tables(spark, sf_small)
    out = J.session_exists(t.payments, t.sessions)
    completed = t.payments.where("status = 'completed'").count()
    assert out.count() == completed == out.select("payment_id").distinct().count()


def test_package_shares_add_up(spark, sf_small):
    from tollgate.sources.fixtures import Tables
    t = Tables(spark, sf_small)
    shares = A.package_breakdown(t.payments, t.packages)
    n, total = shares.agg(F.count("*"), F.sum("share_bp")).collect()[0]
    assert 10000 - n <= total <= 10000  # each share is floored, so at most one bp lost per package


def test_price_list_middle_flag(spark):
    from tollgate.operators import windows as Wn
    from util import packages as pk
    p = pk(spark, [(i, f"p{i}", h, price, 5, True, 0) for i, (h, price) in
                   enumerate([(1, 10), (2, 15), (3, 20), (24, 80), (168, 200)], start=1)])
    got = {(r.category, r.package_id): (r.serial, r.most_booked) for r in Wn.price_list(p, n_partitions=2).collect()}
    assert got[("all", 3)] == (3, True) and got[("short", 2)] == (2, True) and got[("daily", 4)] == (1, False)
    assert sum(1 for v in got.values() if v[1]) == 2  # 'all' and 'short'; the one-item lists get no flag
