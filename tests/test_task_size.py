"""J13 in tasks of a fixed size: what a task sorts and aggregates does not grow with the tables."""

import re

from tollgate import session
from tollgate.operators import joins as J
from util import payments, rows, sessions

KEYS = [*session.SMALL_TASKS, "spark.sql.shuffle.partitions"]


def test_session_exists_in_tasks_of_a_fixed_size(spark, monkeypatch):
    t = "2024-01-20 09:00:00"
    pay = payments(spark, [(i, 7, 3, 20, "completed" if i % 2 else "pending", f"c{i}", t, t) for i in range(60)]
                   + [(1, 8, 4, 20, "completed", "again", t, t), (None, 9, 3, 20, "completed", "none", t, t)])
    ses = sessions(spark, [(i, 7, 3, i if i % 3 else None, 7, t, t, "active", None, 0, 0) for i in range(40)]
                   + [(99, 7, 3, 1, 7, t, t, "active", None, 0, 0)])
    used, before = [], {k: spark.conf.get(k, None) for k in KEYS}
    stable = J.stable
    monkeypatch.setattr(J, "stable", lambda df: used.append({k: spark.conf.get(k) for k in session.SMALL_TASKS}) or stable(df))
    monkeypatch.setattr(J, "PAYMENTS_PER_TASK", 2, raising=False)
    out = J.session_exists(pay, ses)
    assert used == [session.SMALL_TASKS] * 2 and {k: spark.conf.get(k, None) for k in KEYS} == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert set(re.findall(r"hashpartitioning\(payment_id#\d+L?, (\d+)\)", plan)) == {"16"}  # 31 completed payments
    want = [(i, 7, i < 40 and i % 3 != 0) for i in range(60) if i % 2] + [(1, 8, True)]
    assert rows(out.where("payment_id IS NOT NULL"), "payment_id", "user_id", "has_session") == sorted(want)
    assert [tuple(r) for r in out.where("payment_id IS NULL").collect()] == [(None, 9, 3, False)]
