"""Queries over stored structures: published versions, indexes, layouts, maintained reports; and the transitions U11-U13.

Each writes what it stores under the shared checkpoint folder, from the given tables, and
answers from it; its oracle is the plain SQL over the same tables.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..clock import LIVE
from ..functions import callbacks as CB
from ..operators import aggregates as A
from ..operators import distinct as D
from ..operators import incremental as I
from ..operators import joins as J
from ..operators import paging as PG
from ..operators import publishing as PB
from ..operators import search as SX
from ..operators import transitions as U
from ..sources import bucketed, daily
from ..streaming import callbacks as SC
from ..streaming import timers as ST
from ..streaming.runner import run_folder
from . import browse, jobs, reports  # noqa: F401  (their oracles are built on here)
from .oracle import LIVE_SQL
from .registry import REGISTRY, register
from .sqlparts import FIRST_CALLBACKS, PARSED_CALLBACKS

_S_COLS = ", ".join(U.SESSION_COLS)


def _sql(key: str, **tables: str) -> str:
    """The oracle of another key, over other tables."""
    body = REGISTRY[key].body
    for old, new in tables.items():
        body = re.sub(rf"\b{old}\b", new, body)
    return body


# -- C8 and S3: side output ------------------------------------------------------------------------------------

_K = "$.Body.stkCallback"
_RAW_AMOUNT = ("json_extract_string(list_filter(cast(json_extract(body, '$.Body.stkCallback.CallbackMetadata.Item') as json[]), "
               "lambda x: json_extract_string(x, '$.Name') = 'Amount')[1], '$.Value')")
_REASON = f"""case when not json_valid(body) then 'not_json' when json_extract(body, '{_K}') is null then 'no_body'
  when try_cast(json_extract_string(body, '{_K}.ResultCode') as bigint) is null and json_extract(body, '{_K}.ResultCode') is not null then 'bad_result_code'
  when {_RAW_AMOUNT} is not null and try_cast({_RAW_AMOUNT} as decimal(10,2)) is null then 'bad_amount' end"""
_JUDGED = f"(select *, {_REASON} as reason from callback_deliveries)"
_REJECTS = f"select * from {_JUDGED} where reason is not null"


@register("c8r_callback_rejects", _REJECTS)
def c8r(t):
    """Deliveries that cannot be read as callbacks, raw, with the reason."""
    return CB.rejected_callbacks(t.callback_deliveries)


@register("c8d_callback_extract_deliveries", f"""
with fine as (select event_id, received_at, body from {_JUDGED} where reason is null)
select * from {PARSED_CALLBACKS.replace('from callbacks where', 'from fine where')}""")
def c8d(t):
    """Deliveries that can be read, parsed; a broken one among them stops nothing."""
    return CB.parse_callbacks(t.callback_deliveries)


@register("s3r_callback_side_output", _REJECTS)
def s3r(t):
    """The callback stream's second sink: rejected documents, delivered in slices."""
    return SC.run_side_output(t.spark, t.callback_deliveries)[1]


# -- T1, T3, T5 with keyed state -------------------------------------------------------------------------------

@register("t1s_callback_dedup_state", f"select * from {FIRST_CALLBACKS}")
def t1s(t):
    """Streaming dedup by the state store, with the ledger behind it (twin: W4)."""
    return ST.run_dedup_state(t.spark, t.callbacks)


@register("t3t_expiry_timers", f"""
select session_id, user_id, expires_at as expired_at from sessions_live
where status <> 'disconnected' and expires_at < {LIVE_SQL} and started_at <= {LIVE_SQL}""")
def t3t(t):
    """Sessions expire at their own moment of event time, by timers, unless disconnected first (twin: U1)."""
    return ST.run_expiry_timers(t.spark, t.sessions_live, LIVE)


@register("t5t_deadline_timers", f"""
select p.payment_id, p.checkout_request_id, p.created_at, p.created_at + interval 5 minute as deadline
from payments_live p
where p.created_at <= {LIVE_SQL} and p.created_at + interval 5 minute < {LIVE_SQL}
  and not exists (select 1 from {PARSED_CALLBACKS} c where c.checkout_request_id = p.checkout_request_id
    and c.received_at >= p.created_at and c.received_at <= p.created_at + interval 5 minute
    and c.received_at <= {LIVE_SQL})""")
def t5t(t):
    """Payments with no callback within 5 minutes of event time, by timers."""
    return ST.run_deadline_timers(t.spark, t.payments_live, t.callbacks, LIVE)


# -- U: published versions -------------------------------------------------------------------------------------

_S1 = f"select {_S_COLS} from ({REGISTRY['u1_expire_sessions'].body})"
_S2 = f"select {_S_COLS} from ({_sql('u2_disconnect', sessions_live='s1')})"
_NEW = f"select * from ({REGISTRY['u3_open_sessions'].body}) where session_id < 0"


@register("u1v_published_sessions", f"with s1 as ({_S1}), s2 as ({_S2}) select * from s2 union all {_NEW}")
def u1v(t):
    """Sessions expired (U1), disconnected (U2) and opened (U3) as three table versions; the newest one."""
    table = PB.sessions_table(t.spark, run_folder(t.spark, "sessions-versions"))
    table.replace(t.sessions_live)
    PB.expire(table, LIVE, ("sweep", 1))
    PB.disconnect(table, t.disconnect_requests, t.admin_disconnects, ("requests", 1))
    PB.open_sessions(table, t.payments_live, t.packages, LIVE, ("opened", 1))
    return table.read()


_U5_COLS = "payment_id, user_id, package_id, checkout_request_id, amount_kes, status, receipt_number, transaction_date, failure_reason, created_at, updated_at"


@register("u5v_published_payments", f"select {_U5_COLS} from ({REGISTRY['u5_settle_payments'].body})")
def u5v(t):
    """Payments settled by their callbacks as a table version that rewrites the changed days only."""
    table = PB.payments_table(t.spark, run_folder(t.spark, "payments-versions"))
    table.replace(PB.with_settlement(t.payments_pending))
    first = J.first_callbacks(CB.parse_callbacks(t.callbacks))
    PB.settle(table, first, ("callbacks", 1))
    PB.settle(table, first, ("callbacks", 1))  # a replay: nothing happens
    return table.read()


@register("u9v_published_credentials", f"select {_S_COLS} from ({REGISTRY['u9_attach_credentials'].body})")
def u9v(t):
    """Sessions with their credentials attached as a table version."""
    table = PB.sessions_table(t.spark, run_folder(t.spark, "sessions-credentials"), "month")
    table.replace(t.sessions)
    PB.attach_credentials(table, t.payments, t.hotspot_users, t.users, t.packages, ("credentials", 1))
    return table.read()


@register("u10v_published_requests", """
select payment_id, user_id, package_id, amount_kes, status, checkout_request_id, created_at, updated_at from payments_live
union all
select -r.request_id, r.user_id, r.package_id, k.price_kes, 'pending', 'ws_CO_R' || cast(r.request_id as varchar), r.requested_at, r.requested_at
from purchase_requests r join packages k on k.package_id = r.package_id and k.is_active""")
def u10v(t):
    """Payments with the priced purchase requests appended as a table version."""
    table = PB.payments_table(t.spark, run_folder(t.spark, "payments-requested"))
    table.replace(t.payments_live)
    PB.open_payments(table, t.purchase_requests, t.packages, ("requests", 1))
    return table.read()


@register("t2v_settle_published", f"select {_U5_COLS} from ({REGISTRY['u5_settle_payments'].body})")
def t2v(t):
    """Streaming settlement into published tables, a version per batch; the payments (twin: U5)."""
    return SC.run_published(t.spark, t.callbacks, t.payments_pending, t.sessions_live, t.packages)[0]


@register("t2s_sessions_published", f"""
with f as (select checkout_request_id, received_at from {FIRST_CALLBACKS} where result_code = 0)
select {_S_COLS} from sessions_live
union all
select -p.payment_id, p.user_id, p.package_id, p.payment_id, null, f.received_at, f.received_at + interval 1 hour * k.duration_hours, 'active', null, 0, 0, 0
from payments_pending p join f on f.checkout_request_id = p.checkout_request_id join packages k on k.package_id = p.package_id
where p.status <> 'failed' and not exists (select 1 from sessions_live s where s.payment_id = p.payment_id)""")
def t2s(t):
    """The sessions that the settlement stream opens, in the published sessions table."""
    return SC.run_published(t.spark, t.callbacks, t.payments_pending, t.sessions_live, t.packages)[1]


_POLLED = f"""(select checkout_request_id, result_code, result_desc, polled_at,
  case when result_code = 0 then 'completed' when result_code in ({', '.join(map(str, CB.FAILURE_CODES))}) then 'failed' end as outcome
  from (select *, row_number() over (partition by checkout_request_id order by polled_at desc, result_code desc) as rn
    from poll_results where result_code is not null and polled_at <= {LIVE_SQL}) where rn = 1)"""


@register("u11_reconcile_payments", f"""
with j as (select p.*, r.outcome, r.result_desc, r.polled_at, coalesce(r.outcome is not null and p.status not in ('completed', 'failed')
    and p.created_at < {LIVE_SQL} - interval 15 second, false) as changed
  from payments_live p left join {_POLLED} r on r.checkout_request_id = p.checkout_request_id)
select payment_id, user_id, package_id, amount_kes, checkout_request_id, created_at, case when changed then outcome else status end as status,
  case when changed and outcome = 'failed' then result_desc end as failure_reason, case when changed then polled_at else updated_at end as updated_at, changed
from j""")
def u11(t):
    """Unsettled payments older than 15 seconds settled by their status poll."""
    return U.reconcile_payments(t.payments_live, t.poll_results, LIVE)


@register("u11v_published_reconciliation", f"""
select payment_id, user_id, package_id, checkout_request_id, amount_kes, status, null::varchar as receipt_number, null::varchar as transaction_date,
  failure_reason, created_at, updated_at from ({REGISTRY['u11_reconcile_payments'].body})""")
def u11v(t):
    """Payments settled by their status polls as a table version that rewrites the changed days only."""
    table = PB.payments_table(t.spark, run_folder(t.spark, "payments-polled"))
    table.replace(PB.with_settlement(t.payments_live))
    PB.reconcile(table, t.poll_results, LIVE, ("polls", 1))
    return table.read()


_RULES = [("name_not_empty", "length(trim(package_name)) > 0"),
          ("duration_int_ge_1", "regexp_full_match(duration_hours, '[0-9]+') and try_cast(duration_hours as integer) >= 1"),
          ("price_ge_1", "try_cast(price_kes as decimal(10,2)) >= 1"),
          ("speed_int_ge_1", "regexp_full_match(speed_mbps, '[0-9]+') and try_cast(speed_mbps as integer) >= 1")]
_BROKEN = "array_to_string(list_filter([" + ", ".join(f"case when not coalesce({c}, false) then '{n}' end" for n, c in _RULES) + "], lambda x: x is not null), ',')"


@register("u12_create_packages", f"""
select * from packages
union all
select -request_id as package_id, package_name, try_cast(duration_hours as integer) as duration_hours, try_cast(price_kes as decimal(10,2)) as price_kes,
  try_cast(speed_mbps as integer) as speed_mbps, true as is_active, coalesce(sort_order, 0) as sort_order
from package_requests where {_BROKEN} = ''""")
def u12(t):
    """The catalogue with the valid package requests inserted."""
    return U.create_packages(t.packages, t.package_requests)[0]


@register("u12r_refused_packages", f"select request_id, package_name, {_BROKEN} as broken_rules from package_requests where {_BROKEN} <> ''")
def u12r(t):
    """Package requests refused, with the rules they break."""
    return U.create_packages(t.packages, t.package_requests)[1]


@register("u13_start_sessions", """
with paid as (select p.payment_id, p.user_id, p.package_id, k.duration_hours from payments_live p join packages k using (package_id) where p.status = 'completed'),
j as (select r.*, paid.package_id, paid.duration_hours, s.payment_id is not null as taken,
    row_number() over (partition by r.payment_id, r.user_id order by r.requested_at, r.request_id) as rn
  from start_requests r left join paid on paid.payment_id = r.payment_id and paid.user_id = r.user_id
  left join (select distinct payment_id from sessions_live where payment_id is not null) s on s.payment_id = r.payment_id),
f as (select *, case when package_id is null then 'Completed payment not found.' when taken or rn > 1 then 'Session already exists for this payment.' end as refusal from j)
select request_id, user_id, payment_id, case when refusal is null then -payment_id end as session_id, case when refusal is null then package_id end as package_id,
  case when refusal is null then ip_address end as ip_address, case when refusal is null then requested_at end as started_at,
  case when refusal is null then requested_at + interval 1 hour * duration_hours end as expires_at, refusal
from f""")
def u13(t):
    """Sessions started by hand from one's own completed payment, or the refusal."""
    return U.start_session(t.sessions_live, t.start_requests, t.payments_live, t.packages)


# -- F6 and L1 over stored structures --------------------------------------------------------------------------

@register("f6x_user_search_indexed", "select * from users where phone_number ilike '%0000001%' or name ilike '%0000001%'")
def f6x(t):
    """Users whose phone or name contains a text, found by trigram postings."""
    return SX.search(t.users, SX.build(t.users, run_folder(t.spark, "trigrams")), "0000001")


@register("l1d_deep_page", "select * from payments order by created_at desc, payment_id desc limit 20 offset 1180")
def l1d(t):
    """Page 60 of the payments, newest first, from a rank directory."""
    order = [F.col("created_at").desc(), F.col("payment_id").desc()]
    return PG.RankedList.write(t.payments, order, run_folder(t.spark, "ranked"), rows_per_range=5000).page(60, 20)


# -- A: maintained, distinct, laid out -------------------------------------------------------------------------

def maintained(t) -> I.Maintained:
    """The facts of the live tables after U1, U3 and U5, each applied as the delta of its changed rows."""
    m = I.Maintained(t.spark, run_folder(t.spark, "facts"))
    m.build(t.sessions_live, t.payments_pending)
    expired = U.expire_sessions(t.sessions_live, LIVE).where("changed")
    m.apply(I.delta(t.sessions_live.join(expired.select("session_id"), "session_id", "left_semi"), expired, I.session_facts), ("u1", 1))
    m.apply(I.session_facts(U.new_sessions(t.sessions_live, t.payments_live, t.packages, LIVE)), ("u3", 1))
    settled = U.settle_payments(t.payments_pending, J.first_callbacks(CB.parse_callbacks(t.callbacks))).where("changed")
    m.apply(I.delta(t.payments_pending.join(settled.select("payment_id"), "payment_id", "left_semi"), settled, I.payment_facts), ("u5", 1))
    return m


_AFTER = f"""s3 as (select {_S_COLS} from ({REGISTRY['u1_expire_sessions'].body}) union all {_NEW}),
p5 as (select {_U5_COLS} from ({REGISTRY['u5_settle_payments'].body}))"""


@register("a6i_daily_stats_maintained", f"with {_AFTER} {_sql('a6_daily_stats', sessions='s3', payments='p5')}")
def a6i(t):
    """A6 from maintained facts after an expiry, new sessions and a settlement."""
    return I.daily_stats(maintained(t).facts())


@register("a7i_user_totals_maintained", f"with {_AFTER} {_sql('a7_user_totals', sessions='s3', payments='p5')}")
def a7i(t):
    """A7 from maintained facts after an expiry, new sessions and a settlement."""
    return I.user_totals(t.users, maintained(t).facts())


@register("a9i_weekly_spend_maintained", f"with {_AFTER}, q as ({_sql('a9_weekly_spend', payments_live='p5')}) select * from q")
def a9i(t):
    """A9 from maintained facts after a settlement."""
    return I.weekly_spend(t.users, maintained(t).facts(), LIVE)


@register("a4d_distinct_users_window", """
with d as (select distinct cast(started_at as date) as day, user_id from sessions_live where user_id is not null),
days as (select distinct day from d)
select days.day, count(distinct d.user_id) filter (where d.day = days.day) as users_on_day, count(distinct d.user_id) as users_in_window
from days join d on d.day between days.day - 6 and days.day group by days.day""")
def a4d(t):
    """Per day exact distinct users, that day and over the 7 days that end with it, from daily bitmaps."""
    return D.trailing_distinct(D.day_bitmaps(t.sessions_live, "started_at"), 7)


def _daily(t):
    base = run_folder(t.spark, "daily")
    path = daily.write_daily(t.payments_live, "created_at", f"{base}/payments")
    calendar = daily.write_calendar(t.spark, "2023-12-01", "2024-12-31", f"{base}/calendar")
    return daily.read_daily(t.spark, path, t.payments_live), daily.read_calendar(t.spark, calendar)


@register("a16d_revenue_by_day_folder", _sql("a16_revenue_series"))
def a16d(t):
    """A16 over payments stored by day, pruned by the calendar."""
    return daily.revenue_series(*_daily(t), LIVE)


@register("a9d_weekly_spend_by_day_folder", _sql("a9_weekly_spend"))
def a9d(t):
    """A9 over payments stored by day, pruned by the calendar."""
    return daily.weekly_spend(t.users, *_daily(t), LIVE)


BUCKETS = 8


def bucketed_tables(t, buckets: int = BUCKETS) -> bucketed.BucketedTables:
    path = run_folder(t.spark, "bucketed")
    return bucketed.BucketedTables(t.spark, t.sf_dir, path, bucketed.write_bucketed(t, path, buckets, ["users", "sessions", "payments"]), buckets)


@register("a7b_user_totals_bucketed", _sql("a7_user_totals"))
def a7b(t):
    """A7 over tables bucketed by user: no shuffle."""
    b = bucketed_tables(t)
    return A.user_totals(b.users, b.sessions, b.payments)


@register("a12b_favourite_package_bucketed", _sql("a12_favourite_package"))
def a12b(t):
    """A12 over sessions bucketed by user: no shuffle by user."""
    b = bucketed_tables(t)
    return A.favourite_package(b.sessions, t.packages)


@register("j5b_unused_payment_bucketed", _sql("j5_unused_payment"))
def j5b(t):
    """J5 over tables bucketed by user: join and grouping stay in the bucket."""
    b = bucketed_tables(t)
    return J.unused_payments(b.payments, b.sessions, same_user=True)


@register("u9b_attach_credentials_bucketed", _sql("u9_attach_credentials"))
def u9b(t):
    """U9 over tables bucketed by user: join and grouping stay in the bucket."""
    b = bucketed_tables(t)
    return U.attach_credentials(b.sessions, J.unused_payments(b.payments, b.sessions, same_user=True), t.hotspot_users, b.users, t.packages, same_user=True)



