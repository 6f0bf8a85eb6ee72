"""Registered report queries (A keys)."""

from __future__ import annotations

from ..columns import GB, MB, sql_floor_div as fdiv, sql_round_half_up_div as rdiv
from ..operators import aggregates as A
from ..clock import LIVE
from .oracle import LIVE_SQL
from .registry import register

_ST = "status in ('active', 'expired', 'disconnected')"
_SECS = "trunc((epoch_us(ended_at) - epoch_us(started_at)) / 1000000)::bigint"
_S_SECS = _SECS.replace('ended_at', 's.ended_at').replace('started_at', 's.started_at')
_TODAY = f"date_trunc('day', {LIVE_SQL})"


@register("a1_kpi", f"""
select
  (select count(*) from users where role = 'user') as total_users,
  (select count(*) from sessions_live where status = 'active' and expires_at > {LIVE_SQL}) as active_sessions,
  (select count(*) from sessions_live where status = 'active') as active_sessions_any_expiry,
  (select cast(coalesce(sum(amount_kes), 0) as decimal(18,2)) from payments_live where status = 'completed')
    as total_revenue_kes,
  (select cast(coalesce(sum(amount_kes), 0) as decimal(18,2)) from payments_live
    where status = 'completed' and created_at >= {_TODAY}) as today_revenue_kes
""")
def a1(t):
    """Dashboard counters: users, active sessions (both meanings), revenue, today's revenue."""
    return A.kpi(t.users, t.sessions_live, t.payments_live, LIVE)


@register("a2_active_count", "select count(*) as active_sessions from sessions_live where status = 'active'")
def a2(t):
    """Sessions with status active."""
    return A.active_count(t.sessions_live)


@register("a3_last_hour", f"""
select count(*) as sessions_count,
  {rdiv('coalesce(sum(bytes_downloaded + bytes_uploaded), 0)', str(GB))} as total_data_gb,
  case when count(bytes_downloaded + bytes_uploaded) > 0
       then {rdiv('sum(bytes_downloaded + bytes_uploaded)', f'count(bytes_downloaded + bytes_uploaded) * {MB}')}
       else cast(0 as decimal(18,2)) end as avg_data_mb
from sessions_live where {_ST} and started_at >= {LIVE_SQL} - interval 1 hour
""")
def a3(t):
    """Last hour: sessions, GB and mean MB."""
    return A.last_hour(t.sessions_live, LIVE)


@register("a4_today_usage", f"""
select count(*) as sessions_count, count(distinct user_id) as unique_users,
  {rdiv('coalesce(sum(bytes_downloaded + bytes_uploaded), 0)', str(GB))} as total_data_gb
from sessions_live where {_ST} and started_at >= {_TODAY}
""")
def a4(t):
    """Today: sessions, distinct users, GB."""
    return A.today_usage(t.sessions_live, LIVE)


@register("a5_closed_last_hour", f"""
select count(*) as total_sessions,
  coalesce(cast({fdiv('sum(epoch_us(ended_at) - epoch_us(started_at))', '60000000')} as bigint), 0) as total_session_minutes,
  case when count(bytes_downloaded + bytes_uploaded) > 0
       then cast(sum(bytes_downloaded + bytes_uploaded) // (count(bytes_downloaded + bytes_uploaded) * {MB}) as bigint)
       else 0 end as avg_data_mb
from sessions_live
where started_at > {LIVE_SQL} - interval 1 hour and status in ('expired', 'disconnected')
""")
def a5(t):
    """Closed sessions of the last hour: count, minutes, mean MB."""
    return A.closed_last_hour(t.sessions_live, LIVE)


_A6_TAIL = f"""
  {rdiv('coalesce(sum(s.bytes_downloaded + s.bytes_uploaded), 0)', str(GB))} as total_data_gb,"""


@register("a6_daily_stats", f"""
select cast(s.started_at as date) as date, count(distinct s.user_id) as unique_users, count(*) as total_sessions,
  cast({fdiv(f"sum({_S_SECS})", f"count({_S_SECS})")} as bigint) as avg_session_seconds,{_A6_TAIL}
  cast(coalesce(sum(py.amount_kes) filter (where py.status = 'completed'), 0) as decimal(18,2)) as revenue_kes
from sessions s
left join payments py on s.user_id = py.user_id and cast(py.updated_at as date) = cast(s.started_at as date)
where s.{_ST}
group by cast(s.started_at as date)
""")
def a6(t):
    """Per day: users, sessions, mean seconds, GB, revenue -- as written (payments fan out)."""
    return A.daily_stats(t.sessions, t.payments)


@register("a6s_daily_stats_safe", f"""
with ud as (select distinct user_id, cast(started_at as date) as day from sessions where {_ST}),
pay as (select user_id, cast(updated_at as date) as day, sum(amount_kes) as paid
        from payments where status = 'completed' group by all),
rev as (select ud.day, sum(pay.paid) as revenue from ud join pay using (user_id, day) group by ud.day),
st as (select cast(started_at as date) as day, count(distinct user_id) as unique_users, count(*) as total_sessions,
         cast({fdiv(f"sum({_SECS})", f"count({_SECS})")} as bigint) as avg_session_seconds,
         sum(bytes_downloaded + bytes_uploaded) as bytes
       from sessions where {_ST} group by 1)
select st.day as date, unique_users, total_sessions, avg_session_seconds,
  {rdiv('coalesce(bytes, 0)', str(GB))} as total_data_gb,
  cast(coalesce(revenue, 0) as decimal(18,2)) as revenue_kes
from st left join rev using (day)
""")
def a6s(t):
    """Per day: users, sessions, mean seconds, GB, revenue, each user's payments counted once."""
    return A.daily_stats_safe(t.sessions, t.payments)


_USER_COLS = "u.user_id, u.phone_number, u.name, u.role, u.is_active, u.created_at"


@register("a7_user_totals", f"""
select {_USER_COLS}, count(distinct s.session_id) as total_sessions,
  cast(coalesce(sum(py.amount_kes) filter (where py.status = 'completed'), 0) as decimal(18,2)) as total_spent
from users u left join sessions s on s.user_id = u.user_id left join payments py on py.user_id = u.user_id
group by {_USER_COLS}
""")
def a7(t):
    """Per user: sessions and completed spend, as written (spend fans out by sessions)."""
    return A.user_totals(t.users, t.sessions, t.payments, safe=False)


@register("a7p_user_report_page", f"""
select {_USER_COLS}, count(distinct s.session_id) as total_sessions,
  cast(coalesce(sum(py.amount_kes) filter (where py.status = 'completed'), 0) as decimal(18,2)) as total_spent
from users u left join sessions s on s.user_id = u.user_id left join payments py on py.user_id = u.user_id
where u.phone_number ilike '%R#00000%' or u.name ilike '%R#00000%'
group by {_USER_COLS}
order by u.created_at desc, u.user_id desc limit 20 offset 20
""")
def a7p(t):
    """The admin users report as served: search, per-user totals (as written), page 2 of 20, newest first."""
    from pyspark.sql import functions as F
    from ..operators import filters as Fl
    from ..operators import ordering as L
    found = Fl.user_search(t.users, "R#00000")
    report = A.user_totals(found, t.sessions, t.payments, safe=False)
    return L.page(report, [F.col("created_at").desc(), F.col("user_id").desc()], page_no=2, limit=20)


@register("a7s_user_totals_safe", f"""
select {_USER_COLS}, coalesce(s.n, 0) as total_sessions, cast(coalesce(p.spent, 0) as decimal(18,2)) as total_spent
from users u
left join (select user_id, count(*) as n from sessions group by 1) s on s.user_id = u.user_id
left join (select user_id, sum(amount_kes) as spent from payments where status = 'completed' group by 1) p
  on p.user_id = u.user_id
""")
def a7s(t):
    """Per user: sessions and completed spend, pre-aggregated."""
    return A.user_totals(t.users, t.sessions, t.payments, safe=True)


_A8_DUR = "(epoch_us(ended_at) - epoch_us(started_at))"
_A8_N = "count(*) filter (where ended_at is not null)"
_A8 = f"""
  count(*) filter (where status = 'active') as active_sessions_count,
  cast(coalesce(sum(bytes_downloaded + bytes_uploaded) filter (where started_at > {LIVE_SQL} - interval 1 hour), 0)
    as bigint) as total_bytes_hour,
  count(distinct user_id) filter (where started_at >= {_TODAY} and started_at < {_TODAY} + interval 1 day)
    as unique_users_today,
  case when {_A8_N} > 0 then cast((sum({_A8_DUR}) filter (where ended_at is not null) * 2 + {_A8_N} * 1000000)
    // ({_A8_N} * 2000000) as bigint) end as avg_session_duration_seconds"""


@register("a8_system_stats", f"""
select {_A8}, {LIVE_SQL} as recorded_at from sessions_live
""")
def a8(t):
    """The stats snapshot row: active count, last-hour bytes, today's users, mean closed duration."""
    return A.system_stats(t.sessions_live, LIVE)


@register("a8x_system_stats_full", f"""
with r as (select {_A8},
  cast(coalesce(sum(bytes_downloaded + bytes_uploaded) filter
    (where started_at >= {_TODAY} and started_at < {_TODAY} + interval 1 day), 0) as bigint) as total_bytes_today,
  cast(coalesce(sum(bytes_downloaded + bytes_uploaded) filter (where started_at > {LIVE_SQL} - interval 1 minute), 0)
    as bigint) as total_bytes_minute,
  cast(floor(median({_SECS}) filter (where ended_at is not null)) as bigint) as median_session_duration_seconds
  from sessions_live),
n as (select count(*) as new_users_today from users
      where created_at >= {_TODAY} and created_at < {_TODAY} + interval 1 day)
select r.active_sessions_count, r.total_bytes_hour, r.unique_users_today, r.avg_session_duration_seconds,
  r.total_bytes_today, r.total_bytes_minute, n.new_users_today, r.median_session_duration_seconds,
  {LIVE_SQL} as recorded_at
from r, n
""")
def a8x(t):
    """Stats snapshot with the declared extra columns: bytes today/minute, new users, median duration."""
    return A.system_stats(t.sessions_live, LIVE, users=t.users, full=True)


_D0 = f"cast({LIVE_SQL} as date)"


def _days(n: int) -> str:
    return (f"(select cast(d as date) as day_date from (select unnest(generate_series("
            f"{_D0} - interval {n - 1} day, cast({_D0} as timestamp), interval 1 day)) as d))")


_A9 = f"""
with days as {_days(7)},
spend as (select user_id, cast(created_at as date) as day_date, sum(amount_kes) as spent from payments_live
          where status = 'completed' and created_at >= {_D0} - interval 6 day and created_at < {_D0} + interval 1 day
          group by all),
a9 as (select u.user_id, d.day_date, strftime(d.day_date, '%a') as day_name,
         cast(coalesce(s.spent, 0) as decimal(18,2)) as total_spent
       from users u cross join days d left join spend s on s.user_id = u.user_id and s.day_date = d.day_date)"""


@register("a9_weekly_spend", _A9 + "\nselect * from a9")
def a9(t):
    """Per user, 7 days zero-filled with weekday names."""
    return A.weekly_spend(t.users, t.payments_live, LIVE)


@register("a10_weekly_total_max", _A9 + """,
c as (select *, cast(total_spent * 100 as bigint) as c from a9),
m as (select *, greatest(max(c) over (partition by user_id), 100) as max_c,
        sum(c) over (partition by user_id) as week_c from c)
select user_id, day_date, total_spent, cast(week_c / 100 as decimal(18,2)) as week_total,
  cast(max_c / 100 as decimal(18,2)) as max_day, greatest(cast((c * 10000) // max_c as bigint), 200) as bar_bp,
  (c = max_c and c > 0) as is_max
from m
""")
def a10(t):
    """Week total, largest day, bar height (basis points), max-day flag."""
    return A.weekly_total_max(t.users, t.payments_live, LIVE)


@register("a11_status_counts", """
select 'status' as scope, status as key, count(*) as total, cast(ceil(count(*) / 20) as bigint) as pages
from sessions group by status
union all
select 'user' as scope, cast(user_id as varchar) as key, count(*) as total, cast(ceil(count(*) / 10) as bigint) as pages
from sessions group by user_id
""")
def a11(t):
    """Row totals behind each page: per status and per user, with page counts."""
    return A.status_counts(t.sessions)


@register("a12_favourite_package", """
with c as (select user_id, package_id, count(*) as n from sessions group by all),
r as (select c.*, p.package_name,
        row_number() over (partition by user_id order by n desc, p.package_name, c.package_id) as rn
      from c join packages p using (package_id))
select user_id, package_id, package_name, n as n_sessions from r where rn = 1
""")
def a12(t):
    """Most frequent package per user."""
    return A.favourite_package(t.sessions, t.packages)


@register("a13_user_spend", """
select s.user_id, count(*) as total_sessions, cast(coalesce(sum(py.amount_kes), 0) as decimal(18,2)) as total_spent
from sessions s left join payments py on py.payment_id = s.payment_id group by s.user_id
""")
def a13(t):
    """Per user: all sessions and the spend of the paid ones, full history."""
    return A.user_spend(t.sessions, t.payments)


@register("a14_capacity_health", """
with a as (select count(*) as n from sessions_live where status = 'active')
select n as active_sessions, 1000 as max_capacity,
  cast(((n * 2000 + 1000) // 2000) / 10 as decimal(10,1)) as capacity_percent,
  case when n * 100 > 90000 then 'critical' when n * 100 > 75000 then 'warning' else 'healthy' end as status
from a
""")
def a14(t):
    """Active sessions against a capacity of 1000."""
    return A.capacity_health(t.sessions_live, 1000)


def _bw_sql(keys: str, group: str) -> str:
    secs = "trunc((epoch_us(period_end) - epoch_us(period_start)) / 1000000)::bigint"
    inner = (f"select {keys}, count(*) as n_periods, sum(bytes_downloaded)::bigint as bytes_downloaded, "
             f"sum(bytes_uploaded)::bigint as bytes_uploaded, sum(packets_in)::bigint as packets_in, "
             f"sum(packets_out)::bigint as packets_out, sum({secs})::bigint as seconds "
             f"from bandwidth_logs group by {group}")
    return (f"select *, case when seconds > 0 then {rdiv('bytes_downloaded * 8', 'seconds * 1024')} end "
            f"as avg_down_kbps, case when seconds > 0 then {rdiv('bytes_uploaded * 8', 'seconds * 1024')} end "
            f"as avg_up_kbps from ({inner}) g")


@register("a15_bandwidth_by_session", _bw_sql("session_id", "session_id"))
def a15(t):
    """Bandwidth log rollup per session."""
    return A.bandwidth_by_session(t.bandwidth_logs)


@register("a15h_bandwidth_by_user_hour", _bw_sql("user_id, date_trunc('hour', period_start) as hour",
                                                 "user_id, date_trunc('hour', period_start)"))
def a15h(t):
    """Bandwidth log rollup per user and hour."""
    return A.bandwidth_by_user_hour(t.bandwidth_logs)


@register("a16_revenue_series", f"""
with days as {_days(30)},
daily as (select cast(created_at as date) as day_date, sum(amount_kes) as revenue from payments_live
          where status = 'completed' and created_at >= {_D0} - interval 29 day and created_at < {_D0} + interval 1 day
          group by 1)
select d.day_date as day, cast(coalesce(revenue, 0) as decimal(18,2)) as revenue_kes,
  cast(date_trunc('week', d.day_date) as date) as week_start,
  cast(sum(coalesce(revenue, 0)) over (partition by date_trunc('week', d.day_date)) as decimal(18,2))
    as week_revenue_kes
from days d left join daily using (day_date)
""")
def a16(t):
    """30 days of completed revenue, zero-filled, with weekly totals."""
    return A.revenue_series(t.spark, t.payments_live, LIVE)


@register("a17_package_breakdown", """
with per as (select package_id, count(*) as n_sales, sum(amount_kes) as revenue from payments
             where status = 'completed' group by 1),
tot as (select sum(revenue) as total from per)
select per.package_id, k.package_name, per.n_sales, cast(per.revenue as decimal(18,2)) as revenue_kes,
  cast((cast(per.revenue * 100 as hugeint) * 10000) // cast(tot.total * 100 as hugeint) as bigint) as share_bp
from per cross join tot left join packages k on k.package_id = per.package_id
""")
def a17(t):
    """Share of completed sales per package, in basis points."""
    return A.package_breakdown(t.payments, t.packages)


_A18_TABLES = ("users", "packages", "payments", "payments_live", "sessions", "sessions_live", "hotspot_users",
               "bandwidth_logs", "callbacks", "logins")


@register("a18_seed_counts", "\nunion all\n".join(
    f"select '{n}' as table_name, count(*) as row_count, '{n}: ' || cast(count(*) as varchar) as label from {n}"
    for n in _A18_TABLES))
def a18(t):
    """Row count per table, with a text line."""
    return A.seed_counts({n: getattr(t, n) for n in _A18_TABLES})
