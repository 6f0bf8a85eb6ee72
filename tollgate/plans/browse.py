"""Registered filter, projection, join, window and ordering queries (F, P, J, W, L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..clock import LIVE
from ..columns import sql_round_half_up_div as rdiv
from ..operators import filters as Fl
from ..operators import joins as J
from ..operators import ordering as L
from ..operators import projections as P
from ..operators import windows as W
from ..functions.callbacks import parse_callbacks
from .oracle import LIVE_SQL
from .registry import register
from .sqlparts import FIRST_CALLBACKS, SNAPSHOT, epoch_diff, phone_normalised, secs

_CAT = "(case when duration_hours <= 4 then 'short' when duration_hours = 24 then 'daily' else 'weekly' end)"
_CATALOGUE = "package_id, package_name, duration_hours, price_kes, speed_mbps, sort_order"


# -- F ---------------------------------------------------------------------------------------------------------

@register("f1_enum_filter", "select * from sessions where status = 'expired'")
def f1(t):
    """Sessions filtered by an optional status (here: expired)."""
    return Fl.enum_filter(t.sessions, "status", "expired")


@register("f2_unexpired", f"select * from sessions_live where status = 'active' and expires_at > {LIVE_SQL}")
def f2(t):
    """Active and unexpired sessions at the clock."""
    return Fl.unexpired(t.sessions_live, LIVE)


@register("f3_rolling_window", f"select * from payments_live where created_at >= {LIVE_SQL} - interval 7 day")
def f3(t):
    """Payments of the rolling last 7 days."""
    return Fl.rolling_window(t.payments_live, "created_at", LIVE, days=7)


@register("f4_today", f"""select * from payments_live
where status = 'completed' and created_at >= date_trunc('day', {LIVE_SQL})""")
def f4(t):
    """Completed payments since midnight."""
    return Fl.today(t.payments_live.where(F.col("status") == "completed"), "created_at", LIVE)


@register("f5_status_in", "select * from sessions where status in ('expired', 'disconnected')")
def f5(t):
    """Closed sessions."""
    return Fl.status_in(t.sessions, ["expired", "disconnected"])


@register("f6_user_search", "select * from users where phone_number ilike '%R#0000001%' or name ilike '%R#0000001%'")
def f6(t):
    """Users whose phone or name contains a text, case-insensitive."""
    return Fl.user_search(t.users, "R#0000001")


@register("f7_active_catalogue", f"select {_CATALOGUE} from packages where is_active")
def f7(t):
    """Active catalogue, sorted by sort_order then price."""
    return Fl.active_catalogue(t.packages)


@register("f8_package_category", f"""select {_CATALOGUE}, {_CAT} as category from packages
where is_active and {_CAT} = 'weekly'""")
def f8(t):
    """Active packages of one category (weekly, 12 h included as written)."""
    return Fl.package_category(t.packages, "weekly")


@register("f9_paid_rows", "select * from payments_live where status = 'completed' or amount_kes > 0")
def f9(t):
    """Rows counted as paid: completed or a positive amount."""
    return Fl.paid_rows(t.payments_live)


@register("f10_reconcile_due", f"""select * from payments_live
where status not in ('completed', 'failed') and created_at < {LIVE_SQL} - interval 15 second""")
def f10(t):
    """Unsettled payments older than 15 seconds (due for a status poll)."""
    return Fl.reconcile_due(t.payments_live, LIVE)


# -- P ---------------------------------------------------------------------------------------------------------

@register("p1_active_view", f"""
with live as (select *, {epoch_diff(LIVE_SQL, 'expires_at')} as left_us, {epoch_diff('started_at', 'expires_at')} as whole_us
  from sessions_live where status = 'active' and expires_at > {LIVE_SQL})
select session_id, user_id, package_id, status, started_at, expires_at, bytes_downloaded, bytes_uploaded, data_used_mb,
  who.phone_number, who.name, plan.package_name, plan.speed_mbps, account.username as hotspot_username, device.ip_address, device.mac_address,
  cast(trunc(left_us / 1000000) as bigint) as time_remaining_seconds, {rdiv('left_us', '3600000000')} as hours_remaining,
  case when whole_us > 0 then {rdiv('left_us * 100', 'whole_us')} end as percent_remaining
from live join users who using (user_id) join packages plan using (package_id)
left join hotspot_users account using (hotspot_user_id) left join session_devices device using (session_id)
""")
def p1(t):
    """Active sessions view (union of both definitions), with the devices' addresses."""
    return P.active_view(t.sessions_live, t.users, t.packages, t.hotspot_users, LIVE, t.session_devices)


_MS = f"(greatest({epoch_diff(LIVE_SQL, 's.expires_at')}, 0) // 1000)"


@register("p2_session_status", f"""
select s.session_id, s.user_id, p.package_name, p.speed_mbps, s.status, s.started_at, s.expires_at,
  {_MS} as time_remaining_ms, {rdiv(f'{_MS} * 100', 'cast(p.duration_hours as bigint) * 3600000')} as percent_remaining
from sessions_live s join packages p on p.package_id = s.package_id where s.status = 'active'
""")
def p2(t):
    """Every active session's time left (ms, floored at 0) and percent of package time."""
    return P.session_status(t.sessions_live, t.packages, LIVE)


@register("p3_session_history_view", f"""
with past as (select *, bytes_downloaded + bytes_uploaded as moved, {epoch_diff('started_at', 'ended_at')} as us from sessions)
select session_id, user_id, who.phone_number, who.name, plan.package_name, status, started_at, ended_at,
  cast(trunc(us / 1000000) as bigint) as session_duration_seconds, bytes_downloaded, bytes_uploaded, moved >> 20 as total_data_mb
from past join users who using (user_id) join packages plan using (package_id)
""")
def p3(t):
    """Session history with duration and integer MB."""
    return P.session_history(t.sessions, t.users, t.packages)


@register("p4_active_list", """
select s.session_id, s.user_id, s.package_id, s.started_at, s.expires_at, s.status, p.package_name, u.phone_number
from sessions_live s join packages p on p.package_id = s.package_id join users u on u.user_id = s.user_id
where s.status = 'active'
""")
def p4(t):
    """All active sessions with package and phone, newest first."""
    return P.active_list(t.sessions_live, t.packages, t.users)


# -- J ---------------------------------------------------------------------------------------------------------

@register("j1_payment_terms", """
select p.package_id, p.payment_id, p.user_id, k.duration_hours from payments p
join packages k on k.package_id = p.package_id where p.status = 'completed'
""")
def j1(t):
    """Completed payments with their package's duration."""
    return J.payment_terms(t.payments, t.packages)


_J2 = """select py.payment_id, py.status, py.amount_kes, py.checkout_request_id, py.created_at, u.name,
  u.phone_number as user_phone, k.package_name
from payments py join users u on u.user_id = py.user_id join packages k on k.package_id = py.package_id"""


@register("j2_transactions", _J2)
def j2(t):
    """Payments with user and package."""
    return J.transactions(t.payments, t.users, t.packages)


@register("j3_session_list", """
select s.session_id, s.status, s.started_at, s.expires_at, s.data_used_mb, u.phone_number, u.name,
  k.package_name, k.speed_mbps, py.amount_kes, (select count(*) from sessions) as total_sessions
from sessions s join users u on u.user_id = s.user_id join packages k on k.package_id = s.package_id
join payments py on py.payment_id = s.payment_id
""")
def j3(t):
    """Sessions with user, package and payment, plus the unjoined total."""
    return J.session_list(t.sessions, t.users, t.packages, t.payments)


@register("j3p_admin_sessions_page", """
select s.session_id, s.status, s.started_at, s.expires_at, s.data_used_mb, u.phone_number, u.name,
  k.package_name, k.speed_mbps, py.amount_kes,
  (select count(*) from sessions where status = 'active') as total_sessions
from sessions s join users u on u.user_id = s.user_id join packages k on k.package_id = s.package_id
join payments py on py.payment_id = s.payment_id
where s.status = 'active'
order by s.started_at desc, s.session_id desc limit 20
""")
def j3p(t):
    """The admin sessions list as served: status filter, joins, total, first page of 20, newest first."""
    rows = J.session_list(t.sessions, t.users, t.packages, t.payments, status="active")
    return L.page(rows, [F.col("started_at").desc(), F.col("session_id").desc()], page_no=1, limit=20)


@register("j4_left_hotspot", f"""
select s.session_id, s.user_id, s.hotspot_user_id, hu.username as hotspot_username, s.expires_at
from sessions_live s left join hotspot_users hu on hu.hotspot_user_id = s.hotspot_user_id
where s.status = 'active' and s.expires_at > {LIVE_SQL}
""")
def j4(t):
    """Active sessions with optional hotspot username."""
    return J.active_with_hotspot(t.sessions_live, t.hotspot_users, LIVE)


@register("j5_unused_payment", """
with c as (select p.payment_id, p.user_id, p.package_id, p.updated_at, s.session_id as active_session_id
  from payments p left join sessions s on s.payment_id = p.payment_id
  where p.status = 'completed' and (s.session_id is null or (s.status = 'active' and s.hotspot_user_id is null))),
r as (select *, row_number() over (partition by user_id, package_id order by updated_at desc, payment_id desc) as rn
  from c)
select user_id, package_id, payment_id, updated_at, active_session_id from r where rn = 1
""")
def j5(t):
    """Newest usable payment per (user, package)."""
    return J.unused_payments(t.payments, t.sessions)


@register("j6_payment_status_join", """
select py.payment_id, py.checkout_request_id, py.status, py.amount_kes, py.created_at, s.session_id, k.package_name
from payments_live py left join sessions_live s on s.payment_id = py.payment_id
left join packages k on k.package_id = py.package_id
""")
def j6(t):
    """Payments with session and package, both optional."""
    return J.payment_status(t.payments_live, t.sessions_live, t.packages)


_NEWEST = """newest as (select user_id, package_id,
    max(struct_pack(moment := updated_at, id := payment_id, amount := amount_kes)) as pay
  from {} where status = 'completed' group by user_id, package_id)"""


@register("j8_latest_payment", f"""
with {_NEWEST.format('payments')}
select session_id, status, started_at, expires_at, hotspot_user_id, bytes_downloaded, bytes_uploaded,
  who.phone_number, who.name, plan.package_name, plan.speed_mbps, pay.id as latest_payment_id, pay.amount as amount_kes
from sessions join newest using (user_id, package_id) join users who using (user_id) join packages plan using (package_id)
where status = 'active'
""")
def j8(t):
    """Active sessions with the newest completed payment of their (user, package)."""
    return J.hotspot_sessions(t.sessions, t.users, t.packages, t.payments, "active")


@register("j8p_hotspot_sessions_page", f"""
with {_NEWEST.format('payments_live')},
shown as (select session_id, status, started_at, expires_at, hotspot_user_id, who.phone_number, who.name,
    plan.package_name, plan.speed_mbps, pay.amount as amount_kes
  from sessions_live join newest using (user_id, package_id) join users who using (user_id)
  join packages plan using (package_id) where status = 'active')
select shown.*, greatest({secs(LIVE_SQL, 'shown.expires_at')}, 0) as time_remaining_s,
  if(there.bytes_in is null, 'offline', 'online') as hotstatus,
  coalesce(there.bytes_in, 0) as bytes_in, coalesce(there.bytes_out, 0) as bytes_out
from shown left join hotspot_users account using (hotspot_user_id)
left join {SNAPSHOT} there on there.username = account.username
order by shown.started_at desc, shown.session_id desc limit 20
""")
def j8p(t):
    """The admin hotspot list as served: latest payment, time left, live router state, first page."""
    rows = J.hotspot_sessions_live(t.sessions_live, t.users, t.packages, t.payments_live, t.hotspot_users,
                                   t.activity_feed, LIVE)
    return L.page(rows, [F.col("started_at").desc(), F.col("session_id").desc()], page_no=1, limit=20)


@register("j9_update_from", f"""
select py.payment_id, py.user_id, py.package_id, k.duration_hours, c.checkout_request_id, 'completed' as status,
  c.receipt_number, c.transaction_date, coalesce(c.amount_kes, py.amount_kes) as amount_kes
from {FIRST_CALLBACKS} c join payments_live py on py.checkout_request_id = c.checkout_request_id
join packages k on k.package_id = py.package_id
where c.result_code = 0
""")
def j9(t):
    """Successful callbacks joined to their payments and packages (the settle update's FROM)."""
    first = J.first_callbacks(parse_callbacks(t.callbacks))
    return J.settle_join(first, t.payments_live, t.packages)


@register("j10_online_enrich", f"""
select s.session_id, s.user_id, s.hotspot_user_id, s.expires_at,
  greatest({secs(LIVE_SQL, 's.expires_at')}, 0) as time_remaining_s,
  case when snap.bytes_in is not null then 'online' else 'offline' end as hotstatus,
  coalesce(snap.bytes_in, 0) as bytes_in, coalesce(snap.bytes_out, 0) as bytes_out
from sessions_live s left join hotspot_users hu on hu.hotspot_user_id = s.hotspot_user_id
left join {SNAPSHOT} snap on snap.username = hu.username
where s.status = 'active'
""")
def j10(t):
    """Active sessions enriched with the latest router snapshot."""
    return J.online_enrich(t.sessions_live, t.hotspot_users, t.activity_feed, LIVE)


def _meta_values() -> str:
    def lit(v):
        return "NULL" if v is None else (str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'")
    return ",\n  ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in J.PACKAGE_METADATA)


@register("j11_metadata_lookup", f"""
with meta(name, meta_key, type, badge, icon, data_gb) as (values
  {_meta_values()}),
d as (select * from meta where meta_key = '{J.DEFAULT_METADATA_KEY}')
select p.package_id, p.package_name, coalesce(m.meta_key, d.meta_key) as meta_key,
  case when m.meta_key is not null then m.type else d.type end as type,
  case when m.meta_key is not null then m.badge else d.badge end as badge,
  case when m.meta_key is not null then m.icon else d.icon end as icon,
  case when m.meta_key is not null then m.data_gb else d.data_gb end as data_gb
from packages p left join meta m on m.name = p.package_name cross join d
""")
def j11(t):
    """Package display metadata by name, default entry for unknown names."""
    return J.metadata_lookup(t.spark, t.packages)


@register("j12_concurrent_sessions", """
with s as (select session_id, user_id, hotspot_user_id, expires_at from sessions_live
           where status = 'active' and hotspot_user_id is not null),
n as (select user_id, count(*) as n_active from s group by 1)
select s.session_id, s.user_id, s.hotspot_user_id, s.expires_at, n.n_active - 1 as n_other_active
from s join n on n.user_id = s.user_id where n.n_active > 1
""")
def j12(t):
    """Active credentialed sessions whose user holds another one."""
    return J.concurrent_sessions(t.sessions_live)


@register("j12t_overlapping_sessions", """
with w as (select session_id, user_id, started_at, expires_at,
  max(expires_at) over (partition by user_id order by started_at, session_id
                        rows between unbounded preceding and 1 preceding) as prev_max_expires
  from sessions_live)
select *, coalesce(started_at < prev_max_expires, false) as overlaps from w
""")
def j12t(t):
    """Sessions starting before the user's earlier sessions expired."""
    return J.overlapping_sessions(t.sessions_live)


@register("j13_session_exists", """
select p.payment_id, p.user_id, p.package_id,
  exists (select 1 from sessions s where s.payment_id = p.payment_id) as has_session
from payments p where p.status = 'completed'
""")
def j13(t):
    """Completed payments with or without a session (semi / anti join)."""
    return J.session_exists(t.payments, t.sessions)


_NORM = phone_normalised("raw_phone")


@register("j14_duplicate_phone", f"""
with a as (select event_id, raw_phone, {_NORM} as phone from logins),
d as (select phone, count(*) as n_attempts from a where phone is not null group by 1 having count(*) > 1)
select a.event_id, a.raw_phone, a.phone, d.n_attempts from a join d on d.phone = a.phone
""")
def j14(t):
    """Attempts whose normalised phone occurs more than once."""
    return J.duplicate_phones(t.logins)


# -- W ---------------------------------------------------------------------------------------------------------

@register("w1_current_session", f"""
with j as (select s.user_id, s.session_id, s.started_at, s.expires_at, s.data_used_mb, p.package_name, p.speed_mbps,
    p.duration_hours, py.amount_kes, cb.receipt_number, dv.ip_address
  from sessions_live s join packages p on p.package_id = s.package_id
  join payments_live py on py.payment_id = s.payment_id
  left join (select checkout_request_id, receipt_number from {FIRST_CALLBACKS} where result_code = 0) cb on cb.checkout_request_id = py.checkout_request_id
  left join session_devices dv on dv.session_id = s.session_id
  where s.status = 'active' and s.expires_at > {LIVE_SQL}),
r as (select *, row_number() over (partition by user_id order by started_at desc, session_id) as rn from j)
select user_id, session_id, started_at, expires_at, data_used_mb, package_name, speed_mbps, duration_hours,
  amount_kes, receipt_number, ip_address, {epoch_diff(LIVE_SQL, 'expires_at')} // 1000000 as seconds_remaining
from r where rn = 1
""")
def w1(t):
    """Each user's newest unexpired paid session with seconds left."""
    first = J.first_callbacks(parse_callbacks(t.callbacks))
    return W.current_session(t.sessions_live, t.packages, t.payments_live, LIVE, first, t.session_devices)


@register("w2_price_list", f"""
with p as (select package_id, package_name, duration_hours, price_kes, sort_order, {_CAT} as cat
           from packages where is_active),
b as (select package_id, package_name, duration_hours, price_kes, sort_order, 'all' as category from p
      union all select package_id, package_name, duration_hours, price_kes, sort_order, cat as category from p),
r as (select *, row_number() over (partition by category order by price_kes, sort_order, package_id) as serial,
        count(*) over (partition by category) as n_in_list from b)
select category, package_id, package_name, price_kes, duration_hours, serial, n_in_list,
  (serial - 1 = n_in_list // 2 and n_in_list > 1) as most_booked,
  {rdiv('cast(price_kes * 100 as bigint)', 'greatest(duration_hours, 1) * 100')} as price_per_hour
from r
""")
def w2(t):
    """Price list per category: serial, most-booked flag, price per hour."""
    return W.price_list(t.packages)


@register("w3_latest_plan", """
with r as (select user_id, package_id, session_id, started_at,
  row_number() over (partition by user_id order by started_at desc, session_id desc) as rn from sessions)
select r.user_id, r.package_id, p.package_name, r.session_id, r.started_at
from r left join packages p on p.package_id = r.package_id where rn = 1
""")
def w3(t):
    """Package of each user's newest session."""
    return W.latest_plan(t.sessions, t.packages)


@register("w4_first_terminal", f"select * from {FIRST_CALLBACKS}")
def w4(t):
    """First callback per checkout id wins."""
    return J.first_callbacks(parse_callbacks(t.callbacks))


# -- L ---------------------------------------------------------------------------------------------------------

@register("l1_page", f"select * from ({_J2}) x order by created_at desc, payment_id desc limit 20 offset 40")
def l1(t):
    """Page 3 (20 per page) of the transactions list, newest first."""
    return L.page(J.transactions(t.payments, t.users, t.packages),
                  [F.col("created_at").desc(), F.col("payment_id").desc()], page_no=3, limit=20)


@register("l2_history_page", """
with h as (select s.user_id, s.session_id, s.started_at, s.expires_at, s.status, s.data_used_mb, k.package_name,
    k.duration_hours, k.speed_mbps, py.amount_kes, py.created_at as payment_date
  from sessions_live s join packages k on k.package_id = s.package_id
  join payments_live py on py.payment_id = s.payment_id),
r as (select *, row_number() over (partition by user_id order by started_at desc, session_id) as rn from h),
tot as (select user_id, count(*) as total from sessions_live group by 1)
select r.*, tot.total, cast(ceil(tot.total / 10) as bigint) as pages
from r join tot on tot.user_id = r.user_id where rn <= 10
""")
def l2(t):
    """First page (10 rows) of every user's session history, with totals and page counts."""
    s, k, py = t.sessions_live, t.packages, t.payments_live
    h = (s.join(k.select("package_id", "package_name", "duration_hours", "speed_mbps"), "package_id")
         .join(py.select("payment_id", "amount_kes", F.col("created_at").alias("payment_date")), "payment_id")
         .select("user_id", "session_id", "started_at", "expires_at", "status", "data_used_mb", "package_name",
                 "duration_hours", "speed_mbps", "amount_kes", "payment_date"))
    totals = s.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return L.history_pages(h, totals, page_no=1, limit=10)


@register("l4_cheapest3", """
select package_id, package_name, price_kes, duration_hours, speed_mbps from packages where is_active
order by price_kes, package_id limit 3
""")
def l4(t):
    """The three cheapest active packages."""
    return L.cheapest(t.packages, 3)
