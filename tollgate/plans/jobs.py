"""Registered column jobs, quality jobs, transitions and source/sink queries (C, Q, U, S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..clock import LIVE
from ..columns import floor_div, micros_between
from ..functions import callbacks as CB
from ..functions import labels as LB
from ..functions import masking as MK
from ..functions import phones as PH
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import transitions as U
from ..sources import seeds, sinks
from .oracle import LIVE_SQL
from .registry import register
from .sqlparts import FIRST_CALLBACKS, PARSED_CALLBACKS, epoch_diff, phone_normalised, phone_shape

_NORM = phone_normalised("raw_phone")


# -- C ---------------------------------------------------------------------------------------------------------

@register("c1_normalise_phones", f"""
select event_id, raw_phone, {_NORM} as phone, {_NORM} is not null as is_valid, {phone_shape('raw_phone')} as shape
from logins""")
def c1(t):
    """Login phones normalised to 254XXXXXXXXX, with validity and typed shape."""
    return t.logins.select("event_id", "raw_phone", PH.normalise("raw_phone").alias("phone"),
                           PH.normalise("raw_phone").isNotNull().alias("is_valid"),
                           PH.shape("raw_phone").alias("shape"))


@register("c1s_phone_shapes", f"""
select {phone_shape('raw_phone')} as shape, {_NORM} is not null as is_valid, count(*) as n from logins group by all""")
def c1s(t):
    """Counts of login phones by typed shape and validity (the reject counts)."""
    return t.logins.groupBy(PH.shape("raw_phone").alias("shape"),
                            PH.normalise("raw_phone").isNotNull().alias("is_valid")).agg(F.count(F.lit(1)).alias("n"))


@register("c2_payable_phone", f"""
select case when {_NORM} is null then 'invalid' when regexp_matches({_NORM}, '^254(7|1)[0-9]{{8}}$') then 'payable'
  else 'not_mobile' end as outcome, count(*) as n from logins group by 1""")
def c2(t):
    """Normalised phones that the payment API accepts, with reject counts."""
    n = PH.normalise("raw_phone")
    out = F.when(n.isNull(), "invalid").when(PH.payable(n), "payable").otherwise("not_mobile")
    return t.logins.groupBy(out.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _censor_sql(c: str) -> str:
    return f"case when length({c}) > 6 then substr({c}, 1, 3) || '****' || right({c}, 2) else '[REDACTED]' end"


@register("c3_mask_users", f"""
select user_id, {_censor_sql('phone_number')} as phone_log_mask,
  regexp_replace(phone_number, '(.{{7}})(.{{4}})$', '\\1****') as phone_display, {_censor_sql('name')} as name_log_mask
from users""")
def c3(t):
    """Users with phones and names masked for logs and for display."""
    return t.users.select("user_id", MK.log_censor("phone_number").alias("phone_log_mask"),
                          MK.display_mask("phone_number").alias("phone_display"),
                          MK.log_censor("name").alias("name_log_mask"))


_TXT = MK.TEXT_NUMBER_PATTERN


@register("c3d_mask_documents", f"""
select doc_id, len(regexp_extract_all(text, '{_TXT}')) as n_numbers,
  regexp_replace(text, '{_TXT}', '\\1****', 'g') as masked_text
from documents""")
def c3d(t):
    """Whole documents with phone-like numbers masked (last 4 digits) and counted."""
    d = t.documents
    return d.select("doc_id", MK.count_numbers_in_text("text").cast("bigint").alias("n_numbers"),
                    MK.mask_numbers_in_text("text").alias("masked_text"))


_H = "duration_hours"
_HS = f"cast({_H} as varchar)"


@register("c4_duration_label", f"""
select package_id, {_H},
  case when {_H} < 24 then {_HS} || ' Hour' || case when {_H} > 1 then 's' else '' end
       when {_H} < 168 then cast({_H} // 24 as varchar) || ' Day' || case when {_H} // 24 > 1 then 's' else '' end
       else cast({_H} // 168 as varchar) || ' Week' || case when {_H} // 168 > 1 then 's' else '' end end
    as label_server,
  case when {_H} < 1 then cast(cast(round({_H} * 60) as bigint) as varchar) || ' min' when {_H} = 1 then '1h'
       when {_H} = 24 then '24h' when {_H} = 168 then '7 days' when {_H} = 336 then '14 days'
       when {_H} >= 720 then '30 days' when {_H} <= 12 then {_HS} || 'h'
       else cast(({_H} * 2 + 24) // 48 as varchar) || ' days' end as label_catalogue,
  case when {_H} < 1 then cast(cast(round({_H} * 60) as bigint) as varchar) || ' min' when {_H} = 24 then '24 Hours'
       when {_H} <= 12 then {_HS} || 'h' else cast(({_H} * 2 + 24) // 48 as varchar) || 'd' end as label_card,
  case when {_H} < 24 then {_HS} || ' Hour' || case when {_H} > 1 then 's' else '' end
       else case when {_H} % 24 = 0 then cast({_H} // 24 as varchar) else cast({_H} / 24.0 as varchar) end
            || ' Day' || case when {_H} > 24 then 's' else '' end end as label_history,
  case when {_H} < 1 then 'min' when {_H} < 24 then 'h' when {_H} < 168 then 'days' else 'weeks' end as tier
from packages""")
def c4(t):
    """Duration labels per package in the four display variants, plus the unit tier."""
    h = "duration_hours"
    return t.packages.select("package_id", h, LB.duration_label_server(h).alias("label_server"),
                             LB.duration_label_catalogue(h).alias("label_catalogue"),
                             LB.duration_label_card(h).alias("label_card"),
                             LB.duration_label_history(h).alias("label_history"), LB.duration_tier(h).alias("tier"))


@register("c5_speed_band", """
select case when speed_mbps >= 25 then 5 when speed_mbps >= 15 then 4 when speed_mbps >= 10 then 3
            when speed_mbps >= 5 then 2 else 1 end as band, count(*) as n_packages
from packages where is_active group by 1""")
def c5(t):
    """Signal-bar band per active package, counted per band."""
    return t.packages.where(F.col("is_active")).groupBy(LB.speed_band("speed_mbps").alias("band")) \
        .agg(F.count(F.lit(1)).alias("n_packages"))


def _two_sql(x: str) -> str:
    return f"case when {x} < 10 then '0' || cast({x} as varchar) else cast({x} as varchar) end"


_SL = "x.secs_left"


@register("c6_countdown", f"""
with x as (select s.session_id, greatest({epoch_diff(LIVE_SQL, 's.expires_at')}, 0) // 1000000 as secs_left,
             p.duration_hours from sessions_live s join packages p on p.package_id = s.package_id
           where s.status = 'active')
select x.session_id, {_SL},
  case when {_SL} <= 0 then '00:00:00' else {_two_sql(f'{_SL} // 3600')} || ':' || {_two_sql(f'({_SL} % 3600) // 60')}
    || ':' || {_two_sql(f'{_SL} % 60')} end as countdown,
  case when {_SL} > 3600 then cast({_SL} // 3600 as varchar) || 'h ' || cast(({_SL} % 3600) // 60 as varchar)
    || 'm remaining' else cast({_SL} // 60 as varchar) || 'm remaining' end as time_label,
  {_SL} < 1800 as warn_30min, {_SL} * 5 < cast(x.duration_hours as bigint) * 3600 as low_pct
from x""")
def c6(t):
    """Countdown text, time label, 30-minute warning and low-percent flag per active session."""
    now = LIVE
    from ..clock import at
    s = t.sessions_live.where(F.col("status") == "active").join(
        t.packages.select("package_id", "duration_hours"), "package_id")
    left = floor_div(F.greatest(micros_between(at(now), "expires_at"), F.lit(0)), 1_000_000)
    s = s.select("session_id", left.alias("secs_left"), "duration_hours")
    return s.select("session_id", "secs_left", LB.countdown("secs_left").alias("countdown"),
                    LB.time_label("secs_left").alias("time_label"), (F.col("secs_left") < 1800).alias("warn_30min"),
                    (F.col("secs_left") * 5 < F.col("duration_hours").cast("bigint") * 3600).alias("low_pct"))


@register("c7_money_date_labels", """
with c as (select *, cast(amount_kes * 100 as bigint) as cents from payments_live)
select payment_id, 'KES ' || format('{:,}', cents // 100) || case when cents % 100 = 0 then ''
    when cents % 10 = 0 then '.' || cast(cents % 100 // 10 as varchar) else '.' || lpad(cast(cents % 100 as varchar), 2, '0') end
    as amount_label,
  strftime(created_at, '%d %b %Y, %H:%M') as date_label
from c""")
def c7(t):
    """Amount and date display text per payment (KES grouping; '20 Jan 2024, 14:05')."""
    return t.payments_live.select("payment_id", LB.kes_label("amount_kes").alias("amount_label"),
                                  LB.date_label("created_at").alias("date_label"))


@register("c8_callback_extract", f"select * from {PARSED_CALLBACKS}")
def c8(t):
    """Callback documents parsed: fields and metadata items pivoted to columns."""
    return CB.parse_callbacks(t.callbacks)


@register("c9_pay_amount", """
select payment_id, cast(ceil(amount_kes) as bigint) as stk_amount,
  strftime(created_at + interval 3 hour, '%Y%m%d%H%M%S') as timestamp14
from payments_live""")
def c9(t):
    """Whole-unit request amount and the 14-digit UTC+3 request timestamp per payment."""
    return t.payments_live.select("payment_id", LB.stk_amount("amount_kes").alias("stk_amount"),
                                  LB.eat_timestamp14("created_at").alias("timestamp14"))


_CODES = ", ".join(str(c) for c in CB.FAILURE_CODES)


@register("c10_settle_class", f"""
select result_code,
  case when result_code = 0 then 'completed' when result_code in ({_CODES}) then 'failed' else 'pending' end
    as poll_outcome,
  case when result_code = 0 then 'completed' else 'failed' end as callback_outcome, count(*) as n
from {PARSED_CALLBACKS} c group by all""")
def c10(t):
    """Callback result codes classified by both settlement paths, counted."""
    p = CB.parse_callbacks(t.callbacks)
    return p.groupBy("result_code", CB.poll_outcome("result_code").alias("poll_outcome"),
                     CB.callback_outcome("result_code").alias("callback_outcome")).agg(F.count(F.lit(1)).alias("n"))


@register("c11_upload_limit", """
select s.session_id, p.speed_mbps as download_mbps, cast(p.speed_mbps / 2 as decimal(10,1)) as upload_mbps,
  p.speed_mbps * 1024 as down_kbps, p.speed_mbps * 512 as up_kbps
from sessions_live s join packages p on p.package_id = s.package_id where s.status = 'active'""")
def c11(t):
    """Per active session: download/upload limits (upload = half) in Mbps and kbps."""
    s = t.sessions_live.where(F.col("status") == "active").join(t.packages.select("package_id", "speed_mbps"),
                                                                "package_id")
    sp = F.col("speed_mbps")
    return s.select("session_id", sp.alias("download_mbps"), (sp / 2).cast("decimal(10,1)").alias("upload_mbps"),
                    (sp * 1024).alias("down_kbps"), (sp * 512).alias("up_kbps"))


@register("c12_hotspot_username", """
select event_id, raw_phone, right(regexp_replace(raw_phone, '[^0-9]', '', 'g'), 12) as username from logins""")
def c12(t):
    """Hotspot username (last 12 digits) for each typed phone."""
    return t.logins.select("event_id", "raw_phone", PH.hotspot_username("raw_phone").alias("username"))


# -- Q ---------------------------------------------------------------------------------------------------------

_FKS = [  # name, rule, child, column, parent, column
    ("payments.user_id", "RESTRICT", "payments", "user_id", "users", "user_id"),
    ("payments.package_id", "RESTRICT", "payments", "package_id", "packages", "package_id"),
    ("payments_live.user_id", "RESTRICT", "payments_live", "user_id", "users", "user_id"),
    ("payments_live.package_id", "RESTRICT", "payments_live", "package_id", "packages", "package_id"),
    ("sessions.user_id", "RESTRICT", "sessions", "user_id", "users", "user_id"),
    ("sessions.payment_id", "RESTRICT", "sessions", "payment_id", "payments", "payment_id"),
    ("sessions.hotspot_user_id", "SET NULL", "sessions", "hotspot_user_id", "hotspot_users", "hotspot_user_id"),
    ("sessions_live.user_id", "RESTRICT", "sessions_live", "user_id", "users", "user_id"),
    ("sessions_live.hotspot_user_id", "SET NULL", "sessions_live", "hotspot_user_id", "hotspot_users",
     "hotspot_user_id"),
    ("bandwidth_logs.session_id", "CASCADE", "bandwidth_logs", "session_id", "sessions", "session_id"),
    ("bandwidth_logs.user_id", "CASCADE", "bandwidth_logs", "user_id", "users", "user_id"),
]


@register("q1_orphan_keys", "\nunion all\n".join(
    f"select '{n}' as fk, '{r}' as on_delete, c.{cc} as missing_key, count(*) as n_rows from {ct} c "
    f"where c.{cc} is not null and not exists (select 1 from {pt} p where p.{pc} = c.{cc}) group by c.{cc}"
    for n, r, ct, cc, pt, pc in _FKS))
def q1(t):
    """Per foreign key: missing parent keys with the number of child rows and the delete rule."""
    return Q.orphan_keys([(n, r, getattr(t, ct), cc, getattr(t, pt), pc) for n, r, ct, cc, pt, pc in _FKS])


_UNIQUES = [("users.phone_number", "users", "phone_number"),
            ("payments.checkout_request_id", "payments", "checkout_request_id"),
            ("payments_live.checkout_request_id", "payments_live", "checkout_request_id"),
            ("sessions.payment_id", "sessions", "payment_id"),
            ("sessions_live.payment_id", "sessions_live", "payment_id"),
            ("hotspot_users.username", "hotspot_users", "username")]


@register("q2_duplicate_keys", "\nunion all\n".join(
    f"select '{n}' as constraint, cast({c} as varchar) as key_value, count(*) as n from {tb} "
    f"where {c} is not null group by {c} having count(*) > 1" for n, tb, c in _UNIQUES))
def q2(t):
    """Values of UNIQUE columns that occur more than once."""
    return Q.duplicate_keys([(n, getattr(t, tb), c) for n, tb, c in _UNIQUES])


def _check_sql(table: str, checks: dict[str, str]) -> str:
    return "\nunion all\n".join(
        f"select '{table}' as table_name, '{n}' as check_name, count(*) as n_checked, "
        f"count(*) filter (where not coalesce({cond}, false)) as n_violations from {table}"
        for n, cond in checks.items())


@register("q3_domain_checks", "\nunion all\n".join([
    _check_sql("users", {"role_enum": "role in ('user', 'admin')"}),
    _check_sql("packages", {"duration_positive": "duration_hours > 0", "price_positive": "price_kes > 0",
                            "speed_positive": "speed_mbps > 0"}),
    _check_sql("payments", {"status_enum": "status in ('pending', 'completed', 'failed', 'cancelled')"}),
    _check_sql("sessions", {"status_enum": "status in ('active', 'expired', 'paused', 'disconnected')"}),
    _check_sql("bandwidth_logs", {"valid_period": "period_end > period_start"})]))
def q3(t):
    """Enum, positivity and period checks with violation counts."""
    return Q.domain_checks(t.users, t.packages, t.payments, t.sessions, t.bandwidth_logs)


@register("q4_input_rules", "\nunion all\n".join([
    _check_sql("packages", {"duration_int_ge_1": "duration_hours >= 1", "price_ge_1": "price_kes >= 1",
                            "speed_int_ge_1": "speed_mbps >= 1", "name_not_empty": "length(trim(package_name)) > 0"}),
    _check_sql("users", {"name_len_le_100": "length(trim(name)) <= 100"}),
    _check_sql("logins", {"phone_valid": f"{_NORM} is not null"}),
    _check_sql("path_ids", {"uuid_shape": f"regexp_full_match(path_id, '{Q.UUID_SHAPE[1:-1]}')"})]))
def q4(t):
    """Request-validation rules over whole tables, failures per rule."""
    return Q.input_rules(t.packages, t.users, t.logins, t.path_ids)


# -- U ---------------------------------------------------------------------------------------------------------

_S_COLS = ("session_id, user_id, package_id, payment_id, hotspot_user_id, started_at, expires_at, status, ended_at, "
           "bytes_downloaded, bytes_uploaded, data_used_mb")
_S_KEEP = "session_id, user_id, package_id, payment_id, hotspot_user_id, started_at, expires_at"
_S_TAIL = "bytes_downloaded, bytes_uploaded, data_used_mb"


@register("u1_expire_sessions", f"""
select {_S_KEEP}, case when d then 'expired' else status end as status, case when d then {LIVE_SQL} else ended_at end
  as ended_at, {_S_TAIL}, d as changed
from (select *, status = 'active' and expires_at <= {LIVE_SQL} as d from sessions_live)""")
def u1(t):
    """Due active sessions become expired with ended_at = now."""
    return U.expire_sessions(t.sessions_live, LIVE)


@register("u2_disconnect", """
with req as (select user_id, max(requested_at) as requested_at from disconnect_requests group by 1),
fo as (select user_id, session_id from (select *, row_number() over (partition by user_id order by started_at,
  session_id) as rn from sessions_live where status = 'active') where rn = 1),
tg as (select session_id, max(requested_at) as requested_at from (
  select fo.session_id, req.requested_at from fo join req on req.user_id = fo.user_id
  union all select session_id, requested_at from admin_disconnects) group by 1)
select s.session_id, s.user_id, s.package_id, s.payment_id, s.hotspot_user_id, s.started_at, s.expires_at,
  case when tg.requested_at is not null then 'disconnected' else s.status end as status,
  case when tg.requested_at is not null then tg.requested_at else s.ended_at end as ended_at,
  s.bytes_downloaded, s.bytes_uploaded, s.data_used_mb, tg.requested_at is not null as changed
from sessions_live s left join tg on tg.session_id = s.session_id""")
def u2(t):
    """Disconnect requests: each requesting user's first open session, and sessions named by admins."""
    return U.disconnect(t.sessions_live, t.disconnect_requests, t.admin_disconnects)


@register("u3_open_sessions", f"""
select {_S_COLS} from sessions_live
union all
select -p.payment_id as session_id, p.user_id, p.package_id, p.payment_id, cast(null as bigint) as hotspot_user_id,
  {LIVE_SQL} as started_at, {LIVE_SQL} + interval 1 hour * k.duration_hours as expires_at, 'active' as status,
  cast(null as timestamp) as ended_at, cast(0 as bigint) as bytes_downloaded, cast(0 as bigint) as bytes_uploaded,
  cast(0 as decimal(12,2)) as data_used_mb
from payments_live p join packages k on k.package_id = p.package_id
where p.status = 'completed' and p.updated_at <= {LIVE_SQL}
  and not exists (select 1 from sessions_live s where s.payment_id = p.payment_id)""")
def u3(t):
    """Completed payments without a session get one (idempotent by payment)."""
    return U.open_sessions(t.sessions_live, t.payments_live, t.packages, LIVE)


_PF = U.PACKAGE_FIELDS
_U4 = (f"select k.package_id, " + ", ".join(f"coalesce(x.{c}, k.{c}) as {c}" for c in _PF) +
       f", case when x.package_id is not null then {LIVE_SQL} end as updated_at from packages k left join package_patches x on x.package_id = k.package_id")


@register("u4_patch_packages", _U4)
def u4(t):
    """Catalogue patches: non-null fields overwrite, patched rows stamped."""
    return U.patch_packages(t.packages, t.package_patches, LIVE)


@register("u5_settle_payments", f"""
with j as (select p.*, c.result_code, c.result_desc, c.receipt_number, c.transaction_date, c.amount_kes as cb_amount,
  c.received_at, p.status not in ('completed', 'failed') and c.checkout_request_id is not null as o
  from payments_pending p left join {FIRST_CALLBACKS} c on c.checkout_request_id = p.checkout_request_id)
select payment_id, user_id, package_id, checkout_request_id,
  case when o and result_code = 0 then coalesce(cb_amount, amount_kes) else amount_kes end as amount_kes,
  case when o and result_code = 0 then 'completed' when o then 'failed' else status end as status,
  case when o and result_code = 0 then receipt_number end as receipt_number,
  case when o and result_code = 0 then transaction_date end as transaction_date,
  case when o and result_code <> 0 then result_desc end as failure_reason,
  created_at, case when o then received_at else updated_at end as updated_at, o as changed
from j""")
def u5(t):
    """Payments settled by their first callback (completed or failed), settled ones untouched."""
    return U.settle_payments(t.payments_pending, J.first_callbacks(CB.parse_callbacks(t.callbacks)))


@register("u6_touch_timestamp", f"""
with n as ({_U4})
select n.package_id, {', '.join('n.' + c for c in _PF)},
  case when {' or '.join(f'n.{c} is distinct from k.{c}' for c in _PF)} then {LIVE_SQL} end as updated_at,
  ({' or '.join(f'n.{c} is distinct from k.{c}' for c in _PF)}) as changed
from n left join packages k on k.package_id = n.package_id""")
def u6(t):
    """Rows whose values really changed get a new updated_at (null-safe compare)."""
    new = U.patch_packages(t.packages, t.package_patches, LIVE).drop("updated_at")
    return U.touch_changed(t.packages, new, "package_id", _PF, LIVE)


def _pairs(side: str) -> str:
    """JSON object text of a list of (k, o, n) entries, one side's values as strings."""
    return "'{' || array_to_string(list_transform(d, lambda e: '\"' || e.k || '\":\"' || e." + side + " || '\"'), ',') || '}'"


_ENTRIES = ", ".join(f"struct_pack(k := '{c}', o := cast(k.{c} as varchar), n := cast(coalesce(p.{c}, k.{c}) as varchar))" for c in _PF)


@register("u7_audit_diff", f"""
with e as (select k.package_id, list_filter([{_ENTRIES}], lambda e: e.o is distinct from e.n) as d
  from packages k join package_patches p on p.package_id = k.package_id)
select 'update' as action, 'package' as target_type, package_id as target_id, {_pairs('o')} as old_values,
  {_pairs('n')} as new_values, {LIVE_SQL} as created_at
from e where len(d) > 0""")
def u7(t):
    """Audit rows with old and new values (JSON) of each changed package."""
    new = U.patch_packages(t.packages, t.package_patches, LIVE)
    return U.audit_diff(t.packages, new, "package_id", _PF, "package", LIVE)


@register("u8_last_login", f"""
with l as (select {_NORM} as phone_number, ts from logins),
m as (select phone_number, max(ts) as last_login_at from l where phone_number is not null group by 1)
select u.*, m.last_login_at from users u left join m on m.phone_number = u.phone_number""")
def u8(t):
    """Users with their newest login time (phones normalised first)."""
    return U.last_login(t.users, t.logins)


_J5 = """select user_id, package_id, payment_id, updated_at, active_session_id from (
  select *, row_number() over (partition by user_id, package_id order by updated_at desc, payment_id desc) as rn
  from (select p.payment_id, p.user_id, p.package_id, p.updated_at, s.session_id as active_session_id
    from payments p left join sessions s on s.payment_id = p.payment_id
    where p.status = 'completed' and (s.session_id is null or (s.status = 'active' and s.hotspot_user_id is null))))
  where rn = 1"""


@register("u9_attach_credentials", f"""
with elig as ({_J5}),
acct as (select u.user_id, coalesce(h.hotspot_user_id, -u.user_id) as hid,
  right(regexp_replace(u.phone_number, '[^0-9]', '', 'g'), 12) as hotspot_username
  from users u left join hotspot_users h on h.phone_number = u.phone_number),
e as (select active_session_id as session_id from elig where active_session_id is not null),
j as (select s.*, (e.session_id is not null and s.hotspot_user_id is null and s.status = 'active') as hit, acct.hid,
  acct.hotspot_username as hu, k.speed_mbps
  from sessions s left join e on e.session_id = s.session_id left join acct on acct.user_id = s.user_id
  left join packages k on k.package_id = s.package_id)
select session_id, user_id, package_id, payment_id, case when hit then hid else hotspot_user_id end as hotspot_user_id,
  started_at, expires_at, status, ended_at, bytes_downloaded, bytes_uploaded, data_used_mb,
  case when hit then hu end as hotspot_username, case when hit then speed_mbps end as downlink_mbps,
  case when hit then cast(speed_mbps / 2 as decimal(10,1)) end as uplink_mbps, hit as changed
from j""")
def u9(t):
    """Eligible sessions get hotspot credentials (account, username, speed limits)."""
    elig = J.unused_payments(t.payments, t.sessions)
    return U.attach_credentials(t.sessions, elig, t.hotspot_users, t.users, t.packages)


@register("u10_open_payments", """
select r.request_id, r.user_id, r.package_id, r.phone_number, k.price_kes as amount_kes,
  case when k.price_kes is not null then 'pending' else 'rejected' end as status,
  case when k.price_kes is null then 'Package not found or inactive.' end as failure_reason, r.requested_at
from purchase_requests r left join (select package_id, price_kes from packages where is_active) k
  on k.package_id = r.package_id""")
def u10(t):
    """Purchase requests priced as pending payments, or rejected."""
    return U.open_payments(t.purchase_requests, t.packages)


# -- S ---------------------------------------------------------------------------------------------------------

_S1 = ["users", "packages", "payments", "payments_live", "sessions", "sessions_live", "hotspot_users",
       "bandwidth_logs", "callbacks", "logins"]


def _s1(name: str):
    def fn(t):
        return getattr(t, name)
    fn.__doc__ = f"Scan: the {name} table mapped from the driver parquet files."
    return fn


for _name in _S1:
    register(f"s1_scan_{_name}", f"select * from {_name}")(_s1(_name))


@register("s4_activity_feed", """
select polled_at, "user", address, coalesce(try_cast(bytes_in as bigint), 0) as bytes_in,
  coalesce(try_cast(bytes_out as bigint), 0) as bytes_out, uptime
from activity_feed where "user" is not null""")
def s4(t):
    """Router feed rows with blank counters as 0 and rows without a user dropped."""
    return J.clean_feed(t.activity_feed)


@register("s5_report_sink")
def s5(t):
    """The stats row appended to a parquet table in the shared folder, read back."""
    from ..operators.aggregates import system_stats
    return sinks.append_and_read(t.spark, system_stats(t.sessions_live, LIVE), "system_stats")


@register("s6_seed_users", f"""
with s(seed_ord, phone_number, name, role) as (values {', '.join(f"({i + 1}, '{p}', '{n}', '{r}')"
                                                  for i, (p, n, r) in enumerate(seeds.SEED_USERS))})
select * from users
union all
select -seed_ord as user_id, phone_number, name, role, true as is_active, {LIVE_SQL} as created_at from s
where not exists (select 1 from users u where u.phone_number = s.phone_number)""")
def s6u(t):
    """Seed accounts inserted where their phone is absent."""
    return seeds.seed_users(t.spark, t.users, LIVE)


@register("s6_seed_packages", f"""
with s(seed_ord, package_name, hours, price, speed_mbps, sort_order) as (values {', '.join(
    f"({i + 1}, '{n}', {float(h)}, {float(p)}, {sp}, {so})" for i, (n, h, p, sp, so) in enumerate(seeds.SEED_PACKAGES))})
select * from packages
union all
select -seed_ord as package_id, package_name, cast(round(hours) as integer) as duration_hours,
  cast(price as decimal(10,2)) as price_kes, speed_mbps, true as is_active, cast(sort_order as bigint) as sort_order
from s where not exists (select 1 from packages k where k.package_name = s.package_name)""")
def s6p(t):
    """Seed catalogue inserted where the package name is absent (0.5 h rounds to 1)."""
    return seeds.seed_packages(t.spark, t.packages)
