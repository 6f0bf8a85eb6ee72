"""DuckDB twins of the fixture mapping, inlined as CTEs into oracle SQL.

The oracle engine sees only the raw driver tables, so every oracle query is
prefixed with the CTEs it references (and their dependencies), in order.
"""

from __future__ import annotations

import re

LONG_SQL = "TIMESTAMP '2000-01-01 12:00:00'"
LIVE_SQL = "TIMESTAMP '2024-01-20 12:00:00'"

_SESSIONS = """
select session_id, user_id, package_id, payment_id, hotspot_user_id, started_at, expires_at, status,
  case when status = 'disconnected' then started_at + interval '1' minute * (duration_hours * 30)
       when status = 'expired' then expires_at end as ended_at,
  bytes_downloaded, bytes_uploaded,
  cast(cast(bytes_downloaded + bytes_uploaded as decimal(20,2)) / 1048576 as decimal(12,2)) as data_used_mb
from (
  select p.payment_id as session_id, p.user_id, p.package_id,
    case when p.payment_id % 29 = 0 then null else p.payment_id end as payment_id,
    case when p.payment_id % 4 = 0 then null else p.user_id end as hotspot_user_id,
    p.updated_at as started_at, p.updated_at + interval '1' hour * k.duration_hours as expires_at, k.duration_hours,
    case when p.payment_id % 11 = 0 then 'disconnected'
         when p.payment_id % 3 = 0 and p.updated_at + interval '1' hour * k.duration_hours <= @CLOCK then 'expired'
         else 'active' end as status,
    cast(floor(p.amount_kes * 100) as bigint) * 10486 as bytes_downloaded,
    cast(floor(p.amount_kes * 100) as bigint) * 2621 as bytes_uploaded
  from @PAYMENTS p join packages k on k.package_id = p.package_id
  where p.status = 'completed' and p.payment_id % 13 <> 0 and p.updated_at <= @CLOCK
) b
"""

# name -> (sql, dependencies); order of this dict is a valid definition order.
FIXTURE_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "users": ("""
select c_custkey as user_id, '2547' || lpad(cast(c_custkey as string), 8, '0') as phone_number, c_name as name,
  case when c_custkey % 50 = 0 then 'admin' else 'user' end as role, c_acctbal >= 0 as is_active,
  timestamp '1995-01-01 00:00:00' + interval '1' hour * c_custkey as created_at
from customer""", ()),
    "packages": ("""
select p_partkey as package_id, p_name as package_name,
  case when p_size <= 4 then p_size when p_size <= 6 then 12 when p_size <= 15 then 24
       when p_size <= 25 then 168 when p_size <= 35 then 336 else 720 end as duration_hours,
  cast(p_retailprice as decimal(10,2)) as price_kes, cast(replace(p_brand, 'Brand#', '') as int) as speed_mbps,
  p_type <> 'SMALL' as is_active, p_partkey % 10 as sort_order
from part""", ()),
    "payments": ("""
select o.o_orderkey as payment_id, o.o_custkey as user_id, l.package_id,
  cast(o.o_totalprice as decimal(10,2)) as amount_kes,
  case when o.o_orderstatus = 'F' then 'completed' when o.o_orderstatus = 'O' then 'pending'
       when o.o_orderpriority = '5-LOW' then 'cancelled' else 'failed' end as status,
  'ws_CO_' || cast(o.o_orderkey as string) as checkout_request_id,
  o.o_orderdate + interval '1' second * ((o.o_orderkey * 7919) % 86400) as created_at,
  o.o_orderdate + interval '1' second * ((o.o_orderkey * 7919) % 86400 + o.o_orderkey % 3600) as updated_at
from orders o join (select l_orderkey, min(l_partkey) as package_id from lineitem group by l_orderkey) l
  on l.l_orderkey = o.o_orderkey""", ()),
    "payments_live": ("""
select event_id as payment_id, user_id, event_id % 200 as package_id,
  cast(value as decimal(10,2)) as amount_kes,
  case event_type when 'purchase' then 'completed' when 'error' then 'failed' else 'pending' end as status,
  'ws_CO_' || cast(event_id as string) as checkout_request_id,
  ts as created_at, ts + interval '1' second * (event_id % 600) as updated_at
from events where event_type in ('purchase', 'error', 'signup')""", ()),
    "sessions": (_SESSIONS.replace("@CLOCK", LONG_SQL).replace("@PAYMENTS", "payments"),
                 ("payments", "packages")),
    "sessions_live": (_SESSIONS.replace("@CLOCK", LIVE_SQL).replace("@PAYMENTS", "payments_live"),
                      ("payments_live", "packages")),
    "hotspot_users": ("""
select user_id as hotspot_user_id, phone_number, phone_number as username from users where user_id % 5 <> 0""",
                      ("users",)),
    "bandwidth_logs": ("""
select l.l_orderkey as session_id, o.o_custkey as user_id,
  cast(l.l_quantity as bigint) * 1048576 as bytes_downloaded, cast(l.l_quantity as bigint) * 262144 as bytes_uploaded,
  cast(l.l_quantity as bigint) * 1000 as packets_in, cast(l.l_quantity as bigint) * 250 as packets_out,
  l.l_shipdate + interval '1' minute * (l.l_linenumber * 10) as period_start,
  l.l_shipdate + interval '1' minute * (l.l_linenumber * 10 + 10) as period_end
from lineitem l join orders o on o.o_orderkey = l.l_orderkey""", ()),
    "callbacks": ("""
select event_id, ts + interval '1' second * (60 * d.n) as received_at,
  '{"Body":{"stkCallback":{"CheckoutRequestID":"ws_CO_' || cast(event_id as string) || '","ResultCode":' ||
  case when event_type = 'purchase' then '0' else '1032' end ||
  ',"ResultDesc":"r","CallbackMetadata":{"Item":[{"Name":"Amount","Value":' ||
  cast(cast(value as decimal(10,2)) as string) || '},{"Name":"MpesaReceiptNumber","Value":"R' ||
  cast(event_id as string) || '"}]}}}}' as body
from events join (select 0 as n union all select 1 as n) d on d.n = 0 or event_id % 10 = 0
where event_type in ('purchase', 'error')""", ()),
    "callback_deliveries": ("""
select event_id, received_at, case event_id % 40 when 1 then substr(body, 1, 30) when 2 then '{"unexpected":true}'
  when 3 then regexp_replace(body, '"Value":[0-9.-]+', '"Value":"n/a"')
  when 4 then regexp_replace(body, '"Value":[0-9.-]+', '"Value":123456789012.5')
  when 5 then regexp_replace(body, '"ResultCode":[0-9]+', '"ResultCode":"zero"')
  when 6 then regexp_replace(body, '"Value":[0-9.-]+', '"Value":""') else body end as body
from callbacks""", ("callbacks",)),
    "poll_results": ("""
select 'ws_CO_' || cast(event_id as string) as checkout_request_id,
  cast(case event_id % 5 when 0 then 0 when 1 then 1032 when 2 then 4999 end as bigint) as result_code,
  case event_id % 5 when 1 then 'Request cancelled by user' when 2 then 'In progress' end as result_desc,
  ts + interval 20 second as polled_at
from events where event_type = 'signup' and event_id % 5 <> 4""", ()),
    "package_requests": ("""
select p_partkey as request_id, case when p_partkey % 21 = 0 then ' ' else p_name end as package_name,
  case when p_partkey % 15 = 0 then '0.5' when p_partkey % 33 = 0 then 'a day' else cast(p_size as string) end as duration_hours,
  case when p_partkey % 12 = 0 then '0.99' else cast(cast(p_retailprice as decimal(10,2)) as string) end as price_kes,
  case when p_partkey % 27 <> 0 then cast(p_partkey % 40 as string) end as speed_mbps,
  case when p_partkey % 9 <> 0 then p_partkey % 10 end as sort_order
from part where p_partkey % 3 = 0""", ()),
    "session_devices": ("""
select event_id as session_id, '10.5.' || cast(user_id % 256 as string) || '.' || cast(event_id % 256 as string) as ip_address,
  case when event_id % 7 <> 0 then '02:00:5e:' || substr(h, 1, 2) || ':' || substr(h, 3, 2) || ':' || substr(h, 5, 2) end as mac_address
from (select *, lpad(lower(to_hex(event_id)), 6, '0') as h from events where event_type = 'purchase' and event_id % 6 <> 0)""", ()),
    "start_requests": ("""
select event_id * 2 + d.n as request_id, case when event_id % 8 = 0 then user_id + 1 else user_id end as user_id,
  event_id as payment_id, '10.5.0.' || cast(event_id % 256 as string) as ip_address, ts + interval 1 minute * (10 + d.n) as requested_at
from events join (select 0 as n union all select 1 as n) d on d.n = 0 or event_id % 5 = 0
where event_type in ('purchase', 'error')""", ()),
    "path_ids": ("""
select event_id, case event_id % 10 when 0 then cast(event_id as string) when 1 then substr(u, 1, 30) when 2 then upper(u) else u end as path_id
from (select event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) as u
  from (select event_id, md5(cast(event_id as string)) as h from events where event_type = 'click'))""", ()),
    "logins": ("""
select event_id, ts, case event_id % 5
  when 0 then '07' || lpad(cast(user_id as string), 8, '0')
  when 1 then '+254 7' || lpad(cast(user_id as string), 8, '0')
  when 2 then '7' || lpad(cast(user_id as string), 8, '0')
  when 3 then '2547' || lpad(cast(user_id as string), 8, '0')
  else '99' || cast(user_id as string) end as raw_phone
from events where event_type in ('click', 'view')""", ()),
    "activity_feed": ("""
select make_timestamp((epoch_us(ts) // 21600000000 + 1) * 21600000000) as polled_at,
  case when event_id % 17 = 0 then null else '2547' || lpad(cast(user_id as string), 8, '0') end as "user",
  '10.5.' || cast(user_id % 256 as string) || '.' || cast(event_id % 256 as string) as address,
  case when event_id % 7 = 0 then '' else cast(cast(floor(value * 1000) as bigint) as string) end as bytes_in,
  case when event_id % 11 = 0 then null else cast(event_id * 13 as string) end as bytes_out,
  lpad(cast(event_id % 24 as string), 2, '0') || ':00:00' as uptime
from events where event_type = 'view'""", ()),
    "disconnect_requests": (f"""
select user_id, ts as requested_at from events
where event_type = 'click' and ts <= {LIVE_SQL}""", ()),
    "admin_disconnects": (f"""
select event_id as session_id, ts + interval 30 minute as requested_at from events
where event_type = 'purchase' and value >= 150 and ts <= {LIVE_SQL} - interval 30 minute""",
                          ()),
    "package_patches": ("""
select p_partkey as package_id, cast(null as varchar) as package_name, cast(null as integer) as duration_hours,
  cast(p_retailprice + 1 as decimal(10,2)) as price_kes, case when p_size % 2 = 1 then p_size end as speed_mbps,
  case when p_partkey % 14 = 0 then false end as is_active, case when p_partkey % 3 = 0 then 99 end as sort_order
from part where p_partkey % 7 = 0""", ()),
    "payments_pending": ("""
select * replace (case when payment_id % 4 <> 0 and status in ('completed', 'failed') then 'pending'
                       else status end as status)
from payments_live""", ("payments_live",)),
    "purchase_requests": ("""
select event_id as request_id, user_id, event_id % 250 as package_id,
  '2547' || lpad(cast(user_id as string), 8, '0') as phone_number, ts as requested_at
from events where event_type = 'click'""", ()),
}


def _needed(sql: str) -> list[str]:
    seen: list[str] = []

    def visit(name: str) -> None:
        if name in seen:
            return
        for dep in FIXTURE_CTES[name][1]:
            visit(dep)
        seen.append(name)

    for name in FIXTURE_CTES:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    order = list(FIXTURE_CTES)
    return sorted(seen, key=order.index)


def with_fixtures(sql: str) -> str:
    """Prefix ``sql`` with the fixture CTEs it uses.

    ``sql`` may itself start with ``WITH``; its CTEs are appended after ours.
    """
    body = sql.strip()
    names = _needed(body)
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS ({FIXTURE_CTES[n][0].strip()})" for n in names)
    if body[:4].lower() == "with":
        return f"WITH {ctes},\n{body[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
