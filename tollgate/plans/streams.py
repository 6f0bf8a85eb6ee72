"""Registered streaming queries (S3, T1-T6) and the batch rate-limit twin.

Streaming keys run over staged files with ``availableNow`` and return their
sink; each has the SQL of its batch twin as oracle, so stream == batch is
checked value by value.
"""

from __future__ import annotations

from ..clock import LIVE
from ..operators import limits as LM
from ..streaming import callbacks as SC
from ..streaming import deadline as SD
from ..streaming import expiry as SE
from ..streaming import limits as SL
from ..streaming import ticks as ST
from . import jobs, reports  # noqa: F401  (the batch twins U5 and A8 must be registered first)
from .oracle import LIVE_SQL
from .registry import REGISTRY, register
from .sqlparts import FIRST_CALLBACKS, PARSED_CALLBACKS, phone_normalised


@register("s3_callback_source", f"select * from {PARSED_CALLBACKS}")
def s3(t):
    """Callback documents read as a file stream and parsed, drained into a file sink."""
    return SC.run_source(t.spark, t.callbacks)


@register("t1_callback_dedup", f"select * from {FIRST_CALLBACKS}")
def t1(t):
    """Streaming dedup: the first callback per checkout id wins (twin: W4)."""
    return SC.run_dedup(t.spark, t.callbacks)


def _u5_changed() -> str:
    body = REGISTRY["u5_settle_payments"].oracle
    return f"select * from ({body}) x where changed"


@register("t2_settle_stream", None)
def t2(t):
    """Streaming settlement of pending payments by their first callback (twin: U5, changed rows)."""
    return SC.run_settle(t.spark, t.callbacks, t.payments_pending, t.packages)


@register("t3_expiry_stream", f"""
select session_id, user_id, expires_at as expired_at from sessions_live
where status <> 'disconnected' and expires_at < {LIVE_SQL} and started_at <= {LIVE_SQL}""")
def t3(t):
    """Sessions expire when event time passes expires_at unless disconnected first (twin: U1)."""
    return SE.run_expiry(t.spark, t.sessions_live, LIVE)


_NORM = phone_normalised("raw_phone")
_T4B = f"""
with a as (
  select 'general' as limiter, cast(user_id as varchar) as key, ts, 900 as secs, 100 as mx from events
  union all select 'login', coalesce({_NORM}, raw_phone), ts, 900, 5 from logins
  union all select 'payment', cast(user_id as varchar), created_at, 60, 10 from payments_live),
b as (select *, make_timestamp(epoch_us(ts) - epoch_us(ts) % (secs * 1000000)) as window_start from a)
select limiter, key, window_start, window_start + to_seconds(secs) as window_end, count(*) as attempts,
  mx as max_allowed, greatest(count(*) - mx, 0) as refused
from b group by limiter, key, window_start, secs, mx"""


@register("t4_rate_limit", _T4B)
def t4(t):
    """Streaming request counts per limiter, key and window, with refusals (twin: T4b)."""
    return SL.run_rate_limit(t.spark, t.raw("events"), t.logins, t.payments_live)


@register("t4b_rate_limit_batch", _T4B)
def t4b(t):
    """Request counts per limiter, key and window over the whole tables, with refusals."""
    return LM.rate_limit_batch(t.raw("events"), t.logins, t.payments_live)


@register("t5_poll_deadline", f"""
select p.payment_id, p.checkout_request_id, p.created_at, p.created_at + interval 5 minute as deadline
from payments_live p
where p.created_at <= {LIVE_SQL} and p.created_at + interval 5 minute < {LIVE_SQL}
  and not exists (select 1 from {PARSED_CALLBACKS} c where c.checkout_request_id = p.checkout_request_id
    and c.received_at >= p.created_at and c.received_at <= p.created_at + interval 5 minute
    and c.received_at <= {LIVE_SQL})""")
def t5(t):
    """Payments with no callback within 5 minutes, from a stream-stream outer join."""
    return SD.run_deadline(t.spark, t.payments_live, t.callbacks, LIVE)


@register("t6_stats_tick", None)
def t6(t):
    """Stats row appended per trigger; returns the newest tick (twin: A8)."""
    return ST.latest_tick(ST.run_ticks(t.spark, t.sessions_live, LIVE))


def _attach_twin_oracles() -> None:
    """T2, T6 and the sink S5 reuse the SQL of their batch twins (registered in other modules)."""
    from dataclasses import replace
    REGISTRY["t2_settle_stream"] = replace(REGISTRY["t2_settle_stream"], oracle=_u5_changed())
    REGISTRY["s5_report_sink"] = replace(REGISTRY["s5_report_sink"], oracle=REGISTRY["a8_system_stats"].oracle)
    REGISTRY["t6_stats_tick"] = replace(REGISTRY["t6_stats_tick"], oracle=REGISTRY["a8_system_stats"].oracle)


_attach_twin_oracles()
