"""DuckDB snippets shared by several oracle queries."""

from __future__ import annotations

from .oracle import LIVE_SQL


def epoch_diff(a: str, b: str) -> str:
    """b - a in microseconds."""
    return f"(epoch_us({b}) - epoch_us({a}))"


def secs(a: str, b: str) -> str:
    return f"trunc({epoch_diff(a, b)} / 1000000)::bigint"


def stripped(raw: str) -> str:
    return f"regexp_replace(regexp_replace({raw}, '[\\s\\-()]', '', 'g'), '^\\+', '')"


def phone_candidate(raw: str) -> str:
    st = stripped(raw)
    return (f"(case when starts_with({st}, '07') or starts_with({st}, '01') then '254' || substr({st}, 2) "
            f"when length({st}) = 9 and (starts_with({st}, '7') or starts_with({st}, '1')) then '254' || {st} "
            f"else {st} end)")


def phone_normalised(raw: str) -> str:
    c = phone_candidate(raw)
    return f"(case when regexp_matches({c}, '^254[0-9]{{9}}$') then {c} end)"


def phone_shape(raw: str) -> str:
    st = stripped(raw)
    return (f"(case when starts_with({st}, '07') or starts_with({st}, '01') then 'local' "
            f"when length({st}) = 9 and (starts_with({st}, '7') or starts_with({st}, '1')) then 'short' "
            f"when starts_with({st}, '254') then 'international' else 'other' end)")


def _item(name: str) -> str:
    arr = "cast(json_extract(body, '$.Body.stkCallback.CallbackMetadata.Item') as json[])"
    return (f"json_extract_string(list_filter({arr}, lambda x: json_extract_string(x, '$.Name') = '{name}')[1], "
            f"'$.Value')")


PARSED_CALLBACKS = f"""(select event_id, received_at,
  json_extract_string(body, '$.Body.stkCallback.CheckoutRequestID') as checkout_request_id,
  cast(json_extract(body, '$.Body.stkCallback.ResultCode') as bigint) as result_code,
  json_extract_string(body, '$.Body.stkCallback.ResultDesc') as result_desc,
  cast({_item('Amount')} as decimal(10,2)) as amount_kes,
  {_item('MpesaReceiptNumber')} as receipt_number,
  {_item('TransactionDate')} as transaction_date,
  {_item('PhoneNumber')} as phone_number
from callbacks where json_extract(body, '$.Body.stkCallback') is not null)"""

FIRST_CALLBACKS = f"""(select * exclude (rn) from (select *, row_number() over
  (partition by checkout_request_id order by received_at, event_id) as rn from {PARSED_CALLBACKS}) where rn = 1)"""

SNAPSHOT = f"""(select * exclude (rn) from (
  select *, row_number() over (partition by username order by address desc, bytes_in desc, bytes_out desc) as rn from (
    select polled_at, "user" as username, address, coalesce(try_cast(bytes_in as bigint), 0) as bytes_in,
      coalesce(try_cast(bytes_out as bigint), 0) as bytes_out
    from activity_feed where "user" is not null
      and polled_at = (select max(polled_at) from activity_feed where polled_at <= {LIVE_SQL}))) where rn = 1)"""
