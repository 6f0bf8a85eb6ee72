"""Display labels and per-row business arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import as_col, floor_div


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" " + word), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))


def _round_div(n: Column, d: int) -> Column:
    """Math.round(n / d) for n >= 0 (half up), in integers."""
    return floor_div(n * 2 + d, 2 * d)


def duration_label_server(h: Column | str) -> Column:
    """Credential response: N Hour(s) below a day, N Day(s) below a week, else N Week(s)."""
    h = as_col(h)
    return (F.when(h < 24, _plural(h, "Hour"))
            .when(h < 168, _plural(floor_div(h, 24), "Day"))
            .otherwise(_plural(floor_div(h, 168), "Week")))


def duration_label_catalogue(h: Column | str) -> Column:
    """Price list: minutes below 1 h, '1h', '24h', '7 days', '14 days', '30 days', Nh up to 12, else days."""
    h = as_col(h)
    return (F.when(h < 1, F.concat(F.round(h * 60).cast("bigint").cast("string"), F.lit(" min")))
            .when(h == 1, F.lit("1h")).when(h == 24, F.lit("24h")).when(h == 168, F.lit("7 days"))
            .when(h == 336, F.lit("14 days")).when(h >= 720, F.lit("30 days"))
            .when(h <= 12, F.concat(h.cast("string"), F.lit("h")))
            .otherwise(F.concat(_round_div(h, 24).cast("string"), F.lit(" days"))))


def duration_label_card(h: Column | str) -> Column:
    """Package cards: minutes below 1 h, '24 Hours', Nh up to 12, else rounded days 'Nd'."""
    h = as_col(h)
    return (F.when(h < 1, F.concat(F.round(h * 60).cast("bigint").cast("string"), F.lit(" min")))
            .when(h == 24, F.lit("24 Hours"))
            .when(h <= 12, F.concat(h.cast("string"), F.lit("h")))
            .otherwise(F.concat(_round_div(h, 24).cast("string"), F.lit("d"))))


def duration_label_history(h: Column | str) -> Column:
    """Session history: 'N Hour(s)' below a day, else h/24 'Day' ('Days' above 24 h).

    h/24 prints like a JS number: whole days without a decimal point, others in
    the shortest form that reads back the same double (e.g. 1.5)."""
    h = as_col(h)
    days = F.when(h % 24 == 0, floor_div(h, 24).cast("string")).otherwise((h / F.lit(24.0)).cast("string"))
    return (F.when(h < 24, _plural(h, "Hour"))
            .otherwise(F.concat(days, F.lit(" Day"), F.when(h > 24, F.lit("s")).otherwise(F.lit("")))))


def duration_tier(h: Column | str) -> Column:
    h = as_col(h)
    return F.when(h < 1, "min").when(h < 24, "h").when(h < 168, "days").otherwise("weeks")


def category(h: Column | str) -> Column:
    """F8: short (<= 4 h), daily (exactly 24 h), weekly (everything else, 12 h included)."""
    h = as_col(h)
    return F.when(h <= 4, "short").when(h == 24, "daily").otherwise("weekly")


def speed_band(speed: Column | str) -> Column:
    """Signal bars 1-5 at thresholds 5, 10, 15, 25 Mbps."""
    s = as_col(speed)
    return F.when(s >= 25, 5).when(s >= 15, 4).when(s >= 10, 3).when(s >= 5, 2).otherwise(1)


def _two(n: Column) -> Column:
    """At least two digits (padStart: pads, never truncates)."""
    return F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string"))


def countdown(secs: Column | str) -> Column:
    """Hh:mm:ss, '00:00:00' once nothing is left."""
    s = as_col(secs)
    txt = F.concat_ws(":", _two(floor_div(s, 3600)), _two(floor_div(s % 3600, 60)), _two(s % 60))
    return F.when(s <= 0, F.lit("00:00:00")).otherwise(txt)


def time_label(secs: Column | str) -> Column:
    """C6: 'Xh Ym remaining' above an hour, else 'Ym remaining'."""
    s = as_col(secs)
    return (F.when(s > 3600, F.concat(floor_div(s, 3600).cast("string"), F.lit("h "),
                                      floor_div(s % 3600, 60).cast("string"), F.lit("m remaining")))
            .otherwise(F.concat(floor_div(s, 60).cast("string"), F.lit("m remaining"))))


def kes_label(amount: Column | str) -> Column:
    """C7: 'KES 1,234.5' (grouped, up to 3 decimals, none forced)."""
    return F.concat(F.lit("KES "), F.call_function("format_number", as_col(amount), F.lit("#,##0.###")))


def date_label(ts: Column | str) -> Column:
    """C7: '20 Jan 2024, 14:05'."""
    return F.date_format(as_col(ts), "dd MMM yyyy, HH:mm")


def stk_amount(price: Column | str) -> Column:
    """Whole-unit amount sent to the payment API: ceil(price)."""
    return F.ceil(as_col(price)).cast("bigint")


def eat_timestamp14(ts: Column | str) -> Column:
    """Request timestamp, UTC+3, as 14 digits yyyyMMddHHmmss."""
    return F.date_format(F.timestamp_add("HOUR", F.lit(3), as_col(ts)), "yyyyMMddHHmmss")
