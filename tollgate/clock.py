"""Fixed clocks.  Queries never call now(): the clock is an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two time bases of the fixture tables (see FIXTURES.md).
LONG = "2000-01-01 12:00:00"
LIVE = "2024-01-20 12:00:00"


def at(clock: str) -> Column:
    """Clock literal as TIMESTAMP_NTZ (driver files are NTZ)."""
    return F.to_timestamp_ntz(F.lit(clock))


def day_start(clock: str) -> Column:
    """Midnight of the clock's day, as a range bound that pushes down."""
    return F.to_timestamp_ntz(F.lit(clock[:10]))


def minus(clock: str, **kw) -> Column:
    """``clock - interval``: keyword units days/hours/minutes/seconds."""
    c = at(clock)
    for unit, sql_unit in (("days", "DAY"), ("hours", "HOUR"), ("minutes", "MINUTE"), ("seconds", "SECOND")):
        if unit in kw:
            c = F.timestamp_add(sql_unit, F.lit(-int(kw[unit])), c)
    return c


def sql_at(clock: str) -> str:
    """The same clock in DuckDB SQL."""
    return f"TIMESTAMP '{clock}'"
