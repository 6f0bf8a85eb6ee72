"""Small column helpers shared by the operators (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GB = 1 << 30
MB = 1 << 20


def as_col(c: Column | str | int) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def floor_div(c: Column | str, d: Column | str | int) -> Column:
    """Exact floor division of an integer by a positive divisor (-1 / 2 gives -1).

    ``c - pmod(c, d)`` is an exact multiple of ``d``; dividing it as DECIMAL keeps the
    quotient exact for any long (a double would round above 2^53).
    """
    c, d = as_col(c).cast("decimal(38,0)"), as_col(d).cast("decimal(38,0)")
    return ((c - F.pmod(c, d)) / d).cast("bigint")


def sql_floor_div(num: str, den: str) -> str:
    """DuckDB twin of :func:`floor_div` (its ``//`` truncates toward zero)."""
    return f"((({num}) - ((({num}) % ({den})) + ({den})) % ({den})) // ({den}))"


def round_half_up_div(num: Column | str, den: Column | str | int, places: int = 2) -> Column:
    """``num / den`` rounded half up to ``places`` decimals, exact, as DECIMAL(18,places).

    Integer arithmetic only.  For num >= 0 and den > 0.
    """
    num, den = as_col(num).cast("decimal(38,0)"), as_col(den).cast("decimal(38,0)")
    scale = 10 ** places
    q = floor_div(num * (2 * scale) + den, den * 2)
    return (q / F.lit(scale)).cast(f"decimal(18,{places})")


def sql_round_half_up_div(num: str, den: str, places: int = 2) -> str:
    """DuckDB twin of :func:`round_half_up_div` (HUGEINT arithmetic)."""
    scale = 10 ** places
    return (f"cast((cast({num} as hugeint) * {2 * scale} + ({den})) // (cast({den} as hugeint) * 2) / {scale} "
            f"as decimal(18,{places}))")


def micros_between(start: Column | str, end: Column | str) -> Column:
    """end - start in microseconds (works on TIMESTAMP_NTZ, no zone involved)."""
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds of end - start, truncated toward zero."""
    return F.timestamp_diff("SECOND", as_col(start), as_col(end))


def sql_seconds_between(start: str, end: str) -> str:
    """DuckDB twin of :func:`seconds_between` (truncating toward zero)."""
    return f"trunc((epoch_us({end}) - epoch_us({start})) / 1000000)::bigint"


def money(c: Column | str) -> Column:
    """Money sums are reported as DECIMAL(18,2) (never double)."""
    return as_col(c).cast("decimal(18,2)")
