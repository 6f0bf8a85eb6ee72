"""Phone normalisation, payability and hotspot usernames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import as_col

# Phone rules of the service.
STRIP_CHARS = r"[\s\-()]"          # spaces, dashes, brackets are removed
VALID_PHONE = r"^254[0-9]{9}$"     # 254 + 9 digits after normalising
PAYABLE_PHONE = r"^254(7|1)[0-9]{8}$"  # mobile-money numbers: 2547... or 2541...


def stripped(raw: Column | str) -> Column:
    """Remove spaces, dashes and brackets, then one leading '+'."""
    return F.regexp_replace(F.regexp_replace(as_col(raw), STRIP_CHARS, ""), r"^\+", "")


def normalised_candidate(raw: Column | str) -> Column:
    """07.../01... -> 2547.../2541...; 9-digit 7.../1... -> 254...; else unchanged."""
    s = stripped(raw)
    return (F.when(s.startswith("07") | s.startswith("01"), F.concat(F.lit("254"), F.substring(s, 2, 1 << 30)))
            .when((F.length(s) == 9) & (s.startswith("7") | s.startswith("1")), F.concat(F.lit("254"), s))
            .otherwise(s))


def normalise(raw: Column | str) -> Column:
    """The normalised phone, or NULL when it is not 254 + 9 digits."""
    n = normalised_candidate(raw)
    return F.when(n.rlike(VALID_PHONE), n)


def shape(raw: Column | str) -> Column:
    """How the number was typed: local (07/01), short (9 digits), international (254), other."""
    s = stripped(raw)
    return (F.when(s.startswith("07") | s.startswith("01"), "local")
            .when((F.length(s) == 9) & (s.startswith("7") | s.startswith("1")), "short")
            .when(s.startswith("254"), "international")
            .otherwise("other"))


def payable(phone: Column | str) -> Column:
    return as_col(phone).rlike(PAYABLE_PHONE)


def hotspot_username(phone: Column | str) -> Column:
    """Digits of the phone ('+' and non-digits removed), last 12 of them."""
    d = F.regexp_replace(as_col(phone), r"[^0-9]", "")
    return F.when(F.length(d) > 12, F.substring(d, -12, 12)).otherwise(d)
