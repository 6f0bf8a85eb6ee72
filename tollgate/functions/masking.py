"""Masking of personal data in tables and in free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..columns import as_col

# The log censor keeps 3 leading and 2 trailing characters of
# strings longer than 6; shorter values become the redaction marker.
REDACTED = "[REDACTED]"
KEEP_HEAD, KEEP_TAIL, MIN_LEN = 3, 2, 6
# Phone display mask: the last 4 of the final 11 characters become ****.
DISPLAY_MASK_PATTERN = r"(.{7})(.{4})$"
# Numbers in prose: a run of digits with separators, ending in 4 digits.
TEXT_NUMBER_PATTERN = r"(\+?[0-9][0-9 ()\-]{3,})([0-9]{4})"


def log_censor(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(c.isNull(), F.lit(REDACTED)).when(
        F.length(c) > MIN_LEN,
        F.concat(F.substring(c, 1, KEEP_HEAD), F.lit("****"), F.substring(c, -KEEP_TAIL, KEEP_TAIL)),
    ).otherwise(F.lit(REDACTED))


def display_mask(phone: Column | str) -> Column:
    return F.regexp_replace(as_col(phone), DISPLAY_MASK_PATTERN, "$1****")


def mask_numbers_in_text(text: Column | str) -> Column:
    return F.regexp_replace(as_col(text), TEXT_NUMBER_PATTERN, "$1****")


def count_numbers_in_text(text: Column | str) -> Column:
    return F.regexp_count(as_col(text), F.lit(TEXT_NUMBER_PATTERN))
