"""Dates: reading mixed formats, calendar cells, whole-day differences."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.common import col, first_match
from tidemark.functions.text import strip

# Accepted date layouts in the order they are tried.
LAYOUTS = {
    "%Y-%m-%d": r"^\d{4}-\d{1,2}-\d{1,2}$",
    "%Y-%m-%d %H:%M:%S": r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$",
    "%m/%d/%Y": r"^\d{1,2}/\d{1,2}/\d{4}$",
    "%m/%d/%y": r"^\d{1,2}/\d{1,2}/\d{2}$",
    "%d-%b-%Y": r"^\d{1,2}-[A-Za-z]{3}-\d{4}$",
    "%Y%m%d": r"^\d{8}$",
}
# How the numeric layouts are rewritten to year-month-day.  Two-digit years
# from 70 on belong to the 1900s.
TO_ISO = (
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/([7-9]\d)$", "19$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/([0-6]\d)$", "20$3-$1-$2"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
)
ISO = r"^\d{4}-\d{1,2}-\d{1,2}(\s+\d{1,2}:\d{1,2}:\d{1,2})?$"

SECONDS_PER_DAY = 86_400
MONTH_DAYS = 30.4375


def read_date(value) -> Column:
    """The moment a text states; null when no layout reads it.  Nothing is guessed.

    A text is rewritten only when it is not year-month-day already, and only by the patterns
    that its separators allow.
    """
    text = strip(value)
    *slashed, compact = TO_ISO
    plain = text
    for pattern, replacement in slashed:
        plain = F.regexp_replace(plain, pattern, replacement)
    named = F.regexp_extract(text, LAYOUTS["%d-%b-%Y"], 0)
    return (
        F.when(text.rlike(ISO), text.try_cast("timestamp_ntz"))
        .when(text.contains("/"), F.regexp_extract(plain, ISO, 0).try_cast("timestamp_ntz"))
        .when(text.contains("-"), F.try_to_date(named, "d-MMM-yyyy").cast("timestamp_ntz"))
        .otherwise(F.regexp_extract(F.regexp_replace(text, *compact), ISO, 0).try_cast("timestamp_ntz"))
    )


def date_layout(value, moment) -> Column:
    """Label of the layout that read a text; ``unparsed`` when none did; null for blank."""
    text = strip(value)
    rules = [
        (text.isNull() | F.lower(text).isin("", "nan", "none", "nat", "-"), F.lit(None)),
        (col(moment).isNull(), F.lit("unparsed")),
        *[(text.rlike(pattern), F.lit(label)) for label, pattern in LAYOUTS.items()],
    ]
    return first_match(rules)


def month_key(moment) -> Column:
    """``YYYY-MM``."""
    moment = col(moment)
    return F.concat(
        F.lpad(F.year(moment).cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad(F.month(moment).cast("string"), 2, "0"),
    )


def quarter_key(moment) -> Column:
    """``YYYYQn``."""
    moment = col(moment)
    return F.concat(
        F.lpad(F.year(moment).cast("string"), 4, "0"), F.lit("Q"), F.quarter(moment).cast("string")
    )


def season(moment) -> Column:
    """Meteorological season."""
    month = F.month(col(moment))
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "fall")
    )


def whole_days(end, start) -> Column:
    """Whole days from start to end, rounded down, as a double."""
    seconds = F.timestamp_diff(
        "SECOND", col(start).cast("timestamp_ntz"), col(end).cast("timestamp_ntz")
    )
    return F.floor(seconds / F.lit(SECONDS_PER_DAY)).cast("double")


def minus_days(moment, days) -> Column:
    """The moment some days earlier, time of day kept."""
    return col(moment).cast("timestamp_ntz") - F.make_dt_interval(col(days).cast("int"))


def months_between_fixed(end, start) -> Column:
    """Day difference in months of 30.4375 days."""
    return F.date_diff(col(end), col(start)) / F.lit(MONTH_DAYS)
