"""Date parsing that yields NULL instead of failing, and the identifiers built from dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """ISO dates, ISO with a time part, or MM/dd/yyyy; anything else is NULL."""
    day = F.element_at(F.split(F.trim(text), " "), 1)
    return F.coalesce(F.try_to_date(day, "yyyy-MM-dd"), F.try_to_date(day, "MM/dd/yyyy"))


def parse_timestamp(text: Column) -> Column:
    return F.try_to_timestamp(text)


def us_date(day: Column) -> Column:
    return F.date_format(day, "MM/dd/yyyy")


def event_id(day: Column, permno: Column) -> Column:
    return F.concat(F.upper(F.date_format(day, "ddMMMyyyy")), permno.cast("string"))


def theme_id(run_date: Column, ordinal: Column) -> Column:
    return F.format_string("theme_%s_%03d", F.date_format(run_date, "yyyyMMdd"), ordinal)


def utc_stamp(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
