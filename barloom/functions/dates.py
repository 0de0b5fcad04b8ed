"""Date keys used by resampling and reporting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def week_end(day: Column) -> Column:
    """Friday that closes the Saturday-to-Friday week holding ``day``."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM").cast("date")


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def lenient_date(text: Column) -> Column:
    """ISO date or null; a read model must not fail on one bad row."""
    return F.try_to_date(text, "yyyy-MM-dd")


def strict_date(text: Column) -> Column:
    """ISO date; anything else fails the job (ANSI mode)."""
    return F.to_date(text, "yyyy-MM-dd")
