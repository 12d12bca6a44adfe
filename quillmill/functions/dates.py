"""Dates and windows as Spark columns. Nothing reads the clock: `now` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import text

PRESETS = ("current_week", "last_7_days", "custom")


def parse(c: Column) -> Column:
    """A date alone is midnight in the session's zone; what cannot be read is null."""
    t = text(c)
    return F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(t, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(t))


def day_start(t: Column) -> Column:
    return F.date_trunc("day", t)


def day_end(t: Column) -> Column:
    return day_start(t) + F.expr("INTERVAL 23 HOURS 59 MINUTES 59.999 SECONDS")


def window(now: Column, preset: str = "current_week", start: Column | None = None, end: Column | None = None) -> tuple[Column, Column]:
    """First and last instant, to the millisecond: the week from Monday, the last seven days, or given days."""
    if preset == "last_7_days":
        return day_start(now) - F.expr("INTERVAL 6 DAYS"), day_end(now)
    if preset == "custom":
        return day_start(start), day_end(end)
    monday = F.date_trunc("week", now)
    return monday, day_end(monday + F.expr("INTERVAL 6 DAYS"))


def within(t: Column, bounds: tuple[Column, Column]) -> Column:
    """Closed at both ends; false for null."""
    return F.coalesce(t.between(*bounds), F.lit(False))


def range_label(start: Column, end: Column) -> Column:
    day = lambda t: F.date_format(t, "MMM d")
    return F.when(start.isNull() | end.isNull(), "Unknown window").when(F.to_date(start) == F.to_date(end), day(start)).otherwise(F.concat_ws(" - ", day(start), day(end)))


def window_label(now: Column, preset: str = "current_week", start: Column | None = None, end: Column | None = None) -> Column:
    name = {"current_week": "Current Week", "last_7_days": "Last 7 Days", "custom": "Custom"}[preset]
    return F.concat(F.lit(f"{name} · "), range_label(*window(now, preset, start, end)))
