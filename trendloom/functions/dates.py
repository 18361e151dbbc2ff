"""Calendar expressions; none depends on the session time zone."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_number(ds: str | Column) -> Column:
    return F.date_diff(ds, F.lit("1970-01-01").cast("date")).cast("long")


def epoch_seconds(ts: str | Column) -> Column:
    """Whole seconds since 1970 by the wall clock of a zone-less timestamp."""
    c = F.col(ts) if isinstance(ts, str) else ts
    days = F.date_diff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def at_second(seconds: Column) -> Column:
    """The zone-less timestamp of a second since 1970."""
    gone = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
    return F.lit("1970-01-01").cast("timestamp_ntz") + gone


def epoch_micros(ts: str | Column) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    part = F.extract(F.lit("SECOND"), c)
    return (epoch_seconds(c) - F.second(c)) * 1000000 + (part * 1000000).cast("long")


def month_number(ds: str | Column) -> Column:
    """Consecutive month index, so that month arithmetic is integer arithmetic."""
    return (F.year(ds) * 12 + F.month(ds) - 1).cast("long")


def month_start(number: Column) -> Column:
    year = F.floor(number / 12).cast("int")
    return F.make_date(year, (number - year * 12 + 1).cast("int"), F.lit(1))


def day_part(ts: str | Column) -> Column:
    """morning before 12:00, afternoon before 18:00, evening after."""
    return F.when(F.hour(ts) < 12, "morning").when(F.hour(ts) < 18, "afternoon").otherwise("evening")


def cycle(position: Column, period: int) -> tuple[Column, Column]:
    angle = position * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def hours_between(start: str, end: str) -> Column:
    return (epoch_micros(end) - epoch_micros(start)) / F.lit(3.6e9)


def period_label(ds: str | Column) -> Column:
    """Last day of the month as text."""
    return F.date_format(F.last_day(ds), "yyyy-MM-dd")
