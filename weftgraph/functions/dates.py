"""Dates, durations and periods of validity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date(c: Column) -> Column:
    """'YYYY', 'YYYY-M' or 'YYYY-M-D', else null."""
    c = F.trim(c)
    year = F.when(c.rlike(r"^\d{4}$"), F.concat(c, F.lit("-01-01")))
    month = F.when(c.rlike(r"^\d{4}-\d{1,2}$"), F.concat(c, F.lit("-01")))
    day = F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), c)
    return F.coalesce(year, month, day).try_cast("date")


def datetime(c: Column) -> Column:
    """The date of 'dateTtime'."""
    return date(F.substring_index(c, "T", 1))


def date_diff(a: Column, b: Column) -> Column:
    """Days from b to a."""
    return F.datediff(a, b)


def duration(years: int = 0, months: int = 0, weeks: int = 0, days: int = 0, hours: int = 0, minutes: int = 0, seconds: int = 0) -> Column:
    """struct(months, days, seconds)."""
    return F.struct(F.lit(12 * years + months).alias("months"), F.lit(7 * weeks + days).alias("days"), F.lit(3600 * hours + 60 * minutes + seconds).cast("long").alias("seconds"))


def between(a: Column, b: Column) -> Column:
    """The duration from a to b, in days."""
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(F.lit(0).alias("months"), F.datediff(b, a).alias("days"), F.lit(0).cast("long").alias("seconds")))


def days_of(d: Column) -> Column:
    """Whole days of a duration, a month being 30."""
    return d["months"] * 30 + d["days"] + F.floor(d["seconds"] / 86400).cast("int")


def add(c: Column, d: Column) -> Column:
    return F.date_add(c, days_of(d).cast("int"))


def subtract(c: Column, d: Column) -> Column:
    return F.date_sub(c, days_of(d).cast("int"))


def plus(a: Column, b: Column) -> Column:
    """The sum of two durations, part by part."""
    return F.struct(*[(a[k] + b[k]).alias(k) for k in ("months", "days", "seconds")])


def minus(a: Column, b: Column) -> Column:
    return F.struct(*[(a[k] - b[k]).alias(k) for k in ("months", "days", "seconds")])


def day_of_week(c: Column) -> Column:
    """Monday is 1."""
    return F.weekday(c) + 1


def epoch_seconds(c: Column) -> Column:
    return F.unix_date(c).cast("long") * 86400


def valid_at(at: Column, start: Column, end: Column) -> Column:
    """start <= at <= end, a null limit being open."""
    return (start.isNull() | (start <= at)) & (end.isNull() | (end >= at))


def valid_during(first: Column, last: Column, start: Column, end: Column) -> Column:
    """The periods overlap, null limits being open."""
    return (start.isNull() | (start <= last)) & (end.isNull() | (end >= first))
