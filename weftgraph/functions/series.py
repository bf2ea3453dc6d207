"""Time series in long form: id, date, channel, value.

Periods are texts ('2020', '2020-2', '2020-02-03'), years as integers, or None for no limit. One period selects all of it; two
select from the start of the first to the end of the second. Null and NaN values are skipped.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Period = str | int | dt.date | None


def span(period: Period) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a period."""
    if period is None:
        return None, None
    if isinstance(period, dt.date):
        return period, period
    parts = [int(x) for x in str(period).split("-")]
    if len(parts) == 1:
        return dt.date(parts[0], 1, 1), dt.date(parts[0], 12, 31)
    if len(parts) == 2:
        return dt.date(*parts, 1), dt.date(*parts, calendar.monthrange(*parts)[1])
    return dt.date(*parts), dt.date(*parts)


def within(start: Period = None, end: Period | None = ..., date: str = "date") -> Column:
    first, last = span(start)
    if end is not ...:
        last = span(end)[1]
    out = F.lit(True)
    if first:
        out = out & (F.col(date) >= F.lit(first))
    if last:
        out = out & (F.col(date) <= F.lit(last))
    return out


def _values(series: DataFrame, channel: str, start: Period, end) -> DataFrame:
    return series.where((F.col("channel") == channel) & within(start, end) & F.col("value").isNotNull() & ~F.isnan("value"))


def aggregate(series: DataFrame, channel: str, how: str, start: Period = None, end=..., name: str = "value") -> DataFrame:
    """(id, name) by sum, avg, min, max, count, first or last."""
    make = {"sum": F.sum("value"), "avg": F.avg("value"), "min": F.min("value"), "max": F.max("value"), "count": F.count("value"), "first": F.min_by("value", "date"), "last": F.max_by("value", "date")}
    return _values(series, channel, start, end).groupBy("id").agg(make[how].alias(name))


def at(series: DataFrame, channel: str, day: Period, name: str = "value") -> DataFrame:
    """The value at exactly a key: the first day of the period."""
    return series.where((F.col("channel") == channel) & (F.col("date") == F.lit(span(day)[0]))).groupBy("id").agg(F.first("value").alias(name))


def delta(series: DataFrame, channel: str, a: Period, b: Period, name: str = "delta") -> DataFrame:
    """The first value in b less the first value in a."""
    rows = series.where((F.col("channel") == channel) & (within(a) | within(b)))

    def first(p: Period) -> Column:
        return F.min_by(F.when(within(p), F.col("value")), F.when(within(p), F.col("date")))

    return rows.groupBy("id").agg((first(b) - first(a)).alias(name))


def listed(series: DataFrame, channel: str, start: Period = None, end=..., name: str = "series") -> DataFrame:
    """(id, name): the points of a channel in order of time, as an array of (date, value)."""
    points = F.array_sort(F.collect_list(F.struct("date", "value")))
    return _values(series, channel, start, end).groupBy("id").agg(points.alias(name))


def collect(df: DataFrame, id_column: str, date_column: str, channels: dict[str, str], resolution: str = "day") -> DataFrame:
    """Long form of a wide table: channels maps names to columns; dates are cut to the resolution."""
    date = F.trunc(F.col(date_column).cast("date"), {"year": "year", "month": "month", "day": "day"}[resolution]) if resolution != "day" else F.col(date_column).cast("date")
    points = F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(v).cast("double").alias("value")) for c, v in channels.items()]))
    return df.select(F.col(id_column).alias("id"), date.alias("date"), points.alias("p")).select("id", "date", "p.channel", "p.value")
