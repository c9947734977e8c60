"""Time arithmetic and labels."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetsight.functions.coerce import js_round


def at(moment: datetime | Column) -> Column:
    """A timestamp literal (UTC) or the column itself."""
    if isinstance(moment, Column):
        return moment
    return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def before(as_of: datetime | Column, seconds: float) -> Column:
    """``as_of - seconds``. For a datetime this is a literal, so the scan can use it."""
    if isinstance(as_of, Column):
        return as_of - F.make_dt_interval(secs=F.lit(float(seconds)))
    return at(as_of - timedelta(seconds=seconds))


def in_window(c: Column, as_of, seconds: float, inclusive: bool = False, upper: bool = False) -> Column:
    """Trailing window. Metrics use an open lower bound, KPIs and distributions a closed one."""
    low = before(as_of, seconds)
    hit = (c >= low) if inclusive else (c > low)
    return hit & (c <= at(as_of)) if upper else hit


def between(c: Column, start, end) -> Column:
    return (c >= at(start)) & (c <= at(end))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact difference in seconds (microsecond resolution) as double."""
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000.0)


def minutes_between(a: Column, b: Column) -> Column:
    return F.abs(seconds_between(a, b)) / F.lit(60.0)


def time_bucket(c: Column, seconds: float) -> Column:
    """Start of the epoch-aligned bucket that holds ``c``."""
    micros = int(seconds * 1_000_000)
    us = F.unix_micros(c)
    return F.timestamp_micros(us - F.pmod(us, F.lit(micros)))


def shift_month(c: Column, months: int) -> Column:
    return F.add_months(F.date_trunc("month", c), months).cast("timestamp")


def age_label(age_seconds: Column) -> Column:
    """``now``, ``5m ago``, ``2h ago`` (minutes rounded)."""
    m = js_round(age_seconds / 60.0)
    return (
        F.when(m < 1, "now")
        .when(m < 60, F.concat(m.cast("string"), F.lit("m ago")))
        .otherwise(F.concat(F.floor(m / 60).cast("string"), F.lit("h ago")))
    )


def short_age_label(age_seconds: Column) -> Column:
    """``now``, ``5m``, ``2h``, ``3d`` (minutes cut)."""
    m = F.floor(age_seconds / 60.0)
    h = F.floor(m / 60)
    return (
        F.when(m < 1, "now")
        .when(m < 60, F.concat(m.cast("string"), F.lit("m")))
        .when(h < 24, F.concat(h.cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(h / 24).cast("string"), F.lit("d")))
    )


def duration_label(seconds: Column) -> Column:
    """``< 1 min``, ``~12 min``, ``~1h 5m``, ``~2h``."""
    minutes = js_round(seconds / 60.0)
    h, m = F.floor(minutes / 60), F.pmod(minutes, F.lit(60))
    return (
        F.when(minutes < 1, "< 1 min")
        .when(minutes < 60, F.concat(F.lit("~"), minutes.cast("string"), F.lit(" min")))
        .when(m > 0, F.concat(F.lit("~"), h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m")))
        .otherwise(F.concat(F.lit("~"), h.cast("string"), F.lit("h")))
    )
