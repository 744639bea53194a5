"""Column functions over dates and times; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_weekday(day: Column) -> Column:
    """Saturdays and Sundays move to Monday."""
    d = F.weekday(day)
    return F.when(d >= 5, F.date_add(day, F.lit(7) - d)).otherwise(day)


def capped(value: Column, cap: float, weight: float = 1.0) -> Column:
    return F.least(value / F.lit(float(cap)), F.lit(1.0)) * F.lit(float(weight))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_timestamp(later.cast("timestamp")) - F.unix_timestamp(earlier.cast("timestamp"))) / F.lit(86400.0)


def recency(days: Column, horizon: float = 365.0) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - days / F.lit(horizon))


def ago(as_of: Column, then: Column) -> Column:
    """ "n days/hours/minutes ago", "Just now", or the date after a week."""
    s = F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp(then.cast("timestamp"))
    label = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(f" {name} ago"))
    return F.when(s > 7 * 86400, F.date_format(then, "yyyy-MM-dd")).when(s >= 86400, label(86400, "days")).when(s >= 3600, label(3600, "hours")).when(s >= 60, label(60, "minutes")).otherwise("Just now")


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0, jitter: Column | None = None) -> Column:
    """Seconds before an attempt (from 0): doubled each time up to a limit, times 0.5 to 1 by ``jitter`` (0 to 1)."""
    delay = F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(most)))
    return delay * (F.lit(0.5) + F.lit(0.5) * jitter) if jitter is not None else delay
