"""Time expressions. All arithmetic is on UTC epoch values; sessions run with ``timeZone=UTC``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp (with or without zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp."""
    return F.unix_seconds(ts.cast("timestamp"))


def decayed(weight: Column, age_seconds: Column, tau_seconds: float) -> Column:
    """``weight * exp(-age / tau)`` in double precision."""
    return weight.cast("double") * F.exp(-age_seconds.cast("double") / F.lit(float(tau_seconds)))


def camera_epoch(text: Column) -> Column:
    """Epoch seconds of a ``YYYY:MM:DD HH:MM:SS`` stamp, null when it does not parse.

    Month must be 1-12 and day 1-31; days past the end of the month roll over, and clock fields are not range
    checked.
    """
    halves = F.split(text, " ", 2)
    date = F.split(F.get(halves, F.lit(0)), ":")
    clock = F.split(F.get(halves, F.lit(1)), ":")

    def number(parts: Column, i: int) -> Column:
        return F.get(parts, F.lit(i)).try_cast("int")

    year, month, day = (number(date, i) for i in range(3))
    hour, minute, second = (number(clock, i) for i in range(3))
    first = F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))
    days = F.unix_date(first).cast("long") + day - 1
    stamp = days * 86400 + hour.cast("long") * 3600 + minute.cast("long") * 60 + second
    return F.when(day.between(1, 31), stamp)
