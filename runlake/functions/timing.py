"""Arithmetic on zone-less timestamps.

Every time column of this library is ``timestamp_ntz``. Differences stay day-time
intervals, which Spark holds as whole microseconds, so nothing here depends on the
session time zone or on clock changes.
"""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
DAY_US = 86_400 * SECOND_US

_UNIT_US = {
    "us": 1,
    "ms": 1_000,
    "s": SECOND_US,
    "min": 60 * SECOND_US,
    "h": 3_600 * SECOND_US,
    "d": DAY_US,
}

Duration = str | int | timedelta


def to_micros(duration: Duration) -> int:
    """Microseconds of ``"5min"``, ``"90s"``, ``"1D"``, a timedelta, or an int already in µs."""
    if isinstance(duration, timedelta):
        micros = duration // timedelta(microseconds=1)
    elif isinstance(duration, int):
        micros = duration
    else:
        found = re.fullmatch(r"(\d*)\s*([A-Za-z]+)", duration.strip())
        if not found or found[2].lower() not in _UNIT_US:
            raise ValueError(f"cannot read a duration from {duration!r}")
        micros = int(found[1] or 1) * _UNIT_US[found[2].lower()]
    if micros < 0:
        raise ValueError("a duration must not be negative")
    return micros


def interval(micros: int) -> Column:
    """A constant day-time interval."""
    return F.expr(f"interval '{micros // SECOND_US}.{micros % SECOND_US:06d}' second")


def seconds_between(later: Column, earlier: Column) -> Column:
    """Signed distance in seconds, with the microseconds kept."""
    return (later - earlier).cast("interval second").cast("decimal(18,6)").cast("double")


def hours_between(later: Column, earlier: Column) -> Column:
    return seconds_between(later, earlier) / F.lit(3600.0)


def origin() -> Column:
    """A midnight before every reading, so that slot numbers never turn negative."""
    return F.expr("timestamp_ntz'0001-01-01 00:00:00'")


def slot(moment: Column, width_us: int, since: Column | None = None) -> Column:
    """Number of the fixed-width time slot that holds ``moment`` (left-closed slots)."""
    if width_us <= 0:
        raise ValueError("a slot needs a positive width")
    passed = (moment - (origin() if since is None else since)).cast("interval second")
    if width_us % SECOND_US == 0:
        return F.call_function("div", passed.cast("bigint"), F.lit(width_us // SECOND_US))
    micros = (passed.cast("decimal(20,6)") * SECOND_US).cast("bigint")
    return F.call_function("div", micros, F.lit(width_us))


def slot_start(number: Column, width_us: int, since: Column | None = None) -> Column:
    """First moment of a slot."""
    return (origin() if since is None else since) + number * interval(width_us)


def midnight(moment: Column) -> Column:
    return moment.cast("date").cast("timestamp_ntz")
