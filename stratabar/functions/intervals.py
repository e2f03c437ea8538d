"""Intervals and epoch-aligned bins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class TimeInterval:
    """Lengths in milliseconds."""

    SECOND = 1_000
    MINUTE = 60 * SECOND
    HOUR = 60 * MINUTE
    DAY = 24 * HOUR
    WEEK = 7 * DAY


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
#: Lengths in seconds by name.
STANDARD_INTERVALS = {name: int(name[:-1]) * _UNITS[name[-1]] for name in "1s 5s 15s 30s 1m 3m 5m 15m 30m 1h 2h 4h 6h 8h 12h 1d 3d 1w".split()}


def bin_start(time: Column | str, interval: int | Column) -> Column:
    """The start of the epoch-aligned bin of an integer time, floored also before the epoch. Weeks start on Thursdays."""
    t = F.col(time) if isinstance(time, str) else time
    return t - F.pmod(t, F.lit(interval) if isinstance(interval, int) else interval)


def parse_interval(interval: str | int) -> int:
    """Seconds of a standard name or a number of seconds."""
    if isinstance(interval, str):
        if interval not in STANDARD_INTERVALS:
            raise ValueError(f"unknown interval {interval!r}; known: {', '.join(STANDARD_INTERVALS)}")
        return STANDARD_INTERVALS[interval]
    if interval <= 0:
        raise ValueError("an interval must be positive")
    return int(interval)
