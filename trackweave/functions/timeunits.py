"""Microsecond arithmetic on timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import col

_UNITS = {"us": 1, "ms": 1000, "s": 10**6, "sec": 10**6, "min": 60 * 10**6, "minute": 60 * 10**6, "minutes": 60 * 10**6, "h": 3600 * 10**6, "hour": 3600 * 10**6, "hours": 3600 * 10**6, "d": 86400 * 10**6, "day": 86400 * 10**6, "days": 86400 * 10**6}


def micros(value) -> int:
    """Microseconds of "10 min", "30s", a timedelta, or a number of seconds."""
    if hasattr(value, "total_seconds"):
        return round(value.total_seconds() * 10**6)
    if isinstance(value, (int, float)):
        return round(value * 10**6)
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*([a-zA-Z]+)\s*", value)
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"no duration: {value!r}")
    return round(float(m[1] or 1) * _UNITS[m[2].lower()])


def epoch() -> Column:
    return F.expr("timestamp_ntz'1970-01-01 00:00:00'")


def us(ts) -> Column:
    """Microseconds since 1970."""
    return F.timestamp_diff("MICROSECOND", epoch(), col(ts).cast("timestamp_ntz"))


def from_us(n) -> Column:
    return F.timestamp_add("MICROSECOND", col(n).cast("long"), epoch())


def plus(ts, n) -> Column:
    return F.timestamp_add("MICROSECOND", col(n).cast("long"), col(ts))


def nearest(ts, freq) -> Column:
    """The multiple of ``freq`` nearest to a time, ties to the even multiple."""
    f = micros(freq)
    return from_us(F.rint(us(ts) / F.lit(float(f))) * f)


def floor(ts, freq) -> Column:
    f = micros(freq)
    return from_us(us(ts) - F.pmod(us(ts), F.lit(f)))
