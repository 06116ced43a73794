"""Dates and sessions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trading sessions: time zone, first and last local time; fixed values.
SESSIONS = {"sydney": ("Australia/Sydney", 7, 16), "tokyo": ("Asia/Tokyo", 9, 18), "london": ("Europe/London", 8, 16), "new_york": ("America/New_York", 8, 17)}


def floor_micros(ns: Column) -> Column:
    return ns - F.pmod(ns, F.lit(1000))


def to_nanos(amount: Column, unit: str) -> Column:
    return (amount * {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}[unit]).cast("long")


def last_weekday(date: Column) -> Column:
    """The date itself from Monday to Friday, else the Friday before."""
    back = F.when(F.dayofweek(date) == 7, 1).when(F.dayofweek(date) == 1, 2).otherwise(0)
    return F.date_sub(date, back)


def within_day(ts: Column, now: Column) -> Column:
    """Whether ts (ns) is at most 24 hours before now and not after it."""
    return (ts <= now) & (now - ts < 86400 * 10**9)


def leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def session_start(session: str, utc: Column, following: bool = True) -> Column:
    """The session's next (or last) opening at or after (at or before) a UTC timestamp; weekends are skipped; summer time is the zone's."""
    return _session(session, utc, 1, following)


def session_end(session: str, utc: Column, following: bool = True) -> Column:
    return _session(session, utc, 2, following)


def _session(session: str, utc: Column, which: int, following: bool) -> Column:
    zone, hour = SESSIONS[session][0], SESSIONS[session][which]
    local = F.from_utc_timestamp(utc, zone)
    day = F.to_date(local)
    at = day.cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS")
    if following:
        d = F.when(local > at, F.date_add(day, 1)).otherwise(day)
        d = F.when(F.dayofweek(d) == 7, F.date_add(d, 2)).when(F.dayofweek(d) == 1, F.date_add(d, 1)).otherwise(d)
    else:
        d = last_weekday(F.when(local < at, F.date_sub(day, 1)).otherwise(day))
    return F.to_utc_timestamp(d.cast("timestamp") + F.expr(f"INTERVAL {hour} HOURS"), zone)
