"""Sync schedules: when a source is due next."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_MINUTES, DAY = 360, 1440


def next_sync(after: Column, anchor: Column, minutes: int = DEFAULT_MINUTES, time: str = "00:00") -> Column:
    """The first due time later than ``after``; due times start at ``anchor`` and are ``minutes`` apart.

    ``time`` (HH:MM, UTC session) only counts for frequencies of a day or more: due times then start at that time of the
    anchor's day. Null times give null.
    """
    if minutes < 1:
        raise ValueError(f"frequency of {minutes} minutes")
    hours, _, rest = time.partition(":")
    at = int(hours) * 60 + int(rest or 0)
    if not 0 <= at < DAY:
        raise ValueError(f"time of day {time!r}")
    start = F.unix_micros(F.date_trunc("day", anchor).cast("timestamp")) + at * 60_000_000 if minutes >= DAY else F.unix_micros(anchor.cast("timestamp"))
    step = minutes * 60_000_000
    since = F.unix_micros(after.cast("timestamp")) - start
    due = F.when(since < 0, start).otherwise(start + since - F.pmod(since, F.lit(step)) + step)
    return F.timestamp_micros(due)
