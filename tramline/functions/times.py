"""Dates and times of day as the feed format writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(c: Column) -> Column:
    """Date from exactly eight ASCII digits that name a real day."""
    return F.when(c.rlike(r"^[0-9]{8}$"), F.try_to_date(c, "yyyyMMdd"))


def as_seconds(c: Column) -> Column:
    """Seconds from H:MM:SS with one to three hour digits; hours may pass 24."""
    ok = c.rlike(r"^([0-9]{1,3}|\+[0-9]{1,2}):([0-5][0-9]|\+[0-9]):([0-5][0-9]|\+[0-9])$")
    hours = F.substring_index(c, ":", 1)
    after = F.length(hours)  # minutes take two characters, and seconds the rest
    part = [x.try_cast("bigint") for x in (hours, F.substring(c, after + 2, F.lit(2)), F.substring(c, after + 5, F.length(c)))]
    return F.when(ok, part[0] * 3600 + part[1] * 60 + part[2])


def as_seconds_lenient(c: Column) -> Column:
    """The editor's form: one-digit minutes and seconds and plain numbers of seconds too."""
    text = F.trim(c.cast("string"))
    part = [F.split(text, ":").getItem(k).try_cast("bigint") for k in range(3)]
    clock = F.when(text.rlike(r"^[0-9]+:[0-9]{1,2}:[0-9]{1,2}$") & (part[1] <= 59) & (part[2] <= 59), part[0] * 3600 + part[1] * 60 + part[2])
    return F.coalesce(clock, F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint")))


def clock(seconds: Column) -> Column:
    """HH:MM:SS; hours may pass 24."""
    s = seconds.cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("bigint"), F.pmod(s, F.lit(60)))


def covers(start: Column, end: Column, day: Column) -> Column:
    """True if the window covers the day; an unknown end is open."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))
