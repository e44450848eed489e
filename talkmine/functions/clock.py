"""Clock strings and seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_seconds(clock: Column, digits: bool = False) -> Column:
    """'m:ss' or 'h:mm:ss' to seconds; null where a part is no whole number or there are
    other than two or three parts.  `digits`: plain seconds are read too."""
    parts = F.split(F.trim(clock), ":")
    at = lambda k: F.trim(F.get(parts, F.lit(k))).try_cast("int")
    found = F.when(F.size(parts) == 2, at(0) * 60 + at(1)).when(F.size(parts) == 3, at(0) * 3600 + at(1) * 60 + at(2))
    return found.when(F.size(parts) == 1, at(0)) if digits else found


def chunk_clock(seconds: Column) -> Column:
    """'mm:ss', from an hour on 'hh:mm:ss'; fractions of seconds are cut."""
    s = seconds.cast("long")
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(short)


def line_clock(seconds: Column) -> Column:
    """'mm:ss' whose minutes don't roll over."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def progress_clock(seconds: Column) -> Column:
    """'m:ss' padded to two places, from an hour on 'h:mm:ss'; negative is 0."""
    s = F.greatest(F.lit(0), seconds.cast("long"))
    short = F.format_string("%02d:%02d", F.floor(s / 60), s % 60)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(short)


def clamp(value: Column, low, high, default=None) -> Column:
    """`value` as a number within bounds; `default` where it is none."""
    x = F.greatest(F.lit(low), F.least(F.lit(high), value.try_cast("double")))
    x = F.when(value.try_cast("double").isNotNull(), x)
    return x if default is None else F.coalesce(x, F.lit(float(default)))


def recommended(clock: Column, fallback: Column, duration: Column) -> Column:
    """A recommended time in seconds, the event's bound where it can't be read, within
    the recording."""
    s = F.coalesce(to_seconds(clock).cast("double"), fallback.cast("double"))
    return F.least(F.greatest(s, F.lit(0.0)), duration.cast("double"))
