"""The two clocks: float seconds for people, integer microseconds for comparisons."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def us(seconds: Column) -> Column:
    """Microseconds, rounded half to even on the exact binary value."""
    return F.rint(seconds * 1_000_000).cast("long")


def seconds(micros: Column) -> Column:
    return micros / F.lit(1_000_000.0)


def timecode(micros: Column) -> Column:
    """HH:MM:SS.mmm with half-even milliseconds; hours grow beyond two digits."""
    ms = F.rint(micros / F.lit(1000.0)).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def plain_duration(seconds_: Column) -> Column:
    """HH:MM:SS.mmm of seconds whose milliseconds do not carry over: 59.9996 s shows as 00:00:60.000."""
    hours = F.floor(seconds_ / 3600).cast("int")
    minutes = F.floor((seconds_ - hours * 3600) / 60).cast("int")
    return F.format_string("%02d:%02d:%06.3f", hours, minutes, seconds_ - hours * 3600 - minutes * 60)


def parse_timecode(text: Column) -> Column:
    """Seconds of SS, MM:SS or HH:MM:SS; null for anything else, NaN and negatives included."""
    ok = text.rlike(r"^\s*(\d+:){0,2}\d+(\.\d+)?\s*$")
    parts = F.split(F.trim(text), ":")
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double"))
    return F.when(ok, total)


def parse_seconds(value: object) -> float:
    """The driver-side twin of parse_timecode, for annotation files; raises ValueError."""
    if isinstance(value, bool) or value is None:
        raise ValueError(f"not a timecode: {value!r}")
    if isinstance(value, (int, float)):
        total = float(value)
    else:
        parts = str(value).strip().split(":")
        if not 1 <= len(parts) <= 3:
            raise ValueError(f"not a timecode: {value!r}")
        total = 0.0
        for p in parts:
            total = total * 60 + float(p)
    if not math.isfinite(total) or total < 0:
        raise ValueError(f"not a timecode: {value!r}")
    return total


def epoch_us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))
