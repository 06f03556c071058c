"""Seconds, frames and HH:MM:SS.mmm."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sec_to_hms(seconds: Column) -> Column:
    """HH:MM:SS.mmm; empty for null. Milliseconds are rounded after the minutes are split off, so 59.9996 shows 60.000."""
    s = seconds.cast("double")
    whole = F.floor(s / 60)
    return F.when(s.isNull(), "").otherwise(F.format_string("%02d:%02d:%06.3f", F.floor(s / 3600), F.pmod(whole, F.lit(60)), s - whole * 60))


def hms_to_sec(text: Column) -> Column:
    """Seconds of HH:MM:SS with a "." or "," before optional milliseconds; null for anything else."""
    pattern = r"^(\d+):(\d{1,2}):(\d{1,2})(?:[.,](\d{1,3}))?$"
    part = lambda k: F.nullif(F.regexp_extract(F.trim(text), pattern, k), F.lit("")).try_cast("double")
    millis = F.rpad(F.regexp_extract(F.trim(text), pattern, 4), 3, "0").try_cast("double")
    return part(1) * 3600 + part(2) * 60 + part(3) + millis / 1000


def sec_to_frame(seconds: Column, fps: Column) -> Column:
    return F.bround(seconds * fps).cast("long")


def frame_to_sec(frame: Column, fps: Column) -> Column:
    return F.try_divide(frame.cast("double"), fps.cast("double"))


def duration(start: Column, end: Column) -> Column:
    return F.greatest(F.lit(0.0), (end - start).cast("double"))


def bin_index(seconds: Column, width: float) -> Column:
    """The division form: floor(0.3 / 0.1) is 2."""
    return F.floor(seconds / F.lit(float(width))).cast("long")


def frame_time(timestamp: Column, frame: Column, fps: float = 30.0) -> Column:
    return F.coalesce(timestamp, F.coalesce(frame, F.lit(0.0)) / F.lit(fps))
