"""Seconds, milliseconds and timecodes. ``rint`` is used throughout: halves go to even."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_ms(seconds: Column) -> Column:
    return F.rint(seconds * 1000).cast("bigint")


def format_ms(ms: Column) -> Column:
    """``HH:MM:SS,mmm``; below zero is zero, hours may have more digits."""
    ms = F.greatest(ms, F.lit(0))
    div = lambda a, b: F.floor(a / b)
    return F.format_string("%02d:%02d:%02d,%03d", div(ms, 3_600_000), div(ms % 3_600_000, 60_000), div(ms % 60_000, 1000), ms % 1000)


def parse_ms(code: Column) -> Column:
    """Milliseconds of a timecode with ``,`` or ``.`` before one to three digits; null if it is none."""
    part = lambda i: F.nullif(F.regexp_extract(code, r"(\d+):(\d{1,2}):(\d{1,2})[,.](\d{1,3})", i), F.lit(""))
    return part(1).cast("bigint") * 3_600_000 + part(2).cast("bigint") * 60_000 + part(3).cast("bigint") * 1000 + F.rpad(part(4), 3, "0").cast("bigint")


def duration_seconds(field: Column, tag: Column) -> Column:
    """A stream's duration: its own field, else an ``H:M:S.f`` tag."""
    parts = F.split(tag, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    return F.coalesce(field.try_cast("double"), F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2)))


def frame_rate(average: Column, real: Column, default: float = 24.0) -> Column:
    """The first of two ``a/b`` rates within 1 to 240, else ``default``."""

    def rate(c: Column) -> Column:
        value = F.try_divide(F.get(F.split(c, "/"), F.lit(0)).try_cast("double"), F.coalesce(F.nullif(F.get(F.split(c, "/"), F.lit(1)), F.lit("")), F.lit("1")).try_cast("double"))
        return F.when(value.between(1.0, 240.0), value)

    return F.coalesce(rate(average), rate(real), F.lit(default))


def minute_of_day(clock: Column) -> Column:
    """Minutes of ``H:MM``."""
    return F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 1).try_cast("int") * 60 + F.regexp_extract(clock, r"^(\d{1,2}):(\d{2})$", 2).try_cast("int")


def in_window(minute: Column, start: Column, end: Column) -> Column:
    """Whether a minute lies in [start, end), which may cross midnight; without a window always."""
    inside = F.when(start <= end, (minute >= start) & (minute < end)).otherwise((minute >= start) | (minute < end))
    return F.coalesce(inside, F.lit(True))
