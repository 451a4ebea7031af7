"""Clocks and times as column expressions; times are seconds in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_clock(c: Column) -> Column:
    """Bare seconds, m:s or h:m:s, with decimal point or comma; anything else is 0."""
    parts = F.split(F.replace(F.btrim(c), F.lit(","), F.lit(".")), ":")
    values = F.transform(parts, lambda p: p.try_cast("double"))
    return F.coalesce(F.aggregate(values, F.lit(0.0), lambda a, v: a * 60 + v), F.lit(0.0))


def parse_time(c: Column) -> Column:
    """parse_clock, and 11分41秒, 1时2分3秒, 1时41 (1 h 41 min); null if it is none of these."""
    t = F.btrim(c)
    spoken = r"^(?:(\d+)时)?(?:(\d+)分)?(?:(\d+(?:\.\d+)?)(秒?))?$"
    part = lambda k: F.coalesce(F.regexp_extract(t, spoken, k).try_cast("double"), F.lit(0.0))
    bare_minutes = t.rlike(r"^\d+时\d+(\.\d+)?$")
    last = F.when(bare_minutes, F.floor(part(3)) * 60).otherwise(part(3))
    return F.when(t.rlike(r"^\d+(\.\d+)?(:\d+(\.\d+)?){0,2}$"), parse_clock(t)).when((t != "") & t.rlike(spoken), part(1) * 3600 + part(2) * 60 + last)


def _clock(t: Column, per_second: int, fmt: str) -> Column:
    n = F.rint(F.greatest(t, F.lit(0.0)) * per_second).cast("long")
    whole = F.floor(n / per_second)
    return F.format_string(fmt, F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60, n % per_second)


def srt_clock(t: Column) -> Column:
    return _clock(t, 1000, "%02d:%02d:%02d,%03d")


def ass_clock(t: Column) -> Column:
    return _clock(t, 100, "%d:%02d:%02d.%02d")


def shift_time(c: Column, d: Column) -> Column:
    return F.greatest(F.round(c + d, 2), F.lit(0.0))


def in_window(t: Column, start: Column, end: Column) -> Column:
    return (start.isNull() | (t >= start)) & (end.isNull() | (t <= end))


def sample_times(start: Column, end: Column) -> Column:
    """End less 0.2, middle and start plus 0.2, not below 0, each 0.2 or more from those before it."""
    at = F.transform(F.array(end - 0.2, (start + end) / 2, start + 0.2), lambda x: F.greatest(x, F.lit(0.0)))
    return F.aggregate(at, F.array().cast("array<double>"), lambda a, x: F.when(F.exists(a, lambda y: F.abs(y - x) < 0.2), a).otherwise(F.array_append(a, x)))
