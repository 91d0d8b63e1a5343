"""Timestamps as the record formats write them; every zone-less one is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import HALF_LIFE_DAYS, NO_TIME_PRIOR

FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]XXX",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]'Z'",
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSSSS][.SSSS][.SSS][.SS][.S]",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def from_text(text: Column | str) -> Column:
    """ISO text or a number (milliseconds over 1e12, else seconds); null if neither."""
    text = F.trim(_col(text))
    number = F.when(text.rlike(r"^-?\d+(\.\d+)?$"), text.cast("double"))
    epoch = F.timestamp_micros((F.when(F.abs(number) > 1e12, number * 1e3).otherwise(number * 1e6)).cast("long"))
    parsed = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in FORMATS))
    return F.coalesce(F.when(number.isNotNull(), epoch), parsed)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    return (F.unix_micros(_col(later)) - F.unix_micros(_col(earlier))) / F.lit(86_400_000_000.0)


def decay(now: Column | str, start: Column | str, created: Column | str) -> Column:
    """Score factor: halves each 30 days since the first known time, 0.25 without one."""
    known = F.coalesce(_col(start), _col(created))
    return F.when(known.isNull(), F.lit(NO_TIME_PRIOR)).otherwise(F.pow(F.lit(2.0), -days_between(now, known) / HALF_LIFE_DAYS))


def fill_span(start: Column | str, end: Column | str, fallback: Column | str) -> tuple[Column, Column]:
    """Start and end of a chunk: a missing end is the start, a missing start the file's time."""
    start, end, fallback = _col(start), _col(end), _col(fallback)
    return F.coalesce(start, fallback), F.when(start.isNull(), fallback).otherwise(F.coalesce(end, start))
