"""Time expressions: UTC text, local days, unequal daily windows, freshness, rotation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OFFSET_HOURS = 8  # the local clock of windows and days
WINDOWS = ((2, 11, "morning"), (13, 16, "noon"), (20, 23, "peak"))
SKEW_SECONDS = 600


def utc_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_utc(text: Column) -> Column:
    """Only instants that name a zone; null otherwise."""
    return F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text)).otherwise(F.lit(None).cast("timestamp"))


def local(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def local_day(ts: Column, hours: int = OFFSET_HOURS) -> Column:
    return F.date_format(local(ts, hours), "yyyyMMdd")


def slot(ts: Column, windows: tuple[tuple[int, int, str], ...] = WINDOWS, hours: int = OFFSET_HOURS) -> Column:
    """``day-window`` of the local hour, null in the gaps: windows are unequal, so not ``window()``."""
    at = F.hour(local(ts, hours))
    name = F.lit(None).cast("string")
    for first, end, label in windows[::-1]:
        name = F.when((at >= first) & (at < end), label).otherwise(name)
    return F.when(name.isNotNull(), F.concat_ws("-", local_day(ts, hours), name))


def epoch(ts: Column) -> Column:
    return F.unix_timestamp(ts.cast("timestamp"))


def fresh(ts: Column, now: Column, max_hours: float, skew: int = SKEW_SECONDS) -> Column:
    """No older than ``max_hours`` and no more than ``skew`` seconds ahead."""
    return (epoch(now) - epoch(ts)).between(-skew, int(max_hours * 3600))


def rotation_due(last: Column, now: Column, every_days: int, hours: int = OFFSET_HOURS) -> Column:
    return last.isNull() | (F.datediff(F.to_date(local(now, hours)), F.to_date(local(last, hours))) >= every_days)
