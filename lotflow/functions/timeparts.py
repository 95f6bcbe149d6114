"""Calendar parts, grid times and zone conversion."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotflow.domain import LOCAL_ZONE, STRICT_TS


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(day: Column) -> Column:
    """1 = Sunday ... 7 = Saturday."""
    return F.dayofweek(day)


def weekday_name(day: Column) -> Column:
    """``Mon`` ... ``Sun``."""
    return F.date_format(day, "E")


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def in_days(day: Column, days: list[date]) -> Column:
    """Whether the date is one of a listed set (holidays, special days)."""
    return F.to_date(day).isin(days)


def window_start(ts: Column, width: str = "15 minutes") -> Column:
    return F.window(ts, width).getField("start")


def grid_floor(ts: Column, minutes: int = 15) -> Column:
    """Start of the grid cell holding ``ts``, without grouping."""
    step = minutes * 60
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / F.lit(step)) * F.lit(step))


def shift(ts: Column, *, hours: int = 0, minutes: int = 0) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(minutes))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds; both ends are cut to seconds before the subtraction."""
    return F.unix_seconds(end) - F.unix_seconds(start)


def minutes_between(start: Column, end: Column) -> Column:
    return seconds_between(start, end) / F.lit(60.0)


def local_time(ts: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.from_utc_timestamp(ts, zone)


def previous_local_day(as_of: Column, zone: str = LOCAL_ZONE) -> Column:
    """The day before ``as_of`` on the local calendar: what a nightly job processes."""
    return F.date_sub(F.to_date(local_time(as_of, zone)), 1)


def end_of_day(ts: Column) -> Column:
    """23:59:59 of the day of ``ts``."""
    return F.date_trunc("day", ts) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")


def strict_ts(text: Column) -> Column:
    """Text in the one exact layout, else null."""
    return F.try_to_timestamp(text, F.lit(STRICT_TS))


ISO_WITH_ZONE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})$"


def iso_ts(text: Column) -> Column:
    """ISO-8601 text with a zone, else null; text without a zone is not an instant."""
    return F.when(text.rlike(ISO_WITH_ZONE), text.try_cast("timestamp"))
