"""Time expressions. Instants are UTC wall clocks held as ``timestamp_ntz``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVICE_DAY_SHIFT_HOURS = 3  # fixed value: a service day ends at 3 o'clock
LOCAL_ZONE = "America/New_York"

ISO_INSTANT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
)
CLOCK = r"^\s*\d{1,3}:\d{2}:\d{2}\s*$"
MAX_CLOCK_DAYS = 42  # no clock time of that form is later: 999:99:99 is in the 42nd day


def iso_utc(text: Column) -> Column:
    """ISO-8601 text to a UTC instant; empty or unreadable text gives NULL.

    The pattern runs first because Spark also reads a bare year as an instant,
    and the cast goes through a zoned timestamp so that an offset is applied.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(ISO_INSTANT), trimmed).try_cast("timestamp_ltz").cast(
        "timestamp_ntz"
    )


def to_local(ts: Column, zone: str | None) -> Column:
    """The wall clock in ``zone`` for a UTC instant (unchanged when ``None``)."""
    if zone is None or zone == "UTC":
        return ts
    return F.from_utc_timestamp(ts.cast("timestamp"), zone).cast("timestamp_ntz")


def service_date(
    observed: Column, shift_hours: int = SERVICE_DAY_SHIFT_HOURS, zone: str | None = None
) -> Column:
    """Service day of an observation. The shift is taken from UTC unless ``zone`` is given."""
    return F.to_date(F.timestamp_add("HOUR", F.lit(-shift_hours), to_local(observed, zone)))


def hour_floor(ts: Column) -> Column:
    return F.date_trunc("HOUR", ts).cast("timestamp_ntz")


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Add ``day_of_week`` (1 = Sunday ... 7 = Saturday), ``hour`` and ``is_weekend``."""
    weekday = F.dayofweek(ts)
    return df.withColumns(
        {
            "day_of_week": weekday,
            "hour": F.hour(ts),
            "is_weekend": F.when(weekday.isin(1, 7), 1).otherwise(0),
        }
    )


def in_year(ts: Column, year: int) -> Column:
    """Year test as a half-open range, which prunes files; ``year(ts) = y`` does not."""
    start, end = (F.lit(f"{y}-01-01 00:00:00").cast("timestamp_ntz") for y in (year, year + 1))
    return (ts >= start) & (ts < end)


def as_instant(value: str | Column) -> Column:
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp_ntz")


def since(ts: Column, as_of: str | Column, days: int) -> Column:
    """Rows of the last ``days`` days before ``as_of`` (lower bound included)."""
    return ts >= F.timestamp_add("DAY", F.lit(-days), as_instant(as_of))


def until(ts: Column, as_of: str | Column) -> Column:
    """Rows up to ``as_of``, included."""
    return ts <= as_instant(as_of)


def before(ts: Column, as_of: str | Column, days: int) -> Column:
    return ts < F.timestamp_add("DAY", F.lit(-days), as_instant(as_of))


def weekday_name(ts: Column, zone: str | None = LOCAL_ZONE) -> Column:
    return F.date_format(to_local(ts, zone), "EEEE")


def month_name(ts: Column, zone: str | None = LOCAL_ZONE) -> Column:
    return F.date_format(to_local(ts, zone), "MMMM")


def season(ts: Column) -> Column:
    month = F.month(ts)
    return (
        F.when(month.isin(12, 1, 2), "Winter")
        .when(month.isin(3, 4, 5), "Spring")
        .when(month.isin(6, 7, 8), "Summer")
        .otherwise("Fall")
    )


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def local_display(
    ts: Column,
    zone: str = LOCAL_ZONE,
    standard: tuple[int, str] = (-300, "EST"),
    daylight: tuple[int, str] = (-240, "EDT"),
) -> Column:
    """``yyyy-MM-dd HH:mm:ss ZZZ`` in ``zone``; the suffix follows the offset in minutes."""
    local = to_local(ts, zone)
    offset = F.timestamp_diff("MINUTE", ts, local)
    suffix = F.when(offset == standard[0], standard[1]).when(offset == daylight[0], daylight[1])
    return F.concat_ws(" ", F.date_format(local, "yyyy-MM-dd HH:mm:ss"), suffix)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``, truncated towards zero."""
    return F.timestamp_diff("MINUTE", start, end)


def clock_on(day: Column, clock: Column) -> Column:
    """``HH:MM:SS`` on a service day; hours of 24 and more fall on the next day."""
    parts = F.split(F.when(clock.rlike(CLOCK), F.trim(clock)), ":")
    seconds = (
        F.element_at(parts, 1).cast("int") * 3600
        + F.element_at(parts, 2).cast("int") * 60
        + F.element_at(parts, 3).cast("int")
    )
    return F.timestamp_add("SECOND", seconds, day.cast("timestamp_ntz"))
