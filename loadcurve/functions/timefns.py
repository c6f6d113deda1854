"""Calendar arithmetic on zone-free timestamps (`timestamp_ntz`), independent of the session zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loadcurve.constants import SOUTHERN_SEASONS

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _seconds_of_minute(ts: Column) -> Column:
    return F.extract(F.lit("SECOND"), ts)


def floor_hour(ts: Column) -> Column:
    return ts - F.make_dt_interval(F.lit(0), F.lit(0), F.minute(ts), _seconds_of_minute(ts))


def is_on_hour(ts: Column) -> Column:
    return (F.minute(ts) == 0) & (_seconds_of_minute(ts) == 0)


def next_hour(ts: Column) -> Column:
    return ts + F.expr("INTERVAL 1 HOUR")


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.expr(f"INTERVAL {hours} HOUR")


def epoch_hour(ts: Column) -> Column:
    """Whole hours since 1970, as bigint."""
    return (F.unix_date(ts.cast("date")).cast("bigint") * 24 + F.hour(ts)).cast("bigint")


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with fraction, as double."""
    return (
        epoch_hour(ts).cast("double") * 3600
        + F.minute(ts).cast("double") * 60
        + _seconds_of_minute(ts).cast("double")
    )


def from_epoch_seconds(seconds: Column) -> Column:
    """Inverse of `epoch_seconds`, to the microsecond."""
    return F.expr(_EPOCH) + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.round(seconds, 6).cast("decimal(18,6)")
    )


def floor_day(ts: Column) -> Column:
    return ts.cast("date").cast("timestamp_ntz")


def week_start(ts: Column) -> Column:
    """Monday 00:00 of the week."""
    return F.date_sub(ts.cast("date"), F.weekday(ts)).cast("timestamp_ntz")


def calendar_parts(ts: Column) -> dict[str, Column]:
    """hour 0-23, day_of_week with Monday = 0, month 1-12."""
    return {
        "hour": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "month": F.month(ts),
    }


def season_from_month(month: Column, hemisphere: str = "south") -> Column:
    """Season name; the northern map is the southern one shifted by six months."""
    if hemisphere not in ("south", "north"):
        raise ValueError(f"unknown hemisphere {hemisphere!r}")
    local = month if hemisphere == "south" else (month + 5) % 12 + 1
    result = F
    for season, months in SOUTHERN_SEASONS.items():
        result = result.when(local.isin(months), F.lit(season))
    return result


def weekend_flag(ts: Column) -> Column:
    return (F.weekday(ts) >= 5).cast("int")


def day_flag(ts: Column) -> Column:
    """1 from 06:00 to the hour of 18:00, both included."""
    return F.hour(ts).between(6, 18).cast("int")


def slot_minutes(clock: Column) -> Column:
    """Minutes after midnight of `HH:mm` text, 1440 for `24:00`; NULL when it is no such time."""
    text = F.trim(clock)
    hours = F.substring_index(text, ":", 1).try_cast("int")
    minutes = F.substring_index(text, ":", -1).try_cast("int")
    valid = (
        (F.length(text) <= 5)
        & text.contains(":")
        & minutes.between(0, 59)
        & (hours.between(0, 23) | ((hours == 24) & (minutes == 0)))
    )
    return F.when(valid, hours * 60 + minutes)


def timestamp_2400_rollover(day: Column, clock: Column) -> Column:
    """Date plus `HH:mm` text, where `24:00` is midnight of the next day."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), slot_minutes(clock))
