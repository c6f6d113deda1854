"""From source files to one table of readings with weather."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.functions import timefns
from loadcurve.functions.coerce import coerce_flag, coerce_numeric, coerce_timestamp, parse_compact_date
from loadcurve.functions.columns import (
    drop_columns, lowercase_trim_columns, quoted, reorder_columns, require_column, resolve_column,
    resolve_columns_substring, select_renamed,
)
from loadcurve.functions.values import clip_unit, unit_to_kwh
from loadcurve.operators.aggregates import agg_weather_hourly
from loadcurve.operators.joins import join_holiday_calendar, join_weather_hour
from loadcurve.operators.normalize import normalize_minmax_columns, normalize_minmax_global
from loadcurve.operators.reshape import melt_slots, union_sources
from loadcurve.session import cut_lineage
from loadcurve.sources.readers import path_exists, scan_multi_file, scan_source


def _first_or_derived(df: DataFrame, candidates: Sequence[str], derived: Column) -> Column:
    found = resolve_column(df.columns, candidates)
    return derived if found is None else coerce_flag(df, found)


def standardize_readings(
    df: DataFrame,
    region: str,
    *,
    holidays: DataFrame | None = None,
    timestamp_formats: Sequence[str] = (),
) -> DataFrame:
    """The canonical projection of one source: resolved names, typed columns, hourly rows with weather.

    Usage and temperature that come raw are scaled over the source. Further columns are kept after
    the canonical ones.
    """
    columns = df.columns
    ts_name = resolve_column(columns, K.TIMESTAMP_FIRST) or require_column(
        columns, K.TIMESTAMP_OTHER, "timestamp"
    )
    building = require_column(columns, K.BUILDING, "building")
    usage_norm = resolve_column(columns, K.USAGE_NORM)
    usage_raw = usage_norm or require_column(columns, K.USAGE_RAW, "usage")
    temperature_norm = resolve_column(columns, K.TEMPERATURE_NORM)
    temperature_raw = temperature_norm or require_column(columns, K.TEMPERATURE_RAW, "temperature")
    precipitation = resolve_column(columns, K.PRECIPITATION)
    holiday_name = resolve_column(columns, K.IS_HOLIDAY)

    ts = coerce_timestamp(df, ts_name, timestamp_formats)
    resolved = df.withColumn("__ts", ts).where(
        F.col("__ts").isNotNull() & timefns.is_on_hour(F.col("__ts")) & F.col(quoted(building)).isNotNull()
    )
    t = F.col("__ts")
    canonical = {
        "building_name": F.col(quoted(building)).cast("string"),
        "full_timestamp": t,
        "usage_kwh_norm": coerce_numeric(df, usage_raw),
        "apparent_temperature_norm": coerce_numeric(df, temperature_raw),
        "precipitation": (
            F.lit(None).cast("double") if precipitation is None else coerce_numeric(df, precipitation)
        ),
        "is_day": _first_or_derived(df, K.IS_DAY, timefns.day_flag(t)),
        "is_weekend": _first_or_derived(df, K.IS_WEEKEND, timefns.weekend_flag(t)),
        "region": F.lit(region),
    }
    if holiday_name is not None:
        canonical["is_holiday"] = coerce_flag(df, holiday_name)
    extras = [F.col(quoted(c)) for c in columns if c not in {*canonical, "is_holiday"}]
    out = resolved.select(*[c.alias(n) for n, c in canonical.items()], *extras)
    raw = ["usage_kwh_norm"] * (usage_norm is None)
    raw += ["apparent_temperature_norm"] * (temperature_norm is None)
    if raw:
        out = normalize_minmax_columns(out, {c: c for c in raw})
    out = filter_weather_present(out)
    if holiday_name is None:
        out = join_holiday_calendar(out, holidays)
    out = out.withColumns(
        {c: clip_unit(F.col(c)) for c in ("usage_kwh_norm", "apparent_temperature_norm")}
    )
    return reorder_columns(out, K.READING_COLUMNS)


def filter_on_hour(df: DataFrame, ts: str = "full_timestamp") -> DataFrame:
    return df.where(timefns.is_on_hour(F.col(ts)))


def filter_weather_present(
    df: DataFrame, columns: Sequence[str] = ("usage_kwh_norm", "apparent_temperature_norm")
) -> DataFrame:
    """Rows with usage and weather; nothing is imputed."""
    return dropna_subset(df, columns)


def dropna_subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=[c for c in columns if c in df.columns])


def unify_sources(
    spark: SparkSession, sources: Sequence[tuple[str, str]], *, strict: bool = False, **options
) -> DataFrame:
    """Load, standardize and stack (path, region) sources; missing paths are left out, or an error if `strict`."""
    absent = [path for path, _ in sources if strict and not path_exists(spark, path)]
    if absent:
        raise FileNotFoundError(", ".join(absent))
    loaded = [(scan_source(spark, path), region) for path, region in sources]
    frames = [standardize_readings(df, region, **options) for df, region in loaded if df.columns]
    if not frames:
        raise ValueError("no source could be read")
    return union_sources(frames)


def _slot_minutes(name: str) -> int | None:
    """Minutes after midnight of a slot column `HH:mm`; `24:00` is 1440, the next day's midnight."""
    match = re.fullmatch(r"(\d{1,2}):(\d{1,2})", name.strip())
    if match is None:
        return None
    minutes = int(match[1]) * 60 + int(match[2])
    return minutes if int(match[2]) < 60 and minutes <= 1440 else None


def wide_to_long_usage(
    wide: DataFrame,
    holidays: DataFrame | None = None,
    *,
    region: str = "NSW",
    drop: Sequence[str] = ("source_file",),
) -> DataFrame:
    """Wide meter rows (one per station and day) to one row per slot, in kWh, with calendar columns."""
    lower = lowercase_trim_columns(drop_columns(wide, drop))
    # The date is read once per wide row, before a row becomes many.
    dated = lower.withColumn("date", parse_compact_date(F.col("date"))).where(F.col("date").isNotNull())
    slots = {c: _slot_minutes(c) for c in lower.columns if c not in K.WIDE_ID_COLUMNS}
    labels = {c: m for c, m in slots.items() if m is not None}
    long = melt_slots(dated, K.WIDE_ID_COLUMNS, labels, slot="minutes", value="usage")
    typed = long.select(
        F.col(quoted("zone substation")).alias("building_name"),
        (
            F.col("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("minutes"))
        ).alias("full_timestamp"),
        unit_to_kwh(coerce_numeric(long, "usage"), F.col("unit")).alias("usage_kwh"),
    ).where(F.col("full_timestamp").isNotNull() & F.col("usage_kwh").isNotNull())
    t = F.col("full_timestamp")
    flagged = typed.withColumns(
        {"season": timefns.season_from_month(F.month(t)), "is_weekend": timefns.weekend_flag(t)}
    )
    return join_holiday_calendar(flagged, holidays, region=F.lit(region)).select(*K.LONG_USAGE_COLUMNS)


def merge_wide_files(
    spark: SparkSession, pattern: str, holidays: DataFrame | None = None, **scan_options
) -> DataFrame:
    """All wide meter files of a glob as one long usage table."""
    frames = scan_multi_file(spark, pattern, required=K.WIDE_ID_COLUMNS, **scan_options)
    long = [wide_to_long_usage(f, holidays) for f in frames]
    if not long:
        raise ValueError(f"no meter file could be read from {pattern}")
    return union_sources(long)


def prepare_weather(raw: DataFrame) -> DataFrame:
    """Hourly weather with scaled temperature from a raw weather table with fuzzy column names."""
    lower = lowercase_trim_columns(raw)
    picked = resolve_columns_substring(lower.columns, K.WEATHER_NEEDED)
    if picked is None:
        raise ValueError(f"weather columns {K.WEATHER_NEEDED} not found in {raw.columns}")
    named = select_renamed(lower, picked)
    typed = named.select(
        coerce_timestamp(named, "time").alias("time"),
        coerce_numeric(named, "apparent_temperature").alias("apparent_temperature"),
        coerce_numeric(named, "precipitation").alias("precipitation"),
        coerce_flag(named, "is_day").alias("is_day"),
    ).where(F.col("time").isNotNull())
    # Stored: its limits and the join read it, the raw weather is read once.
    hourly = cut_lineage(agg_weather_hourly(typed, "time"))
    return normalize_minmax_global(
        hourly, "apparent_temperature", "apparent_temperature_norm", constant_value=0.0
    )


def attach_weather(usage: DataFrame, raw_weather: DataFrame) -> DataFrame:
    """Long usage with hourly weather: scaled usage, rows on the hour that have weather."""
    typed = usage.withColumns(
        {
            "full_timestamp": coerce_timestamp(usage, "full_timestamp"),
            "usage_kwh": coerce_numeric(usage, "usage_kwh"),
        }
    ).dropna(subset=["full_timestamp", "usage_kwh"])
    scaled = normalize_minmax_global(typed, "usage_kwh", "usage_kwh_norm", constant_value=0.0)
    joined = join_weather_hour(filter_on_hour(scaled), prepare_weather(raw_weather), check_unique=False)
    kept = filter_weather_present(joined, ["apparent_temperature_norm"])
    trimmed = drop_columns(kept, ["season", "timestamp_hour", "usage_kwh", "apparent_temperature"])
    return reorder_columns(trimmed, K.WEATHER_JOINED_COLUMNS)
