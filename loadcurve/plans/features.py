"""The feature table for training, and the newest feature row per building for scoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve import constants as K
from loadcurve.functions import timefns
from loadcurve.functions.coerce import coerce_flag, coerce_numeric, coerce_timestamp
from loadcurve.functions.columns import entity_keys, quoted, reorder_columns, require_column, resolve_column
from loadcurve.functions.values import region_default
from loadcurve.operators.aggregates import agg_weather_hourly
from loadcurve.operators.joins import join_holiday_calendar, join_weather_hour
from loadcurve.operators.normalize import (
    encode_region, normalize_minmax_entity, normalize_minmax_global, region_dimension,
)
from loadcurve.operators.series import window_over_hours, window_over_series

FALLBACK_TEMPERATURE = 0.5
FALLBACK_PRECIPITATION = 0.0


def lag_columns(
    w: WindowSpec, usage: str = "usage_pb", temperature: str | None = "apparent_temperature_norm",
    target: bool = True,
) -> dict[str, Column]:
    """Lags, rolling mean and target over row positions."""
    day = w.rowsBetween(-K.ROLLING_ROWS, -1)
    columns = {
        "lag_1h": F.lag(usage, 1).over(w),
        "lag_24h": F.lag(usage, 24).over(w),
        "rollmean_24h": F.when(
            F.count(usage).over(day) == K.ROLLING_ROWS, F.avg(usage).over(day)
        ),
    }
    if temperature:
        columns["temp_lag_1h"] = F.lag(temperature, 1).over(w)
        columns["temp_lag_24h"] = F.lag(temperature, 24).over(w)
    if target:
        columns[K.TARGET] = F.lead(usage, 1).over(w)
    return columns


def lag_columns_by_hours(
    w: WindowSpec, usage: str = "usage_pb", temperature: str | None = "apparent_temperature_norm",
    target: bool = True,
) -> dict[str, Column]:
    """The same by elapsed hours: a lag is NULL when that very hour is absent."""

    def at(name: str, hours: int) -> Column:
        return F.max(name).over(w.rangeBetween(hours, hours))

    day = w.rangeBetween(-K.ROLLING_ROWS, -1)
    columns = {
        "lag_1h": at(usage, -1),
        "lag_24h": at(usage, -24),
        "rollmean_24h": F.when(
            F.count(usage).over(day) == K.ROLLING_ROWS, F.avg(usage).over(day)
        ),
    }
    if temperature:
        columns["temp_lag_1h"] = at(temperature, -1)
        columns["temp_lag_24h"] = at(temperature, -24)
    if target:
        columns[K.TARGET] = at(usage, 1)
    return columns


def add_lags(
    df: DataFrame,
    keys: Sequence[str],
    *,
    ts: str = "full_timestamp",
    mode: str = "rows",
    usage: str = "usage_pb",
    temperature: str | None = "apparent_temperature_norm",
    target: bool = True,
    **series_options,
) -> DataFrame:
    """Add lag, rolling-mean and target columns: `mode="rows"` by position, `"hours"` by elapsed time.

    By hours, the value of an hour with several rows is their highest; with `unique_hours=True`
    (no such hour) the rows need not be combined first.
    """
    ahead = 1 if target else 0
    if mode == "hours":
        def by_hours(frame: DataFrame, time: str) -> DataFrame:
            return window_over_hours(
                frame, keys, time, lambda w: lag_columns_by_hours(w, usage, temperature, target),
                before=K.ROLLING_ROWS, after=ahead,
            )

        if series_options.get("unique_hours"):
            return by_hours(df, ts)
        hourly = df.withColumn("__at", timefns.floor_hour(F.col(ts)))
        measured = [usage] + ([temperature] if temperature else [])
        per_hour = hourly.groupBy(*keys, "__at").agg(*[F.max(c).alias(c) for c in measured])
        return hourly.join(by_hours(per_hour, "__at").drop(*measured), [*keys, "__at"]).drop("__at")
    if mode != "rows":
        raise ValueError(f"unknown lag mode {mode!r}")
    ties = [usage] + ([temperature] if temperature else [])
    return window_over_series(
        df, keys, ts, lambda w: lag_columns(w, usage, temperature, target),
        before=K.ROLLING_ROWS, after=ahead, ties=ties, **series_options,
    )


def build_features(
    readings: DataFrame,
    *,
    mode: str = "rows",
    region_in_key: bool = True,
    hemisphere: str = "south",
    fit_until: str | None = None,
    regions: DataFrame | None = None,
    **series_options,
) -> DataFrame:
    """Feature rows with next-hour target from unified readings.

    `fit_until` limits the per-building scaling to rows up to that time, so that later data do not
    reach earlier features. `regions` is a stored region dimension. Pass `unique_hours=True` when
    no building has two rows in one hour; otherwise series lengths are counted first.
    """
    typed = typed_readings(readings)
    keys = entity_keys(typed, region_in_key)
    region_ids = region_dimension(typed) if regions is None else regions
    fit_where = None
    if fit_until is not None:
        fit_where = F.col("full_timestamp") <= F.lit(fit_until).cast("timestamp_ntz")
    scaled = normalize_minmax_entity(
        typed, "usage_kwh_norm", "usage_pb", keys, fit_where=fit_where
    ).withColumnRenamed("usage_kwh_norm", "usage_kwh_norm_orig")
    return finished_features(add_lags(scaled, keys, mode=mode, **series_options), region_ids, hemisphere)


def typed_readings(readings: DataFrame) -> DataFrame:
    """Readings with numbers, flags, region and time of the right types; rows without what features need are left out."""
    numeric = ["usage_kwh_norm", "apparent_temperature_norm", "precipitation"]
    flags = ["is_day", "is_holiday", "is_weekend"]
    coerced = {c: coerce_numeric(readings, c) for c in numeric if c in readings.columns}
    coerced |= {c: coerce_flag(readings, c) for c in flags if c in readings.columns}
    coerced["region"] = region_default(F.col("region") if "region" in readings.columns else None)
    if not isinstance(readings.schema["full_timestamp"].dataType, T.TimestampNTZType):
        coerced["full_timestamp"] = coerce_timestamp(readings, "full_timestamp")
    return readings.withColumns(coerced).dropna(subset=["building_name", "full_timestamp", "usage_kwh_norm", "apparent_temperature_norm"])


def finished_features(lagged: DataFrame, region_ids: DataFrame, hemisphere: str = "south") -> DataFrame:
    """Feature rows from readings with lags: complete ones, with calendar columns, in the order of the feature table."""
    complete = lagged.dropna(
        subset=["lag_1h", "lag_24h", "rollmean_24h", K.TARGET, "apparent_temperature_norm"]
    )
    calendar = timefns.calendar_parts(F.col("full_timestamp"))
    dated = complete.withColumns(calendar).withColumn(
        "season", timefns.season_from_month(F.col("month"), hemisphere)
    )
    return reorder_columns(encode_region(dated, region_ids), K.FEATURE_COLUMNS)


def load_weather(raw: DataFrame) -> DataFrame:
    """Hourly weather for scoring: scaled temperature (mean), precipitation (sum), daylight (max)."""
    lower = raw.toDF(*[c.strip().lower() for c in raw.columns])
    columns = lower.columns
    ts_name = require_column(columns, K.TIMESTAMP_FIRST + K.TIMESTAMP_OTHER, "time")
    norm = resolve_column(columns, K.TEMPERATURE_NORM[:1])
    temperature = norm or require_column(columns, K.TEMPERATURE_RAW, "temperature")
    precipitation = resolve_column(columns, ["precipitation", "precip", "rain"])
    is_day = resolve_column(columns, K.IS_DAY)
    time = coerce_timestamp(lower, ts_name)
    typed = lower.select(
        time.alias("time"),
        coerce_numeric(lower, temperature).alias("apparent_temperature_norm"),
        (
            F.lit(FALLBACK_PRECIPITATION) if precipitation is None else coerce_numeric(lower, precipitation)
        ).alias("precipitation"),
        (timefns.day_flag(time) if is_day is None else coerce_flag(lower, is_day)).alias("is_day"),
    ).where(F.col("time").isNotNull())
    if norm is None:
        typed = normalize_minmax_global(
            typed, "apparent_temperature_norm", "apparent_temperature_norm", floor=K.ENTITY_FLOOR
        )
    return agg_weather_hourly(typed, "time", temperature="apparent_temperature_norm")


def weather_fallback(df: DataFrame, ts: str = "full_timestamp") -> DataFrame:
    """Constant weather where a frame has none: middle temperature, no rain, daylight by hour."""
    defaults = {
        "apparent_temperature_norm": F.lit(FALLBACK_TEMPERATURE),
        "precipitation": F.lit(FALLBACK_PRECIPITATION),
        "is_day": timefns.day_flag(F.col(ts)),
    }
    return df.withColumns({n: c for n, c in defaults.items() if n not in df.columns})


def _scoring_readings(usage: DataFrame, region: str, weather: DataFrame | None) -> DataFrame:
    columns = usage.columns
    ts_name = require_column(columns, K.TIMESTAMP_FIRST + K.TIMESTAMP_OTHER, "timestamp")
    building = require_column(columns, K.BUILDING_SCORING, "building")
    usage_norm = resolve_column(columns, K.USAGE_NORM_SCORING)
    usage_name = usage_norm or require_column(columns, K.USAGE_RAW, "usage")
    temperature_norm = resolve_column(columns, K.TEMPERATURE_NORM[:1])
    temperature = temperature_norm or resolve_column(columns, K.TEMPERATURE_RAW)
    precipitation = resolve_column(columns, ["precipitation", "precip", "rain"])

    out = {
        "building_name": F.col(quoted(building)).cast("string"),
        "full_timestamp": coerce_timestamp(usage, ts_name),
        "usage_kwh_norm": coerce_numeric(usage, usage_name),
        "region": region_default(F.col("region") if "region" in columns else None, region),
    }
    for flag in ("is_weekend", "is_holiday"):
        if flag in columns:
            out[flag] = coerce_flag(usage, flag)
    if weather is None and temperature is not None:
        out["apparent_temperature_norm"] = coerce_numeric(usage, temperature)
        if precipitation is not None:
            out["precipitation"] = coerce_numeric(usage, precipitation)
        is_day = resolve_column(columns, K.IS_DAY)
        if is_day is not None:
            out["is_day"] = coerce_flag(usage, is_day)
    df = usage.select(*[c.alias(n) for n, c in out.items()]).where(F.col("full_timestamp").isNotNull())
    if usage_norm is None:
        df = normalize_minmax_global(df, "usage_kwh_norm", "usage_kwh_norm", floor=K.ENTITY_FLOOR)
    if weather is not None:
        return join_weather_hour(df, weather).drop("timestamp_hour")
    if temperature is None:
        return weather_fallback(df)
    if temperature_norm is None:
        df = normalize_minmax_global(
            df, "apparent_temperature_norm", "apparent_temperature_norm", floor=K.ENTITY_FLOOR
        )
    embedded = agg_weather_hourly(
        weather_fallback(df), "full_timestamp", temperature="apparent_temperature_norm",
        by=["region"], precipitation_rule="max",
    )
    return join_weather_hour(df, embedded, check_unique=False).drop("timestamp_hour")


def latest_per_entity(
    df: DataFrame, keys: Sequence[str] | None = None, ts: str = "full_timestamp"
) -> DataFrame:
    """The newest row of each entity, as an aggregate (no sort)."""
    keys = list(keys or entity_keys(df))
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), F.struct(F.col(ts), *[F.col(c) for c in rest if c != ts])).alias("r")
    )
    return newest.select(*keys, "r.*")


def prediction_features(
    usage: DataFrame,
    region: str = "NSW",
    weather: DataFrame | None = None,
    *,
    regions: DataFrame | None = None,
    holidays: DataFrame | None = None,
    mode: str = "rows",
    **series_options,
) -> DataFrame:
    """One feature row per building, for its newest hour with a full day of history.

    `weather` is an hourly table from `load_weather`; without it weather comes from the usage
    frame, or is constant if there is none.
    """
    df = _scoring_readings(usage, region, weather)
    df = df.where(
        timefns.is_on_hour(F.col("full_timestamp")) & F.col("apparent_temperature_norm").isNotNull()
    )
    if "is_weekend" not in df.columns:
        df = df.withColumn("is_weekend", timefns.weekend_flag(F.col("full_timestamp")))
    if "is_holiday" not in df.columns:
        df = join_holiday_calendar(df, holidays)
    keys = entity_keys(df)
    region_ids = region_dimension(df) if regions is None else regions
    scaled = normalize_minmax_entity(df, "usage_kwh_norm", "usage_pb", keys)
    lagged = add_lags(scaled, keys, mode=mode, target=False, **series_options)
    valid = lagged.dropna(subset=["lag_1h", "lag_24h", "rollmean_24h"])
    last = encode_region(latest_per_entity(valid, keys), region_ids)
    t = F.col("full_timestamp")
    return last.withColumns(
        timefns.calendar_parts(t)
        | {"timestamp_last": t, "timestamp_next": timefns.next_hour(t)}
    )
