"""Joins of readings with weather, holidays, regions and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.functions import timefns
from loadcurve.functions.columns import shared_entity_keys
from loadcurve.operators.holidays import STANDING_YEARS, calendar_of_region, is_holiday_by_rule, standing_calendar
from loadcurve.operators.sized import assert_unique_key, join_lookup


__all__ = [
    "assert_unique_key", "cross_join_grid", "join_building_region", "join_holiday_calendar",
    "join_preds_features", "join_weather_hour", "repeated_keys", "semi_join_keys", "unscored_entities",
]


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys that repeat, with their row counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def join_weather_hour(
    readings: DataFrame, weather: DataFrame, *, ts: str = "full_timestamp", check_unique: bool = True
) -> DataFrame:
    """Many readings to the one weather row of their hour (and region, when weather has one).

    Readings without weather are left out.
    """
    keys = ["timestamp_hour"] + (["region"] if {"region"} <= set(readings.columns) & set(weather.columns) else [])
    overlap = [c for c in weather.columns if c in readings.columns and c not in keys]
    keyed = readings.drop(*overlap).withColumn("timestamp_hour", timefns.floor_hour(F.col(ts)))
    return join_lookup(keyed, weather, keys, unique=check_unique)


def join_holiday_calendar(
    df: DataFrame,
    holidays: DataFrame | None = None,
    *,
    ts: str = "full_timestamp",
    region: Column | None = None,
    out: str = "is_holiday",
) -> DataFrame:
    """Flag rows whose date is a holiday of their region (NSW, else GB).

    `holidays` is a dimension of (calendar, holiday_date). By default it is the standing calendar
    of 1900 to 2199, a fixed table of about 9,000 rows, so the data are not read for it; dates
    of other years are worked out row by row from the same rules.
    """
    own = holidays is not None
    holidays = holidays if own else standing_calendar(df.sparkSession)
    marked = holidays.select(
        F.col("calendar").alias("__calendar"), F.col("holiday_date").alias("__day"), F.lit(1).alias("__hit")
    )
    marked = marked.distinct() if own else marked
    region = F.col("region") if region is None else region
    keyed = df.withColumns({"__calendar": calendar_of_region(region), "__day": F.col(ts).cast("date")})
    keys = ["__calendar", "__day"]
    joined = join_lookup(keyed, marked, keys, "left") if own else keyed.join(F.broadcast(marked), keys, "left")
    hit = F.coalesce(F.col("__hit"), F.lit(0))
    if not own:
        standing = F.year("__day").between(*STANDING_YEARS) | F.col("__day").isNull()
        hit = F.when(standing, hit).otherwise(is_holiday_by_rule(F.col("__calendar"), F.col("__day")).cast("int"))
    return (
        joined.withColumn(out, hit)
        .drop("__calendar", "__day", "__hit")
    )


def semi_join_keys(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs in `wanted`."""
    return df.join(wanted.select(*keys), list(keys), "left_semi")


def join_preds_features(
    predictions: DataFrame,
    features: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Predictions with the named feature columns (those that exist); predictions are all kept."""
    keys = list(keys or [*shared_entity_keys(predictions, features), "full_timestamp"])
    wanted = [c for c in columns if c in features.columns and c not in predictions.columns]
    return predictions.join(features.select(*keys, *wanted), list(keys), "left")


def join_building_region(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Attach `region` to results that name a building only; where names repeat over regions, carry the region instead."""
    return join_lookup(df, mapping.select("building_name", "region"), ["building_name"], "left")


def cross_join_grid(df: DataFrame, values: Sequence[float], column: str) -> DataFrame:
    """Every row once per grid value; the grid is a short literal list, so rows stay where they are."""
    grid = F.array(*[F.lit(float(v)) for v in values])
    return df.drop(column).withColumn(column, F.explode(grid))


def unscored_entities(
    inputs: DataFrame, scored: DataFrame, keys: Sequence[str] | None = None
) -> DataFrame:
    """Entities of the input that got no score."""
    keys = list(keys or shared_entity_keys(inputs, scored))
    return inputs.select(*keys).distinct().join(scored.select(*keys).distinct(), list(keys), "left_anti")
