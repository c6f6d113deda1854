"""The given tables in the shapes of this package: readings, weather, wide meter rows, features.

Later stages read the tables of earlier ones from storage, as a pipeline does between its jobs; they
are written once per session and input folder, to the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.functions import timefns
from loadcurve.operators.joins import join_holiday_calendar, join_weather_hour
from loadcurve.operators.normalize import normalize_minmax_global
from loadcurve.plans.features import build_features
from loadcurve.plans.models import forecast_naive
from loadcurve.session import scratch_path

SLOTS = [f"{h:02d}:00" for h in range(1, 25)]

_stored: dict[tuple[str, str, str], str] = {}


def source(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def stored(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The named table of this session and folder, written on first use."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _stored:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per building and hour, with raw usage."""
    user = F.col("user_id")
    return (
        source(spark, sf, "events")
        .groupBy(
            F.concat(F.lit("b"), user.cast("string")).alias("building_name"),
            timefns.floor_hour(F.col("ts")).alias("full_timestamp"),
            F.when(user % 2 == 0, F.lit("NSW")).otherwise(F.lit("LCL")).alias("region"),
        )
        .agg(F.sum("value").alias("usage_kwh"))
    )


def weather_events(spark: SparkSession, sf: str) -> DataFrame:
    """Weather observations: one row per event, several per hour."""
    return source(spark, sf, "events").select(
        F.col("ts").alias("time"),
        F.regexp_extract("props", "[0-9]+", 0).cast("double").alias("apparent_temperature"),
        F.when(F.col("event_type") == "error", F.col("value")).otherwise(F.lit(0.0)).alias("precipitation"),
        timefns.day_flag(F.col("ts")).alias("is_day"),
    )


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """One row per hour."""
    return (
        weather_events(spark, sf)
        .groupBy(timefns.floor_hour(F.col("time")).alias("timestamp_hour"))
        .agg(
            F.avg("apparent_temperature").alias("apparent_temperature"),
            F.sum("precipitation").alias("precipitation"),
            F.max("is_day").alias("is_day"),
        )
    )


def weather_norm(spark: SparkSession, sf: str) -> DataFrame:
    scaled = normalize_minmax_global(
        weather(spark, sf), "apparent_temperature", "apparent_temperature_norm"
    )
    return scaled.drop("apparent_temperature")


def unified_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Readings with weather and calendar flags, built from the events."""
    scaled = normalize_minmax_global(readings(spark, sf), "usage_kwh", "usage_kwh_norm")
    joined = join_weather_hour(scaled, weather_norm(spark, sf), check_unique=False)
    flagged = joined.withColumn("is_weekend", timefns.weekend_flag(F.col("full_timestamp")))
    return join_holiday_calendar(flagged).select(*K.READING_COLUMNS)


def unified(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "unified", lambda: unified_plan(spark, sf))


def features_plan(spark: SparkSession, sf: str, **options) -> DataFrame:
    # Readings are grouped by building and hour, so no building has two rows in one hour.
    return build_features(unified(spark, sf), unique_hours=True, **options)


def features(spark: SparkSession, sf: str) -> DataFrame:
    return stored(spark, sf, "features", lambda: features_plan(spark, sf))


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Persistence forecasts of all feature rows."""
    return forecast_naive(features(spark, sf)).select(
        "region", "building_name", "full_timestamp", F.col("y_next").alias("y_true"), "y_pred"
    )


def wide_readings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per station and day, one column per hour ending; midnight is `24:00` of the day before."""
    ts, user = F.col("ts"), F.col("user_id")
    midnight = F.hour(ts) == 0
    day = F.when(midnight, F.date_sub(ts.cast("date"), 1)).otherwise(ts.cast("date"))
    slot = F.when(midnight, F.lit("24:00")).otherwise(
        F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":00"))
    )
    unit = F.when(user % 3 == 0, F.lit("KWH")).when(user % 3 == 1, F.lit("kw")).otherwise(F.lit("MW"))
    return (
        source(spark, sf, "events")
        .select(
            F.year(day).cast("string").alias("Year"),
            F.concat(F.lit("Station "), user.cast("string")).alias("Zone Substation"),
            F.upper(F.date_format(day, "ddMMMyyyy")).alias("Date"),
            unit.alias("Unit"),
            slot.alias("slot"),
            "value",
        )
        .groupBy("Year", "Zone Substation", "Date", "Unit")
        .pivot("slot", SLOTS)
        .agg(F.round(F.sum("value"), 6))
    )


def weather_text_file(spark: SparkSession, sf: str) -> str:
    """A weather CSV with lines before its header, written from the hourly weather; returns its folder."""
    w = weather(spark, sf)
    time = F.date_format("timestamp_hour", "yyyy-MM-dd'T'HH:mm")
    cells = [time, F.col("apparent_temperature"), F.col("precipitation"), F.col("is_day")]
    body = w.select(
        F.unix_date(F.col("timestamp_hour").cast("date")).alias("day"),
        F.concat_ws(",", *[c.cast("string") for c in cells]).alias("line"),
    )
    preamble = [
        (-4, "latitude,longitude,elevation"),
        (-3, "-33.9,151.2,25.0"),
        (-2, ""),
        (-1, "time,apparent_temperature (C),precipitation (mm),is_day ()"),
    ]
    head = spark.createDataFrame(preamble, "day int, line string")
    path = scratch_path(spark, "weather_text")
    # Hourly weather is a few thousand rows a year: one file.
    head.unionByName(body).orderBy("day", "line").select("line").coalesce(1).write.text(path)
    return path
