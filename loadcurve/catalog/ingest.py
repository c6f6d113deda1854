"""Queries for sources, sinks, unions and wide-to-long (survey 2.1 and 2.8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.catalog.ctes import cte, sql
from loadcurve.catalog.registry import query, r6, rounded, sql_r6
from loadcurve.functions.columns import quoted
from loadcurve.operators.aggregates import metric_mae_rmse
from loadcurve.operators.reshape import melt_wide_readings, union_sources
from loadcurve.plans.unify import (
    attach_weather, merge_wide_files, standardize_readings, unify_sources, wide_to_long_usage,
)
from loadcurve.session import scratch_path
from loadcurve.sources import fixtures as fx
from loadcurve.sources import heads, readers, writers

_SLOT_SUMS = ", ".join(
    f"round(sum(CASE WHEN slot = '{s}' THEN value END), 6) AS \"{s}\"" for s in fx.SLOTS
)
cte("wide_events", """
SELECT user_id, value,
       CASE WHEN hour(ts) = 0 THEN CAST(ts AS DATE) - 1 ELSE CAST(ts AS DATE) END AS d,
       CASE WHEN hour(ts) = 0 THEN '24:00' ELSE lpad(CAST(hour(ts) AS VARCHAR), 2, '0') || ':00' END AS slot,
       CASE user_id % 3 WHEN 0 THEN 'KWH' WHEN 1 THEN 'kw' ELSE 'MW' END AS unit
FROM events
""")
cte("wide", f"""
SELECT CAST(year(d) AS VARCHAR) AS year, 'Station ' || user_id AS zone_substation, d,
       upper(strftime(d, '%d%b%Y')) AS date, unit, {_SLOT_SUMS}
FROM wide_events GROUP BY ALL
""")
cte("long_slots", """
SELECT zone_substation, d, date, unit, slot, round(sum(value), 6) AS usage
FROM (SELECT *, 'Station ' || user_id AS zone_substation, upper(strftime(d, '%d%b%Y')) AS date FROM wide_events)
GROUP BY ALL
""")
cte("long_usage", """
SELECT zone_substation AS building_name,
       CASE WHEN slot = '24:00' THEN CAST(d + 1 AS TIMESTAMP)
            ELSE d + to_hours(CAST(left(slot, 2) AS INTEGER)) END AS full_timestamp,
       CASE upper(unit) WHEN 'KW' THEN usage * 0.25 WHEN 'MW' THEN usage * 1000 * 0.25 ELSE usage END AS usage_kwh
FROM long_slots
""")
cte("long_flagged", """
SELECT l.*, CASE WHEN month(full_timestamp) IN (12, 1, 2) THEN 'Summer'
                 WHEN month(full_timestamp) IN (3, 4, 5) THEN 'Autumn'
                 WHEN month(full_timestamp) IN (6, 7, 8) THEN 'Winter' ELSE 'Spring' END AS season,
       CAST(h.holiday_date IS NOT NULL AS INTEGER) AS is_holiday,
       CAST(isodow(full_timestamp) >= 6 AS INTEGER) AS is_weekend
FROM long_usage l LEFT JOIN holidays h
  ON h.calendar = 'NSW' AND h.holiday_date = CAST(full_timestamp AS DATE)
""")


def _wide_files(spark: SparkSession, sf: str) -> str:
    """Wide readings as CSV files in one folder per unit; returns the glob of the files."""
    path = scratch_path(spark, "wide_files")
    fx.wide_readings(spark, sf).withColumn("folder", F.lower("Unit")).repartition("folder").write.option(
        "header", True
    ).partitionBy("folder").csv(path)
    return f"{path}/*/*.csv"


@query("scan_source", "SELECT event_id, user_id, value, 'NSW' AS region FROM events")
def scan_source(spark: SparkSession, sf: str) -> DataFrame:
    present = readers.scan_source(spark, f"{sf}/events.parquet", "NSW")
    absent = readers.scan_source(spark, f"{sf}/no_such_table.parquet", "LCL", present.drop("region").schema)
    return present.unionByName(absent).select("event_id", "user_id", "value", "region")


@query("scan_multi_file", sql(f"""
SELECT zone_substation, date, unit, CAST(count(*) AS BIGINT) AS n_slots, {sql_r6('sum(usage)', 'usage')}
FROM long_slots GROUP BY 1, 2, 3
"""))
def scan_multi_file(spark: SparkSession, sf: str) -> DataFrame:
    frames = readers.scan_multi_file(spark, _wide_files(spark, sf), required=K.WIDE_ID_COLUMNS)
    wide = union_sources(list(frames))
    values = [F.col(quoted(s)).cast("double") for s in fx.SLOTS]
    present = sum((v.isNotNull().cast("bigint") for v in values), F.lit(0).cast("bigint"))
    total = sum((F.coalesce(v, F.lit(0.0)) for v in values), F.lit(0.0))
    return wide.select(
        F.col(quoted("Zone Substation")).alias("zone_substation"), F.col("Date").alias("date"),
        F.col("Unit").alias("unit"), present.alias("n_slots"), r6(total).alias("usage"),
    )


_WIDE_HEADER = ",".join(["Year", "Zone Substation", "Date", "Unit", *fx.SLOTS])


@query("scan_file_heads", sql(f"""
SELECT DISTINCT lower(unit) AS folder, '{_WIDE_HEADER}' AS header, TRUE AS first_block_only FROM long_slots
"""))
def scan_file_heads(spark: SparkSession, sf: str) -> DataFrame:
    """The header of each folder's files, from a pass that reads no more than the first block of a file."""
    files = heads.files_of(spark, _wide_files(spark, sf))
    lines = heads.first_lines(spark, files, 4096)
    folder = F.regexp_extract("file", "folder=([^/]*)/", 1)
    first = lines.where("line = 0").groupBy(folder.alias("folder"), F.col("value").alias("header"))
    return first.agg((F.max("bytes_read") <= 4096).alias("first_block_only"))


@query("scan_weather_skip_preamble", sql(f"""
SELECT strftime(timestamp_hour, '%Y-%m-%dT%H:%M') AS time, {sql_r6('apparent_temperature', 'apparent_temperature')},
       {sql_r6('precipitation', 'precipitation')}, is_day FROM weather
"""))
def scan_weather_skip_preamble(spark: SparkSession, sf: str) -> DataFrame:
    frames = readers.scan_weather_skip_preamble(spark, fx.weather_text_file(spark, sf))
    raw = union_sources(list(frames))
    return raw.select(
        "time",
        r6(F.col(quoted("apparent_temperature (c)")).cast("double")).alias("apparent_temperature"),
        r6(F.col(quoted("precipitation (mm)")).cast("double")).alias("precipitation"),
        F.col(quoted("is_day ()")).cast("int").alias("is_day"),
    )


@query("scan_column_pruned", "SELECT l_orderkey, l_quantity, l_shipdate FROM lineitem")
def scan_column_pruned(spark: SparkSession, sf: str) -> DataFrame:
    return readers.scan_column_pruned(
        spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate", "l_absent"]
    )


_READINGS_SQL = sql(f"SELECT building_name, full_timestamp, region, {sql_r6('usage_kwh', 'usage_kwh')} FROM readings")


@query("sink_csv", _READINGS_SQL)
def sink_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "readings_csv")
    writers.sink_csv(fx.readings(spark, sf), path)
    return readers.scan_source(spark, path).select(
        "building_name", F.col("full_timestamp").cast("timestamp_ntz").alias("full_timestamp"), "region",
        r6(F.col("usage_kwh").cast("double")).alias("usage_kwh"),
    )


@query("sink_parquet", _READINGS_SQL)
def sink_parquet(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "readings_parquet") + ".parquet"
    writers.sink_parquet(fx.readings(spark, sf), path)
    return rounded(readers.scan_source(spark, path), "usage_kwh").select(
        "building_name", "full_timestamp", "region", "usage_kwh"
    )


@query("sink_head_sample", sql(f"""
SELECT building_name, full_timestamp, region, {sql_r6('usage_kwh', 'usage_kwh')}
FROM readings ORDER BY region, building_name, full_timestamp LIMIT 5000
"""))
def sink_head_sample(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(writers.sink_head_sample(fx.readings(spark, sf)), "usage_kwh")


@query("sink_metrics", sql(f"""
SELECT 'naive' AS model, split, 'mae' AS metric, {sql_r6('avg(abs(y_next - lag_1h))', 'value')}
FROM split_features GROUP BY split
UNION ALL
SELECT 'naive', split, 'rmse', round(sqrt(avg((y_next - lag_1h) * (y_next - lag_1h))), 6) + 0.0
FROM split_features GROUP BY split
"""))
def sink_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from loadcurve.plans.splits import filter_split, quantile_cutoffs

    features = fx.features(spark, sf)
    split = filter_split(features, quantile_cutoffs(features)).select(
        F.lit("naive").alias("model"), "split", F.col("y_next").alias("y_true"), F.col("lag_1h").alias("y_pred")
    )
    path = scratch_path(spark, "metrics")
    rows = writers.metric_rows(metric_mae_rmse(split), ["model", "split"], ["mae", "rmse"])
    writers.sink_metrics(rows, path)
    stored = spark.read.schema("model string, split string, metric string, value double").json(path)
    return rounded(stored, "value")


@query("union_sources", """
SELECT c_custkey AS id, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment
FROM customer
UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
""")
def union_two(spark: SparkSession, sf: str) -> DataFrame:
    customers = fx.source(spark, sf, "customer").toDF("id", "name", "nationkey", "acctbal", "segment")
    suppliers = fx.source(spark, sf, "supplier").toDF("id", "name", "nationkey", "acctbal")
    return union_sources([customers, suppliers])


@query("melt_wide_readings", sql("SELECT zone_substation, date, unit, slot AS time, usage FROM long_slots"))
def melt(spark: SparkSession, sf: str) -> DataFrame:
    wide = fx.wide_readings(spark, sf)
    long = melt_wide_readings(wide, ["Year", "Zone Substation", "Date", "Unit"])
    return long.select(
        F.col(quoted("Zone Substation")).alias("zone_substation"), F.col("Date").alias("date"),
        F.col("Unit").alias("unit"), "time", "usage",
    )


@query("merge_wide_files", sql(f"""
SELECT building_name, full_timestamp, {sql_r6('usage_kwh', 'usage_kwh')}, season, is_holiday, is_weekend
FROM long_flagged
"""))
def merge_files(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(merge_wide_files(spark, _wide_files(spark, sf)), "usage_kwh")


@query("attach_weather", sql(f"""
SELECT building_name, full_timestamp,
       {sql_r6('(usage_kwh - (SELECT min(usage_kwh) FROM long_usage)) / (SELECT max(usage_kwh) - min(usage_kwh) FROM long_usage)', 'usage_kwh_norm')},
       {sql_r6('(apparent_temperature - (SELECT min(apparent_temperature) FROM weather)) / (SELECT max(apparent_temperature) - min(apparent_temperature) FROM weather)', 'apparent_temperature_norm')},
       {sql_r6('precipitation', 'precipitation')}, is_day, is_holiday, is_weekend
FROM long_flagged JOIN weather ON timestamp_hour = full_timestamp
"""))
def attach(spark: SparkSession, sf: str) -> DataFrame:
    usage = wide_to_long_usage(fx.wide_readings(spark, sf))
    raw_weather = fx.weather_events(spark, sf).toDF(
        "time (local)", "Apparent_Temperature (C)", "Precipitation (mm)", "is_day ()"
    )
    return rounded(
        attach_weather(usage, raw_weather), "usage_kwh_norm", "apparent_temperature_norm", "precipitation"
    )


def _raw_source(spark: SparkSession, sf: str, region: str) -> DataFrame:
    """Readings of one region with weather, named and typed as a file from elsewhere might be."""
    w = fx.weather(spark, sf)
    r = fx.readings(spark, sf).where(F.col("region") == region)
    return r.join(w, r.full_timestamp == w.timestamp_hour).select(
        F.col("building_name").alias("Site"),
        F.date_format("full_timestamp", "yyyy-MM-dd HH:mm:ss").alias("DateTime"),
        F.col("usage_kwh").cast("string").alias("kWh"),
        F.col("apparent_temperature").cast("string").alias("Apparent_Temperature"),
        F.col("precipitation").cast("string").alias("rain_mm"),
    )


def _standard_sql(region: str) -> str:
    calendar = "NSW" if region == "NSW" else "GB"
    rows = (
        f"(SELECT r.*, w.apparent_temperature, w.precipitation FROM readings r "
        f"JOIN weather w ON w.timestamp_hour = r.full_timestamp WHERE r.region = '{region}')"
    )
    return f"""
SELECT building_name, full_timestamp,
       {sql_r6('(usage_kwh - u_lo) / greatest(u_hi - u_lo, 1e-9)', 'usage_kwh_norm')},
       {sql_r6('(apparent_temperature - t_lo) / greatest(t_hi - t_lo, 1e-9)', 'apparent_temperature_norm')},
       {sql_r6('precipitation', 'precipitation')},
       CAST(hour(full_timestamp) BETWEEN 6 AND 18 AS INTEGER) AS is_day,
       CAST(isodow(full_timestamp) >= 6 AS INTEGER) AS is_weekend,
       CAST(h.holiday_date IS NOT NULL AS INTEGER) AS is_holiday,
       '{region}' AS region
FROM {rows} s,
     (SELECT min(usage_kwh) AS u_lo, max(usage_kwh) AS u_hi, min(apparent_temperature) AS t_lo,
             max(apparent_temperature) AS t_hi FROM {rows}) limits
LEFT JOIN holidays h ON h.calendar = '{calendar}' AND h.holiday_date = CAST(full_timestamp AS DATE)
"""


_STANDARD_ROUNDED = ["usage_kwh_norm", "apparent_temperature_norm", "precipitation"]


@query("standardize_readings", sql(_standard_sql("NSW")))
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    out = standardize_readings(_raw_source(spark, sf, "NSW"), "NSW").select(*K.READING_COLUMNS)
    return rounded(out, *_STANDARD_ROUNDED)


@query("unify_sources", sql(_standard_sql("NSW") + " UNION ALL " + _standard_sql("LCL")))
def unify(spark: SparkSession, sf: str) -> DataFrame:
    nsw, lcl = scratch_path(spark, "nsw"), scratch_path(spark, "lcl") + ".parquet"
    writers.sink_csv(_raw_source(spark, sf, "NSW"), nsw)
    _raw_source(spark, sf, "LCL").write.parquet(lcl)
    absent = scratch_path(spark, "absent") + ".parquet"
    out = unify_sources(spark, [(nsw, "NSW"), (lcl, "LCL"), (absent, "LCL")]).select(*K.READING_COLUMNS)
    return rounded(out, *_STANDARD_ROUNDED)
