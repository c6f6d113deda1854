"""Queries for column resolution, scalar functions and filters (survey 2.2 and 2.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.catalog.ctes import sql
from loadcurve.catalog.registry import query, r6, rounded, sql_r6
from loadcurve.functions import columns as cols
from loadcurve.functions import timefns, timeformats
from loadcurve.functions import values as vals
from loadcurve.functions.coerce import (
    coerce_flag, coerce_numeric, coerce_timestamp, downcast_types, parse_compact_date,
)
from loadcurve.plans.features import weather_fallback
from loadcurve.plans.splits import filter_split as split_filter
from loadcurve.plans.splits import quantile_cutoffs
from loadcurve.plans.unify import dropna_subset, filter_on_hour, filter_weather_present
from loadcurve.sources import fixtures as fx


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return fx.source(spark, sf, "events")


@query("resolve_column", """
SELECT ts AS full_timestamp, user_id AS building, value AS usage FROM events
""")
def resolve_column(spark: SparkSession, sf: str) -> DataFrame:
    odd = _events(spark, sf).select(
        F.col("event_id").alias("Humidity"), F.col("user_id").alias("Household ID"),
        F.col("ts").alias("DateTime"), F.col("value").alias("Total_KWH"),
    )
    found = {
        cols.resolve_column(odd.columns, K.TIMESTAMP_FIRST)
        or cols.resolve_column(odd.columns, K.TIMESTAMP_OTHER): "full_timestamp",
        cols.resolve_column(odd.columns, ["building_name", "id", "household"]): "building",
        cols.resolve_column(odd.columns, K.USAGE_RAW): "usage",
    }
    return cols.select_renamed(odd, found)


@query("resolve_columns_substring", f"""
SELECT ts AS time, {sql_r6("CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE)", 'apparent_temperature')},
       CASE WHEN event_type = 'error' THEN value ELSE 0 END AS precipitation,
       CAST(hour(ts) BETWEEN 6 AND 18 AS INTEGER) AS is_day FROM events
""")
def resolve_columns_substring(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.weather_events(spark, sf).toDF(
        "time (local)", "apparent_temperature (C)", "precipitation (mm)", "is_day ()"
    )
    picked = cols.resolve_columns_substring(raw.columns, K.WEATHER_NEEDED)
    return rounded(cols.select_renamed(raw, picked), "apparent_temperature")


@query("lowercase_trim_columns", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def lowercase_trim(spark: SparkSession, sf: str) -> DataFrame:
    odd = fx.source(spark, sf, "supplier").toDF(" S_SuppKey", "S_NAME ", " s_NationKey ", "S_AcctBal")
    return cols.lowercase_trim_columns(odd)


@query("coerce_numeric", """
SELECT event_id, CASE WHEN event_id % 10 IN (0, 1, 2, 3) THEN NULL ELSE value END AS value FROM events
""")
def numeric(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 10
    text = (
        F.when(k == 0, F.lit("nan")).when(k == 1, F.lit("n/a")).when(k == 2, F.lit(""))
        .when(k == 3, F.lit("12d")).when(k == 4, F.concat(F.lit(" "), F.col("value").cast("string")))
        .otherwise(F.col("value").cast("string"))
    )
    df = _events(spark, sf).select("event_id", text.alias("value"))
    return df.select("event_id", coerce_numeric(df, "value").alias("value"))


@query("coerce_flag", """
SELECT event_id, CAST(CASE WHEN event_id % 5 IN (0, 1) THEN 0 ELSE event_id % 3 END AS INTEGER) AS flag FROM events
""")
def flag(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("event_id") % 5, (F.col("event_id") % 3).cast("string")
    text = F.when(k == 1, F.lit("x")).when(k == 2, F.concat(v, F.lit(".7"))).when(k > 2, v)
    df = _events(spark, sf).select("event_id", text.alias("flag"))
    return df.select("event_id", coerce_flag(df, "flag").alias("flag"))


@query("infer_timestamp_formats", """
SELECT event_id, user_id % 4 AS file, date_trunc('minute', ts) AS ts FROM events
""")
def inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Times of four files of other formats, among them day-first and month-first, each read as its own values tell."""
    file = F.col("user_id") % 4
    shown = ["yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm", "dd.MM.yyyy HH:mm"]
    text = F.lit(None).cast("string")
    for i, form in enumerate(shown):
        text = F.when(file == i, F.date_format("ts", form)).otherwise(text)
    rows = _events(spark, sf).select("event_id", file.alias("file"), text.alias("ts"))
    return timeformats.coerce_inferred(rows, "ts", ["file"])


@query("coerce_timestamp", """
SELECT event_id, date_trunc(CASE event_id % 3 WHEN 0 THEN 'second' ELSE 'minute' END, ts) AS ts
FROM events WHERE event_id % 3 <> 2
""")
def timestamp(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    text = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, F.date_format("ts", "dd/MM/yyyy HH:mm")).otherwise(F.lit("unknown"))
    )
    df = _events(spark, sf).select("event_id", text.alias("ts"))
    parsed = df.select("event_id", coerce_timestamp(df, "ts", ["dd/MM/yyyy HH:mm"]).alias("ts"))
    return dropna_subset(parsed, ["ts"])


@query("downcast_types", """
SELECT event_id, CAST(CAST(value AS FLOAT) AS DOUBLE) AS value,
       CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE user_id % 7 END AS INTEGER) AS flag FROM events
""")
def downcast(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 4 != 0, F.col("user_id") % 7)
    df = downcast_types(_events(spark, sf).select("event_id", "value", flag.alias("flag")), ["value"], ["flag"])
    return df.withColumn("value", F.col("value").cast("double"))


@query("parse_compact_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderdate END AS day FROM orders
""")
def compact_date(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 7 == 0, F.lit("99XYZ2018")).when(
        key % 2 == 0, F.upper(F.date_format("o_orderdate", "ddMMMyyyy"))
    ).otherwise(F.date_format("o_orderdate", "ddMMMyyyy"))
    day = parse_compact_date(text).cast("timestamp_ntz")
    return fx.source(spark, sf, "orders").select("o_orderkey", day.alias("day"))


@query("timestamp_2400_rollover", """
SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP)
       + CASE event_id % 4 WHEN 0 THEN INTERVAL 24 HOUR ELSE to_hours(hour(ts)) END AS full_timestamp
FROM events
""")
def rollover(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    clock = F.when(F.col("event_id") % 4 == 0, F.lit("24:00")).otherwise(
        F.concat(F.lpad(F.hour(ts).cast("string"), 2, "0"), F.lit(":00"))
    )
    return _events(spark, sf).select(
        "event_id", timefns.timestamp_2400_rollover(ts.cast("date"), clock).alias("full_timestamp")
    )


@query("floor_hour", "SELECT event_id, date_trunc('hour', ts) AS timestamp_hour FROM events")
def floor_hour(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", timefns.floor_hour(F.col("ts")).alias("timestamp_hour"))


@query("next_hour", "SELECT event_id, ts + INTERVAL 1 HOUR AS timestamp_next FROM events")
def next_hour(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", timefns.next_hour(F.col("ts")).alias("timestamp_next"))


@query("unit_to_kwh", f"""
SELECT l_orderkey, l_linenumber, {sql_r6('''CASE l_returnflag WHEN 'A' THEN l_quantity
       WHEN 'R' THEN l_quantity * 0.25 ELSE l_quantity * 1000 * 0.25 END''', 'usage_kwh')} FROM lineitem
""")
def unit_to_kwh(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    unit = F.when(flag == "A", F.lit("kwh")).when(flag == "R", F.lit(" kW")).otherwise(F.lit("MW"))
    usage = vals.unit_to_kwh(F.col("l_quantity"), unit)
    return fx.source(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(usage).alias("usage_kwh"))


@query("calendar_parts", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CAST(month(ts) AS INTEGER) AS month FROM events
""")
def calendar_parts(spark: SparkSession, sf: str) -> DataFrame:
    parts = timefns.calendar_parts(F.col("ts"))
    return _events(spark, sf).select("event_id", *[c.alias(n) for n, c in parts.items()])


@query("season_from_month", """
SELECT o_orderkey, CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Summer' WHEN month(o_orderdate) <= 5 THEN 'Autumn'
       WHEN month(o_orderdate) <= 8 THEN 'Winter' ELSE 'Spring' END AS south,
       CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter' WHEN month(o_orderdate) <= 5 THEN 'Spring'
       WHEN month(o_orderdate) <= 8 THEN 'Summer' ELSE 'Autumn' END AS north FROM orders
""")
def season(spark: SparkSession, sf: str) -> DataFrame:
    month = F.month("o_orderdate")
    return fx.source(spark, sf, "orders").select(
        "o_orderkey", timefns.season_from_month(month).alias("south"),
        timefns.season_from_month(month, "north").alias("north"),
    )


@query("weekend_flag", "SELECT event_id, CAST(isodow(ts) IN (6, 7) AS INTEGER) AS is_weekend FROM events")
def weekend(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", timefns.weekend_flag(F.col("ts")).alias("is_weekend"))


@query("day_flag", "SELECT event_id, CAST(hour(ts) >= 6 AND hour(ts) <= 18 AS INTEGER) AS is_day FROM events")
def day(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).select("event_id", timefns.day_flag(F.col("ts")).alias("is_day"))


@query("clip_unit", f"""
SELECT l_orderkey, l_linenumber, {sql_r6('least(greatest(l_discount * 20 - 0.5, 0), 1)', 'clipped')} FROM lineitem
""")
def clip(spark: SparkSession, sf: str) -> DataFrame:
    clipped = vals.clip_unit(F.col("l_discount") * 20 - 0.5)
    return fx.source(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(clipped).alias("clipped"))


@query("region_default", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'NSW' ELSE c_mktsegment END AS region, 'NSW' AS constant FROM customer
""")
def region(spark: SparkSession, sf: str) -> DataFrame:
    partly = F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))
    return fx.source(spark, sf, "customer").select(
        "c_custkey", vals.region_default(partly).alias("region"), vals.region_default(None).alias("constant")
    )


@query("weather_fallback", sql("""
SELECT building_name, full_timestamp, 0.5::DOUBLE AS apparent_temperature_norm, 0.0::DOUBLE AS precipitation,
       CAST(hour(full_timestamp) BETWEEN 6 AND 18 AS INTEGER) AS is_day FROM readings
"""))
def fallback(spark: SparkSession, sf: str) -> DataFrame:
    return weather_fallback(fx.readings(spark, sf).select("building_name", "full_timestamp"))


@query("fill_absent_features", "SELECT event_id, value, 0.0::DOUBLE AS region_id, 0.0::DOUBLE AS is_day FROM events")
def fill_absent(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf).select("event_id", "value")
    return cols.fill_absent_features(df, ["value", "region_id", "is_day"])


@query("reorder_columns", """
SELECT s_nationkey, s_suppkey, s_name, s_acctbal FROM supplier
""")
def reorder(spark: SparkSession, sf: str) -> DataFrame:
    return cols.reorder_columns(fx.source(spark, sf, "supplier"), ["s_nationkey", "s_absent", "s_suppkey"])


@query("drop_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def drop(spark: SparkSession, sf: str) -> DataFrame:
    return cols.drop_columns(fx.source(spark, sf, "supplier"), ["s_name", "s_nationkey", "s_absent"])


@query("label_flags", sql("""
SELECT building_name, full_timestamp, CASE is_weekend WHEN 1 THEN 'Weekend' ELSE 'Weekday' END AS weekend_label,
       CASE is_holiday WHEN 1 THEN 'Holiday' ELSE 'Non-Holiday' END AS holiday_label FROM unified
"""))
def labels(spark: SparkSession, sf: str) -> DataFrame:
    return fx.unified(spark, sf).select(
        "building_name", "full_timestamp",
        vals.label_flag(F.col("is_weekend"), "Weekend", "Weekday").alias("weekend_label"),
        vals.label_flag(F.col("is_holiday"), "Holiday", "Non-Holiday").alias("holiday_label"),
    )


@query("residual", sql(f"""
SELECT building_name, full_timestamp, {sql_r6('y_true - y_pred', 'resid')}, {sql_r6('abs(y_true - y_pred)', 'abs_err')} FROM preds
"""))
def residual(spark: SparkSession, sf: str) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return fx.predictions(spark, sf).select(
        "building_name", "full_timestamp", r6(vals.residual(y, p)).alias("resid"),
        r6(vals.abs_error(y, p)).alias("abs_err"),
    )


@query("pct_improve", sql("""
SELECT split, round((1 - avg(abs(y_next - rollmean_24h)) / avg(abs(y_next - lag_1h))) * 100, 1) + 0.0 AS pct
FROM split_features GROUP BY split
"""))
def pct(spark: SparkSession, sf: str) -> DataFrame:
    features = fx.features(spark, sf)
    split = split_filter(features, quantile_cutoffs(features))
    errors = split.groupBy("split").agg(
        F.avg(vals.abs_error(F.col("y_next"), F.col("lag_1h"))).alias("naive"),
        F.avg(vals.abs_error(F.col("y_next"), F.col("rollmean_24h"))).alias("model"),
    )
    return errors.select("split", (vals.pct_improve(F.col("naive"), F.col("model")) + 0.0).alias("pct"))


@query("filter_on_hour", """
SELECT event_id, ts FROM (SELECT event_id, date_trunc('minute', ts) AS ts FROM events) WHERE date_trunc('hour', ts) = ts
""")
def on_hour(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    minute = ts - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.extract(F.lit("SECOND"), ts))
    return filter_on_hour(_events(spark, sf).select("event_id", minute.alias("ts")), "ts")


@query("filter_weather_present", """
SELECT event_id FROM events WHERE event_id % 10 <> 0 AND event_id % 7 <> 0
""")
def weather_present(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf).select(
        "event_id",
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("usage_kwh_norm"),
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("apparent_temperature_norm"),
    )
    return filter_weather_present(df).select("event_id")


@query("dropna_subset", "SELECT event_id FROM events WHERE event_id % 10 <> 0")
def dropna(spark: SparkSession, sf: str) -> DataFrame:
    df = _events(spark, sf).select(
        "event_id", F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("value")
    )
    return dropna_subset(df, ["value", "absent"]).select("event_id")


@query("filter_split", sql("SELECT building_name, full_timestamp, split FROM split_features"))
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    features = fx.features(spark, sf)
    return split_filter(features, quantile_cutoffs(features)).select("building_name", "full_timestamp", "split")
