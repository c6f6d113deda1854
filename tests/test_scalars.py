from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from loadcurve.functions import columns as cols
from loadcurve.functions import timefns
from loadcurve.functions import values as vals
from loadcurve.functions.coerce import coerce_flag, coerce_numeric, coerce_timestamp, parse_compact_date
from tests.helpers import column, texts


def test_exact_match_goes_by_candidate_order():
    assert cols.resolve_column(["Customer", "Meter_ID"], ["meter_id", "customer"]) == "Meter_ID"


def test_substring_match_goes_by_file_order():
    assert cols.resolve_column(["rain (mm)", "precip total"], ["precip", "rain"]) == "rain (mm)"


def test_candidate_must_cover_whole_name_parts():
    assert cols.resolve_column(["humidity", "Customer ID"], ["id"]) == "Customer ID"
    assert cols.resolve_column(["humidity"], ["id"]) is None
    assert cols.resolve_column(["humidity"], ["id"], whole_parts=False) == "humidity"


def test_multi_part_candidates():
    assert cols.resolve_column(["apparent_temperature (C)"], ["apparent_temperature"]) == "apparent_temperature (C)"
    assert cols.resolve_column(["Zone Substation name"], ["zone substation"]) == "Zone Substation name"


def test_substring_pick_is_all_or_nothing():
    assert cols.resolve_columns_substring(["time", "is_day ()"], ["time", "precipitation"]) is None
    assert cols.resolve_columns_substring(["time (x)", "is_day ()"], ["time", "is_day"]) == {"time (x)": "time", "is_day ()": "is_day"}


def test_coerce_numeric(spark):
    df = texts(spark, ["1.5", " 3 ", "nan", "", "n/a", "1e3", "12d", "2.5f", None, "-4"])
    out = column(df.select(coerce_numeric(df, "v").alias("v")))
    assert out == [1.5, 3.0, None, None, None, 1000.0, None, None, None, -4.0]


def test_coerce_flag(spark):
    df = texts(spark, ["1", "0", "1.9", "yes", None, "nan"])
    assert column(df.select(coerce_flag(df, "v").alias("v"))) == [1, 0, 1, 0, 0, 0]


def test_coerce_timestamp_formats_in_order(spark):
    df = texts(spark, ["2020-02-29 23:00", "2020-02-30 01:00", "03/04/2020 05:00", "x"])
    out = column(df.select(coerce_timestamp(df, "v", ["dd/MM/yyyy HH:mm"]).alias("v")))
    assert out == [datetime(2020, 2, 29, 23), None, datetime(2020, 4, 3, 5), None]


def test_compact_date(spark):
    df = texts(spark, ["01MAY2018", "31dec2019", "32JAN2018", ""])
    assert column(df.select(parse_compact_date(F.col("v")).alias("v"))) == [date(2018, 5, 1), date(2019, 12, 31), None, None]


@pytest.mark.parametrize(
    "day, clock, expected",
    [
        ("2020-01-31", "24:00", datetime(2020, 2, 1)),
        ("2019-12-31", "24:00", datetime(2020, 1, 1)),
        ("2020-02-28", "24:00", datetime(2020, 2, 29)),
        ("2020-02-28", "00:15", datetime(2020, 2, 28, 0, 15)),
        ("2020-02-28", "25:00", None),
        (None, "00:15", None),
    ],
)
def test_midnight_rolls_over(spark, day, clock, expected):
    df = spark.createDataFrame([(day, clock)], "d string, c string")
    got = df.select(timefns.timestamp_2400_rollover(F.col("d").cast("date"), F.col("c")).alias("t")).first()["t"]
    assert got == expected


def test_time_functions(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-03 06:59:59.999999' AS t")
    t = F.col("t")
    row = df.select(
        timefns.floor_hour(t).alias("floor"), timefns.next_hour(t).alias("next"), timefns.week_start(t).alias("week"),
        timefns.day_flag(t).alias("day"), timefns.weekend_flag(t).alias("weekend"), timefns.is_on_hour(t).alias("on"),
        timefns.from_epoch_seconds(timefns.epoch_seconds(t)).alias("back"), timefns.calendar_parts(t)["day_of_week"].alias("dow"),
    ).first()
    assert row["floor"] == datetime(2024, 3, 3, 6)
    assert row["next"] == datetime(2024, 3, 3, 7, 59, 59, 999999)
    assert row["week"] == datetime(2024, 2, 26)
    assert (row["day"], row["weekend"], row["on"], row["dow"]) == (1, 1, False, 6)
    assert row["back"] == datetime(2024, 3, 3, 6, 59, 59, 999999)


def test_floor_does_not_depend_on_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Australia/Adelaide")
        t = spark.sql("SELECT TIMESTAMP_NTZ'2024-10-06 02:30:00' AS t").select(timefns.floor_hour(F.col("t")).alias("t")).first()["t"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert t == datetime(2024, 10, 6, 2)


def test_units(spark):
    df = spark.createDataFrame([(4.0, "KWH"), (4.0, "kw"), (4.0, "MW"), (4.0, None)], "u double, unit string")
    assert column(df.select(vals.unit_to_kwh(F.col("u"), F.col("unit")).alias("v"))) == [4.0, 1.0, 1000.0, 4.0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (0.3,), (2.0,), (None,)], "x double")
    assert column(df.select(vals.clip_unit(F.col("x")).alias("v"))) == [0.0, 0.3, 1.0, None]


def test_seasons(spark):
    df = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    south = column(df.select(timefns.season_from_month(F.col("m")).alias("v")))
    north = column(df.select(timefns.season_from_month(F.col("m"), "north").alias("v")))
    assert south[0] == "Summer" and south[2] == "Autumn" and south[6] == "Winter" and south[8] == "Spring"
    assert north[0] == "Winter" and north[2] == "Spring" and north[6] == "Summer" and north[11] == "Winter"


def test_pct_improve_guards_zero(spark):
    df = spark.createDataFrame([(2.0, 1.0), (0.0, 1.0), (None, 1.0)], "b double, m double")
    assert column(df.select(vals.pct_improve(F.col("b"), F.col("m")).alias("v"))) == [50.0, None, None]


def test_slot_text(spark):
    df = texts(spark, ["00:15", "24:00", " 7:05 ", "24:15", "12:60", "noon", "12", "00:15:00", "-1:00", None])
    out = column(df.select(timefns.slot_minutes(F.col("v")).alias("v")))
    assert out == [15, 1440, 425, None, None, None, None, None, None, None]
