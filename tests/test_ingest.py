from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loadcurve.operators.joins import join_weather_hour
from loadcurve.operators.reshape import union_sources
from loadcurve.operators.sized import DuplicateKeyError, join_lookup
from loadcurve.plans.unify import attach_weather, merge_wide_files, prepare_weather, standardize_readings, unify_sources
from loadcurve.sources.readers import scan_multi_file, scan_source, scan_weather_skip_preamble

HEADER = "Year,Zone Substation,Date,Unit,00:15,12:00,24:00\n"


@pytest.fixture
def wide_folder(tmp_path):
    for folder, name, text in [
        ("a_one", "x.csv", HEADER + "2018,North,30APR2018,KWH,1.0,2.0,3.0\n2018,North,31DEC2018,kw,4.0,,8.0\n"),
        ("a_one", "empty.csv", ""),
        # Columns in another order, and another set of slots.
        ("a_two", "y.csv", "Unit,24:00,06:30,Date,Zone Substation,Year\nMW,0.5,x,28FEB2020,South,2020\n"),
        ("a_two", "bad.csv", "some,other,file\n1,2,3\n"),
        ("other", "z.csv", HEADER + "2018,Hidden,30APR2018,KWH,1.0,2.0,3.0\n"),
    ]:
        path = tmp_path / folder
        path.mkdir(exist_ok=True)
        (path / name).write_text(text)
    return tmp_path


def test_wide_files_of_different_layouts(spark, wide_folder):
    out = merge_wide_files(spark, f"{wide_folder}/a_*/*.csv")
    assert out.columns == ["building_name", "full_timestamp", "usage_kwh", "season", "is_holiday", "is_weekend"]
    got = {(r["building_name"], r["full_timestamp"]): (r["usage_kwh"], r["season"], r["is_holiday"], r["is_weekend"]) for r in out.collect()}
    assert got == {
        ("North", datetime(2018, 4, 30, 0, 15)): (1.0, "Autumn", 0, 0),
        ("North", datetime(2018, 4, 30, 12)): (2.0, "Autumn", 0, 0),
        ("North", datetime(2018, 5, 1)): (3.0, "Autumn", 0, 0),
        ("North", datetime(2018, 12, 31, 0, 15)): (1.0, "Summer", 0, 0),
        ("North", datetime(2019, 1, 1)): (2.0, "Summer", 1, 0),
        ("South", datetime(2020, 2, 29)): (125.0, "Summer", 0, 1),
    }


def test_scan_names_the_source_file(spark, wide_folder):
    frames = list(scan_multi_file(spark, f"{wide_folder}/a_*/*.csv", required=["year"]))
    names = {r[0].rsplit("/", 1)[1] for f in frames for r in f.select("source_file").distinct().collect()}
    assert names == {"x.csv", "y.csv"}
    assert list(scan_multi_file(spark, f"{wide_folder}/none_*/*.csv")) == []


@pytest.mark.parametrize("quote", ["", '"'])
def test_weather_preamble(spark, tmp_path, quote):
    head = ",".join(f"{quote}{c}{quote}" for c in ["Time", "apparent_temperature (C)", "precipitation (mm)", "is_day ()"])
    lines = ["latitude,longitude", "-33.0,151.0", "", head, "2020-01-01T00:00,20.5,0.0,0", "2020-01-01T00:30,21.5,1.0,1", "2020-01-01T01:00,x,0.5,"]
    (tmp_path / "w.csv").write_text("\n".join(lines) + "\n")
    raw = union_sources(list(scan_weather_skip_preamble(spark, str(tmp_path))))
    assert raw.columns[0] == "time" and raw.count() == 3
    hourly = {r["timestamp_hour"]: r for r in prepare_weather(raw).collect()}
    first, second = hourly[datetime(2020, 1, 1)], hourly[datetime(2020, 1, 1, 1)]
    assert (first["apparent_temperature"], first["precipitation"], first["is_day"]) == (21.0, 1.0, 1)
    assert first["apparent_temperature_norm"] == 0.0  # one temperature only: constant
    assert (second["apparent_temperature"], second["is_day"]) == (None, 0)


def test_weather_preamble_fallback_row(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a\nb\nc\nstamp,rain\n2020-01-01,1\n")
    (raw,) = scan_weather_skip_preamble(spark, str(tmp_path))
    assert raw.columns == ["stamp", "rain"] and raw.count() == 1


def test_missing_source_is_empty(spark, tmp_path):
    assert scan_source(spark, f"{tmp_path}/no.parquet").columns == []
    with pytest.raises(ValueError):
        unify_sources(spark, [(f"{tmp_path}/no.parquet", "NSW")])


def test_standardize(spark):
    rows = [
        ("s1", "2024-01-26 00:00", "10", "5", "1.5", "keep"),
        ("s1", "2024-01-26 01:00", "30", "15", None, "keep"),
        ("s1", "2024-01-26 01:30", "999", "99", None, "off the hour"),
        ("s1", "2024-01-26 02:00", "nan", "10", None, "no usage"),
        ("s1", "bad", "5", "10", None, "no time"),
        ("s1", "2024-01-27 12:00", "20", "x", None, "no weather"),
        (None, "2024-01-27 12:00", "20", "1", None, "no building"),
    ]
    df = spark.createDataFrame(rows, "Meter_ID string, Timestamp string, kWh string, Apparent_Temperature string, rain string, note string")
    out = standardize_readings(df, "NSW").orderBy("full_timestamp").collect()
    assert [r["note"] for r in out] == ["keep", "keep"]
    assert [r["usage_kwh_norm"] for r in out] == [0.0, 1.0]
    assert [r["apparent_temperature_norm"] for r in out] == [0.0, 1.0]
    assert [r["precipitation"] for r in out] == [1.5, None]
    assert [(r["is_day"], r["is_weekend"], r["is_holiday"], r["region"]) for r in out] == [(0, 0, 1, "NSW")] * 2


def test_standardize_clips_and_keeps_given_flags(spark):
    df = spark.createDataFrame(
        [("b", "2024-01-01 00:00", "1.7", "-0.2", "1", "0")],
        "building_name string, full_timestamp string, usage_kwh_norm string, apparent_temperature_norm string, is_day string, is_holiday string",
    )
    r = standardize_readings(df, "NSW").first()
    assert (r["usage_kwh_norm"], r["apparent_temperature_norm"], r["is_day"], r["is_holiday"]) == (1.0, 0.0, 1, 0)
    assert r["precipitation"] is None


def test_missing_columns_are_errors(spark):
    df = spark.createDataFrame([("b",)], "building_name string")
    with pytest.raises(ValueError, match="timestamp"):
        standardize_readings(df, "NSW")


def test_attach_weather_needs_hour_and_weather(spark):
    usage = spark.createDataFrame(
        [("b", "2020-01-01 00:00:00", 1.0), ("b", "2020-01-01 00:15:00", 5.0), ("b", "2020-01-01 01:00:00", 3.0), ("b", "2020-01-02 00:00:00", 2.0)],
        "building_name string, full_timestamp string, usage_kwh double",
    )
    weather = spark.createDataFrame(
        [("2020-01-01T00:00", 10.0, 0.1, 0), ("2020-01-01T01:00", 20.0, 0.2, 1)],
        "`time (x)` string, `apparent_temperature (C)` double, `precipitation (mm)` double, `is_day ()` int",
    )
    out = attach_weather(usage, weather).orderBy("full_timestamp").collect()
    assert [(r["usage_kwh_norm"], r["apparent_temperature_norm"], r["precipitation"]) for r in out] == [(0.0, 0.0, 0.1), (0.5, 1.0, 0.2)]


def test_repeated_weather_key_is_an_error(spark):
    readings = spark.sql("SELECT 'b' AS building_name, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS full_timestamp")
    weather = spark.sql("SELECT explode(array(1, 2)) AS x, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS timestamp_hour")
    with pytest.raises(DuplicateKeyError):
        join_weather_hour(readings, weather)


def test_lookup_above_the_limit_is_not_broadcast(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 50)
    lookup = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = join_lookup(df, lookup, ["k"])
    large = join_lookup(df, lookup, ["k"], max_rows=10)
    assert "Broadcast" in small._jdf.queryExecution().optimizedPlan().toString() or "broadcast" in small._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in large._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
