"""A profile merged from stored parts equals the whole one; old rows are not read."""

import pytest
from pyspark.sql import functions as F

from loadcurve.catalog import relational
from loadcurve.operators.aggregates import profile_dataset
from loadcurve.plans import profile_parts
from tests.helpers import hourly_frame


def _rows(df):
    return sorted(map(str, df.select("region", "n_rows", "n_buildings", "time_start", "time_end").collect()))


def test_merged_parts_equal_the_whole(spark, tmp_path):
    df, _ = hourly_frame(spark, {f"b{i}": 40 + i for i in range(30)})
    df = df.withColumn("region", F.when(F.col("building_name") < "b2", "LCL").otherwise("NSW"))
    path, day = str(tmp_path / "profile"), F.dayofmonth("full_timestamp")
    for part in (20, 21, 22):
        profile_parts.store_part(df.where(day == part), path, f"d{part}")
    assert _rows(profile_parts.merged_profile(spark, path)) == _rows(profile_dataset(df))
    # The same append once more replaces its part only.
    profile_parts.store_part(df.where(day == 21), path, "d21")
    assert _rows(profile_parts.merged_profile(spark, path)) == _rows(profile_dataset(df))


def test_estimate_stays_within_the_error_of_the_sketch(spark, tmp_path):
    path = str(tmp_path / "profile")
    df = spark.range(60_000).select(F.concat(F.lit("b"), F.col("id") % 40_000).alias("building_name"), F.lit("NSW").alias("region"), F.col("id").alias("full_timestamp"))
    for part, rows in (("one", df.where("full_timestamp < 25000")), ("two", df.where("full_timestamp >= 25000"))):
        profile_parts.store_part(rows, path, part, log_cells=12)
    total = profile_parts.merged_profile(spark, path).where("region IS NULL").first()
    assert total["n_rows"] == 60_000 and abs(total["n_buildings"] / 40_000 - 1) < 4 * 1.04 / 64


def test_old_rows_are_not_read_again(spark, tmp_path):
    df, _ = hourly_frame(spark, {"a": 50, "b": 20})
    path = str(tmp_path / "profile")
    for part, rows in (("old", df.where("building_name = 'a'")), ("new", df.where("building_name = 'b'"))):
        profile_parts.store_part(rows, path, part)
    merged = profile_parts.merged_profile(spark, path)
    files = merged.inputFiles()
    assert len(files) == 2 and all("part=" in f for f in files)
    # Each part is one row a region, whatever was appended.
    assert spark.read.parquet(path).count() == 2


def test_names_of_parts(spark, tmp_path):
    df, _ = hourly_frame(spark, {"a": 3})
    for name in ("", "a/b", "..", "x=y", "_x"):
        with pytest.raises(ValueError):
            profile_parts.store_part(df, str(tmp_path), name)


def test_exact_parts_count_every_building(spark, tmp_path):
    path, names = str(tmp_path / "profile"), F.concat(F.lit("b"), F.col("id") % 30_000)
    df = spark.range(50_000).select(
        F.when(F.col("id") % 7 != 0, names).alias("building_name"), F.when(F.col("id") % 2 == 0, "NSW").alias("region"), F.col("id").alias("full_timestamp")
    )
    for part, rows in (("one", df.where("full_timestamp < 20000")), ("two", df.where("full_timestamp >= 20000")), ("two", df.where("full_timestamp >= 20000"))):
        profile_parts.store_part(rows, path, part, exact=True)
    assert _rows(profile_parts.merged_profile(spark, path)) == _rows(profile_dataset(df))


def test_profile_query_counts_by_name(spark, tmp_path, monkeypatch):
    df = spark.range(40_000).select(
        F.concat(F.lit("b"), "id").alias("building_name"), F.lit("NSW").alias("region"), F.col("id").alias("full_timestamp"), F.lit("train").alias("split")
    )
    monkeypatch.setattr(relational, "_split_features", lambda spark, sf: df)
    assert {r["n_buildings"] for r in relational.appended_profile(spark, "").collect()} == {40_000}
