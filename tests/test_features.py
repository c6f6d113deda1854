import pandas as pd
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.plans.features import build_features, latest_per_entity, load_weather, prediction_features, weather_fallback
from loadcurve.plans.splits import filter_split, quantile_cutoffs
from tests.helpers import hourly_frame

MEASURES = ["lag_1h", "lag_24h", "rollmean_24h", "usage_pb", "temp_lag_1h", "temp_lag_24h"]


def _rows(df):
    return df.toPandas().sort_values(["region", "building_name", "full_timestamp"]).reset_index(drop=True)


def test_schema_and_row_count(spark):
    df, _ = hourly_frame(spark, {"a": 100, "b": 26, "c": 25, "d": 24})
    out = build_features(df)
    assert out.columns == K.FEATURE_COLUMNS
    counts = {r["building_name"]: r["count"] for r in out.groupBy("building_name").count().collect()}
    # The first 24 rows lack history, the last lacks a next hour.
    assert counts == {"a": 75, "b": 1}


def test_features_do_not_see_later_rows(spark):
    df, _ = hourly_frame(spark, {"a": 200, "b": 150})
    cut = "2020-12-25 00:00:00"
    early = build_features(df.where(f"full_timestamp <= TIMESTAMP_NTZ'{cut}'"), fit_until=cut)
    changed = df.withColumn(
        "usage_kwh_norm", F.when(F.col("full_timestamp") > F.lit(cut).cast("timestamp_ntz"), F.lit(7.0)).otherwise(F.col("usage_kwh_norm"))
    )
    late = build_features(changed, fit_until=cut)
    a = _rows(early)
    b = _rows(late.join(early.select("building_name", "full_timestamp"), ["building_name", "full_timestamp"], "left_semi"))
    pd.testing.assert_frame_equal(a[MEASURES], b[MEASURES])


def test_equal_names_in_two_regions(spark):
    df, _ = hourly_frame(spark, {"same": 60})
    both = df.unionByName(df.withColumns({"region": F.lit("LCL"), "usage_kwh_norm": F.col("usage_kwh_norm") * 0.5}))
    apart = build_features(both)
    assert {r["region"]: r["count"] for r in apart.groupBy("region").count().collect()} == {"NSW": 35, "LCL": 35}
    assert {(r["region"], r["region_id"]) for r in apart.collect()} == {("LCL", 0), ("NSW", 1)}
    merged = build_features(both, region_in_key=False)
    assert merged.count() == 120 - 24 - 1


def test_constant_building_scales_to_zero(spark):
    df, _ = hourly_frame(spark, {"flat": 40})
    out = build_features(df.withColumn("usage_kwh_norm", F.lit(0.3)))
    assert out.select("usage_pb").distinct().collect()[0][0] == 0.0


def test_default_region_when_absent(spark):
    df, _ = hourly_frame(spark, {"a": 30})
    assert build_features(df.drop("region")).select("region").distinct().collect()[0][0] == "NSW"


def test_cutoffs_and_disjoint_splits(spark):
    df, _ = hourly_frame(spark, {"a": 101, "b": 101})
    cut = quantile_cutoffs(df).first()
    times = pd.Series(sorted(r[0] for r in df.select("full_timestamp").collect()))
    want = times.astype("int64").quantile([0.8, 0.9])
    assert [pd.Timestamp(c).value for c in cut] == [pd.Timestamp(int(w), unit=times.dt.unit).value for w in want]
    split = filter_split(df, quantile_cutoffs(df))
    stats = {r["split"]: (r["lo"], r["hi"], r["n"]) for r in split.groupBy("split").agg(
        F.min("full_timestamp").alias("lo"), F.max("full_timestamp").alias("hi"), F.count("*").alias("n")).collect()}
    assert stats["train"][1] <= cut["train_end"] < stats["val"][0] <= stats["val"][1] <= cut["val_end"] < stats["test"][0]
    assert sum(s[2] for s in stats.values()) == 202


def test_scoring_row_equals_training_row(spark):
    df, _ = hourly_frame(spark, {"a": 80, "b": 50, "short": 20})
    scored = prediction_features(df)
    assert {r["building_name"] for r in scored.collect()} == {"a", "b"}
    # One more hour makes the newest scoring row a training row; scaling is over the same values.
    last = {r["building_name"]: r for r in scored.collect()}
    extra = latest_per_entity(df).withColumn("full_timestamp", F.col("full_timestamp") + F.expr("INTERVAL 1 HOUR"))
    train = build_features(df.unionByName(extra.select(df.columns)))
    for r in train.collect():
        b = r["building_name"]
        if b in last and r["full_timestamp"] == last[b]["timestamp_last"]:
            for c in ["lag_1h", "lag_24h", "rollmean_24h", "hour", "month", "day_of_week"]:
                assert r[c] == last[b][c]
            assert (last[b]["timestamp_next"] - last[b]["timestamp_last"]).total_seconds() == 3600


def test_scoring_with_weather_file_and_raw_usage(spark):
    df, _ = hourly_frame(spark, {"a": 60})
    usage = df.select(F.col("building_name").alias("Site"), F.col("full_timestamp").alias("time"), (F.col("usage_kwh_norm") * 40).alias("kwh"))
    raw = df.select(
        F.date_format("full_timestamp", "yyyy-MM-dd HH:mm").alias(" Time "), (F.col("apparent_temperature_norm") * 30).alias("Apparent_Temperature"),
        F.col("precipitation").alias("Rain"),
    )
    out = prediction_features(usage, "LCL", load_weather(raw))
    row = out.first()
    assert out.count() == 1 and row["region"] == "LCL" and 0 <= row["apparent_temperature_norm"] <= 1
    bare = prediction_features(usage, "LCL").first()
    assert bare["apparent_temperature_norm"] == 0.5 and bare["precipitation"] == 0.0
    assert bare["lag_1h"] == row["lag_1h"]


def test_fallback_keeps_given_columns(spark):
    df, _ = hourly_frame(spark, {"a": 3})
    out = weather_fallback(df.drop("precipitation"))
    assert [r["precipitation"] for r in out.collect()] == [0.0] * 3
    assert out.select("apparent_temperature_norm").collect() == df.select("apparent_temperature_norm").collect()
