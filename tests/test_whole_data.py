"""Results do not depend on row counts, partitionings or column counts; buildings are told apart by region."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadcurve.operators import aggregates as agg
from loadcurve.operators import bins, joins, ranks, sampling
from loadcurve.operators.sized import fits_broadcast
from loadcurve.plans import explain, models
from loadcurve.plans.unify import unify_sources
from loadcurve.session import remove_scratch, scratch_path, shared_dir
from loadcurve.sources.readers import scan_weather_skip_preamble
from tests.helpers import hourly_frame


def _values(spark):
    rows = [(k, i, None if k == "z" else float((i * 7919) % 1009) / 7.0) for k in "abz" for i in range(700)] + [(None, 0, 1.5)]
    return spark.createDataFrame(rows, "k string, i int, x double")


def test_quantiles_are_the_same_on_either_path(spark, monkeypatch):
    df = _values(spark)
    for f in (bins.group_quartiles, bins.box_stats):
        small, large = (sorted(map(str, f(df, "x", ["k"], **o).collect())) for o in ({}, {"small_rows": 0, "rows_per_range": 100}))
        assert small == large and len(small) == 4
    deciles = [i / 10 for i in range(11)]
    small = ranks.exact_quantiles(df, "x", deciles).first()
    assert small == ranks.exact_quantiles(df, "x", deciles, small_rows=0, rows_per_range=50).first()
    monkeypatch.setattr(ranks, "MAX_RANGES", 3)
    assert small == ranks.exact_quantiles(df, "x", deciles, small_rows=0, rows_per_range=50).first()
    weighted = df.withColumn("w", F.col("i") % 3)
    a, b = (ranks.exact_quantiles(weighted, "x", [0.3, 0.5], ["k"], weight="w", **o).collect() for o in ({}, {"small_rows": 0, "rows_per_range": 100}))
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_medians_take_the_same_passes_for_any_number_of_columns(spark):
    df = spark.range(300).select(*[(F.col("id") * k % 101).cast("double").alias(f"c{k}") for k in range(1, 13)])
    assert ranks.exact_medians(df, df.columns).first() == ranks.exact_medians(df, df.columns, small_rows=0).first()
    tracker = spark.sparkContext.statusTracker()

    def jobs(columns):
        spark.sparkContext.setJobGroup(f"medians {len(columns)}", "")
        ranks.exact_medians(df, columns, small_rows=0).first()
        return len(tracker.getJobIdsForGroup(f"medians {len(columns)}"))

    assert jobs(df.columns[:2]) == jobs(df.columns)


def test_all_columns_and_all_rows(spark):
    wide = spark.range(3).select("id", *[F.lit(None).cast("int").alias(f"c{i}") for i in range(40)])
    assert agg.profile_missing_matrix(wide, ["id"]).count() == 3 * 41
    df, _ = hourly_frame(spark, {"a": 1000})
    rows = df.withColumns({c: F.lit(0.5) for c in ("lag_1h",)})
    scorer = models.column_scorer(F.col("apparent_temperature_norm") * F.col("precipitation"))
    out = explain.elasticity_by_entity(rows, scorer, inputs=["precipitation", "apparent_temperature_norm"]).first()
    want = rows.agg(F.median("precipitation")).first()[0]
    assert out["n_rows_used"] == 1000 and abs(out["elasticity"] - want) < 1e-12


def test_holidays_of_any_year(spark):
    days = ["1895-12-25", "2250-12-25", "2250-12-24", "1895-01-01", "2024-12-25", "2024-12-24"]
    df = spark.createDataFrame([(d, "NSW") for d in days], "d string, region string").withColumn("full_timestamp", F.col("d").cast("timestamp_ntz"))
    got = {r["d"]: r["is_holiday"] for r in joins.join_holiday_calendar(df).collect()}
    assert got == {d: int(not d.endswith("-24")) for d in days}
    for region in ("NSW", "LCL"):  # rules row by row give the standing calendar
        span = spark.sql("SELECT explode(sequence(DATE'1999-01-01', DATE'2023-12-31')) AS d").select(F.col("d").cast("timestamp_ntz").alias("full_timestamp"), F.lit(region).alias("region"))
        by_table = joins.join_holiday_calendar(span).agg(F.sum("is_holiday")).first()[0]
        from loadcurve.operators.holidays import calendar_of_region, is_holiday_by_rule

        by_rule = span.agg(F.sum(is_holiday_by_rule(calendar_of_region(F.col("region")), F.col("full_timestamp").cast("date")).cast("int"))).first()[0]
        assert by_table == by_rule > 150


def test_correlation_leaves_nan_out(spark):
    df = spark.createDataFrame([(float(i), float("nan") if i == 3 else None if i == 5 else float(-i * i), float(i % 4)) for i in range(20)], "a double, b double, c double")
    got = {(r["left_col"], r["right_col"]): r["corr"] for r in agg.correlation_matrix(df).collect()}
    clean = df.where("not isnan(b) and b is not null")
    assert abs(got["a", "b"] - clean.agg(F.corr("a", "b")).first()[0]) < 1e-12 and abs(got["b", "c"]) < 0.99


def _two_regions(spark):
    start = datetime(2021, 1, 1)
    rows = [(r, "same", start + timedelta(hours=h), float(h % 5) * k, float(h % 5)) for k, r in enumerate(("LCL", "NSW"), 1) for h in range(30)]
    return spark.createDataFrame(rows, "region string, building_name string, full_timestamp timestamp_ntz, usage_pb double, lag_1h double")


def test_one_name_in_two_regions_is_two_buildings(spark):
    features = _two_regions(spark).withColumns({"y_next": F.col("usage_pb"), "hour": F.hour("full_timestamp"), "apparent_temperature_norm": F.lit(0.5)})
    preds = models.prediction_table(features, models.column_scorer(F.col("lag_1h")))
    assert preds.columns == ["region", "building_name", "full_timestamp", "y_true", "y_pred"]
    assert joins.join_preds_features(preds, features, ["hour"]).count() == preds.count() == 60
    assert {(r["region"], r["mae"]) for r in agg.metric_mae_by_entity(preds).collect()} == {("LCL", 0.0), ("NSW", 2.0)}
    assert agg.hourly_profile(features).count() == 2
    assert sampling.worst_entities_series(preds, 1).select("region").distinct().collect()[0][0] == "NSW"
    assert sampling.top_entities_by_count(preds, 1).count() == 30
    assert sampling.sample_per_entity(features, 7).groupBy("region").count().collect()[0]["count"] == 7
    assert sampling.downsample_every_nth(preds, max_points=10).count() == 20
    assert joins.unscored_entities(features, features.where("region = 'LCL'")).collect()[0]["region"] == "NSW"
    scorer = models.column_scorer(F.col("apparent_temperature_norm") * F.col("usage_pb"))
    out = explain.elasticity_by_entity(features, scorer, inputs=["usage_pb", "apparent_temperature_norm"]).collect()
    assert {(r["region"], round(r["elasticity"], 9)) for r in out} == {("LCL", 2.0), ("NSW", 4.0)}


def test_samples_do_not_depend_on_the_partitioning(spark):
    df, _ = hourly_frame(spark, {f"b{i}": 200 for i in range(6)})
    doubled = df.unionByName(df.where("hour(full_timestamp) = 3").withColumn("usage_kwh_norm", F.lit(0.25)))
    scorer = models.column_scorer(F.col("usage_kwh_norm") * 2)

    def all_of(frame):
        importance = models.permutation_importance(frame.withColumn("y_next", F.col("usage_kwh_norm")), scorer, features=["usage_kwh_norm", "precipitation"], rows_per_block=300)
        return [
            sorted(map(str, out.collect()))
            for out in (
                sampling.sample_rows(frame, 0.3), sampling.sample_per_entity(frame, 20), sampling.downsample_every_nth(frame, max_points=30),
                importance.select("feature", F.round("importance_mean", 9), F.round("importance_std", 9)),
            )
        ]

    one, many = all_of(doubled.coalesce(1)), all_of(doubled.repartition(9))
    assert one == many and 350 < len(one[0]) < 500
    hours = sampling.sample_per_entity(df, 20).groupBy("full_timestamp").count()
    assert hours.count() > 60  # each building has hours of its own


def test_long_preamble(spark, tmp_path):
    lines = [f"note {i},x" for i in range(24)] + ["Time,apparent_temperature (C)"] + [f"2020-01-01T{h:02d}:00,{h}" for h in range(5)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (raw,) = scan_weather_skip_preamble(spark, str(tmp_path))
    assert raw.columns == ["time", "apparent_temperature (c)"] and raw.count() == 5
    plan = raw._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1 and "hashpartitioning" not in plan


def test_broadcast_is_bounded_in_bytes(spark):
    wide = spark.range(50).select("id", F.repeat(F.lit("x"), 3_000_000).alias("v"))
    assert not fits_broadcast(wide) and fits_broadcast(wide.select("id")) and not fits_broadcast(spark.range(600_000).toDF("id"))


def test_missing_source_is_an_error_if_strict(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        unify_sources(spark, [(f"{tmp_path}/no.csv", "NSW")], strict=True)


def test_shared_folder(spark, monkeypatch):
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Elsewhere)
    path = scratch_path(spark, "t")
    spark.range(3).write.parquet(path)
    monkeypatch.setattr("loadcurve.session._scratch", [(spark, path)])
    assert remove_scratch(spark) == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path)
