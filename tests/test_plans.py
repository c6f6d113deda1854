"""Plans keep the shape they are meant to have."""

import re

from pyspark.sql import functions as F

from loadcurve.operators.aggregates import metric_mae_by_entity
from loadcurve.plans.features import build_features
from loadcurve.plans.splits import filter_split, quantile_cutoffs
from loadcurve.plans.unify import standardize_readings
from loadcurve.session import scratch_path
from loadcurve.sources import fixtures as fx
from loadcurve.sources.readers import scan_column_pruned
from tests.helpers import hourly_frame

SF = "/root/testdata/sf0.001"


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def row_shuffles(plan):
    """Shuffles of the readings by building in the final plan."""
    final = plan.split("== Initial Plan ==")[0]
    return [x for x in final.splitlines() if re.search(r" Exchange hashpartitioning\(region#\d+, building_name#\d+", x)]


def test_features_shuffle_the_rows_once(spark):
    df, _ = hourly_frame(spark, {"a": 100, "b": 80})
    path = scratch_path(spark, "plan_readings")
    df.write.parquet(path)
    plan = executed(build_features(spark.read.parquet(path), unique_hours=True))
    assert len(row_shuffles(plan)) == 1 and plan.split("== Initial Plan ==")[0].count("Sort [") == 1
    assert len(row_shuffles(executed(build_features(spark.read.parquet(path))))) == 1


def test_features_straight_from_raw_sources_shuffle_once(spark):
    assert len(row_shuffles(executed(build_features(fx.unified_plan(spark, SF), unique_hours=True)))) == 1


def test_columns_and_filters_reach_the_scan(spark):
    df = scan_column_pruned(spark, f"{SF}/lineitem.parquet", ["l_orderkey", "l_quantity"]).where("l_quantity > 10")
    plan = executed(df)
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>", plan)
    assert "GreaterThan(l_quantity,10.0)" in plan


def test_metrics_read_only_their_columns(spark):
    plan = executed(metric_mae_by_entity(fx.predictions(spark, SF)))
    assert re.search(r"ReadSchema: struct<building_name:string,region:string,lag_1h:double,y_next:double>", plan)


def test_no_python_in_the_data_path(spark):
    df, _ = hourly_frame(spark, {"a": 60})
    raw = df.withColumn("full_timestamp", F.col("full_timestamp").cast("string"))
    plan = executed(build_features(standardize_readings(raw, "NSW"), unique_hours=True))
    assert not re.search(r"PythonUDF|ArrowEvalPython|BatchEvalPython|MapInPandas", plan)


def test_small_lookups_do_not_shuffle_the_readings(spark):
    plan = executed(fx.unified_plan(spark, SF))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_split_bounds_reach_the_scan(spark):
    features = fx.features(spark, SF)
    cutoffs = quantile_cutoffs(features)
    test = filter_split(features, cutoffs, only=["test"])
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThan\(full_timestamp", executed(test.select("lag_1h")))
    for names in (["train"], ["val"], ["test"], ["val", "test"]):
        kept = filter_split(features, cutoffs, only=names)
        assert kept.count() == filter_split(features, cutoffs).where(F.col("split").isin(names)).count() > 0
        assert {r[0] for r in kept.select("split").distinct().collect()} == set(names)
