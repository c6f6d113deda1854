from datetime import datetime, timedelta

import pytest

from loadcurve.operators.joins import join_preds_features
from loadcurve.plans.features import add_lags
from loadcurve.sources.bucketed import joined_by_bucket, open_bucketed, sink_bucketed

KEYS = ["region", "building_name"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rows = [("NSW" if b % 3 else "LCL", f"b {b}", datetime(2024, 1, 1) + timedelta(hours=(h * 7) % 60), float(h * b % 11), 0.1 * b) for b in range(23) for h in range(60)]
    usage = spark.createDataFrame(rows, "region string, building_name string, full_timestamp timestamp_ntz, usage_pb double, apparent_temperature_norm double")
    preds = usage.selectExpr("*", "usage_pb + 1 AS y_pred").drop("usage_pb", "apparent_temperature_norm").where("hour(full_timestamp) % 2 = 0")
    folder = tmp_path_factory.mktemp("bucketed")
    sink_bucketed(usage, f"{folder}/usage", 5)
    sink_bucketed(preds, f"{folder}/preds", 5)
    return usage, preds, str(folder)


def _joined(usage, preds):
    lagged = add_lags(usage, KEYS, unique_hours=True)
    return join_preds_features(preds, lagged, ["usage_pb", "lag_1h", "lag_24h", "rollmean_24h"])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_and_lags_without_a_shuffle(spark, tables):
    usage, preds, folder = tables
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = _joined(usage, preds)
        assert "Exchange" in _plan(plain)
        with joined_by_bucket(spark):
            stored = _joined(open_bucketed(spark, f"{folder}/usage"), open_bucketed(spark, f"{folder}/preds"))
            assert "Exchange" not in _plan(stored) and "SortMergeJoin" in _plan(stored)
            got = sorted(map(tuple, stored.collect()))
        assert got == sorted(map(tuple, plain.select(*stored.columns).collect())) and len(got) == preds.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_one_file_for_each_bucket(spark, tables):
    _, preds, folder = tables
    table = open_bucketed(spark, f"{folder}/preds")
    assert len(table.inputFiles()) <= 5 and table.count() == preds.count()
    assert table.schema == preds.schema
    one = table.where("building_name = 'b 4' AND region = 'NSW'")
    assert one.count() == 30
