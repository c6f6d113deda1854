import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.operators.aggregates import model_comparison_table, pick_best_model, summary_five_number
from loadcurve.plans import explain, models
from loadcurve.plans.features import build_features, prediction_features
from loadcurve.plans.splits import filter_split, quantile_cutoffs


@pytest.fixture(scope="module")
def readings(spark):
    """A daily cycle with noise, driven by temperature, for eight buildings over forty days."""
    rng = np.random.default_rng(3)
    rows = []
    for b in range(8):
        for i in range(24 * 40):
            t = datetime(2021, 3, 1) + timedelta(hours=i)
            temp = 0.5 + 0.3 * math.sin(2 * math.pi * (t.hour - 9) / 24) + 0.05 * rng.standard_normal()
            use = 1 + math.sin(2 * math.pi * t.hour / 24) + 0.5 * temp * (b + 1) / 4 + 0.1 * rng.standard_normal()
            rain = None if i % 50 == 0 else float(rng.exponential(0.2))
            rows.append((f"b{b}", t, float(use), min(1.0, max(0.0, temp)), rain, int(6 <= t.hour <= 18), int(t.weekday() >= 5), 0, "NSW" if b % 2 else "LCL"))
    return spark.createDataFrame(
        rows,
        "building_name string, full_timestamp timestamp_ntz, usage_kwh_norm double, apparent_temperature_norm double, "
        "precipitation double, is_day int, is_weekend int, is_holiday int, region string",
    ).cache()


@pytest.fixture(scope="module")
def split(readings):
    features = build_features(readings, unique_hours=True)
    return filter_split(features, quantile_cutoffs(features)).cache()


@pytest.fixture(scope="module")
def fitted(split):
    train = split.where("split = 'train'")
    return {
        "RF": models.train_random_forest(train, num_trees=20, max_depth=8, max_bins=32),
        "GBT": models.train_gradient_boosting(train, max_iter=20, max_depth=4, step_size=0.2, max_bins=32, holdout=0.1),
    }


@pytest.fixture(scope="module")
def scorers(fitted):
    return {"Naive": models.column_scorer(F.col("lag_1h"))} | {n: models.model_scorer(m) for n, m in fitted.items()}


def test_models_beat_persistence(split, scorers):
    metrics = models.evaluate_models(split, scorers)
    mae = {(r["model"], r["split"]): r["mae"] for r in metrics.collect()}
    assert len(mae) == 6
    for part in ("val", "test"):
        assert mae["RF", part] < 0.5 * mae["Naive", part]
        assert mae["GBT", part] < 0.5 * mae["Naive", part]
    best = pick_best_model(metrics, ["GBT", "RF"]).first()
    assert best["model"] == min(("GBT", "RF"), key=lambda m: mae[m, "val"])
    table = {r["model"]: (r["val_mae"], r["test_mae"]) for r in model_comparison_table(metrics).collect()}
    assert table["Naive"] == (mae["Naive", "val"], mae["Naive", "test"])


def test_tie_goes_to_the_earlier_candidate(spark):
    metrics = spark.createDataFrame([("RF", "val", 0.1), ("GBT", "val", 0.1), ("x", "val", 0.0)], "model string, split string, mae double")
    assert pick_best_model(metrics, ["GBT", "RF"]).first()["model"] == "GBT"


def test_save_and_load_give_the_same_predictions(split, fitted, tmp_path):
    path = str(tmp_path / "m")
    models.save_model(fitted["RF"], path)
    again = models.model_scorer(models.load_model(path))
    keys = ["building_name", "full_timestamp"]
    one = models.predict_test(split, models.model_scorer(fitted["RF"])).orderBy(*keys).collect()
    assert one == models.predict_test(split, again).orderBy(*keys).collect()


def test_inputs_are_taken_by_name(split, fitted):
    scorer = models.model_scorer(fitted["RF"])
    turned = split.select(*reversed(split.columns))
    keys = ["building_name", "full_timestamp"]
    assert models.predict_test(split, scorer).orderBy(*keys).collect() == models.predict_test(turned, scorer).orderBy(*keys).collect()


def test_next_hour(readings, scorers):
    out = models.predict_next_hour(prediction_features(readings, unique_hours=True), scorers["GBT"])
    assert out.columns == ["region", "building_name", "timestamp_last", "timestamp_next", "y_pred_next", *K.MODEL_FEATURES]
    rows = out.collect()
    assert len(rows) == 8 and all(r["timestamp_next"] - r["timestamp_last"] == timedelta(hours=1) for r in rows)


def test_importance_finds_the_driver(spark):
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    df = spark.createDataFrame([(float(a), float(b), float(c), float(2 * a + 0.2 * b)) for a, b, c in x], "a double, b double, c double, y_next double")
    scorer = models.column_scorer(2 * F.col("a") + 0.2 * F.col("b"))
    for block in (10**6, 100):
        out = {r["feature"]: r for r in models.permutation_importance(df, scorer, features=["a", "b", "c"], rows_per_block=block).collect()}
        # E|U - V| of two uniforms is 1/3.
        assert abs(out["a"]["importance_mean"] - 2 / 3) < 0.05
        assert abs(out["b"]["importance_mean"] - 0.2 / 3) < 0.01
        assert out["c"]["importance_mean"] == 0.0 and out["a"]["importance_std"] > 0


def test_shuffle_uses_every_value_once(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    out = models.shuffled_within_blocks(df, ["x"], repeats=2, blocks=7, seed=1).toPandas()
    for r in range(2):
        donated = out[f"donor_{r}"].map(lambda d: d["x"])
        assert sorted(donated) == sorted(out["x"])
        assert abs(np.corrcoef(out["x"], donated)[0, 1]) < 0.15


def test_formula_slope_is_recovered(split):
    scorer = models.column_scorer(F.col("lag_1h") + 0.37 * F.col("apparent_temperature_norm"))
    out = explain.elasticity_by_entity(split, scorer, max_rows=50).collect()
    assert len(out) == 8
    assert all(abs(r["elasticity"] - 0.37) < 1e-12 and r["n_rows_used"] == 50 for r in out)


def test_copies_count_in_the_median(spark, split):
    scorer = models.column_scorer(F.col("lag_1h") * F.col("apparent_temperature_norm"))
    one = split.where("building_name = 'b0'").dropna(subset=K.MODEL_FEATURES).orderBy("lag_1h").limit(2)
    low = one.limit(1)
    rows = one.unionByName(low).unionByName(low)
    got = explain.elasticity_by_entity(rows, scorer).first()
    assert got["n_rows_used"] == 4
    assert abs(got["elasticity"] - low.first()["lag_1h"]) < 1e-9


def test_segments_of_190_buildings(spark):
    scores = spark.range(190).select(F.concat(F.lit("b"), "id").alias("building_name"), (F.col("id") ** 1.5).alias("elasticity"))
    out = explain.segment_by_quartile(scores)
    s = explain.elasticity_summary(out).first()
    assert (s["n_low"], s["n_moderate"], s["n_high"], s["n_unknown"], s["n_buildings"]) == (48, 94, 48, 0, 190)


def test_segment_ties_and_missing(spark):
    scores = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0), ("d", None)], "building_name string, elasticity double")
    out = {r["building_name"]: r["segment"] for r in explain.segment_by_quartile(scores).collect()}
    assert out == {"a": "High", "b": "High", "c": "High", "d": "Unknown"}


def test_five_numbers(spark):
    df = spark.createDataFrame([(0.02731810314589677,), (0.02908973662544034,), (0.03295219496473352,)], "mae double")
    r = summary_five_number(df, "mae").first()
    assert (r["n"], round(r["min"], 4), round(r["median"], 4), round(r["max"], 4)) == (3, 0.0273, 0.0291, 0.0330)


def test_profiles(split):
    scorer = models.column_scorer(F.col("hour") * 2 + F.col("apparent_temperature_norm"))
    hours = {r["grid"]: r["y_pred"] for r in explain.profile_at_median(split, scorer, "hour", range(24)).collect()}
    assert len(hours) == 24 and abs(hours[5.0] - hours[4.0] - 2) < 1e-12
    rain = explain.profile_precipitation(split, scorer).orderBy("grid").collect()
    assert len(rain) == 41 and rain[0]["grid"] == 0.0 and rain[-1]["grid"] > 0


def test_pca_is_centred_and_ordered(split):
    out = explain.pca_2d(split, ["usage_pb", "lag_1h", "hour", "apparent_temperature_norm"])
    m = out.agg(F.avg("pc1"), F.avg("pc2"), F.var_samp("pc1"), F.var_samp("pc2"), F.corr("pc1", "pc2")).first()
    assert abs(m[0]) < 1e-9 and abs(m[1]) < 1e-9 and m[2] > m[3] and abs(m[4]) < 1e-6


def test_clusters_separate_two_kinds_of_day(spark):
    rows = [(f"b{b}", h, (1.0 if h < 12 else 0.0) if b % 2 else (0.0 if h < 12 else 1.0)) for b in range(10) for h in range(24)]
    df = spark.createDataFrame(rows, "building_name string, hour int, usage_pb double")
    labels, centres = explain.kmeans_profiles(df, k=2, starts=3)
    got = {r["building_name"]: r["cluster"] for r in labels.collect()}
    assert len({got[f"b{b}"] for b in range(0, 10, 2)}) == 1 and got["b0"] != got["b1"]
    assert centres.count() == 48
