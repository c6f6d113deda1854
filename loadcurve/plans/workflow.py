"""The two jobs of a user: train and explain from source files, and forecast the next hour.

Each step writes its table below one output folder and the next step reads it from there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.functions.columns import fill_absent_features
from loadcurve.operators.aggregates import metric_mae_by_entity, pick_best_model, profile_dataset
from loadcurve.operators.normalize import region_dimension
from loadcurve.operators.sampling import sample_split_cap
from loadcurve.plans import explain, models
from loadcurve.plans.features import build_features, load_weather, prediction_features
from loadcurve.plans.splits import filter_split, quantile_cutoffs
from loadcurve.plans.unify import unify_sources
from loadcurve.session import cut_lineage
from loadcurve.sources.readers import scan_source
from loadcurve.sources.writers import metric_rows, sink_csv, sink_metrics, sink_parquet

NAIVE, FOREST, BOOSTED = "Naive", "RF", "GBT"


def train(
    spark: SparkSession,
    sources: Sequence[tuple[str, str]],
    out: str,
    *,
    caps: dict[str, int] | None = None,
    forest: dict | None = None,
    boosted: dict | None = None,
    importance: bool = True,
    **feature_options,
) -> DataFrame:
    """From (path, region) sources to features, models, metrics, predictions and segments.

    All rows are used unless `caps` limits the rows of a split. Returns the metrics table.
    """
    sink_parquet(unify_sources(spark, sources), f"{out}/readings.parquet")
    readings = spark.read.parquet(f"{out}/readings.parquet")
    region_dimension(readings).write.mode("overwrite").parquet(f"{out}/regions.parquet")
    regions = spark.read.parquet(f"{out}/regions.parquet")

    sink_parquet(build_features(readings, regions=regions, **feature_options), f"{out}/features.parquet")
    features = spark.read.parquet(f"{out}/features.parquet")
    profile_dataset(features).write.mode("overwrite").parquet(f"{out}/profile.parquet")

    quantile_cutoffs(features).write.mode("overwrite").parquet(f"{out}/cutoffs.parquet")
    cutoffs = spark.read.parquet(f"{out}/cutoffs.parquet")
    if caps:
        capped = sample_split_cap(filter_split(features, cutoffs), caps, ["region", "building_name", "full_timestamp"])
        capped.drop("split").write.mode("overwrite").parquet(f"{out}/capped_features.parquet")
    used = spark.read.parquet(f"{out}/capped_features.parquet") if caps else features

    rows = filter_split(used, cutoffs, only=["train"])
    fitted = {
        FOREST: models.train_random_forest(rows, **(forest or {})),
        BOOSTED: models.train_gradient_boosting(rows, **(boosted or {})),
    }
    for name, model in fitted.items():
        models.save_model(model, f"{out}/models/{name}")
    scorers = {NAIVE: models.column_scorer(F.col("lag_1h"))}
    scorers |= {name: models.model_scorer(model) for name, model in fitted.items()}

    metrics = models.evaluate_models(filter_split(used, cutoffs, only=["val", "test"]), scorers)
    sink_metrics(metric_rows(metrics, ["model", "split"], ["mae", "rmse"]), f"{out}/metrics")
    metrics.write.mode("overwrite").parquet(f"{out}/metrics.parquet")
    metrics = spark.read.parquet(f"{out}/metrics.parquet")
    best = pick_best_model(metrics, [BOOSTED, FOREST])
    best.write.mode("overwrite").parquet(f"{out}/best_model.parquet")
    scorer = scorers[best.first()["model"]]

    if importance:
        val = filter_split(used, cutoffs, only=["val"])
        sink_csv(models.permutation_importance(val, scorers[BOOSTED]), f"{out}/importance")
    test = filter_split(used, cutoffs, only=["test"])
    models.predict_test(test, scorer).write.mode("overwrite").parquet(f"{out}/predictions.parquet")
    sink_csv(metric_mae_by_entity(spark.read.parquet(f"{out}/predictions.parquet")), f"{out}/building_mae")

    elasticity = explain.elasticity_by_entity(filter_split(features, cutoffs, only=["test"]), scorer)
    elasticity.write.mode("overwrite").parquet(f"{out}/elasticity.parquet")
    segmented = explain.segment_by_quartile(spark.read.parquet(f"{out}/elasticity.parquet"))
    sink_csv(segmented.orderBy("elasticity"), f"{out}/segments")
    sink_metrics(explain.elasticity_summary(segmented), f"{out}/elasticity_summary")
    return metrics


def forecast(
    spark: SparkSession,
    trained: str,
    usage_path: str,
    out: str,
    *,
    region: str = "NSW",
    weather_path: str | None = None,
    model: str | None = None,
    **feature_options,
) -> DataFrame:
    """Next-hour forecast for every building of a usage file, by the best model of a training run."""
    name = model or spark.read.parquet(f"{trained}/best_model.parquet").first()["model"]
    scorer = models.model_scorer(models.load_model(f"{trained}/models/{name}"))
    usage = scan_source(spark, usage_path)
    if not usage.columns:
        raise FileNotFoundError(usage_path)
    weather = load_weather(scan_source(spark, weather_path)) if weather_path else None
    latest = prediction_features(
        usage, region, weather, regions=spark.read.parquet(f"{trained}/regions.parquet"), **feature_options
    )
    ready = cut_lineage(fill_absent_features(latest, models.K.MODEL_FEATURES))
    if not ready.limit(1).count():
        raise ValueError(f"no building of {usage_path} has a full day of history to forecast from")
    if ready.where("region_id is null").limit(1).count():
        raise ValueError(f"training has not seen region {region}")
    sink_csv(models.predict_next_hour(ready, scorer), out)
    return scan_source(spark, out)
