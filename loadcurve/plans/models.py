"""Forecast models: baselines, forests and boosted trees on histograms, scoring and importance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import mean, pstdev

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.functions.columns import entity_keys, fill_absent_features, quoted
from loadcurve.operators.aggregates import metric_mae_rmse
from loadcurve.plans.boosting import fit_boosted_trees
from loadcurve.plans.forest import Forest, fit_forest
from loadcurve.plans.trees import FlatTrees, trees_of_forest
from loadcurve.session import let_workers_import
from loadcurve.sources.readers import path_exists

Model = PipelineModel | FlatTrees
Scorer = Callable[[DataFrame], DataFrame]

_VECTOR = "__inputs"
_PREPARED = {"precipitation": ["__precipitation", "__precipitation_missing"]}
# A forest takes no missing values: rain is filled with 0 and its absence is an input of its own.
_FILLED = {"__precipitation": "coalesce(precipitation, 0D)", "__precipitation_missing": "CAST(precipitation IS NULL AS DOUBLE)"}


def column_scorer(prediction: Column) -> Scorer:
    """A scorer that is a formula over feature columns."""
    return lambda df: df.withColumn("y_pred", prediction)


class ModelScorer:
    """A scorer that applies a fitted model; inputs are taken by name, in the stored order."""

    def __init__(self, model: Model):
        self.model = model
        self._flat: FlatTrees | None = model if isinstance(model, FlatTrees) else None

    def __call__(self, df: DataFrame) -> DataFrame:
        if isinstance(self.model, FlatTrees):
            let_workers_import(df.sparkSession)
            return self.model.score(df)
        return self.model.transform(df).drop(_VECTOR, *_PREPARED["precipitation"])

    def trees(self, spark: SparkSession) -> FlatTrees:
        """The model as flat arrays; of a pipeline, read once."""
        let_workers_import(spark)
        if self._flat is None:
            self._flat = trees_of_forest(self.model, _FILLED)
        return self._flat


def model_scorer(model: Model) -> ModelScorer:
    return ModelScorer(model)


def forecast_naive(features: DataFrame, column: str = "lag_1h") -> DataFrame:
    """Persistence: the prediction is an observed usage (`lag_1h`, or `usage_pb` for one step)."""
    return column_scorer(F.col(column))(features)


def _input_names(features: Sequence[str]) -> list[str]:
    names: list[str] = []
    for f in features:
        names += _PREPARED.get(f, [f])
    return names


def present_features(df: DataFrame, features: Sequence[str] = K.MODEL_FEATURES) -> list[str]:
    """The model features a frame has, in training order."""
    return [f for f in features if f in df.columns]


def train_random_forest(
    train: DataFrame,
    *,
    num_trees: int = 200,
    max_depth: int = 12,
    min_leaf: int = 5,
    max_bins: int = 128,
    seed: int = 42,
    features: Sequence[str] | None = None,
) -> Forest:
    features = features or present_features(train)
    inputs = {name: _FILLED.get(name, name) for name in _input_names(features)}
    return fit_forest(
        train, K.TARGET, inputs, names=[f for f in features if f not in _PREPARED], num_trees=num_trees, max_depth=max_depth,
        min_leaf=min_leaf, max_bins=max_bins, seed=seed,
    )


def train_gradient_boosting(
    train: DataFrame,
    *,
    max_iter: int = 300,
    max_depth: int = 8,
    step_size: float = 0.05,
    min_leaf: int = 20,
    max_bins: int = 255,
    max_leaves: int = 31,
    holdout: float | None = None,
    features: Sequence[str] | None = None,
) -> FlatTrees:
    """Histogram-boosted trees with squared error; missing inputs go to a learned side.

    All `max_iter` rounds are made at any number of rows. Only where `holdout` names a share of rows are these kept out, and the
    rounds end when their error has not fallen by 1e-7 in ten rounds.
    """
    features = features or present_features(train)
    if not holdout:
        held = None
    else:
        # By content, so that the same rows are held out on every evaluation of the frame.
        held = "__holdout"
        bucket = F.pmod(F.xxhash64(*features, K.TARGET), F.lit(10_000))
        train = train.withColumn(held, bucket < int(holdout * 10_000))
    return fit_boosted_trees(
        train, K.TARGET, features, rounds=max_iter, max_depth=max_depth, step_size=step_size, min_leaf=min_leaf,
        max_bins=max_bins, max_leaves=max_leaves, held_out=held,
    )


def save_model(model: Model, path: str) -> None:
    if isinstance(model, FlatTrees):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str) -> Model:
    spark = SparkSession.active()
    return FlatTrees.load(spark, path) if path_exists(spark, f"{path}/nodes") else PipelineModel.load(path)


def score_models(df: DataFrame, scorers: dict[str, Scorer]) -> DataFrame:
    """Predictions of several models in long form (`model`, `y_pred`), from one pass over the rows."""
    wide = df
    for i, scorer in enumerate(scorers.values()):
        wide = scorer(wide).withColumnRenamed("y_pred", f"__pred_{i}")
    entries = [
        F.struct(F.lit(name).alias("model"), F.col(f"__pred_{i}").cast("double").alias("y_pred"))
        for i, name in enumerate(scorers)
    ]
    return (
        wide.withColumn("__scored", F.explode(F.array(*entries)))
        .select(*df.columns, "__scored.model", "__scored.y_pred")
    )


def evaluate_models(
    features: DataFrame,
    scorers: dict[str, Scorer],
    *,
    splits: Sequence[str] = ("val", "test"),
    target: str = K.TARGET,
) -> DataFrame:
    """MAE and RMSE by model and split; `features` carries the `split` column."""
    rows = features.where(F.col("split").isin(list(splits)))
    scored = score_models(rows, scorers).withColumn("y_true", F.col(target).cast("double"))
    return metric_mae_rmse(scored)


def prediction_table(
    features: DataFrame,
    scorer: Scorer,
    *,
    target: str = K.TARGET,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Keys (region, building and time) with `y_true` and `y_pred`."""
    keys = list(keys or [*entity_keys(features), "full_timestamp"])
    return scorer(features).select(
        *keys, F.col(target).cast("double").alias("y_true"), F.col("y_pred").cast("double").alias("y_pred")
    )


def predict_test(features: DataFrame, scorer: Scorer, **options) -> DataFrame:
    """The prediction table of the test split."""
    return prediction_table(features.where(F.col("split") == "test"), scorer, **options)


def predict_next_hour(
    latest: DataFrame, scorer: Scorer, features: Sequence[str] = K.MODEL_FEATURES
) -> DataFrame:
    """Next-hour forecast per building with the inputs used, from `prediction_features` rows."""
    filled = fill_absent_features(latest, features)
    return (
        scorer(filled)
        .withColumnRenamed("y_pred", "y_pred_next")
        .select(*entity_keys(latest), "timestamp_last", "timestamp_next", "y_pred_next", *features)
    )


def shuffled_within_blocks(
    df: DataFrame, columns: Sequence[str], *, repeats: int, blocks: int, seed: int
) -> DataFrame:
    """Add `donor_<r>`: the named columns of another row, for each repeat.

    Rows are dealt by a hash of their values to blocks. Within a block each row takes the values of its
    successor in the order of another hash (the last takes the first's), so every value is used exactly
    once, and the same rows meet on every partitioning. Blocks are of even size but for equal rows.
    """
    row = [F.col(quoted(c)) for c in df.columns]
    out = df.withColumn("__block", F.pmod(F.xxhash64(F.lit(seed), *row), F.lit(blocks)))
    for r in range(repeats):
        out = out.withColumn(f"__order_{r}", F.xxhash64(F.lit(seed + 1 + r), *row))
    packed = F.struct(*columns)
    for r in range(repeats):
        w = Window.partitionBy("__block").orderBy(f"__order_{r}")
        first = F.first(packed).over(w)
        out = out.withColumn(f"donor_{r}", F.coalesce(F.lead(packed, 1).over(w), first))
    return out.drop("__block", *[f"__order_{r}" for r in range(repeats)])


def permutation_importance(
    df: DataFrame,
    scorer: Scorer,
    *,
    features: Sequence[str] | None = None,
    repeats: int = 3,
    seed: int = 42,
    rows_per_block: int = 200_000,
    target: str = K.TARGET,
) -> DataFrame:
    """Rise of the MAE when one feature is shuffled: mean and population deviation over the repeats.

    All features and repeats are scored as one long frame; an index of -1 is the unshuffled row.
    """
    features = list(features or present_features(df))
    blocks = max(1, df.count() // rows_per_block)
    rows = df.select(*features, F.col(target).cast("double").alias("y_true"))
    donors = shuffled_within_blocks(rows, features, repeats=repeats, blocks=blocks, seed=seed)
    trials = [F.struct(F.lit(-1).alias("feature"), F.lit(0).alias("repeat"))]
    trials += [
        F.struct(F.lit(i).alias("feature"), F.lit(r).alias("repeat"))
        for i in range(len(features))
        for r in range(repeats)
    ]
    long = donors.withColumn("__trial", F.explode(F.array(*trials)))
    mixed = []
    for i, f in enumerate(features):
        value = F
        for r in range(repeats):
            hit = (F.col("__trial.feature") == i) & (F.col("__trial.repeat") == r)
            value = value.when(hit, F.col(f"donor_{r}.{f}"))
        mixed.append(value.otherwise(F.col(f)).alias(f))
    trial_rows = long.select(*mixed, "y_true", F.col("__trial.feature").alias("__f"), F.col("__trial.repeat").alias("__r"))
    maes = (
        scorer(trial_rows)
        .groupBy("__f", "__r")
        .agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    )
    # features x repeats + 1 numbers.
    found = {(r["__f"], r["__r"]): r["mae"] for r in maes.collect()}
    base = found.get((-1, 0))
    rows = []
    for i, name in enumerate(features):
        rises = [found[i, r] - base for r in range(repeats)] if base is not None else []
        rows.append((name, mean(rises) if rises else None, pstdev(rises) if rises else None))
    out = df.sparkSession.createDataFrame(
        rows, "feature string, importance_mean double, importance_std double"
    )
    return out.orderBy(F.desc("importance_mean"), "feature")
