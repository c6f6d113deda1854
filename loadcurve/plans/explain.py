"""Temperature sensitivity, segments, response profiles, components and clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from loadcurve.functions.columns import entity_keys
from loadcurve.operators.aggregates import HOURS, hourly_profile, numeric_columns
from loadcurve.operators.joins import cross_join_grid
from loadcurve.operators.onerow import attach_row
from loadcurve.operators.ranks import exact_medians, exact_quantiles
from loadcurve.operators.sampling import sample_per_entity
from loadcurve.operators.sized import join_lookup
from loadcurve.plans.clusters import cluster_rows
from loadcurve.plans.models import ModelScorer, Scorer, present_features
from loadcurve.session import cut_lineage

TEMPERATURE = "apparent_temperature_norm"


def unit_grid(points: int) -> list[float]:
    """Evenly spaced values from 0 to 1."""
    return [i / (points - 1) for i in range(points)]


def ice_curves(
    df: DataFrame, scorer: Scorer, grid: Sequence[float], *, column: str = TEMPERATURE,
    ids: Sequence[str] = ("building_name", "full_timestamp"),
) -> DataFrame:
    """The prediction of every row at every grid value of one feature, others held."""
    return scorer(cross_join_grid(df, grid, column)).select(*ids, F.col(column).alias("grid"), "y_pred")


def ice_steps(df: DataFrame, scorer: ModelScorer, grid: Sequence[float], *, column: str = TEMPERATURE, out: str = "response") -> DataFrame:
    """Each row with its curve as an array, one value for each grid value, from one walk through the model's trees.

    A tree's answer is constant between its thresholds, so a row with the whole range of the feature is led through each tree once;
    rows are neither copied nor shuffled. Equal to `ice_curves` point by point.
    """
    return scorer.trees(df.sparkSession).with_response(df, column, grid, out)


def response_slopes(df: DataFrame, scorer: ModelScorer, grid: Sequence[float], *, column: str = TEMPERATURE) -> DataFrame:
    """Each row with the least-squares `slope` of its curve, as `ice_slope` of `ice_curves` gives it."""
    return scorer.trees(df.sparkSession).with_slope(df, column, grid)


def ice_slope(curves: DataFrame, ids: Sequence[str], points: int) -> DataFrame:
    """Least-squares slope of each curve; `n_rows` counts rows that share an id (copies)."""
    return curves.groupBy(*ids).agg(
        F.regr_slope("y_pred", "grid").alias("slope"),
        (F.count(F.lit(1)) / points).cast("bigint").alias("n_rows"),
    )


def elasticity_by_entity(
    features: DataFrame,
    scorer: Scorer,
    *,
    grid_points: int = 11,
    max_rows: int | None = None,
    keys: Sequence[str] | None = None,
    inputs: Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Median temperature slope per building over all of its rows, or over a sample of `max_rows`.

    Rows with a missing input are left out. Of a model of trees, each row's slope comes from one walk through the trees.
    For other forecasts, a row is copied for each grid value; a curve's points stay in one partition until the slope is
    taken, so one row per curve is shuffled, named by a hash of its inputs.
    """
    keys = list(keys or entity_keys(features))
    points = max(3, grid_points)
    inputs = list(inputs or present_features(features))
    complete = features.dropna(subset=inputs)
    if max_rows is not None:
        complete = sample_per_entity(complete, max_rows, keys=keys, seed=seed)
    if isinstance(scorer, ModelScorer):
        slopes = response_slopes(complete, scorer, unit_grid(points)).select(*keys, "slope", F.lit(1).cast("bigint").alias("n_rows"))
        return _median_slopes(cut_lineage(slopes), keys)
    others = [c for c in inputs if c != TEMPERATURE]
    named = complete.withColumn("__curve", F.xxhash64("full_timestamp", *others))
    ids = [*keys, "__curve"]
    return _median_slopes(cut_lineage(ice_slope(ice_curves(named, scorer, unit_grid(points), ids=ids), ids, points)), keys)


def _median_slopes(slopes: DataFrame, keys: Sequence[str]) -> DataFrame:
    rows = slopes.groupBy(*keys).agg(F.sum("n_rows").alias("n_rows_used"))
    medians = exact_quantiles(slopes, "slope", [0.5], keys, names=["elasticity"], weight="n_rows")
    return join_lookup(rows, medians, keys, null_safe=True).select(*keys, "elasticity", "n_rows_used")


def segment_by_quartile(df: DataFrame, column: str = "elasticity", out: str = "segment", **options) -> DataFrame:
    """High from the third quartile up, Low to the first quartile, else Moderate; missing is Unknown."""
    quartiles = exact_quantiles(df, column, [0.25, 0.75], names=["low", "high"], **options)
    x = F.col(column)
    label = (
        F.when(x.isNull(), "Unknown")
        .when(x >= F.col("__q.high"), "High")
        .when(x <= F.col("__q.low"), "Low")
        .otherwise("Moderate")
    )
    return attach_row(df, quartiles, "__q").withColumn(out, label).drop("__q")


def elasticity_summary(segmented: DataFrame, **options) -> DataFrame:
    """One row: buildings, scored buildings, quartiles, and buildings per segment."""
    e, s = F.col("elasticity"), F.col("segment")
    counts = segmented.agg(
        F.count(F.lit(1)).alias("n_buildings"),
        F.count(e).alias("n_with_scores"),
        *[
            F.count_if(s == name).alias(f"n_{name.lower()}")
            for name in ("High", "Moderate", "Low", "Unknown")
        ],
    )
    quartiles = exact_quantiles(
        segmented, "elasticity", [0.25, 0.5, 0.75],
        names=["q25_elasticity", "median_elasticity", "q75_elasticity"], **options,
    )
    return attach_row(counts, quartiles, "__q").select(*counts.columns, "__q.*")


def profile_at_median(
    df: DataFrame,
    scorer: Scorer,
    column: str,
    grid: Sequence[float] | Column,
    *,
    inputs: Sequence[str] | None = None,
) -> DataFrame:
    """The prediction along one feature, all others at their median: (grid, y_pred)."""
    inputs = list(inputs or present_features(df))
    base = exact_medians(df.dropna(subset=inputs), inputs)
    points = grid if isinstance(grid, Column) else F.array(*[F.lit(float(v)) for v in grid])
    return scorer(base.withColumn(column, F.explode(points))).select(
        F.col(column).cast("double").alias("grid"), F.col("y_pred").cast("double").alias("y_pred")
    )


def profile_precipitation(
    df: DataFrame, scorer: Scorer, *, points: int = 41, inputs: Sequence[str] | None = None
) -> DataFrame:
    """As `profile_at_median` along precipitation, from 0 to its 99th percentile."""
    inputs = list(inputs or present_features(df))
    complete = df.dropna(subset=inputs)
    top = exact_quantiles(complete, "precipitation", [0.99], names=["p99"])
    base = attach_row(exact_medians(complete, inputs), top, "__top")
    upper = F.greatest(F.col("__top.p99"), F.lit(1e-6))
    steps = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: i * (upper / (points - 1)))
    gridded = base.withColumn("precipitation", F.explode(steps)).drop("__top")
    return scorer(gridded).select(
        F.col("precipitation").alias("grid"), F.col("y_pred").cast("double").alias("y_pred")
    )


def averaged_profile(curves: DataFrame) -> DataFrame:
    """The mean of ICE curves at each grid value."""
    return curves.groupBy("grid").agg(F.avg("y_pred").alias("y_pred"))


def pca_2d(
    df: DataFrame, columns: Sequence[str] | None = None, *, keys: Sequence[str] = ()
) -> DataFrame:
    """First two principal components of the centred numeric columns, rows without gaps only."""
    columns = list(columns or numeric_columns(df))
    complete = df.dropna(subset=columns).select(*keys, *[F.col(c).cast("double").alias(f"__{c}") for c in columns])
    raw = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__raw").transform(complete)
    raw = raw.select(*keys, "__raw").persist(StorageLevel.MEMORY_AND_DISK)
    centred = (
        StandardScaler(inputCol="__raw", outputCol="__centred", withMean=True, withStd=False)
        .fit(raw)
        .transform(raw)
    )
    scores = PCA(k=2, inputCol="__centred", outputCol="__scores").fit(centred).transform(centred)
    pair = vector_to_array("__scores")
    out = cut_lineage(scores.select(*keys, pair[0].alias("pc1"), pair[1].alias("pc2")))
    raw.unpersist()
    return out


def kmeans_profiles(
    features: DataFrame,
    *,
    k: int = 4,
    starts: int = 10,
    seed: int = 42,
    keys: Sequence[str] | None = None,
    **options,
) -> tuple[DataFrame, DataFrame]:
    """Clusters of 24-hour profiles: (buildings with cluster, centres per cluster and hour).

    The start with the lowest cost wins; all starts share each pass over the profiles (`plans/clusters.py`).
    """
    keys = list(keys or entity_keys(features))
    columns = [f"h{h}" for h in HOURS]
    labels, found, _ = cluster_rows(hourly_profile(features, keys), keys, columns, k=k, starts=starts, seed=seed, **options)
    centres = features.sparkSession.createDataFrame(
        [(c, h, float(v)) for c, centre in enumerate(found) for h, v in enumerate(centre)],
        "cluster int, hour int, usage double",
    )
    return labels, centres
