"""Queries for models, scoring and explanation (survey 2.9). Formula scorers are SQL-checked."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.catalog.ctes import cte, sql
from loadcurve.catalog.registry import query, r6, rounded, sql_r6
from loadcurve.operators.aggregates import HOURS, hourly_profile, metric_mae_by_entity
from loadcurve.operators.onerow import attach_row
from loadcurve.plans import explain, models
from loadcurve.plans.features import prediction_features
from loadcurve.plans.splits import filter_split, quantile_cutoffs
from loadcurve.session import cut_lineage, scratch_path
from loadcurve.sources import fixtures as fx

# A forecast by formula, so that curves, slopes and segments can be checked in SQL.
_FORMULA = (
    "0.41379163 * lag_1h + 0.30718271 * rollmean_24h + 0.20931937 * {t} * lag_24h + 0.10173539 * {t} * {t}"
    " + 0.00113717 * {h} + 0.00013717931 * {p}"
)


def _formula_text(t: str = "apparent_temperature_norm", h: str = "hour", p: str = "precipitation") -> str:
    # Exponents make both engines read the constants as doubles.
    return re.sub(r"(0\.\d+)", r"\1e0", _FORMULA).format(t=t, h=h, p=p)


_fitted: dict[tuple[str, str, str], object] = {}


def _formula() -> models.Scorer:
    return models.column_scorer(F.expr(_formula_text()))


def _split(spark: SparkSession, sf: str, *only: str) -> DataFrame:
    features = fx.features(spark, sf)
    return filter_split(features, quantile_cutoffs(features), only=only or None)


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return _split(spark, sf, "train")


def _model(spark: SparkSession, sf: str, kind: str):
    """A fitted model, once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _fitted:
        if kind == "forest":
            _fitted[key] = models.train_random_forest(_train(spark, sf))
        else:
            _fitted[key] = models.train_gradient_boosting(_train(spark, sf))
    return _fitted[key]


def _scorer(spark: SparkSession, sf: str, kind: str) -> models.Scorer:
    """One forecast; only its own model is fitted."""
    return models.column_scorer(F.col("lag_1h")) if kind == "naive" else models.model_scorer(_model(spark, sf, kind))


def _scorers(spark: SparkSession, sf: str) -> dict[str, models.Scorer]:
    return {kind: _scorer(spark, sf, kind) for kind in ("naive", "forest", "boosted")}


@query("forecast_naive", sql(f"""
SELECT region, building_name, full_timestamp, {sql_r6('y_true', 'y_true')}, {sql_r6('y_pred', 'y_pred')} FROM preds
"""))
def naive(spark: SparkSession, sf: str) -> DataFrame:
    scorer = models.column_scorer(F.col("lag_1h"))
    return rounded(models.prediction_table(fx.features(spark, sf), scorer), "y_true", "y_pred")


# What a fitted model predicts is not for SQL to say. These queries return what must hold of the predictions: their keys and
# targets, that they keep to the range of the targets in training (which averages of targets do, and boosted sums do within a
# small overshoot), and what no constant forecast meets: predictions vary, and on the rows learned from they err less than the mean.
_OVERSHOOT = 0.25
#: Share of the error of the training mean that a model's error on its training rows stays below.
_FIT_SHARE = 0.9


def _checked(spark: SparkSession, sf: str, predictions: DataFrame, column: str = "y_pred") -> DataFrame:
    predictions = cut_lineage(predictions)
    limits = _train(spark, sf).agg(F.min(K.TARGET).alias("lo"), F.max(K.TARGET).alias("hi"), F.stddev_pop(K.TARGET).alias("sd"))
    varies = predictions.agg(F.stddev_pop(column).alias("sd"))
    slack = _OVERSHOOT * (F.col("__limits.hi") - F.col("__limits.lo"))
    inside = F.col(column).between(F.col("__limits.lo") - slack, F.col("__limits.hi") + slack)
    marked = attach_row(attach_row(predictions, limits, "__limits"), varies, "__made")
    marked = marked.withColumns({"in_range": F.coalesce(inside, F.lit(False)), "varies": F.col("__made.sd") > 0.01 * F.col("__limits.sd")})
    return marked.drop("__limits", "__made", column)


def _fit_checked(spark: SparkSession, sf: str, kind: str, trees: int) -> DataFrame:
    """The training rows with the facts of their predictions, and the number of trees."""
    predictions = cut_lineage(models.prediction_table(_train(spark, sf), models.model_scorer(_model(spark, sf, kind))))
    means = predictions.agg(F.avg("y_true").alias("m"))
    errors = attach_row(predictions, means, "__mean").agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("own"), F.avg(F.abs(F.col("y_true") - F.col("__mean.m"))).alias("mean")
    )
    fits = (F.col("__errors.own") < _FIT_SHARE * F.col("__errors.mean")).alias("fits")
    out = attach_row(_checked(spark, sf, predictions), errors, "__errors")
    return out.select("*", fits, F.lit(trees).alias("n_trees")).drop("__errors")


def _keys_sql(split: str, *facts: str) -> str:
    return sql(f"""
SELECT region, building_name, full_timestamp, {sql_r6('y_next', 'y_true')}, {', '.join(facts)}
FROM split_features WHERE split = '{split}'
""")


_IN_RANGE = ("TRUE AS in_range", "TRUE AS varies")


@query("train_random_forest", _keys_sql("train", *_IN_RANGE, "TRUE AS fits", "200 AS n_trees"))
def forest(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit_checked(spark, sf, "forest", _model(spark, sf, "forest").stages[-1].getNumTrees), "y_true")


@query("train_gradient_boosting", _keys_sql("train", *_IN_RANGE, "TRUE AS fits", "300 AS n_trees"))
def boosted(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_fit_checked(spark, sf, "boosted", len(_model(spark, sf, "boosted").trees)), "y_true")


# A target that trees can meet exactly: steps of two whole-numbered inputs, and a level of its own where an input is missing.
_STEPS = "CASE WHEN {d} = 2 THEN 0.9e0 WHEN {h} < 12 THEN 0.25e0 ELSE 0.5e0 END"
_STEP_INPUTS = ["hour", "rain", "lag_1h"]


def _step_model(spark: SparkSession, sf: str):
    """One tree of full step over the training rows; `rain` is missing on the days of their own level."""
    rows = _split(spark, sf).withColumn("rain", F.when(F.col("day_of_week") != 2, F.lit(0.5)))
    rows = rows.withColumn(K.TARGET, F.expr(_STEPS.format(d="day_of_week", h="hour")))
    key = (spark.sparkContext.applicationId, sf, "steps")
    if key not in _fitted:
        train = rows.where("split = 'train'")
        _fitted[key] = models.train_gradient_boosting(train, max_iter=1, max_depth=4, step_size=1.0, features=_STEP_INPUTS)
    return rows, models.model_scorer(_fitted[key])


@query("boosted_step_function", sql(f"""
SELECT region, building_name, full_timestamp, {sql_r6(_STEPS.format(d='day_of_week', h='hour'), 'y_pred')} FROM split_features
"""))
def step_function(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions for every row of a tree that is fitted to steps of its inputs, missing values among them: the steps themselves."""
    rows, scorer = _step_model(spark, sf)
    return rounded(scorer(rows).select("region", "building_name", "full_timestamp", "y_pred"), "y_pred")


@query("response_steps", sql(f"""
SELECT region, building_name, full_timestamp, g AS grid, {sql_r6(_STEPS.format(d='day_of_week', h='g'), 'y_pred')}
FROM split_features, range(24) r(g) WHERE split = 'test'
"""))
def steps_of_response(spark: SparkSession, sf: str) -> DataFrame:
    """The response of every test row to the hour, from one walk through the tree, as one row for each hour."""
    rows, scorer = _step_model(spark, sf)
    hours = [float(h) for h in range(24)]
    curves = explain.ice_steps(rows.where("split = 'test'"), scorer, hours, column="hour")
    long = curves.select("region", "building_name", "full_timestamp", F.posexplode("response").alias("grid", "y_pred"))
    return rounded(long.withColumn("grid", F.col("grid").cast("bigint")), "y_pred")


@query("response_slopes", sql("""
SELECT model, region, building_name, full_timestamp, TRUE AS agrees, TRUE AS varies
FROM split_features, (VALUES ('forest'), ('boosted')) m(model) WHERE split = 'test'
"""))
def slopes_of_response(spark: SparkSession, sf: str) -> DataFrame:
    """For each test row and fitted model, whether the slope of its response is that of its curve point by point."""
    grid, keys = explain.unit_grid(11), ["region", "building_name", "full_timestamp"]
    rows, parts = cut_lineage(_split(spark, sf, "test")), []
    for name in ("forest", "boosted"):
        scorer = _scorer(spark, sf, name)
        own = explain.response_slopes(rows, scorer, grid).select(*keys, F.col("slope").alias("own"))
        curves = explain.ice_slope(explain.ice_curves(rows, scorer, grid, ids=keys), keys, len(grid))
        both = cut_lineage(own.join(curves, keys))
        facts = both.agg(F.stddev_pop("own").alias("sd"))
        agrees = (F.abs(F.col("own") - F.col("slope")) < 1e-9).alias("agrees")
        parts.append(attach_row(both, facts, "__f").select(F.lit(name).alias("model"), *keys, agrees, (F.col("__f.sd") > 0).alias("varies")))
    return parts[0].unionByName(parts[1])


@query("evaluate_models", sql("""
SELECT model, split, count(*) AS n, TRUE AS agrees, TRUE AS varies, CASE WHEN model = 'naive' THEN round(avg(abs(y_next - lag_1h)), 6) + 0.0 END AS naive_mae
FROM split_features, (VALUES ('naive'), ('forest'), ('boosted')) m(model) WHERE split <> 'train' GROUP BY 1, 2
"""))
def evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """MAE and RMSE by model and split: the naive MAE, whether all agree with sums over stored predictions, and whether those vary."""
    rows, scorers = _split(spark, sf, "val", "test"), _scorers(spark, sf)
    metrics = models.evaluate_models(rows, scorers)
    scored = cut_lineage(models.score_models(rows, scorers).select("model", "split", K.TARGET, "y_pred", (F.col("y_pred") - F.col(K.TARGET)).alias("e")))
    again = scored.groupBy("model", "split").agg(
        (F.sum(F.abs("e")) / F.count("e")).alias("a"), F.sqrt(F.sum(F.col("e") * F.col("e")) / F.count("e")).alias("q"),
        (F.stddev_pop("y_pred") > 0.01 * F.stddev_pop(K.TARGET)).alias("varies"),
    )
    agrees = (F.abs(F.col("mae") - F.col("a")) < 1e-9) & (F.abs(F.col("rmse") - F.col("q")) < 1e-9)
    naive_mae = F.when(F.col("model") == "naive", r6("mae")).alias("naive_mae")
    return metrics.join(again, ["model", "split"]).select("model", "split", "n", agrees.alias("agrees"), "varies", naive_mae)


@query("predict_test", _keys_sql("test", *_IN_RANGE))
def test_predictions(spark: SparkSession, sf: str) -> DataFrame:
    out = models.predict_test(_split(spark, sf, "test"), _scorer(spark, sf, "boosted"))
    return rounded(_checked(spark, sf, out), "y_true")


_SCORED_FEATURES = ["lag_1h", "lag_24h", "rollmean_24h", "apparent_temperature_norm", "temp_lag_1h", "temp_lag_24h", "precipitation"]


@query("predict_next_hour", sql("""
SELECT region, building_name, full_timestamp AS timestamp_last, full_timestamp + INTERVAL 1 HOUR AS timestamp_next,
       CAST(hour(full_timestamp) AS INTEGER) AS hour, CAST(isodow(full_timestamp) - 1 AS INTEGER) AS day_of_week,
       CAST(month(full_timestamp) AS INTEGER) AS month, is_day, is_weekend, is_holiday, region_id, TRUE AS in_range, TRUE AS varies, """
    + ", ".join(sql_r6(c, c) for c in _SCORED_FEATURES) + """
FROM lagged WHERE lag_1h IS NOT NULL AND lag_24h IS NOT NULL AND rollmean_24h IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY region, building_name ORDER BY full_timestamp DESC) = 1
"""))
def next_hour(spark: SparkSession, sf: str) -> DataFrame:
    latest = prediction_features(fx.unified(spark, sf), unique_hours=True)
    out = models.predict_next_hour(latest, _scorer(spark, sf, "boosted"))
    return rounded(_checked(spark, sf, out, "y_pred_next"), *_SCORED_FEATURES)


@query("model_save_load", _keys_sql("test", "TRUE AS same"))
def save_load(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the model that was stored and read again predicts the same for each test row."""
    path = scratch_path(spark, "model")
    models.save_model(_model(spark, sf, "forest"), path)
    both = {"first": models.model_scorer(_model(spark, sf, "forest")), "again": models.model_scorer(models.load_model(path))}
    keys = ["region", "building_name", "full_timestamp"]
    scored = models.score_models(_split(spark, sf, "test"), both).groupBy(*keys).agg(
        F.max(K.TARGET).alias("y_true"), (F.min("y_pred") == F.max("y_pred")).alias("same")
    )
    return rounded(scored, "y_true")


_FORMULA_INPUTS = ["lag_1h", "rollmean_24h", "lag_24h", "apparent_temperature_norm", "hour", "precipitation"]


@query("permutation_importance", sql(f"""
SELECT feature, feature IN ({', '.join(f"'{c}'" for c in _FORMULA_INPUTS)}) AS matters, n_rows
FROM (SELECT unnest([{', '.join(f"'{c}'" for c in K.MODEL_FEATURES)}]) AS feature), (SELECT count(*) AS n_rows FROM split_features WHERE split = 'val')
"""))
def importance(spark: SparkSession, sf: str) -> DataFrame:
    """Which inputs matter to a forecast by formula: shuffling any other changes nothing at all."""
    val = _split(spark, sf, "val")
    found = models.permutation_importance(val, _formula())
    matters = (F.col("importance_mean") != 0) | (F.col("importance_std") != 0)
    return attach_row(found.select("feature", matters.alias("matters")), val.agg(F.count(F.lit(1)).alias("n_rows")), "__n").select(
        "feature", "matters", "__n.n_rows"
    )


cte("formula_curves", f"""
SELECT region, building_name, full_timestamp, g / 10.0 AS grid, {_formula_text(t='(g / 10.0)')} AS y_pred
FROM features, range(11) r(g)
""")
cte("formula_slopes", """
SELECT region, building_name, full_timestamp, regr_slope(y_pred, grid) AS slope FROM formula_curves GROUP BY 1, 2, 3
""")
cte("formula_elasticity", """
SELECT region, building_name, median(slope) AS elasticity, count(*) AS n_rows_used FROM formula_slopes GROUP BY 1, 2
""")
cte("formula_segments", """
SELECT e.*, CASE WHEN elasticity >= q75 THEN 'High' WHEN elasticity <= q25 THEN 'Low' ELSE 'Moderate' END AS segment
FROM formula_elasticity e, (SELECT quantile_cont(elasticity, 0.25) AS q25, quantile_cont(elasticity, 0.75) AS q75 FROM formula_elasticity)
""")


@query("ice_curves", sql(f"""
SELECT building_name, full_timestamp, {sql_r6('grid', 'grid')}, {sql_r6('y_pred', 'y_pred')} FROM formula_curves
"""))
def curves(spark: SparkSession, sf: str) -> DataFrame:
    out = explain.ice_curves(fx.features(spark, sf), _formula(), explain.unit_grid(11))
    return rounded(out, "grid", "y_pred")


@query("ice_slope", sql(f"""
SELECT building_name, full_timestamp, {sql_r6('slope', 'slope')}, CAST(1 AS BIGINT) AS n_rows FROM formula_slopes
"""))
def slopes(spark: SparkSession, sf: str) -> DataFrame:
    grid = explain.unit_grid(11)
    curves = explain.ice_curves(fx.features(spark, sf), _formula(), grid)
    return rounded(explain.ice_slope(curves, ["building_name", "full_timestamp"], len(grid)), "slope")


def _elasticity(spark: SparkSession, sf: str) -> DataFrame:
    return explain.elasticity_by_entity(fx.features(spark, sf), _formula())


@query("elasticity_by_entity", sql(f"""
SELECT region, building_name, {sql_r6('elasticity', 'elasticity')}, n_rows_used FROM formula_elasticity
"""))
def elasticity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_elasticity(spark, sf), "elasticity")


@query("segment_by_quartile", sql(f"""
SELECT region, building_name, {sql_r6('elasticity', 'elasticity')}, n_rows_used, segment FROM formula_segments
"""))
def segments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(explain.segment_by_quartile(_elasticity(spark, sf)), "elasticity")


@query("elasticity_summary", sql(f"""
SELECT count(*) AS n_buildings, count(elasticity) AS n_with_scores,
       {sql_r6('quantile_cont(elasticity, 0.25)', 'q25_elasticity')}, {sql_r6('median(elasticity)', 'median_elasticity')},
       {sql_r6('quantile_cont(elasticity, 0.75)', 'q75_elasticity')},
       count(*) FILTER (segment = 'High') AS n_high, count(*) FILTER (segment = 'Moderate') AS n_moderate,
       count(*) FILTER (segment = 'Low') AS n_low, count(*) FILTER (segment = 'Unknown') AS n_unknown
FROM formula_segments
"""))
def summary(spark: SparkSession, sf: str) -> DataFrame:
    out = explain.elasticity_summary(explain.segment_by_quartile(_elasticity(spark, sf)))
    return rounded(out, "q25_elasticity", "median_elasticity", "q75_elasticity")


cte("median_row", "SELECT " + ", ".join(f"median({c})::DOUBLE AS {c}" for c in K.MODEL_FEATURES) + " FROM features")


@query("profile_at_median", sql(f"""
SELECT {sql_r6('g / 40.0', 'grid')}, {sql_r6(_formula_text(t='(g / 40.0)'), 'y_pred')}, 'temperature' AS profile
FROM median_row, range(41) r(g)
UNION ALL
SELECT g::DOUBLE, {sql_r6(_formula_text(h='g'), 'y_pred')}, 'hour' FROM median_row, range(24) r(g)
UNION ALL
SELECT {sql_r6('g / 40.0 * p99', 'grid')}, {sql_r6(_formula_text(p='(g / 40.0 * p99)'), 'y_pred')}, 'precipitation'
FROM median_row, (SELECT greatest(quantile_cont(precipitation, 0.99), 1e-6) AS p99 FROM features), range(41) r(g)
"""))
def profile(spark: SparkSession, sf: str) -> DataFrame:
    features = fx.features(spark, sf)
    scorer = _formula()
    parts = {
        "temperature": explain.profile_at_median(features, scorer, explain.TEMPERATURE, explain.unit_grid(41)),
        "hour": explain.profile_at_median(features, scorer, "hour", range(24)),
        "precipitation": explain.profile_precipitation(features, scorer),
    }
    named = [df.withColumn("profile", F.lit(name)) for name, df in parts.items()]
    return rounded(named[0].unionByName(named[1]).unionByName(named[2]), "grid", "y_pred")


@query("pca_2d", sql("""
SELECT count(*) AS n, 0.0::DOUBLE AS mean_1, 0.0::DOUBLE AS mean_2, TRUE AS uncorrelated, TRUE AS in_order, TRUE AS least_error FROM features
WHERE usage_pb IS NOT NULL AND apparent_temperature_norm IS NOT NULL AND precipitation IS NOT NULL AND is_day IS NOT NULL
"""))
def components(spark: SparkSession, sf: str) -> DataFrame:
    """Of the two scores: centred, uncorrelated, the first wider, and together at least as wide as any two columns."""
    columns = ["usage_pb", "hour", "day_of_week", "month", "apparent_temperature_norm", "precipitation",
               "is_day", "is_weekend", "is_holiday", "region_id"]
    features = fx.features(spark, sf)
    scores = explain.pca_2d(features, columns, keys=["building_name", "full_timestamp"])
    spreads = features.dropna(subset=columns).agg(*[F.var_pop(F.col(c).cast("double")).alias(c) for c in columns])
    widest = spreads.select(F.sort_array(F.array(*columns), asc=False).alias("v"))
    facts = scores.agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("pc1")).alias("mean_1"), r6(F.avg("pc2")).alias("mean_2"),
        (F.abs(F.corr("pc1", "pc2")) < 1e-6).alias("uncorrelated"), (F.var_pop("pc1") >= F.var_pop("pc2")).alias("in_order"),
        (F.var_pop("pc1") + F.var_pop("pc2")).alias("held"),
    )
    least = F.col("held") >= (F.col("__w.v")[0] + F.col("__w.v")[1]) * (1 - 1e-9)
    return attach_row(facts, widest, "__w").withColumn("least_error", least).drop("held", "__w")


def _clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Labels and centres, once per session and folder."""
    key = (spark.sparkContext.applicationId, sf, "clusters")
    if key not in _fitted:
        _fitted[key] = explain.kmeans_profiles(fx.features(spark, sf))
    return _fitted[key]


@query("kmeans_profiles", sql("SELECT DISTINCT region, building_name, TRUE AS nearest FROM features"))
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each building's cluster is the one of the nearest centre."""
    labels, centres = _clusters(spark, sf)
    hours = [F.struct(F.lit(h).alias("hour"), F.col(f"h{h}").alias("x")) for h in HOURS]
    long = hourly_profile(fx.features(spark, sf)).select("region", "building_name", F.explode(F.array(*hours)).alias("p"))
    long = long.select("region", "building_name", "p.*")
    away = long.join(F.broadcast(centres), "hour").groupBy("region", "building_name", "cluster").agg(
        F.sum((F.col("x") - F.col("usage")) ** 2).alias("d")
    )
    best = away.groupBy("region", "building_name").agg(F.min("d").alias("least"))
    own = away.join(labels, ["region", "building_name", "cluster"]).join(best, ["region", "building_name"])
    return own.select("region", "building_name", (F.col("d") <= F.col("least") + 1e-9).alias("nearest"))


@query("kmeans_centres", sql("""
SELECT CAST(c AS INTEGER) AS cluster, CAST(h AS INTEGER) AS hour, TRUE AS within FROM range(4) a(c), range(24) b(h), (SELECT count(*) FROM features)
"""))
def cluster_centres(spark: SparkSession, sf: str) -> DataFrame:
    """The centre of each cluster at each hour, and whether it lies between the least and greatest usage of a building."""
    _, centres = _clusters(spark, sf)
    hours = [F.struct(F.lit(h).alias("hour"), F.col(f"h{h}").alias("x")) for h in HOURS]
    limits = hourly_profile(fx.features(spark, sf)).select(F.explode(F.array(*hours)).alias("p")).groupBy("p.hour").agg(
        F.min("p.x").alias("lo"), F.max("p.x").alias("hi")
    )
    within = F.col("usage").between(F.col("lo") - 1e-9, F.col("hi") + 1e-9)
    return centres.join(limits, "hour").select("cluster", "hour", within.alias("within"))


@query("elasticity_by_model", sql(f"""
SELECT region, building_name, count(*) AS n_rows_used, TRUE AS rule_holds, TRUE AS varies FROM split_features
WHERE split = 'test' AND {' AND '.join(f'{c} IS NOT NULL' for c in K.MODEL_FEATURES)} GROUP BY 1, 2
"""))
def model_elasticity(spark: SparkSession, sf: str) -> DataFrame:
    """Rows behind the elasticity of every building under the fitted forest, and whether its segment follows the rule."""
    scorer = _scorer(spark, sf, "forest")
    out = cut_lineage(explain.segment_by_quartile(explain.elasticity_by_entity(_split(spark, sf, "test"), scorer)))
    quarters = out.agg(F.percentile("elasticity", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.stddev_pop("elasticity").alias("sd"))
    e, q = F.col("elasticity"), F.col("__q.q")
    rule = F.when(e >= q[1], "High").when(e <= q[0], "Low").otherwise("Moderate")
    marked = attach_row(out, quarters, "__q").withColumn("rule_holds", F.col("segment") == rule)
    return marked.select("region", "building_name", "n_rows_used", "rule_holds", (F.col("__q.sd") > 0).alias("varies"))


@query("mae_of_forest_by_entity", sql("""
SELECT region, building_name, count(*) AS n, TRUE AS agrees, TRUE AS varies FROM split_features WHERE split = 'test' GROUP BY 1, 2
"""))
def forest_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Test MAE per building of the fitted forest: rows behind it, and whether it agrees with sums over stored predictions."""
    predicted = cut_lineage(models.predict_test(_split(spark, sf, "test"), _scorer(spark, sf, "forest")))
    error = F.abs(F.col("y_true") - F.col("y_pred"))
    again = predicted.groupBy("region", "building_name").agg(
        F.sum(error).alias("s"), F.count(error).alias("n"), F.stddev_pop("y_pred").alias("sd")
    )
    both = metric_mae_by_entity(predicted).join(again, ["region", "building_name"])
    agrees = (F.abs(F.col("mae") * F.col("n") - F.col("s")) < 1e-9).alias("agrees")
    return both.select("region", "building_name", "n", agrees, ((F.col("sd") > 0) | (F.col("n") == 1)).alias("varies"))


@query("averaged_profile", sql(f"""
SELECT {sql_r6('grid', 'grid')}, {sql_r6('avg(y_pred)', 'y_pred')} FROM formula_curves GROUP BY grid
"""))
def mean_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = explain.ice_curves(fx.features(spark, sf), _formula(), explain.unit_grid(11))
    return rounded(explain.averaged_profile(out), "grid", "y_pred")
