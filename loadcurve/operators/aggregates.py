"""Profiles, metrics and grouped summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions import timefns
from loadcurve.functions.columns import entity_keys, quoted
from loadcurve.functions.values import abs_error
from loadcurve.operators.onerow import attach_row
from loadcurve.operators.ranks import exact_quantiles

HOURS = list(range(24))
MONTHS = list(range(1, 13))
WEEKDAYS = list(range(7))


def agg_weather_hourly(
    df: DataFrame,
    ts: str,
    temperature: str = "apparent_temperature",
    precipitation: str = "precipitation",
    is_day: str = "is_day",
    *,
    by: Sequence[str] = (),
    precipitation_rule: str = "sum",
) -> DataFrame:
    """One weather row per hour: mean temperature, summed (or highest) precipitation, any daylight.

    A sum over no values is 0; a highest of no values stays missing.
    """
    combine = {"sum": lambda c: F.coalesce(F.sum(c), F.lit(0.0)), "max": F.max}[precipitation_rule]
    return (
        df.withColumn("timestamp_hour", timefns.floor_hour(F.col(ts)))
        .groupBy(*by, "timestamp_hour")
        .agg(
            F.avg(temperature).alias(temperature),
            combine(precipitation).alias(precipitation),
            F.max(is_day).alias(is_day),
        )
    )


def profile_dataset(
    df: DataFrame, *, ts: str = "full_timestamp", by: str = "region", approximate: bool = False
) -> DataFrame:
    """Rows, distinct buildings and time range, per region and for all (`region` NULL)."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.rollup(by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct(F.col("building_name")).alias("n_buildings"),
        F.min(ts).alias("time_start"),
        F.max(ts).alias("time_end"),
    )


def profile_missingness(df: DataFrame) -> DataFrame:
    """Share of missing values per column, highest first; one pass over the data."""
    shares = [F.avg(F.col(quoted(c)).isNull().cast("int")).alias(c) for c in df.columns]
    return (
        df.agg(*shares)
        .unpivot([], [F.col(quoted(c)) for c in df.columns], "column_name", "missing_fraction")
        .orderBy(F.desc("missing_fraction"), "column_name")
    )


def profile_missing_matrix(
    df: DataFrame, keys: Sequence[str], *, max_columns: int | None = None
) -> DataFrame:
    """0/1 missing marks per row and column in long form; with `max_columns`, for the most incomplete columns."""
    columns = list(df.columns)
    if max_columns is not None and len(columns) > max_columns:
        columns = [r["column_name"] for r in profile_missingness(df).limit(max_columns).collect()]
    key_columns = [F.col(quoted(k)).alias(f"key_{k}") for k in keys]
    marks = [F.col(quoted(c)).isNull().cast("int").alias(c) for c in columns]
    return df.select(*key_columns, *marks).unpivot(
        [f"key_{k}" for k in keys], [quoted(c) for c in columns], "column_name", "is_missing"
    )


def building_region_map(df: DataFrame) -> DataFrame:
    """One region per building (the alphabetically first, so that it does not depend on row order)."""
    return (
        df.where(F.col("building_name").isNotNull() & F.col("region").isNotNull())
        .groupBy("building_name")
        .agg(F.min("region").alias("region"))
    )


def metric_mae_rmse(predictions: DataFrame, by: Sequence[str] = ("model", "split")) -> DataFrame:
    error = F.col("y_true") - F.col("y_pred")
    return predictions.groupBy(*by).agg(
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.count(error).alias("n"),
    )


def mae_by(predictions: DataFrame, by: dict[str, Column]) -> DataFrame:
    """Mean absolute error by any named expressions."""
    error = abs_error(F.col("y_true"), F.col("y_pred"))
    return predictions.groupBy(*[c.alias(n) for n, c in by.items()]).agg(F.avg(error).alias("mae"))


def metric_mae_by_entity(predictions: DataFrame, by: Sequence[str] | None = None) -> DataFrame:
    """MAE per building, best first."""
    by = list(by or entity_keys(predictions))
    return mae_by(predictions, {c: F.col(c) for c in by}).orderBy("mae", *by)


def pick_best_model(
    metrics: DataFrame, candidates: Sequence[str], *, split: str = "val"
) -> DataFrame:
    """The candidate with the lowest validation MAE; a tie goes to the earlier candidate."""
    priority = F.array_position(F.array(*[F.lit(c) for c in candidates]), F.col("model"))
    return (
        metrics.where((F.col("split") == split) & F.col("model").isin(list(candidates)))
        .where(F.col("mae").isNotNull())
        .agg(
            F.min_by("model", F.struct("mae", priority.alias("priority"))).alias("model"),
            F.min("mae").alias("mae"),
        )
    )


def model_comparison_table(
    metrics: DataFrame, splits: Sequence[str] = ("val", "test"), value: str = "mae"
) -> DataFrame:
    """One row per model, one MAE column per split."""
    wide = metrics.groupBy("model").pivot("split", list(splits)).agg(F.first(value))
    return wide.select("model", *[F.col(s).alias(f"{s}_{value}") for s in splits])


def pivot_mean(
    df: DataFrame, rows: dict[str, Column], column: Column, values: Sequence[int], x: Column, prefix: str
) -> DataFrame:
    """Mean of x by row keys and a listed set of column values, wide."""
    keyed = df.select(*[c.alias(n) for n, c in rows.items()], column.alias("__c"), x.alias("__x"))
    wide = keyed.groupBy(*rows).pivot("__c", list(values)).agg(F.avg("__x"))
    return wide.select(*rows, *[F.col(quoted(str(v))).alias(f"{prefix}{v}") for v in values])


def usage_heatmap_hour_dow(features: DataFrame, x: str = "usage_pb") -> DataFrame:
    return pivot_mean(features, {"hour": F.col("hour")}, F.col("day_of_week"), WEEKDAYS, F.col(x), "dow_")


def usage_heatmap_hour_month(features: DataFrame, x: str = "usage_pb") -> DataFrame:
    return pivot_mean(features, {"hour": F.col("hour")}, F.col("month"), MONTHS, F.col(x), "month_")


def hourly_profile(
    features: DataFrame, keys: Sequence[str] | None = None, x: str = "usage_pb"
) -> DataFrame:
    """Mean usage of each building at each hour of the day, wide; hours without data are 0."""
    keys = list(keys or entity_keys(features))
    wide = pivot_mean(features, {k: F.col(k) for k in keys}, F.col("hour"), HOURS, F.col(x), "h")
    return wide.na.fill(0.0, [f"h{h}" for h in HOURS])


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def _pearson(n: float, su: float, sv: float, suu: float, svv: float, suv: float) -> float | None:
    spread_u, spread_v = n * suu - su * su, n * svv - sv * sv
    if spread_u <= 1e-12 * n * suu or spread_v <= 1e-12 * n * svv:
        return None
    return max(-1.0, min(1.0, (n * suv - su * sv) / math.sqrt(spread_u * spread_v)))


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every column pair over the rows where both are present, long form.

    A first pass takes means and gaps; a second sums products of centred values, where only pairs
    with gaps need sums of their own. Plain sums keep a wide matrix within generated code. A pair
    without variance gives NULL.
    """
    columns = list(columns or numeric_columns(df))
    # NaN is a missing value here.
    x = {c: F.nanvl(F.col(quoted(c)).cast("double"), F.lit(None).cast("double")) for c in columns}
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(x[c]).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.avg(x[c]).alias(f"m{i}") for i, c in enumerate(columns)],
    ).first()
    has_gaps = {c for i, c in enumerate(columns) if first[f"n{i}"] < first["n"]}
    centred = {c: x[c] - F.lit(first[f"m{i}"] or 0.0) for i, c in enumerate(columns)}

    sums: dict[tuple, Column] = {}

    def total(kind: tuple, value: Column, *partners: str) -> tuple:
        masks = sorted(set(partners) & has_gaps)
        key = (*kind, *masks)
        if key not in sums:
            for m in masks:
                value = F.when(x[m].isNotNull(), value)
            sums[key] = F.coalesce(F.sum(value), F.lit(0.0))
        return key

    pairs = []
    for i, a in enumerate(columns):
        for b in columns[i:]:
            u, v = centred[a], centred[b]
            parts = [
                total(("n",), F.lit(1.0), a, b), total(("s", a), u, b), total(("s", b), v, a),
                total(("q", a), u * u, b), total(("q", b), v * v, a), total(("p", a, b), u * v),
            ]
            pairs.append((a, b, parts))
    values = dict(zip(sums, df.agg(*[c.alias(f"s{i}") for i, c in enumerate(sums.values())]).first()))
    # columns x columns numbers from here on.
    rows = []
    for a, b, parts in pairs:
        r = _pearson(*[values[k] for k in parts])
        rows += [(left, right, r) for left, right in {(a, b), (b, a)}]
    return df.sparkSession.createDataFrame(rows, "left_col string, right_col string, corr double")


def summary_five_number(df: DataFrame, column: str, **options) -> DataFrame:
    """Count, minimum, quartiles and maximum of a column, one row."""
    x = F.col(quoted(column))
    extremes = df.agg(F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"))
    quartiles = exact_quantiles(df, column, [0.25, 0.5, 0.75], names=["q25", "median", "q75"], **options)
    return attach_row(extremes, quartiles, "q").select("n", "min", "q.q25", "q.median", "q.q75", "max")
