"""Min-max scaling and label encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.constants import ENTITY_FLOOR, GLOBAL_FLOOR
from loadcurve.functions.columns import quoted
from loadcurve.operators.onerow import attach_row
from loadcurve.operators.sized import join_lookup


def _scaled(x: Column, low: Column, high: Column, floor: float, constant_value: float | None) -> Column:
    scaled = (x - low) / F.greatest(high - low, F.lit(floor))
    if constant_value is None:
        return scaled
    flat = low.isNull() | (low == high)
    return F.when(flat, F.lit(float(constant_value))).otherwise(scaled)


def normalize_minmax_columns(
    df: DataFrame,
    columns: dict[str, str],
    *,
    floor: float = GLOBAL_FLOOR,
    constant_value: float | None = None,
) -> DataFrame:
    """Scale columns ({source: result}) by their minimum and maximum over the whole frame.

    All limits come from one aggregate. A range is at least `floor`. With `constant_value`, a
    constant or empty column takes that value in every row instead.
    """
    limits = df.agg(
        *[
            side(quoted(c)).alias(f"{tag}{i}")
            for i, c in enumerate(columns)
            for tag, side in (("low", F.min), ("high", F.max))
        ]
    )
    scaled = {
        out: _scaled(
            F.col(quoted(c)), F.col(f"__limits.low{i}"), F.col(f"__limits.high{i}"), floor, constant_value
        )
        for i, (c, out) in enumerate(columns.items())
    }
    return attach_row(df, limits, "__limits").withColumns(scaled).drop("__limits")


def normalize_minmax_global(df: DataFrame, column: str, out: str, **options) -> DataFrame:
    """Scale one column by the minimum and maximum of the whole frame."""
    return normalize_minmax_columns(df, {column: out}, **options)


def entity_limits(df: DataFrame, column: str, keys: Sequence[str], where: Column | None = None) -> DataFrame:
    """Minimum and maximum per entity (`__low`, `__high`); combined before the shuffle."""
    fitted = df if where is None else df.where(where)
    c = F.col(quoted(column))
    return fitted.groupBy(*keys).agg(F.min(c).alias("__low"), F.max(c).alias("__high"))


def normalize_minmax_entity(
    df: DataFrame,
    column: str,
    out: str,
    keys: Sequence[str],
    *,
    floor: float = ENTITY_FLOOR,
    fit_where: Column | None = None,
) -> DataFrame:
    """Scale a column by its entity's own minimum and maximum.

    `fit_where` limits the rows the limits come from (for example the training period). The limits
    are one row per entity, combined before the shuffle and joined back as a sized lookup.
    """
    return scale_by_limits(df, entity_limits(df, column, keys, fit_where), column, out, keys, floor=floor)


def scale_by_limits(
    df: DataFrame, limits: DataFrame, column: str, out: str, keys: Sequence[str], *, floor: float = ENTITY_FLOOR
) -> DataFrame:
    """Scale a column by limits as `entity_limits` gives them."""
    joined = join_lookup(df, limits, keys, "left")
    return joined.withColumn(
        out, _scaled(F.col(quoted(column)), F.col("__low"), F.col("__high"), floor, None)
    ).drop("__low", "__high")


def region_dimension(df: DataFrame, column: str = "region") -> DataFrame:
    """(region, region_id): the sorted region labels with their index. A table of labels, a few rows."""
    labels = df.agg(F.array_sort(F.collect_set(column)).alias("labels"))
    return labels.select(F.posexplode("labels").alias("region_id", column)).select(column, "region_id")


def encode_region(df: DataFrame, dimension: DataFrame | None = None, column: str = "region") -> DataFrame:
    """Add `region_id`; pass the dimension stored at training to score with the same ids."""
    if dimension is not None:
        return join_lookup(df, dimension, [column], "left")
    labels = df.agg(F.array_sort(F.collect_set(column)).alias("labels"))
    position = F.array_position("__regions.labels", F.col(column)).cast("int") - 1
    return (
        attach_row(df, labels, "__regions").withColumn("region_id", position).drop("__regions")
    )
