"""Unions and wide-to-long."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.columns import quoted


def union_sources(sources: Sequence[DataFrame]) -> DataFrame:
    """Stack frames whose columns differ; what a frame lacks is NULL."""
    if not sources:
        raise ValueError("no sources to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sources)


def melt_wide_readings(
    df: DataFrame,
    id_columns: Sequence[str],
    *,
    slot: str = "time",
    value: str = "usage",
) -> DataFrame:
    """One row per slot column that has a value."""
    slots = [c for c in df.columns if c not in id_columns]
    return df.unpivot(
        [quoted(c) for c in id_columns], [quoted(c) for c in slots], slot, value
    ).where(F.col(value).isNotNull())


def melt_slots(
    df: DataFrame, id_columns: Sequence[str], labels: dict[str, int], *, slot: str, value: str
) -> DataFrame:
    """As `melt_wide_readings`, with a number per slot column in place of its name."""
    pairs = [F.struct(F.lit(n).alias(slot), F.col(quoted(c)).alias(value)) for c, n in labels.items()]
    return df.select(*[F.col(quoted(c)) for c in id_columns], F.inline(F.array(*pairs))).where(
        F.col(value).isNotNull()
    )


def sort_canonical(
    df: DataFrame, keys: Sequence[str] = ("region", "building_name", "full_timestamp")
) -> DataFrame:
    """Global order by region, building and time (a range shuffle; for sinks, not for windows)."""
    return df.orderBy(*keys)
