"""Writing results. Every sink writes a directory of part files from the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sink_csv(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def sink_parquet(
    df: DataFrame,
    path: str,
    *,
    partition_by: Sequence[str] = ("region",),
    sort_by: Sequence[str] = ("building_name", "full_timestamp"),
    mode: str = "overwrite",
) -> None:
    """Parquet by partition column, sorted within files so that row-group statistics are narrow.

    Rows are rebalanced by region and building: a building stays together, and one that is too large
    for a task is split at run time, without a sampling pass over the input.
    """
    partition_by = [c for c in partition_by if c in df.columns]
    sort_by = [c for c in sort_by if c in df.columns]
    together = [*partition_by, *sort_by[:1]]
    balanced = df.hint("rebalance", *together) if together else df
    order = [*partition_by, *sort_by]
    ordered = balanced.sortWithinPartitions(*order) if order else balanced
    ordered.write.mode(mode).partitionBy(*partition_by).parquet(path)


def sink_head_sample(
    df: DataFrame,
    n: int = 5000,
    keys: Sequence[str] = ("region", "building_name", "full_timestamp"),
) -> DataFrame:
    """The first n rows in key order (a top-k, no full sort)."""
    return df.orderBy(*keys).limit(n)


def metric_rows(metrics: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Metrics in long form: keys, metric name, value."""
    return metrics.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        list(keys), list(values), "metric", "value"
    )


def sink_metrics(metrics: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Metrics as JSON lines; a metric table is a few rows, so one file."""
    metrics.coalesce(1).write.mode(mode).json(path)
