"""Chronological split."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.functions import timefns
from loadcurve.operators.onerow import attach_row


def quantile_cutoffs(
    df: DataFrame, *, ts: str = "full_timestamp", train: float = 0.8, val: float = 0.1
) -> DataFrame:
    """One row (train_end, val_end): quantiles of the row times, over all rows.

    Rows are counted per distinct time before the quantile, so what one task holds is the number
    of distinct hours, not of rows.
    """
    per_time = (
        df.where(F.col(ts).isNotNull())
        .groupBy(timefns.epoch_seconds(F.col(ts)).alias("s"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    q = per_time.agg(F.percentile("s", [train, train + val], F.col("n")).alias("q"))
    return q.select(
        timefns.from_epoch_seconds(F.col("q")[0]).alias("train_end"),
        timefns.from_epoch_seconds(F.col("q")[1]).alias("val_end"),
    )


def split_label(ts: Column, train_end: Column, val_end: Column) -> Column:
    """train up to and including train_end, val up to and including val_end, test after."""
    return (
        F.when(ts <= train_end, F.lit("train"))
        .when(ts <= val_end, F.lit("val"))
        .when(ts > val_end, F.lit("test"))
    )


def filter_split(
    df: DataFrame, cutoffs: DataFrame, *, ts: str = "full_timestamp", only: Sequence[str] | None = None
) -> DataFrame:
    """Add the `split` column from a one-row cutoff table.

    `only` keeps the rows of the named splits, by comparisons of the time with constants that the
    scan can use to skip row groups.
    """
    t = F.col(ts)
    train_end, val_end = F.col("__cutoffs.train_end"), F.col("__cutoffs.val_end")
    rows = attach_row(df, cutoffs.select("train_end", "val_end"), "__cutoffs")
    if only is not None:
        bounds = {"train": t <= train_end, "val": (t > train_end) & (t <= val_end), "test": t > val_end}
        rows = rows.where(reduce(or_, [bounds[name] for name in only]))
    return rows.withColumn("split", split_label(t, train_end, val_end)).drop("__cutoffs")
