"""Bins, histograms and box statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.columns import quoted
from loadcurve.operators.onerow import attach_row
from loadcurve.operators.ranks import exact_quantiles
from loadcurve.operators.sized import join_lookup


def unit_edges(parts: int = 10) -> list[float]:
    """Edges of equal bins over [0, 1]."""
    return [i * (1.0 / parts) for i in range(parts)] + [1.0]


def bin_by_edges(x: Column, edges: Sequence[Column]) -> Column:
    """1-based bin of x among ascending edges: right-closed, the first bin holds the lowest edge too.

    Equal edges count once. Values outside get NULL. Plain comparisons, so it stays in codegen.
    """
    below = [F.when(edges[0] < x, 1).otherwise(0)]
    for previous, edge in zip(edges, edges[1:]):
        below.append(F.when((edge < x) & (edge != previous), 1).otherwise(0))
    passed = below[0]
    for b in below[1:]:
        passed = passed + b
    return F.when((x >= edges[0]) & (x <= edges[-1]), F.greatest(passed, F.lit(1)))


def bin_equal_width(df: DataFrame, column: str, edges: Sequence[float], out: str = "bin") -> DataFrame:
    """Add the right-closed bin of a column among given edges."""
    literal_edges = [F.lit(float(e)) for e in edges]
    return df.withColumn(out, bin_by_edges(F.col(quoted(column)), literal_edges))


def bin_quantile(
    df: DataFrame, column: str, parts: int = 10, out: str = "bin", **quantile_options
) -> DataFrame:
    """Add the quantile bin of a column; equal edges are merged. The edges are one row, attached as such."""
    probabilities = [i / parts for i in range(parts)] + [1.0]
    edges = exact_quantiles(df, column, probabilities, **quantile_options)
    attached = attach_row(df, edges, "__edges")
    columns = [F.col(f"__edges.q{i}") for i in range(parts + 1)]
    return attached.withColumn(out, bin_by_edges(F.col(quoted(column)), columns)).drop("__edges")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from minimum to maximum: (bin, bin_lo, bin_hi, n), empty bins kept.

    Bins are closed on the left, the last one on both sides. A constant column gets a range of one
    around its value.
    """
    x = F.col(quoted(column)).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull())
    raw = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    span = raw.select(
        F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    )

    def edge(i: Column, lo: Column, hi: Column) -> Column:
        return F.when(i == bins, hi).otherwise(lo + i * ((hi - lo) / bins))

    lo, hi, v = F.col("__span.lo"), F.col("__span.hi"), F.col("x")
    guess = F.least(F.floor((v - lo) / (hi - lo) * bins), F.lit(bins - 1))
    placed = (
        attach_row(values, span, "__span")
        .withColumn("bin", guess)
        .withColumn("bin", F.when(v < edge(F.col("bin"), lo, hi), F.col("bin") - 1).otherwise(F.col("bin")))
        .withColumn(
            "bin",
            F.when(
                (v >= edge(F.col("bin") + 1, lo, hi)) & (F.col("bin") < bins - 1), F.col("bin") + 1
            ).otherwise(F.col("bin")),
        )
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every_bin = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    i = F.col("bin")
    return every_bin.select(
        i.cast("bigint").alias("bin"),
        edge(i, F.col("lo"), F.col("hi")).alias("bin_lo"),
        edge(i + 1, F.col("lo"), F.col("hi")).alias("bin_hi"),
    ).join(counts, "bin", "left").na.fill(0, ["n"])


def group_quartiles(df: DataFrame, column: str, by: Sequence[str], **options) -> DataFrame:
    """Q1, median and Q3 per group."""
    return exact_quantiles(df, column, [0.25, 0.5, 0.75], by, names=["q1", "median", "q3"], **options)


def box_stats(df: DataFrame, column: str, by: Sequence[str], **options) -> DataFrame:
    """Quartiles and whiskers per group; whiskers are the extreme values within 1.5 IQR of the box."""
    quartiles = group_quartiles(df, column, by, **options)
    x = F.col(quoted(column))
    iqr = F.col("q3") - F.col("q1")
    inside = (x >= F.col("q1") - 1.5 * iqr) & (x <= F.col("q3") + 1.5 * iqr)
    return (
        join_lookup(df.select(*by, x), quartiles, by, null_safe=True)
        .groupBy(*by, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_lo"),
            F.max(F.when(inside, x)).alias("whisker_hi"),
            F.count(x).alias("n"),
        )
    )
