"""Exact quantiles from mergeable sketches and one more scan.

A KLL sketch for each group names, for each wanted rank, two values that surely enclose it. In the second scan the rows between
such values are counted by value, all others are only counted by the gap that they lie in. That table of weighted values has the
same quantiles as the rows. What is shuffled is a share of the rows that the sketch's error bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.columns import quoted
from loadcurve.operators.onerow import attach_row
from loadcurve.operators.ranks import exact_quantiles
from loadcurve.operators.sized import join_lookup
from loadcurve.session import cut_lineage

SKETCH_K = 4096


def rank_error(k: int) -> float:
    """The published rank error of a KLL sketch, as a share of the rows, at 99 % confidence."""
    return 2.296 / k**0.9021


def _bounds(values: DataFrame, by: Sequence[str], probabilities: Sequence[float], k: int, margin: float) -> DataFrame:
    """For each group `lo` and `hi`: values below and above each wanted rank; a group of up to k rows is kept whole.

    NaN is above all numbers, as in Spark's order; the sketch, which passes over NaN, gets infinity in its place.
    """
    infinite = F.lit(float("inf"))
    found = values.groupBy(*by).agg(
        F.kll_sketch_agg_double(F.when(F.isnan("value"), infinite).otherwise(F.col("value")), k).alias("__sketch"),
        F.min("value").alias("__min"), F.max("value").alias("__max"), F.count("value").alias("__rows"),
    )

    def bound(at: float, end: str) -> Column:
        if not 0 < at < 1:
            return F.col(end)
        inner = F.kll_sketch_get_quantile_double("__sketch", F.lit(at))
        kept = F.when(F.col("__rows") <= k, F.col(end))
        return (kept if end == "__min" else kept.when(inner == infinite, F.col(end))).otherwise(inner)

    ordered = sorted(float(p) for p in probabilities)
    lows, highs = [bound(p - margin, "__min") for p in ordered], [bound(p + margin, "__max") for p in ordered]
    return found.select(*by, F.array(*lows).alias("lo"), F.array(*highs).alias("hi"))


def condensed(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    k: int = SKETCH_K,
    margin: float | None = None,
) -> DataFrame:
    """Weighted values with the same quantiles: group, `value`, `n`, `gap`, and `inside` (false for the rows of a whole gap).

    A gap stands at its least value, before the rows inside that have its number. Rows without a value are one row of each group.
    """
    by, margin = list(by), 2 * rank_error(k) if margin is None else margin
    values = df.select(*by, F.col(quoted(column)).cast("double").alias("value"))
    bounds = _bounds(values, by, probabilities, k, margin)
    if by:
        placed = join_lookup(values, bounds.withColumn("__b", F.struct("lo", "hi")).drop("lo", "hi"), by, "left", null_safe=True)
    else:
        placed = attach_row(values, bounds, "__b")
    v, lo, hi = F.col("value"), F.col("__b.lo"), F.col("__b.hi")
    inside, gap = F.lit(False), F.lit(0)
    for i in range(len(probabilities)):
        inside = inside | ((v >= lo[i]) & (v <= hi[i]))
        gap = gap + F.when(v > hi[i], 1).otherwise(0)
    inside = F.coalesce(inside, F.lit(False))
    marked = placed.select(*by, "value", inside.alias("inside"), F.when(v.isNotNull(), gap).alias("gap"))
    own = F.when(F.col("inside"), F.col("value"))
    return (
        marked.groupBy(*by, "gap", "inside", own.alias("own"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("__least"))
        .select(*by, F.coalesce("own", "__least").alias("value"), "n", "gap", "inside")
    )


def _holds(stored: DataFrame, by: Sequence[str], probabilities: Sequence[float]) -> bool:
    """Whether no wanted rank lies in a gap. The window sees at most two rows for each probability and two more."""
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = group.orderBy("gap", "inside").rowsBetween(Window.unboundedPreceding, -1)
    pieces = stored.where(F.col("value").isNotNull()).groupBy(*by, "gap", "inside").agg(F.sum("n").alias("n"))
    ranked = pieces.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "total": F.sum("n").over(group)})
    missed = F.lit(False)
    for p in probabilities:
        at = (F.col("total") - 1) * F.lit(float(p))
        missed = missed | ((F.ceil(at) >= F.col("before")) & (F.floor(at) < F.col("before") + F.col("n")))
    return not ranked.where(~F.col("inside") & missed).take(1)


def bracketed_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    names: Sequence[str] | None = None,
    k: int = SKETCH_K,
    margin: float | None = None,
    **options,
) -> DataFrame:
    """As `exact_quantiles`, to the last bit, with at most a few times the sketch's error of the rows shuffled.

    `margin` (share of the rows on each side of a rank) is twice the sketch's error unless given. Where a sketch was further off,
    which the counts show, the scan is repeated with four times the margin; at a margin of one nothing is left out.
    """
    by, margin = list(by), 2 * rank_error(k) if margin is None else margin
    while True:
        stored = cut_lineage(condensed(df, column, probabilities, by, k=k, margin=margin))
        if margin >= 1 or _holds(stored, by, probabilities):
            return exact_quantiles(stored, "value", probabilities, by, names=names, weight="n", **options)
        margin = min(1.0, 4 * max(margin, 1e-6))
