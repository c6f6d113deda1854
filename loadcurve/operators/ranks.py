"""Exact ranks and quantiles of unbounded columns, without sorting a group in one task.

Values are cut into ranges at approximate quantiles of the whole column, so that a range holds a
bounded share of all rows whatever the groups look like. A rank is then the rows of earlier ranges
(a small counted table) plus the running count within the range. A quantile needs only the ranges
that hold its rank, so only their rows are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.columns import quoted
from loadcurve.operators.sized import join_lookup

ROWS_PER_RANGE = 500_000
SMALL_ROWS = 200_000
MAX_RANGES = 10_000


def _range_count(rows: int, rows_per_range: int) -> int:
    return max(1, -(-rows // rows_per_range))


def _cut_points(values: DataFrame, ranges: int) -> list[float]:
    """Inner cut points of near-equal ranges."""
    if ranges < 2:
        return []
    probabilities = [i / ranges for i in range(1, ranges)]
    cuts = values.select(
        F.percentile_approx("value", probabilities, max(10_000, 10 * ranges)).alias("cuts")
    ).first()["cuts"]
    return sorted(set(cuts or []))


def _in_ranges(values: DataFrame, ranges: int) -> DataFrame:
    """Add `__range`. At most MAX_RANGES cut points reach the driver; more ranges are cuts of these ranges."""
    cuts = _cut_points(values, min(ranges, MAX_RANGES))
    if not cuts:
        return values.withColumn("__range", F.lit(0.0))
    placed = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="value", outputCol="__range", handleInvalid="keep",
    ).transform(values)
    finer = -(-ranges // MAX_RANGES)
    if finer == 1:
        return placed
    probabilities = [i / finer for i in range(1, finer)]
    inner = placed.groupBy("__range").agg(
        F.percentile_approx("value", probabilities, max(10_000, 10 * finer)).alias("__inner")
    )
    below = F.size(F.filter("__inner", lambda c: c < F.col("value")))
    whole = join_lookup(placed, inner, ["__range"])
    return whole.withColumn("__range", F.col("__range") + below / finer).drop("__inner")


def _target_ranks(total: Column, probability: float) -> tuple[Column, Column, Column]:
    """Ranks below and above a quantile, and the weight of the upper one."""
    at = (total - 1) * F.lit(float(probability))
    return F.floor(at), F.ceil(at), at - F.floor(at)


def value_ranks(
    df: DataFrame,
    column: str,
    by: Sequence[str] = (),
    *,
    rows: int | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    probabilities: Sequence[float] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per (group, distinct value): `value`, `n`, `before` (rows below), `total` (group rows).

    With `probabilities`, only values from ranges that hold the ranks of those quantiles. With `weight`,
    a whole number, a row counts that many times.
    """
    by = list(by)
    times = F.lit(1) if weight is None else F.col(quoted(weight)).cast("bigint")
    present = df.select(*by, F.col(quoted(column)).cast("double").alias("value"), times.alias("__times")).where(
        F.col("value").isNotNull()
    )
    n_rows = present.count() if rows is None else rows
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ranges = _range_count(n_rows, rows_per_range)
    if ranges == 1:
        # No more distinct values in all than one range may hold.
        running = group.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        return (
            present.groupBy(*by, "value")
            .agg(F.sum("__times").alias("n"))
            .withColumns({"before": F.sum("n").over(running) - F.col("n"), "total": F.sum("n").over(group)})
        )
    placed = _in_ranges(present, ranges)
    # One row per group and range, so a group has as many rows here as there are ranges.
    counts = placed.groupBy(*by, "__range").agg(F.sum("__times").alias("__n"))
    earlier = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *by,
        "__range",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__below"),
        F.sum("__n").over(group).alias("total"),
        "__n",
    )
    if probabilities is not None:
        first, last = F.col("__below"), F.col("__below") + F.col("__n") - 1
        holds = F.lit(False)
        for p in probabilities:
            lower, upper, _ = _target_ranks(F.col("total"), p)
            holds = holds | ((lower <= last) & (upper >= first))
        offsets = offsets.where(holds)
    kept = join_lookup(placed, offsets.drop("__n"), [*by, "__range"], null_safe=True)
    counted = kept.groupBy(*by, "__range", "__below", "total", "value").agg(
        F.sum("__times").alias("n")
    )
    within = Window.partitionBy(*by, "__range").orderBy("value")
    inside = F.sum("n").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return counted.select(*by, "value", "n", (F.col("__below") + inside).alias("before"), "total")


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    *,
    names: Sequence[str] | None = None,
    small_rows: int = SMALL_ROWS,
    rows_per_range: int = ROWS_PER_RANGE,
    weight: str | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation, one row per group and one column per probability.

    Up to `small_rows` rows (counted first) the built-in `percentile` does it in one aggregate;
    beyond, ranks do it with no group held in one task. Both give the same numbers to the last bit,
    and a row of NULLs for a group without values. With `weight` a row counts that many times.
    """
    by = list(by)
    names = list(names or [f"q{i}" for i in range(len(probabilities))])
    n_rows = df.where(F.col(quoted(column)).isNotNull()).count()
    if n_rows <= small_rows:
        times = F.lit(1) if weight is None else F.col(quoted(weight)).cast("bigint")
        all_q = F.percentile(F.col(quoted(column)).cast("double"), list(probabilities), times)
        return (
            df.groupBy(*by)
            .agg(all_q.alias("__q"))
            .select(*by, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])
        )
    ranks = value_ranks(
        df, column, by, rows=n_rows, rows_per_range=rows_per_range, probabilities=probabilities, weight=weight
    )
    first, last = F.col("before"), F.col("before") + F.col("n") - 1
    picks = []
    for i, p in enumerate(probabilities):
        lower, upper, _ = _target_ranks(F.col("total"), p)
        for tag, rank in (("lo", lower), ("hi", upper)):
            picks.append(
                F.max(F.when((first <= rank) & (rank <= last), F.col("value"))).alias(f"__{tag}{i}")
            )
    picked = ranks.groupBy(*by).agg(F.max("total").alias("__total"), *picks)
    out = []
    for i, (p, name) in enumerate(zip(probabilities, names)):
        lower, upper, weight_up = _target_ranks(F.col("__total"), p)
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        at = (F.col("__total") - 1) * F.lit(float(p))
        # The order of operations of the built-in, so that results agree to the last bit.
        out.append(F.when(lo == hi, lo).otherwise((upper - at) * lo + weight_up * hi).alias(name))
    found = picked.select(*by, *out)
    if not by:
        return found
    return join_lookup(df.select(*by).distinct(), found, by, "left", null_safe=True)


def exact_medians(
    df: DataFrame, columns: Sequence[str], *, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """The median of each column, one row; the number of passes does not depend on the number of columns."""
    if df.count() <= small_rows:
        return df.agg(
            *[F.percentile(F.col(quoted(c)).cast("double"), 0.5).alias(c) for c in columns]
        )
    entries = [F.struct(F.lit(c).alias("column"), F.col(quoted(c)).cast("double").alias("value")) for c in columns]
    long = df.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    medians = exact_quantiles(long, "value", [0.5], ["column"], names=["median"], small_rows=small_rows)
    return medians.groupBy().pivot("column", list(columns)).agg(F.first("median"))
