"""Tables behind the error, calibration and distribution figures."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.functions import timefns
from loadcurve.functions.columns import quoted
from loadcurve.functions.values import abs_error, residual
from loadcurve.operators.aggregates import MONTHS, mae_by, pivot_mean
from loadcurve.operators.bins import bin_equal_width, bin_quantile, box_stats, histogram, unit_edges
from loadcurve.operators.ranks import value_ranks
from loadcurve.operators.sized import join_lookup
from loadcurve.plans.splits import filter_split
from loadcurve.session import cut_lineage


def add_errors(predictions: DataFrame) -> DataFrame:
    y, p = F.col("y_true"), F.col("y_pred")
    return predictions.withColumns({"resid": residual(y, p), "abs_err": abs_error(y, p)})


def error_by_hour(predictions: DataFrame) -> DataFrame:
    return mae_by(predictions, {"hour": F.hour("full_timestamp")})


def error_by_week(predictions: DataFrame) -> DataFrame:
    return mae_by(predictions, {"week": timefns.week_start(F.col("full_timestamp"))})


def error_heatmap_hour_month(predictions: DataFrame) -> DataFrame:
    t = F.col("full_timestamp")
    error = abs_error(F.col("y_true"), F.col("y_pred"))
    return pivot_mean(predictions, {"hour": F.hour(t)}, F.month(t), MONTHS, error, "month_")


def error_by_temp_bin(merged: DataFrame, parts: int = 10) -> DataFrame:
    """MAE per temperature bin; empty bins are kept with NULL."""
    binned = bin_equal_width(merged, "apparent_temperature_norm", unit_edges(parts), "bin")
    errors = mae_by(binned.where(F.col("bin").isNotNull()), {"bin": F.col("bin")})
    every = merged.sparkSession.range(1, parts + 1).select(F.col("id").cast("int").alias("bin"))
    # Both sides are one row per bin.
    return every.join(F.broadcast(errors), "bin", "left")


def error_by_region_temp_bin(merged: DataFrame, parts: int = 10) -> DataFrame:
    """MAE per region and temperature bin; empty bins of a region are kept with NULL."""
    binned = bin_equal_width(merged, "apparent_temperature_norm", unit_edges(parts), "bin")
    per_region = mae_by(
        binned.where(F.col("region").isNotNull()), {"region": F.col("region"), "bin": F.col("bin")}
    )
    # One row per region from here: the bins of a region as a map, read out for every bin.
    maps = per_region.groupBy("region").agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "mae")))
        ).alias("m")
    )
    return maps.select(
        "region", F.explode(F.sequence(F.lit(1), F.lit(parts))).alias("bin"), "m"
    ).select("region", "bin", F.try_element_at("m", F.col("bin")).alias("mae"))


def error_by_precip_quantile_bin(merged: DataFrame, parts: int = 10, **options) -> DataFrame:
    """MAE per quantile bin of precipitation, missing counted as 0."""
    filled = merged.na.fill(0.0, ["precipitation"])
    binned = bin_quantile(filled, "precipitation", parts, "bin", **options)
    return mae_by(binned, {"bin": F.col("bin")})


def calibration_deciles(predictions: DataFrame, parts: int = 10, **options) -> DataFrame:
    """Mean prediction and mean truth per quantile bin of the prediction."""
    binned = bin_quantile(predictions, "y_pred", parts, "bin", **options)
    return binned.groupBy("bin").agg(
        F.avg("y_pred").alias("pred_mean"), F.avg("y_true").alias("true_mean"), F.count(F.lit(1)).alias("n")
    )


def error_box_by(merged: DataFrame, by: Sequence[str], **options) -> DataFrame:
    return box_stats(add_errors(merged).select(*by, "abs_err"), "abs_err", by, **options)


def error_cdf(predictions: DataFrame, **options) -> DataFrame:
    """Cumulative share of absolute errors, at each distinct error.

    The i-th smallest of n errors (from 0) has share i / (n - 1). Equal errors are one row with
    their number and the shares of the first and last of them.
    """
    ranks = value_ranks(add_errors(predictions).select("abs_err"), "abs_err", **options)
    last = F.greatest(F.col("total") - 1, F.lit(1))
    return ranks.select(
        F.col("value").alias("abs_err"),
        "n",
        (F.col("before") / last).alias("cdf_first"),
        ((F.col("before") + F.col("n") - 1) / last).alias("cdf_last"),
    )


def splits_timeline(
    df: DataFrame, cutoffs: DataFrame, *, ts: str = "full_timestamp", bins: int = 60
) -> DataFrame:
    """Rows per equal stretch of time, with the split each stretch begins in."""
    seconds = df.select(timefns.epoch_seconds(F.col(ts)).alias("s"))
    counts = histogram(seconds, "s", bins).select(
        "bin",
        timefns.from_epoch_seconds(F.col("bin_lo")).alias("time_from"),
        timefns.from_epoch_seconds(F.col("bin_hi")).alias("time_to"),
        "n",
    )
    return filter_split(counts, cutoffs, ts="time_from")


def kde_1d(
    df: DataFrame,
    x: str,
    by: Sequence[str] = (),
    *,
    gridsize: int = 200,
    cut: float = 3.0,
    bins: int = 4096,
) -> DataFrame:
    """Gaussian density per group on a grid: (by, grid, density).

    Scott bandwidth n^(-1/5) times the sample deviation; the grid reaches `cut` bandwidths beyond
    the data. Each value is shared between its two nearest of `bins` equally spaced points, and
    the kernel is summed over those points: work per row does not depend on the grid, and the
    error is of order (point spacing / bandwidth) squared. Groups without spread are left out.
    """
    by = list(by)
    rows = df.select(*by, F.col(quoted(x)).cast("double").alias("x")).where(F.col("x").isNotNull())
    one = F.lit(1).alias("__g")
    rows, keys = (rows, by) if by else (rows.withColumn("__g", one), ["__g"])
    stats = (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("lo"),
            F.max("x").alias("hi"),
            F.stddev_samp("x").alias("sd"),
        )
        .withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
        .where(F.col("bw") > 0)
    )
    position = (F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / (bins - 1))
    left = F.least(F.floor(position), F.lit(bins - 2))
    shares = (
        join_lookup(rows, stats, keys)
        .select(*keys, left.alias("i"), (position - left).alias("w"))
        .groupBy(*keys, "i")
        .agg(F.sum(1 - F.col("w")).alias("w0"), F.sum("w").alias("w1"))
        .select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.col("i").alias("i"), F.col("w0").alias("w")),
                    F.struct((F.col("i") + 1).alias("i"), F.col("w1").alias("w")),
                )
            ).alias("p"),
        )
        .groupBy(*keys, "p.i")
        .agg(F.sum("p.w").alias("w"))
    )
    lo, hi, bw = F.col("lo"), F.col("hi"), F.col("bw")
    start, stop = lo - cut * bw, hi + cut * bw
    grid = start + F.col("g") * ((stop - start) / (gridsize - 1))
    centre = lo + F.col("i") * ((hi - lo) / (bins - 1))
    z = (F.col("grid") - centre) / bw
    density = F.sum(F.col("w") * F.exp(-0.5 * z * z)) / F.first(F.col("n") * bw * math.sqrt(2 * math.pi))
    # At most `bins` rows per group before the grid is applied.
    return (
        join_lookup(shares, stats, keys)
        .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))))
        .withColumn("grid", grid)
        .groupBy(*keys, "g", "grid")
        .agg(density.alias("density"))
        .select(*by, "grid", "density")
    )


def kde_2d(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    *,
    gridsize: int = 50,
    cut: float = 3.0,
    bins: int = 256,
    reach: float = 8.0,
) -> DataFrame:
    """Gaussian density of two columns per group on a grid: (by, grid_x, grid_y, density).

    The kernel covariance is the sample covariance times the squared Scott factor n^(-1/6). Values
    are shared between the four nearest of bins x bins points, as in `kde_1d`. A point touches the
    cells within `reach` deviations of the kernel only (an ellipse); beyond 8 a share of 1.3e-14 of its
    peak is left out.
    """
    by = list(by)
    rows = df.select(
        *by, F.col(quoted(x)).cast("double").alias("x"), F.col(quoted(y)).cast("double").alias("y")
    ).dropna(subset=["x", "y"])
    rows, keys = (rows, by) if by else (rows.withColumn("__g", F.lit(1)), ["__g"])
    factor = F.pow(F.col("n").cast("double"), F.lit(-1.0 / 3.0))
    stats = (
        rows.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("x").alias("x_lo"), F.max("x").alias("x_hi"),
            F.min("y").alias("y_lo"), F.max("y").alias("y_hi"),
            F.covar_samp("x", "x").alias("vx"),
            F.covar_samp("y", "y").alias("vy"),
            F.covar_samp("x", "y").alias("vxy"),
        )
        .withColumns({c: F.col(c) * factor for c in ("vx", "vy", "vxy")})
        .withColumn("det", F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy"))
        .where(F.col("det") > 0)
    )
    stats = cut_lineage(stats)

    def place(axis: str):
        lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        position = (F.col(axis) - lo) / ((hi - lo) / (bins - 1))
        left = F.least(F.floor(position), F.lit(bins - 2))
        return left, position - left

    (ix, wx), (iy, wy) = place("x"), place("y")
    corners = [
        F.struct((F.col("ix") + dx).alias("ix"), (F.col("iy") + dy).alias("iy"), F.col(f"w{dx}{dy}").alias("w"))
        for dx in (0, 1)
        for dy in (0, 1)
    ]
    u, v = F.col("wx"), F.col("wy")
    points = (
        join_lookup(rows, stats, keys)
        .select(*keys, ix.alias("ix"), iy.alias("iy"), wx.alias("wx"), wy.alias("wy"))
        .groupBy(*keys, "ix", "iy")
        .agg(
            F.sum((1 - u) * (1 - v)).alias("w00"), F.sum((1 - u) * v).alias("w01"),
            F.sum(u * (1 - v)).alias("w10"), F.sum(u * v).alias("w11"),
        )
        .select(*keys, F.explode(F.array(*corners)).alias("p"))
        .groupBy(*keys, "p.ix", "p.iy")
        .agg(F.sum("p.w").alias("w"))
        .where(F.col("w") > 0)
    )

    def grid(axis: str, index: str):
        lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        reach = cut * F.sqrt(F.col(f"v{axis}"))
        return lo - reach + F.col(index) * (((hi + reach) - (lo - reach)) / (gridsize - 1))

    def centre(axis: str):
        lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        return lo + F.col(f"i{axis}") * ((hi - lo) / (bins - 1))

    def near(axis: str, middle, half):
        """Indexes of the grid values of an axis within `half` of a middle."""
        lo, hi = F.col(f"{axis}_lo"), F.col(f"{axis}_hi")
        edge = lo - cut * F.sqrt(f"v{axis}")
        step = ((hi - lo) + 2 * cut * F.sqrt(f"v{axis}")) / (gridsize - 1)
        first = F.greatest(F.ceil((middle - half - edge) / step), F.lit(0)).cast("int")
        last = F.least(F.floor((middle + half - edge) / step), F.lit(gridsize - 1)).cast("int")
        return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))

    dx, dy = F.col("dx"), F.col("grid_y") - centre("y")
    # Given dx, the form is least at dy = dx vxy / vx, and grows with the square of the distance from there by vx / det.
    middle = centre("y") + dx * F.col("vxy") / F.col("vx")
    half = F.sqrt(F.greatest(reach * reach - dx * dx / F.col("vx"), F.lit(0.0)) * F.col("det") / F.col("vx"))
    form = (F.col("vy") * dx * dx - 2 * F.col("vxy") * dx * dy + F.col("vx") * dy * dy) / F.col("det")
    sums = (
        join_lookup(points, stats, keys)
        .withColumn("gx", F.explode(near("x", centre("x"), reach * F.sqrt("vx"))))
        .withColumn("dx", grid("x", "gx") - centre("x"))
        .withColumn("gy", F.explode(near("y", middle, half)))
        .withColumn("grid_y", grid("y", "gy"))
        .groupBy(*keys, "gx", "gy")
        .agg(F.sum(F.col("w") * F.exp(-0.5 * form)).alias("__sum"))
    )
    norm = F.col("n") * 2 * math.pi * F.sqrt("det")
    steps = F.sequence(F.lit(0), F.lit(gridsize - 1))
    cells = stats.withColumn("gx", F.explode(steps)).withColumn("gy", F.explode(steps))
    return (
        cells.withColumns({"grid_x": grid("x", "gx"), "grid_y": grid("y", "gy")})
        .join(sums, [*keys, "gx", "gy"], "left")
        .select(*by, "grid_x", "grid_y", (F.coalesce("__sum", F.lit(0.0)) / norm).alias("density"))
    )
