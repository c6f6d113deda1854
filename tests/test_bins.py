import math

import numpy as np
import pandas as pd

from loadcurve.operators import bins
from loadcurve.plans import diagnostics as diag


def _frame(spark, values):
    return spark.createDataFrame([(float(v) if v is not None else None,) for v in values], "x double")


def test_equal_width_bins_like_cut(spark):
    values = [0.0, 0.1, 0.1000001, 0.3, 0.30000000000000004, 0.5, 1.0, -0.01, 1.01, None]
    got = [r["bin"] for r in bins.bin_equal_width(_frame(spark, values), "x", bins.unit_edges()).collect()]
    cut = pd.cut(pd.Series(values, dtype=float), np.linspace(0, 1, 11), include_lowest=True, labels=False)
    want = [None if math.isnan(v) else int(v) + 1 for v in cut]
    assert got == want


def test_quantile_bins_like_qcut_with_repeated_edges(spark):
    values = [0.0] * 60 + list(np.linspace(0.1, 5, 37)) + [9.0] * 3
    out = bins.bin_quantile(_frame(spark, values), "x").toPandas().sort_values("x")
    want = pd.qcut(pd.Series(sorted(values)), 10, duplicates="drop", labels=False) + 1
    assert out["bin"].tolist() == want.tolist()


def test_quantile_bins_same_by_ranks(spark):
    rng = np.random.default_rng(4)
    df = _frame(spark, np.round(rng.exponential(1, 2000), 2))
    small = bins.bin_quantile(df, "x").groupBy("bin").count()
    large = bins.bin_quantile(df, "x", small_rows=0, rows_per_range=100).groupBy("bin").count()
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_histogram_like_numpy(spark):
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.normal(0, 1, 500), np.linspace(-3, 3, 31)])
    out = bins.histogram(_frame(spark, values), "x", 30).orderBy("bin").toPandas()
    counts, edges = np.histogram(values, bins=30)
    assert out["n"].tolist() == counts.tolist()
    np.testing.assert_allclose(out["bin_lo"], edges[:-1])
    np.testing.assert_allclose(out["bin_hi"], edges[1:])


def test_histogram_of_constant_and_empty(spark):
    out = bins.histogram(_frame(spark, [2.0, 2.0, None]), "x", 4).orderBy("bin").toPandas()
    counts, edges = np.histogram([2.0, 2.0], bins=4)
    assert out["n"].tolist() == counts.tolist()
    np.testing.assert_allclose(out["bin_lo"], edges[:-1])


def test_box_whiskers(spark):
    rows = [("a", float(v)) for v in [1, 2, 3, 4, 5, 100]] + [("b", 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    a = bins.box_stats(df, "x", ["g"]).where("g = 'a'").first()
    assert (a["q1"], a["median"], a["q3"], a["whisker_lo"], a["whisker_hi"], a["n"]) == (2.25, 3.5, 4.75, 1.0, 5.0, 6)


def _kde(x, grid):
    bw = np.std(x, ddof=1) * len(x) ** -0.2
    return np.exp(-0.5 * ((grid[:, None] - x[None, :]) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi))


def test_kde_close_to_exact_sum(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, 300), rng.normal(4, 0.3, 150)])
    out = diag.kde_1d(_frame(spark, x), "x").orderBy("grid").toPandas()
    assert len(out) == 200
    np.testing.assert_allclose(out["density"], _kde(x, out["grid"].to_numpy()), atol=1e-5)
    assert abs(np.trapezoid(out["density"], out["grid"]) - 1) < 0.01


def test_kde_2d_close_to_exact_sum(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, 400)
    y = 0.7 * x + rng.normal(0, 0.5, 400)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    out = diag.kde_2d(df, "x", "y", gridsize=15).toPandas()
    cov = np.cov(x, y) * len(x) ** (-1 / 3)
    inv = np.linalg.inv(cov)
    d = np.stack([out["grid_x"].to_numpy()[:, None] - x, out["grid_y"].to_numpy()[:, None] - y], -1)
    want = np.exp(-0.5 * np.einsum("...i,ij,...j", d, inv, d)).sum(1) / (len(x) * 2 * math.pi * math.sqrt(np.linalg.det(cov)))
    np.testing.assert_allclose(out["density"], want, atol=2e-3 * want.max())


def test_kde_2d_touches_near_cells_only_and_keeps_all(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 0.05, 4000), [30.0]])
    df = spark.createDataFrame([(float(a), float(a + b)) for a, b in zip(x, rng.normal(0, 0.05, 4001))], "x double, y double")
    out, whole = (diag.kde_2d(df, "x", "y", gridsize=20, reach=r).toPandas().sort_values(["grid_x", "grid_y"]) for r in (8.0, 1e6))
    assert len(out) == len(whole) == 400 and (out["density"] == 0).any()
    np.testing.assert_allclose(out["density"], whole["density"], atol=1e-12 * whole["density"].max())


def test_error_cdf_with_ties(spark):
    rows = [("a", 0.0, e) for e in [0.0, 0.0, 0.0, 0.2, 0.5]]
    preds = spark.createDataFrame(rows, "building_name string, y_true double, y_pred double")
    out = [tuple(r) for r in diag.error_cdf(preds).orderBy("abs_err").collect()]
    assert out == [(0.0, 3, 0.0, 0.5), (0.2, 1, 0.75, 0.75), (0.5, 1, 1.0, 1.0)]


def test_empty_temperature_bins_are_kept(spark):
    df = spark.createDataFrame(
        [("NSW", 0.05, 1.0, 0.5), ("NSW", 0.95, 1.0, 0.75), ("LCL", 0.5, 0.0, 0.0)],
        "region string, apparent_temperature_norm double, y_true double, y_pred double",
    )
    one = {r["bin"]: r["mae"] for r in diag.error_by_temp_bin(df).collect()}
    assert len(one) == 10 and one[1] == 0.5 and one[10] == 0.25 and one[5] == 0.0 and one[2] is None
    both = {(r["region"], r["bin"]): r["mae"] for r in diag.error_by_region_temp_bin(df).collect()}
    assert len(both) == 20 and both["LCL", 5] == 0.0 and both["LCL", 1] is None and both["NSW", 10] == 0.25


def test_correlation_skips_gaps_per_pair(spark):
    from loadcurve.operators.aggregates import correlation_matrix

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame(rng.random((50, 3)), columns=["a", "b", "c"])
    pdf.loc[::7, "a"] = np.nan
    pdf["flat"] = 1.0
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double")
    got = {(r["left_col"], r["right_col"]): r["corr"] for r in correlation_matrix(df).collect()}
    want = pdf.corr()
    for x in pdf:
        for y in pdf:
            if math.isnan(want.loc[x, y]):
                assert got[x, y] is None
            else:
                assert abs(got[x, y] - want.loc[x, y]) < 1e-12
    assert len(got) == 16
