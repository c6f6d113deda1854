import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcurve.operators.ranks import exact_medians, exact_quantiles, value_ranks

PROBABILITIES = [0.0, 0.1, 0.25, 0.5, 0.77, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows, one value a third of them; a group without a name, missing values."""
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(1000, 0.5), rng.lognormal(0, 2, 1900), [np.nan] * 100])
    groups = np.array(["hot"] * 2000 + ["b"] * 600 + ["tiny"] * 3 + ["none"] * 397)
    rng.shuffle(values)
    rows = [(None if g == "none" else str(g), None if np.isnan(v) else float(v)) for g, v in zip(groups, values)]
    return spark.createDataFrame(rows, "g string, x double").repartition(5), rows


@pytest.mark.parametrize("options", [{}, {"small_rows": 0, "rows_per_range": 100}, {"small_rows": 0, "rows_per_range": 10**6}])
def test_grouped_quantiles_equal_numpy(skewed, options):
    df, rows = skewed
    got = {r["g"]: r for r in exact_quantiles(df, "x", PROBABILITIES, ["g"], **options).collect()}
    for group in {g for g, _ in rows}:
        x = [v for g, v in rows if g == group and v is not None]
        want = np.quantile(x, PROBABILITIES)
        np.testing.assert_allclose([got[group][f"q{i}"] for i in range(len(PROBABILITIES))], want, rtol=1e-12)


def test_global_quantiles(skewed):
    df, rows = skewed
    row = exact_quantiles(df, "x", [0.3, 0.9], names=["a", "b"], small_rows=0, rows_per_range=50).first()
    want = np.quantile([v for _, v in rows if v is not None], [0.3, 0.9])
    np.testing.assert_allclose([row["a"], row["b"]], want, rtol=1e-12)


def test_only_target_ranges_are_kept(skewed):
    df, rows = skewed
    all_ranks = value_ranks(df, "x", rows_per_range=100)
    some = value_ranks(df, "x", rows_per_range=100, probabilities=[0.9])
    assert some.count() < all_ranks.count() / 5


def test_ranks_equal_numpy(skewed):
    df, rows = skewed
    x = np.array(sorted(v for _, v in rows if v is not None))
    got = value_ranks(df, "x", rows_per_range=64).orderBy("value").toPandas()
    values, first, counts = np.unique(x, return_index=True, return_counts=True)
    np.testing.assert_allclose(got["value"], values)
    assert (got["before"].to_numpy() == first).all() and (got["n"].to_numpy() == counts).all()
    assert set(got["total"]) == {len(x)}


def test_medians_of_many_columns(skewed):
    df, rows = skewed
    two = df.withColumn("y", F.col("x") * 2)
    for small in (10**6, 0):
        row = exact_medians(two, ["x", "y"], small_rows=small).first()
        want = np.median([v for _, v in rows if v is not None])
        np.testing.assert_allclose([row["x"], row["y"]], [want, 2 * want])
