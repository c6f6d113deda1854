"""Quantiles bracketed by sketches equal the plain ones and shuffle few rows."""

import numpy as np
from pyspark.sql import functions as F

from loadcurve.operators import brackets
from loadcurve.operators.ranks import exact_quantiles

PROBABILITIES = [0.0, 0.25, 0.5, 0.9, 1.0]


def _rows(spark, n=60_000):
    g = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 500 == 1, "few").when(F.col("id") % 1000 == 2, None).otherwise("rest")
    x = F.when(g == "rest", F.rand(1)).otherwise(F.round(F.randn(2), 2))
    return spark.range(n).select(g.alias("g"), x.alias("x"))


def _same(a, b):
    key = lambda r: (r[0] is not None, str(r[0]))
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_same_bits_as_the_plain_way(spark):
    df = _rows(spark).checkpoint()
    for by in ([], ["g"]):
        want = exact_quantiles(df, "x", PROBABILITIES, by)
        for options in ({}, {"k": 200}, {"k": 200, "small_rows": 100, "rows_per_range": 500}):
            _same(brackets.bracketed_quantiles(df, "x", PROBABILITIES, by, **options), want)


def test_rows_between_the_bounds_are_a_share_of_the_error(spark):
    df = spark.range(200_000).select(F.rand(3).alias("x")).checkpoint()
    wanted = [0.25, 0.5, 0.75]
    stored = brackets.condensed(df, "x", wanted, k=800)
    assert stored.agg(F.sum("n")).first()[0] == 200_000
    assert stored.count() < 200_000 * 3 * 6 * brackets.rank_error(800)
    assert stored.where("not inside").count() <= 4


def test_a_sketch_that_misses_is_noticed(spark):
    df = spark.range(50_000).select(F.rand(4).alias("x")).checkpoint()
    assert not brackets._holds(brackets.condensed(df, "x", [0.5], k=8, margin=-0.2), [], [0.5])
    _same(brackets.bracketed_quantiles(df, "x", [0.5], k=8, margin=0.0), exact_quantiles(df, "x", [0.5]))


def test_missing_values_nan_ties_and_empty_tables(spark):
    rows = [("a", None), ("a", None), ("b", float("nan")), ("b", 1.0), ("b", 2.0), ("c", float("nan")), ("d", 5.0), ("d", 5.0), (None, 7.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r["g"]: r for r in brackets.bracketed_quantiles(df, "x", [0.0, 0.5], ["g"]).collect()}
    assert set(got) == {"a", "b", "c", "d", None} and got["a"]["q0"] is None
    assert (got["b"]["q0"], got["b"]["q1"]) == (1.0, 2.0) and np.isnan(got["c"]["q1"])
    assert got["d"]["q1"] == 5.0 and got[None]["q0"] == 7.0
    assert brackets.bracketed_quantiles(df.where("false"), "x", [0.5], ["g"]).count() == 0
    assert brackets.bracketed_quantiles(df.where("false"), "x", [0.5]).collect()[0][0] is None
