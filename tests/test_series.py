"""Ranged windows against a plain window, and against pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loadcurve.operators.sampling import downsample_every_nth, sample_hash, sample_per_entity, sample_split_cap
from loadcurve.operators.series import window_over_hours, window_over_series, with_positions
from loadcurve.plans.features import add_lags, lag_columns, lag_columns_by_hours
from tests.helpers import hourly_frame

KEYS = ["building_name"]
LAGS = ["lag_1h", "lag_24h", "rollmean_24h", "temp_lag_1h", "temp_lag_24h", "y_next"]


def _sorted(df, *extra):
    return df.toPandas().sort_values(["building_name", "full_timestamp", *extra]).reset_index(drop=True)


@pytest.mark.parametrize(
    "slicing",
    [{}, {"unique_hours": True}, {"max_rows": 1000}, {"max_rows": 40}, {"max_rows": 5}],
)
def test_ranges_equal_plain_window(spark, slicing):
    df, _ = hourly_frame(spark, {"a": 700, "b": 30, "c": 24, "d": 1, "e": 1500}, gap=0.2)
    df = df.withColumnRenamed("usage_kwh_norm", "usage_pb")
    got = _sorted(add_lags(df, KEYS, **slicing))
    plain = df.withColumns(lag_columns(Window.partitionBy(*KEYS).orderBy("full_timestamp")))
    want = _sorted(plain)
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_lags_against_pandas(spark):
    df, pdf = hourly_frame(spark, {"a": 300, "b": 60}, gap=0.1)
    got = _sorted(add_lags(df, KEYS, usage="usage_kwh_norm", max_rows=20))
    pdf = pdf.sort_values(["building_name", "full_timestamp"]).reset_index(drop=True)
    g = pdf.groupby("building_name")["usage_kwh_norm"]
    want = pd.DataFrame(
        {
            "lag_1h": g.shift(1),
            "lag_24h": g.shift(24),
            "rollmean_24h": g.transform(lambda s: s.shift(1).rolling(24, min_periods=24).mean()),
            "y_next": g.shift(-1),
        }
    )
    for c in want:
        np.testing.assert_allclose(got[c].astype(float), want[c], rtol=1e-9)


def test_copies_and_hot_building(spark):
    """One building-hour holds a third of all rows, most of them exact copies; all rows are kept."""
    df, _ = hourly_frame(spark, {"a": 200, "b": 60})
    hot = df.where("building_name = 'a'").orderBy("full_timestamp").limit(1)
    copies = hot.crossJoin(spark.range(130)).drop("id")
    full = df.unionByName(copies).withColumnRenamed("usage_kwh_norm", "usage_pb")
    columns = lambda w: lag_columns(w)
    ties = ["usage_pb", "apparent_temperature_norm"]
    got = _sorted(
        window_over_series(full, KEYS, "full_timestamp", columns, before=24, after=1, ties=ties, max_rows=50), *LAGS
    )
    want = _sorted(full.withColumns(lag_columns(Window.partitionBy(*KEYS).orderBy("full_timestamp", *ties))), *LAGS)
    assert len(got) == 390
    pd.testing.assert_frame_equal(got[want.columns], want)


def test_same_result_for_any_row_order(spark):
    df, _ = hourly_frame(spark, {"a": 400, "b": 90}, gap=0.3)
    df = df.withColumnRenamed("usage_kwh_norm", "usage_pb")
    one = _sorted(add_lags(df.coalesce(1), KEYS, max_rows=100))
    many = _sorted(add_lags(df.orderBy(F.rand(3)).repartition(7), KEYS, max_rows=100))
    pd.testing.assert_frame_equal(one, many)


def test_rolling_mean_needs_24_present_values(spark):
    df, _ = hourly_frame(spark, {"x23": 23, "x24": 24, "x25": 25, "hole": 60})
    missing = (F.col("building_name") == "hole") & (F.col("full_timestamp") == F.lit("2020-12-21 06:00:00").cast("timestamp_ntz"))
    df = df.withColumn("usage_pb", F.when(~missing, F.col("usage_kwh_norm"))).drop("usage_kwh_norm")
    out = add_lags(df, KEYS, max_rows=20).where("rollmean_24h is not null").groupBy("building_name").count()
    counts = {r["building_name"]: r["count"] for r in out.collect()}
    # The hole is row 30: windows ending before it are rows 24..30, those starting after it rows 55..59.
    assert counts == {"x25": 1, "hole": 7 + 5}


def test_hour_mode_leaves_gaps_missing(spark):
    df, pdf = hourly_frame(spark, {"a": 500}, gap=0.2, start=pd.Timestamp("2020-12-15").to_pydatetime())
    got = _sorted(
        window_over_hours(df, KEYS, "full_timestamp", lambda w: lag_columns_by_hours(w, "usage_kwh_norm"), before=24, after=1)
    )
    s = pdf.set_index("full_timestamp")["usage_kwh_norm"].asfreq("h")
    for name, shift in (("lag_1h", 1), ("lag_24h", 24), ("y_next", -1)):
        want = s.shift(shift).reindex(pdf["full_timestamp"]).to_numpy()
        np.testing.assert_allclose(got[name].astype(float), want)
    want = s.shift(1).rolling(24, min_periods=24).mean().reindex(pdf["full_timestamp"]).to_numpy()
    np.testing.assert_allclose(got["rollmean_24h"].astype(float), want, rtol=1e-9)


@pytest.mark.parametrize("slicing", [{}, {"unique_hours": True}, {"max_rows": 30}])
def test_positions(spark, slicing):
    df, pdf = hourly_frame(spark, {"a": 150, "b": 40}, gap=0.2)
    got = _sorted(with_positions(df, KEYS, "full_timestamp", **slicing))
    want = pdf.sort_values(["building_name", "full_timestamp"]).groupby("building_name").cumcount().to_numpy()
    assert (got["position"].to_numpy() == want).all()
    assert got.groupby("building_name")["series_rows"].first().to_dict() == pdf["building_name"].value_counts().to_dict()


def test_downsample(spark):
    df, _ = hourly_frame(spark, {"long": 250, "short": 100})
    out = downsample_every_nth(df, max_points=100, max_rows=20)
    counts = {r["building_name"]: r["count"] for r in out.groupBy("building_name").count().collect()}
    assert counts == {"long": 125, "short": 100}


def test_sample_per_entity_is_repeatable_and_capped(spark):
    df, _ = hourly_frame(spark, {"hot": 900, "cold": 5})
    one = _sorted(sample_per_entity(df, 20))
    two = _sorted(sample_per_entity(df.repartition(9), 20))
    pd.testing.assert_frame_equal(one, two)
    assert one["building_name"].value_counts().to_dict() == {"hot": 20, "cold": 5}


def test_split_cap(spark):
    df, _ = hourly_frame(spark, {f"b{i}": 300 for i in range(10)})
    split = F.when(F.col("full_timestamp") < F.lit("2020-12-30").cast("timestamp_ntz"), "train").otherwise("val")
    out = sample_split_cap(df.withColumn("split", split), {"train": 100, "val": 5000}, ["building_name", "full_timestamp"])
    counts = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"train": 100, "val": 600}
    assert out.where("split = 'train'").select("building_name").distinct().count() > 5


def test_split_cap_with_copies_stays_under_the_cap(spark):
    df, _ = hourly_frame(spark, {"a": 100})
    copies = df.limit(1).crossJoin(spark.range(500)).drop("id")
    rows = df.unionByName(copies).withColumn("split", F.lit("train"))
    out = sample_split_cap(rows, {"train": 50}, ["building_name", "full_timestamp"])
    assert out.count() == 50
    only = copies.withColumn("split", F.lit("train")).repartition(5)
    assert sample_split_cap(only, {"train": 100}, ["building_name", "full_timestamp"]).count() == 100


def test_split_cap_keeps_the_lowest_hashes_on_any_partitioning(spark):
    df, _ = hourly_frame(spark, {f"b{i}": 200 for i in range(8)})
    df = df.withColumn("split", F.when(F.col("building_name") < "b3", "train").when(F.col("building_name") < "b6", "val").otherwise("test"))
    keys, caps = ["building_name", "full_timestamp"], {"train": 77, "val": 0, "test": 10**12}
    hashed = df.withColumn("h", sample_hash(keys, 42)).toPandas()
    want = pd.concat([g.nsmallest(min(caps[s], len(g)), "h") for s, g in hashed.groupby("split")])
    for rows in (df.coalesce(1), df.repartition(7)):
        got = sample_split_cap(rows, caps, keys).toPandas()
        assert set(map(tuple, got[keys].to_numpy())) == set(map(tuple, want[keys].to_numpy())) and len(got) == len(want) == 477
    assert sample_split_cap(df.where("false"), caps, keys).count() == 0
