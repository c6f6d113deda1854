import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loadcurve.plans import models
from loadcurve.plans.features import add_lags
from loadcurve.streaming import next_hour
from loadcurve.streaming.next_hour import stream_lags, stream_next_hour

SCHEMA = "region string, building_name string, full_timestamp timestamp_ntz, usage_kwh_norm double, apparent_temperature_norm double"
KEYS = ["region", "building_name"]
LAGS = ["lag_1h", "lag_24h", "rollmean_24h", "temp_lag_1h", "temp_lag_24h"]


def _rows(seed=4):
    rng = random.Random(seed)
    rows = []
    for b, n in (("a", 70), ("b", 30), ("c", 10), (None, 28)):
        for i in range(n):
            if rng.random() < 0.05:
                continue  # an hour that never came
            rows.append(("NSW", b, datetime(2024, 1, 1) + timedelta(hours=i), None if rng.random() < 0.03 else rng.random(), rng.random()))
    return sorted(rows, key=lambda r: r[2])


def _run(spark, folder, name, parts, **options):
    """Each part as a file of its own, each in a query started anew from the checkpoint."""
    source, target = folder / f"{name}-in", folder / f"{name}-out"
    source.mkdir()
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{source}/p{i}")
        stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(source))
        lagged = stream_lags(stream, **options)
        query = lagged.writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(str(target))
        query.awaitTermination()
    return spark.read.parquet(str(target))


def _same(got, want):
    order = lambda df: sorted(map(tuple, df.collect()), key=str)
    a, b = order(got), order(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:3] == y[:3]
        assert all((p is None and q is None) or abs(p - q) < 1e-12 for p, q in zip(x[3:], y[3:], strict=True)), (x, y)


@pytest.fixture(scope="module")
def rows():
    return _rows()


def _plain(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    return add_lags(frame, KEYS, usage="usage_kwh_norm", target=False, unique_hours=True).select(*frame.columns, *LAGS)


def test_replay_with_restarts_equals_lags(spark, tmp_path, rows):
    cuts = [0, 40, 41, 90, len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    got = _run(spark, tmp_path, "replay", parts)
    _same(got.select(*KEYS, "full_timestamp", "usage_kwh_norm", "apparent_temperature_norm", *LAGS), _plain(spark, rows))


def test_late_readings(spark, tmp_path, rows):
    """Readings up to two hours late are taken in order, later ones and repeats are left out; the last two hours wait."""
    rng = random.Random(1)
    mixed = [(r[2] + timedelta(hours=rng.choice([0, 0, 1, 1.9])), r) for r in rows if r[1] == "a"]
    arrived = [r for _, r in sorted(mixed, key=lambda x: x[0])]
    too_late = ("NSW", "a", arrived[0][2] - timedelta(hours=50), 9.0, 9.0)
    last = max(r[2] for r in arrived)
    parts = [arrived[:20], [*arrived[20:45], too_late, arrived[3]], arrived[45:]]
    got = _run(spark, tmp_path, "late", parts, wait_hours=2)
    want = _plain(spark, [r for r in arrived if r[2] <= last - timedelta(hours=2)])
    _same(got.select(*KEYS, "full_timestamp", "usage_kwh_norm", "apparent_temperature_norm", *LAGS), want)


def test_forecast_on_arrival(spark, rows):
    lagged = _plain(spark, rows)
    out = stream_next_hour(lagged, models.column_scorer(F.col("lag_1h") + F.col("hour"))).collect()
    assert len(out) == lagged.dropna(subset=LAGS[:3]).count() > 0
    assert all(r["y_pred_next"] == r["lag_1h"] + r["hour"] and r["timestamp_next"] - r["timestamp_last"] == timedelta(hours=1) for r in out)


def test_a_buildings_rows_become_columns_at_once():
    class Kept:
        asked, value = 0, None

        def exists(self):
            raise AssertionError("one question a building: the value itself says whether it is there")

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    state, day = next_hour.LastDay(0, ["region", "building_name"]), 26
    state.state = Kept()
    rows = pd.DataFrame({"in_at": np.arange(day) * 10, "in_usage": [None, *np.arange(day - 1.0)], "in_temperature": np.arange(float(day))})
    (frame,) = state.handleInputRows(("NSW", "b1"), iter([rows]), None)
    assert list(frame.columns[:3]) == ["region", "building_name", "at"] and set(frame["building_name"]) == {"b1"}
    assert frame["at"].dtype == "int64" and all(str(t) == "float64" for t in frame.dtypes[3:])
    last = frame.iloc[-1]
    assert (last["lag_1h"], last["lag_24h"], last["rollmean_24h"], last["temp_lag_24h"]) == (23.0, 0.0, 11.5, 1.0)
    assert frame["usage"].isna().tolist() == [True] + [False] * (day - 1)
    assert list(state.handleInputRows(("NSW", "b1"), iter([rows]), None)) == [] and len(state.state.value[0]) == 24
