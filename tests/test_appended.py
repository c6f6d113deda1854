import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loadcurve.plans import appended
from loadcurve.plans.features import build_features

SCHEMA = "building_name string, full_timestamp timestamp_ntz, region string, usage_kwh_norm double, apparent_temperature_norm double, precipitation double, is_day int, is_holiday int, is_weekend int"
START = datetime(2024, 1, 1)


def _rows():
    rng = random.Random(3)
    rows = []
    for b, region, n in (("a", "NSW", 120), ("b", "LCL", 100), ("c", "NSW", 20), ("a", "LCL", 60)):
        rows += [
            (b, START + timedelta(hours=i), region, rng.random(), rng.random(), rng.random() if i % 9 else None, i % 2, 0, 1)
            for i in range(n) if rng.random() > 0.04
        ]
    return rows


def _plain(spark, rows, fit_hours):
    frame = spark.createDataFrame(rows, SCHEMA)
    return build_features(frame, unique_hours=True, fit_until=str(START + timedelta(hours=fit_hours)))


def _sorted(df):
    return sorted((tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("cuts", [[50, 51, 52, 80, 200], [40, 200]])
def test_appends_equal_one_run(spark, tmp_path, cuts):
    rows, path = _rows(), str(tmp_path / "table")
    at = lambda r: (r[1] - START) / timedelta(hours=1)
    for k, (low, high) in enumerate(zip([-1, *cuts], cuts, strict=False)):
        part = [r for r in rows if low < at(r) <= high]
        # late rows and repeats of stored ones are left out
        late = [(*r[:3], 9.9, *r[4:]) for r in rows if at(r) <= low][-30:]
        assert appended.append_features(spark.createDataFrame(part + late, SCHEMA).repartition(3), path) == k
    got, want = appended.read_features(spark, path), _plain(spark, rows, cuts[0])
    assert got.columns == want.columns and _sorted(got) == _sorted(want) and got.count() > 150


def test_earlier_features_are_not_read(spark, tmp_path, monkeypatch):
    rows, path, read = _rows(), str(tmp_path / "table"), []
    frame = lambda low, high: spark.createDataFrame([r for r in rows if low <= (r[1] - START) / timedelta(hours=1) < high], SCHEMA)
    appended.append_features(frame(0, 60), path)
    real = type(spark.read).parquet
    monkeypatch.setattr(type(spark.read), "parquet", lambda self, *p, **k: read.extend(p) or real(self, *p, **k))
    appended.append_features(frame(60, 70), path)
    assert not any("/features/append=0" in p for p in read) and any("/tail/append=0" in p for p in read)
    tail = spark.read.parquet(f"{path}/tail/append=1")
    assert tail.groupBy("region", "building_name").count().agg(F.max("count")).first()[0] == appended.TAIL_ROWS


def test_a_broken_append_is_made_again(spark, tmp_path, monkeypatch):
    rows, path = _rows(), str(tmp_path / "table")
    frame = lambda low, high: spark.createDataFrame([r for r in rows if low <= (r[1] - START) / timedelta(hours=1) < high], SCHEMA)
    appended.append_features(frame(0, 50.5), path)
    monkeypatch.setattr(appended, "Window", None)
    with pytest.raises(AttributeError):  # after the features are written, before the tail is
        appended.append_features(frame(50.5, 60), path)
    monkeypatch.undo()
    assert appended.read_features(spark, path).count() == spark.read.parquet(f"{path}/features/append=0").count()
    assert appended.append_features(frame(50.5, 200), path) == 1
    assert _sorted(appended.read_features(spark, path)) == _sorted(_plain(spark, rows, 50))


def test_buildings_and_regions_that_come_later(spark, tmp_path):
    path = str(tmp_path / "table")
    first = [("a", START + timedelta(hours=i), "NSW", i / 100, 0.5, 0.0, 1, 0, 0) for i in range(40)]
    later = [("z", START + timedelta(hours=i), "AAA", 1 - i / 100, 0.5, 0.0, 1, 0, 0) for i in range(40)]
    for part in (first, later, [(*r[:1], r[1] + timedelta(hours=40), *r[2:]) for r in later]):
        appended.append_features(spark.createDataFrame(part, SCHEMA), path)
    got = appended.read_features(spark, path)
    assert {(r["region"], r["region_id"]) for r in got.select("region", "region_id").distinct().collect()} == {("NSW", 0), ("AAA", 1)}
    assert got.where("building_name = 'z'").count() == 80 - 24 - 1
    appended.append_features(spark.createDataFrame([], SCHEMA), path)
    assert appended.read_features(spark, path).count() == got.count()
