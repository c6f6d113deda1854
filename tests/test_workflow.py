from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.plans import workflow
from loadcurve.plans.features import add_lags
from loadcurve.plans.unify import standardize_readings
from loadcurve.streaming.ingest import append_readings, stream_readings
from tests.helpers import hourly_frame

COLUMNS = "building_name,full_timestamp,usage_kwh_norm,apparent_temperature_norm,precipitation,is_day"


def _lines(buildings, hours, seed, start=datetime(2021, 1, 1)):
    rng = np.random.default_rng(seed)
    for b in range(buildings):
        for i in range(hours):
            t = start + timedelta(hours=i)
            use = 0.5 + 0.4 * np.sin(2 * np.pi * t.hour / 24) * rng.uniform(0.8, 1)
            yield f"b{seed}_{b},{t:%Y-%m-%d %H:%M:%S},{use:.6f},{rng.random():.6f},{rng.random():.3f},{int(6 <= t.hour <= 18)}"


def _write(path, lines):
    path.write_text("\n".join([COLUMNS, *lines]) + "\n")


def test_train_then_forecast(spark, tmp_path):
    _write(tmp_path / "nsw.csv", _lines(3, 300, 1))
    _write(tmp_path / "lcl.csv", _lines(2, 300, 2))
    out = str(tmp_path / "run")
    small = {"num_trees": 5, "max_depth": 4, "max_bins": 16}
    metrics = workflow.train(
        spark, [(str(tmp_path / "nsw.csv"), "NSW"), (str(tmp_path / "lcl.csv"), "LCL")], out,
        forest=small, boosted={"max_iter": 3, "max_depth": 3, "max_bins": 16}, unique_hours=True,
        caps={"train": 900, "val": 100, "test": 100},
    )
    assert {(r["model"], r["split"]) for r in metrics.collect()} == {(m, s) for m in ("Naive", "RF", "GBT") for s in ("val", "test")}
    assert spark.read.parquet(f"{out}/features.parquet").count() == 5 * (300 - 25)
    assert spark.read.option("header", True).csv(f"{out}/segments").count() == 5
    assert spark.read.option("header", True).csv(f"{out}/importance").count() == 14
    assert spark.read.json(f"{out}/metrics").count() == 12
    assert {r["region"]: r["region_id"] for r in spark.read.parquet(f"{out}/regions.parquet").collect()} == {"LCL": 0, "NSW": 1}
    nxt = workflow.forecast(spark, out, str(tmp_path / "nsw.csv"), str(tmp_path / "next"), region="NSW", unique_hours=True)
    rows = nxt.collect()
    assert len(rows) == 3 and {r["timestamp_next"][:19] for r in rows} == {"2021-01-13T12:00:00"} and {r["region_id"] for r in rows} == {"1"}
    with pytest.raises(FileNotFoundError):
        workflow.forecast(spark, out, str(tmp_path / "none.csv"), str(tmp_path / "x"))


def test_new_files_are_appended_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    target, checkpoint = str(tmp_path / "table"), str(tmp_path / "state")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS.split(",")])

    def run():
        q = append_readings(stream_readings(spark, str(folder), schema, "NSW"), target, checkpoint)
        q.awaitTermination(120)
        return spark.read.parquet(target)

    _write(folder / "one.csv", _lines(2, 30, 3))
    assert run().count() == 60
    _write(folder / "two.csv", _lines(1, 20, 4))
    table = run()
    batch = standardize_readings(spark.read.schema(schema).option("header", True).csv(str(folder)), "NSW")
    columns = ["building_name", "full_timestamp", "usage_kwh_norm", "is_weekend", "is_holiday", "is_day"]
    assert table.count() == 80
    assert table.select(columns).exceptAll(batch.select(columns)).count() == 0


def test_stream_needs_scaled_columns(spark, tmp_path):
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("building_name", "full_timestamp", "kwh")])
    with pytest.raises(ValueError):
        stream_readings(spark, str(tmp_path), schema, "NSW")


def test_hour_mode_with_copies(spark):
    df, _ = hourly_frame(spark, {"a": 120}, gap=0.1)
    df = df.withColumnRenamed("usage_kwh_norm", "usage_pb")
    doubled = df.unionByName(df.limit(40))
    plain = add_lags(df, ["building_name"], mode="hours", unique_hours=True)
    copies = add_lags(doubled, ["building_name"], mode="hours")
    assert copies.count() == doubled.count()
    names = ["full_timestamp", "lag_1h", "lag_24h", "y_next", F.round("rollmean_24h", 9).alias("r")]
    assert sorted(map(str, copies.select(*names).distinct().collect())) == sorted(map(str, plain.select(*names).distinct().collect()))
