"""Small frames and result comparison for the tests."""

from __future__ import annotations

from datetime import datetime, timedelta

import numpy as np
import pandas as pd

START = datetime(2020, 12, 20)


def hourly_frame(spark, lengths: dict[str, int], *, gap: float = 0.0, seed: int = 0, start=START):
    """Readings with weather for each building, `gap` being the share of missing hours."""
    rng = np.random.default_rng(seed)
    rows = []
    for building, n in lengths.items():
        for i in range(n):
            if rng.random() < gap:
                continue
            t = start + timedelta(hours=i)
            rows.append((building, t, float(rng.random()), float(rng.random()), float(rng.random()), "NSW"))
    pdf = pd.DataFrame(
        rows,
        columns=["building_name", "full_timestamp", "usage_kwh_norm", "apparent_temperature_norm", "precipitation", "region"],
    )
    df = spark.createDataFrame(
        rows,
        "building_name string, full_timestamp timestamp_ntz, usage_kwh_norm double, "
        "apparent_temperature_norm double, precipitation double, region string",
    )
    flags = {"is_day": "int(hour(full_timestamp) between 6 and 18)", "is_weekend": "int(weekday(full_timestamp) >= 5)", "is_holiday": "0"}
    return df.selectExpr("*", *[f"{e} as {n}" for n, e in flags.items()]), pdf


def texts(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def column(df, name="v"):
    return [r[name] for r in df.collect()]
