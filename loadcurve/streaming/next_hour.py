"""Lag features and next-hour forecasts of readings as they arrive, from each building's last day kept as state."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loadcurve import constants as K
from loadcurve.functions import timefns
from loadcurve.functions.columns import quoted
from loadcurve.plans.models import Scorer
from loadcurve.session import let_workers_import

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_STATE = "times array<bigint>, usage array<double>, temperature array<double>, waiting_times array<bigint>, waiting_usage array<double>, waiting_temperature array<double>"


class LastDay(StatefulProcessor):
    """Keeps the last 24 readings of a building, and those that still wait for earlier ones.

    A reading waits until one that is `wait` microseconds newer has come; then readings are taken in order of time. One that is
    not newer than the last taken is late, and left out; of several with one time the first that came counts.
    """

    def __init__(self, wait: int, keys: Sequence[str]):
        self.wait, self.keys = wait, list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last_day", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.state.get() or ([],) * 6
        times, usage, temperature, *waiting = (list(x) for x in held)
        for part in rows:
            for into, c in zip(waiting, ("in_at", "in_usage", "in_temperature"), strict=True):
                into += part[c].tolist()
        if not waiting[0]:
            return
        at = np.array(waiting[0], np.int64)
        order = np.argsort(at, kind="stable")
        ready_until = at.max() - self.wait
        out, left = [], [[], [], []]
        for i in order.tolist():
            t, u, c = (w[i] for w in waiting)
            u, c = (None if x is None or x != x else float(x) for x in (u, c))
            if times and t <= times[-1]:
                continue
            if t > ready_until:
                for into, x in zip(left, (t, u, c), strict=True):
                    into.append(x)
                continue
            day = usage[-K.ROLLING_ROWS :]
            full = len(day) == K.ROLLING_ROWS
            mean = sum(day) / K.ROLLING_ROWS if full and None not in day else None
            back = lambda values, n: values[-n] if len(values) >= n else None
            out.append((t, u, c, back(usage, 1), back(usage, K.ROLLING_ROWS), mean, back(temperature, 1), back(temperature, K.ROLLING_ROWS)))
            times, usage, temperature = (x[-K.ROLLING_ROWS + 1 :] + [y] for x, y in ((times, t), (usage, u), (temperature, c)))
        self.state.update((times, usage, temperature, *left))
        if out:
            names = ["at", "usage", "temperature", "lag_1h", "lag_24h", "rollmean_24h", "temp_lag_1h", "temp_lag_24h"]
            # one frame for each building: made of whole columns, which takes a fraction of the time of one made of rows
            columns = {name: [value] * len(out) for name, value in zip(self.keys, key, strict=True)}
            at, *rest = zip(*out, strict=True)
            columns["at"] = np.array(at, np.int64)
            columns |= {name: np.array(x, np.float64) for name, x in zip(names[1:], rest, strict=True)}
            yield pd.DataFrame(columns)

    def close(self) -> None:
        pass


def stream_lags(
    readings: DataFrame,
    keys: Sequence[str] = ("region", "building_name"),
    *,
    ts: str = "full_timestamp",
    usage: str = "usage_kwh_norm",
    temperature: str = "apparent_temperature_norm",
    wait_hours: int = 0,
) -> DataFrame:
    """Each building's readings with lags and the rolling mean, by position as `lag_features` has them, as soon as they can be told.

    State is 24 readings a building and those of the last `wait_hours`, which may still be followed by earlier ones; readings that come
    later than that are left out. It lies with the checkpoint of the query, so a restarted one goes on where it stopped. The session's
    state store must be RocksDB, which this sets where nothing else is.
    """
    spark = readings.sparkSession
    let_workers_import(spark)
    if spark.conf.get(_PROVIDER, None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(_PROVIDER, ROCKSDB)
    keys = list(keys)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    rows = readings.where(F.col(ts).isNotNull()).select(
        *[F.col(quoted(k)) for k in keys], at.alias("in_at"), F.col(usage).cast("double").alias("in_usage"), F.col(temperature).cast("double").alias("in_temperature")
    )
    kinds = ", ".join(f"{quoted(k)} {rows.schema[k].dataType.simpleString()}" for k in keys)
    made = "at bigint, usage double, temperature double, lag_1h double, lag_24h double, rollmean_24h double, temp_lag_1h double, temp_lag_24h double"
    lagged = rows.groupBy(*keys).transformWithStateInPandas(LastDay(wait_hours * 3_600_000_000, keys), f"{kinds}, {made}", "Append", "None")
    time = F.timestamp_micros("at").cast(readings.schema[ts].dataType).alias(ts)
    rest = [c for c in lagged.columns if c not in [*keys, "at", "usage", "temperature"]]
    return lagged.select(*keys, time, F.col("usage").alias(usage), F.col("temperature").alias(temperature), *rest)


def stream_next_hour(lagged: DataFrame, scorer: Scorer, ts: str = "full_timestamp") -> DataFrame:
    """The forecast for the hour after each reading that has a full day before it, as `y_pred_next` for `timestamp_next`."""
    t = F.col(ts)
    full = lagged.dropna(subset=["lag_1h", "lag_24h", "rollmean_24h"]).withColumns(timefns.calendar_parts(t))
    scored = scorer(full).withColumnRenamed("y_pred", "y_pred_next")
    return scored.withColumns({"timestamp_last": t, "timestamp_next": timefns.next_hour(t)})
