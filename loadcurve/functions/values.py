"""Small numeric and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit_to_kwh(usage: Column, unit: Column, interval_hours: float = 0.25) -> Column:
    """Energy of one slot: power units are multiplied by the slot length, other units are kept."""
    u = F.upper(F.trim(unit))
    return (
        F.when(u == "KW", usage * interval_hours)
        .when(u == "MW", usage * 1000 * interval_hours)
        .otherwise(usage)
    )


def clip_unit(x: Column) -> Column:
    """Clip to [0, 1]; NULL stays NULL."""
    return F.when(x < 0, F.lit(0.0)).when(x > 1, F.lit(1.0)).otherwise(x)


def region_default(region: Column | None, default: str = "NSW") -> Column:
    return F.lit(default) if region is None else F.coalesce(region, F.lit(default))


def label_flag(flag: Column, yes: str, no: str) -> Column:
    return F.when(flag == 1, F.lit(yes)).otherwise(F.lit(no))


def residual(y_true: Column, y_pred: Column) -> Column:
    return y_true - y_pred


def abs_error(y_true: Column, y_pred: Column) -> Column:
    return F.abs(y_true - y_pred)


def pct_improve(baseline: Column, model: Column) -> Column:
    """Percent by which the model's error is below the baseline's; NULL without a baseline."""
    return F.when(baseline != 0, F.round((1 - model / baseline) * 100, 1))
