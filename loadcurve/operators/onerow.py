"""Attaching a one-row aggregate to every row as constants: no join, no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _constant(value, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, (T.TimestampNTZType, T.DateType)):
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value).cast(kind)


def attach_row(df: DataFrame, one_row: DataFrame, name: str = "__row1") -> DataFrame:
    """Add the single row of `one_row` as a struct column.

    The row is computed at once and enters the plan as constants. So comparisons with it can reach
    the scan, and two branches over the same rows have equal plans and share their shuffle.
    """
    values = one_row.first()
    fields = [
        _constant(None if values is None else values[f.name], f.dataType).alias(f.name)
        for f in one_row.schema.fields
    ]
    return df.withColumn(name, F.struct(*fields))
