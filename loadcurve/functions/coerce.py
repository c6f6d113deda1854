"""Text to typed values; what cannot be read becomes NULL, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.columns import quoted

# Java accepts a type suffix on a number ("1d", "2.5f"); a meter file means something else by it.
_JAVA_SUFFIX = r"[0-9.][dDfF]\s*$"


def _source_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def coerce_numeric(df: DataFrame, name: str) -> Column:
    """A double column; text that is no number, and NaN, become NULL."""
    c = F.col(quoted(name))
    if isinstance(_source_type(df, name), T.StringType):
        number = F.when(~c.rlike(_JAVA_SUFFIX), c.try_cast("double"))
    else:
        number = c.cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def coerce_flag(df: DataFrame, name: str) -> Column:
    """An int column; missing or unreadable is 0, fractions are cut off."""
    return F.coalesce(coerce_numeric(df, name).try_cast("int"), F.lit(0))


def coerce_timestamp(df: DataFrame, name: str, formats: Sequence[str] = ()) -> Column:
    """A zone-free timestamp. ISO forms are always read; `formats` lists further patterns in order."""
    c = F.col(quoted(name))
    if not isinstance(_source_type(df, name), T.StringType):
        return c.cast("timestamp_ntz")
    attempts = [c.try_cast("timestamp_ntz")]
    attempts += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*attempts)


def parse_compact_date(c: Column) -> Column:
    """`01MAY2018` (any case) to a date; NULL when it is no such date."""
    return F.try_to_timestamp(F.trim(c), F.lit("ddMMMyyyy")).cast("date")


def downcast_types(
    df: DataFrame, float_columns: Sequence[str], int_columns: Sequence[str]
) -> DataFrame:
    """Float columns to 32 bit, flag and calendar columns to int with 0 for missing; one projection."""
    narrowed = {c: coerce_numeric(df, c).cast("float") for c in float_columns if c in df.columns}
    narrowed |= {c: coerce_flag(df, c) for c in int_columns if c in df.columns}
    return df.withColumns(narrowed)
