"""Ordered row windows over long series, without one task per series.

A series with at most one row per hour is short (a century is 876,600 rows), and a plain window does.
Where that is not known, series are counted first. One that is too long for a task is cut into
contiguous ranges of its row order; a range is then what one task sorts. Row offsets within reach of
a range's ends are worked out over the rows near the ends alone. The result equals a plain window.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loadcurve.functions import timefns
from loadcurve.session import cut_lineage

_RANGE, _ROW, _SIZE, _TIE = "__range", "__row", "__size", "__tie"

MAX_SERIES_ROWS = 1_000_000
BROADCAST_SERIES = 100_000

WindowColumns = Callable[[WindowSpec], dict[str, Column]]


def split_long_series(
    df: DataFrame, keys: Sequence[str], max_rows: int = MAX_SERIES_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """The rows of series up to `max_rows`, and those of longer ones (None if there are none).

    Series are counted with a combine before the shuffle. At most (all rows / `max_rows`) can be long.
    """
    names = [f"__long_{i}" for i in range(len(keys))]
    long_keys = cut_lineage(
        df.groupBy(*keys)
        .count()
        .where(F.col("count") > max_rows)
        .select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    )
    n_long = long_keys.count()
    if n_long == 0:
        return df, None
    if n_long <= BROADCAST_SERIES:
        long_keys = F.broadcast(long_keys)
    is_long = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)])
    return df.join(long_keys, is_long, "left_anti"), df.join(long_keys, is_long, "left_semi")


def _with_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int) -> DataFrame:
    """Add the number of the contiguous range of (keys, order) a row falls in.

    A random last sort key lets even exact copies fall in several ranges. Rows are stored before
    and after the cut, so that every later branch, and every retried task, sees the same ranges.
    """
    tied = cut_lineage(df.withColumn(_TIE, F.rand(17)))
    ranges = max(2, 2 * -(-tied.count() // max_rows))
    ranged = tied.repartitionByRange(ranges, *keys, *order, _TIE).withColumn(_RANGE, F.spark_partition_id())
    return cut_lineage(ranged.drop(_TIE))


def _over_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: WindowColumns,
    before: int,
    after: int,
    max_rows: int,
) -> DataFrame:
    in_range = Window.partitionBy(*keys, _RANGE)
    w = in_range.orderBy(*order)
    placed = _with_ranges(df, keys, order, max_rows).withColumns(
        {_ROW: F.row_number().over(w), _SIZE: F.count(F.lit(1)).over(in_range)}
    )
    to_end = F.col(_SIZE) - F.col(_ROW)
    near_end = (F.col(_ROW) <= before) | (to_end < after)
    inner = placed.withColumns(columns(w)).where(~near_end)

    reach = before + after
    end_rows = placed.where((F.col(_ROW) <= reach) | (to_end < reach))
    across = Window.partitionBy(*keys).orderBy(_RANGE, _ROW)
    ends = end_rows.withColumns(columns(across)).where(near_end)
    return inner.unionByName(ends).drop(_RANGE, _ROW, _SIZE)


def window_over_series(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: WindowColumns,
    *,
    before: int,
    after: int,
    ties: Sequence[str] = (),
    unique_hours: bool = False,
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Add window columns over each key's rows in time order.

    `columns(w)` builds the columns for a window specification; they may look back `before` rows
    and ahead `after` rows. Rows with equal times are ordered by `ties`. With `unique_hours` the
    caller knows that no series has two rows in one hour, and nothing is counted.
    """
    order = [ts, *ties]
    plain = columns(Window.partitionBy(*keys).orderBy(*order))
    if unique_hours:
        return df.withColumns(plain)
    usual, long = split_long_series(df, keys, max_rows)
    if long is None:
        return usual.withColumns(plain)
    ranged = _over_ranges(long, keys, order, columns, before, after, max_rows)
    return usual.withColumns(plain).unionByName(ranged)


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    *,
    ties: Sequence[str] = (),
    position: str = "position",
    size: str = "series_rows",
    unique_hours: bool = False,
    max_rows: int = MAX_SERIES_ROWS,
) -> DataFrame:
    """Add each row's 0-based position in its series and the series length."""
    order = [ts, *ties]
    whole = Window.partitionBy(*keys)
    plain = {
        position: (F.row_number().over(whole.orderBy(*order)) - 1).cast("bigint"),
        size: F.count(F.lit(1)).over(whole),
    }
    if unique_hours:
        return df.withColumns(plain)
    usual, long = split_long_series(df, keys, max_rows)
    if long is None:
        return usual.withColumns(plain)
    ranged = _with_ranges(long, keys, order, max_rows)
    part = [*keys, _RANGE]
    earlier = whole.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    # One row per series and range.
    offsets = (
        ranged.groupBy(*part)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *part,
            F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
            F.sum("__n").over(whole).alias(size),
        )
    )
    within = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    placed = (
        ranged.withColumn(_ROW, within)
        .join(offsets, part)
        .withColumn(position, F.col("__before") + F.col(_ROW) - 1)
        .drop("__before", _RANGE, _ROW)
    )
    return usual.withColumns(plain).unionByName(placed)


_YEAR = "__year"


def window_over_hours(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: WindowColumns,
    *,
    before: int,
    after: int,
) -> DataFrame:
    """Add window columns whose frames are ranges of elapsed hours (a missing hour stays missing).

    `columns(w)` gets a window ordered by hours since 1970. The rows of a series are dealt by year;
    those within `before` hours of a year's end also go to the next year, and those within `after`
    hours of its start to the previous one. So a single shuffle by (key, year) is enough.
    """
    t = F.col(ts)
    years = F.array_distinct(
        F.array(
            F.year(t), F.year(timefns.shift_hours(t, before)), F.year(timefns.shift_hours(t, -after))
        )
    )
    spread = df.withColumns({"__own": F.year(t), "__hour": timefns.epoch_hour(t)}).withColumn(
        _YEAR, F.explode(years)
    )
    w = Window.partitionBy(*keys, _YEAR).orderBy("__hour")
    return (
        spread.withColumns(columns(w))
        .where(F.col(_YEAR) == F.col("__own"))
        .drop(_YEAR, "__own", "__hour")
    )
