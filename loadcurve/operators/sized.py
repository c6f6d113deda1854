"""Joining a lookup table whose size is checked before it is broadcast."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.columns import quoted
from loadcurve.session import cut_lineage

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


class DuplicateKeyError(ValueError):
    """The lookup side of a many-to-one join has a repeated key."""


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Return the frame, or raise when a key repeats. The check is one combined aggregate."""
    repeated = df.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect()
    if repeated:
        raise DuplicateKeyError(f"key {list(keys)} repeats: {repeated[0].asDict()}")
    return df


def fits_broadcast(stored: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a stored table is small in rows and, by the lengths of its values, in bytes; one aggregate."""
    row = F.lit(0).cast("bigint")
    for field in stored.schema.fields:
        c = F.col(quoted(field.name))
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            row = row + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            row = row + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8
        else:
            row = row + 8
    size = stored.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()
    return size["rows"] <= max_rows and size["bytes"] <= max_bytes


def join_lookup(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    *,
    unique: bool = False,
    null_safe: bool = False,
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join a narrow lookup table.

    The lookup is computed once and measured. Up to `max_rows` rows and BROADCAST_BYTES bytes it is broadcast
    and the large side is not shuffled. A larger one is joined by sort-merge, where hot keys are split at run time.
    `unique` makes a repeated lookup key an error; `null_safe` lets NULL keys match each other.
    """
    stored = cut_lineage(lookup)
    if unique:
        assert_unique_key(stored, keys)
    fits = fits_broadcast(stored, max_rows)
    if not null_safe:
        return df.join(F.broadcast(stored) if fits else stored, list(keys), how)
    renamed = {k: f"__key_{i}" for i, k in enumerate(keys)}
    stored = stored.withColumnsRenamed(renamed)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(r)) for k, r in renamed.items()])
    return df.join(F.broadcast(stored) if fits else stored, same, how).drop(*renamed.values())
