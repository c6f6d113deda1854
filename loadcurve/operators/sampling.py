"""Repeatable samples by hash, top and bottom rows, representative series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.functions.columns import entity_keys, quoted
from loadcurve.operators.aggregates import metric_mae_by_entity
from loadcurve.operators.series import with_positions

# 13 hex digits of the digest: 52 bits, exact as a double too.
_HASH_DIGITS = 13
_HASH_RANGE = float(16**_HASH_DIGITS)
_SALTS = 32
# Leading bits of the hash by which the rows of a split are counted first.
_CELL_BITS = 20


def sample_hash(keys: Sequence[str], seed: int) -> Column:
    """A uniform bigint from the row's key and a seed; the same in any engine that has md5."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, _HASH_DIGITS), 16, 10).cast("bigint")


def sample_split_cap(
    df: DataFrame,
    caps: dict[str, int],
    keys: Sequence[str],
    *,
    split: str = "split",
    seed: int = 42,
) -> DataFrame:
    """At most `caps[split]` rows of each split, spread evenly over all keys.

    The rows with the lowest hashes are kept. One aggregate counts the rows of each split by the leading bits of the hash, a
    second one those of the cell that the cap falls into by the whole hash; both limits are one row a split. Rows of one key share
    a hash; of those at the limit as many are kept as there is room for.
    """
    hashed = df.where(F.col(split).isin(list(caps))).withColumn("__hash", sample_hash(keys, seed))
    cell = F.shiftright("__hash", 4 * _HASH_DIGITS - _CELL_BITS)
    crossed = _crossing(hashed.select(split, cell.alias("value")), split, caps)
    in_cell = F.lit(False)
    for name, (value, _) in crossed.items():
        in_cell = in_cell | ((F.col(split) == name) & (cell == value))
    limits = _crossing(
        hashed.where(in_cell).select(split, F.col("__hash").alias("value")), split, {name: room for name, (_, room) in crossed.items()}
    )
    below, room, full = F.lit(True), F.lit(0), F.lit(False)
    for name, (value, left) in limits.items():
        mine = F.col(split) == name
        below = below & (~mine | (F.col("__hash") < value))
        full = full | (mine & (F.col("__hash") == value))
        room = F.when(mine, left).otherwise(room)
    kept = hashed.where(below).drop("__hash")
    if not any(left for _, left in limits.values()):
        return kept
    # Rows of the key at the limit: first some of each partition, then some of these.
    row = F.xxhash64(*[F.col(quoted(c)) for c in df.columns])
    at_limit = hashed.where(full & (room > 0)).withColumns({"__row": row, "__part": F.spark_partition_id()})
    for by in ([split, "__part"], [split]):
        ranked = F.row_number().over(Window.partitionBy(*by).orderBy("__row"))
        at_limit = at_limit.withColumn("__rank", ranked).where(F.col("__rank") <= room)
    return kept.unionByName(at_limit.drop("__hash", "__row", "__part", "__rank"))


def _crossing(values: DataFrame, split: str, caps: dict[str, int]) -> dict[str, tuple[int, int]]:
    """For each split with more rows than its cap: the value at which the cap is passed, and the room left before it.

    Values are counted first, so a split is as many rows in the window as it has distinct values.
    """
    cap = F.lit(0)
    for name, rows in caps.items():
        cap = F.when(F.col(split) == name, F.lit(int(rows))).otherwise(cap)
    running = Window.partitionBy(split).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    counted = values.groupBy(split, "value").agg(F.count(F.lit(1)).alias("n")).withColumn("through", F.sum("n").over(running))
    first = counted.where(F.col("through") > cap).groupBy(split).agg(
        F.min(F.struct("value", (cap - F.col("through") + F.col("n")).alias("room"))).alias("at")
    )
    return {r[split]: (r["at"]["value"], r["at"]["room"]) for r in first.collect()}  # one row a split


def sample_per_entity(
    df: DataFrame,
    n: int,
    *,
    keys: Sequence[str] | None = None,
    ts: str = "full_timestamp",
    seed: int = 42,
) -> DataFrame:
    """At most n rows of each entity, the same ones on every run; each entity has hours of its own.

    Done in two rounds: the first keeps n rows of each of several hash parts of an entity, so that
    an entity with very many rows is not gathered in one task.
    """
    keys = list(keys or entity_keys(df))
    order = [F.col("__hash"), F.col(ts), F.xxhash64(*[F.col(quoted(c)) for c in df.columns])]
    hashed = df.withColumn("__hash", sample_hash([*keys, ts], seed)).withColumn(
        "__salt", F.pmod(F.xxhash64("__hash"), F.lit(_SALTS))
    )
    part = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        hashed.withColumn("__rank", F.row_number().over(part))
        .where(F.col("__rank") <= n)
        .withColumn("__rank", F.row_number().over(whole))
        .where(F.col("__rank") <= n)
        .drop("__hash", "__salt", "__rank")
    )


def sample_rows(df: DataFrame, fraction: float, seed: int = 42, keys: Sequence[str] | None = None) -> DataFrame:
    """About this share of the rows, for scatter plots, by the hash of their key; aggregates use all rows."""
    keys = list(keys or [*entity_keys(df), "full_timestamp"])
    return df.where(sample_hash(keys, seed) < F.lit(fraction * _HASH_RANGE))


def top_features(importance: DataFrame, n: int = 12) -> DataFrame:
    return importance.orderBy(F.desc("importance_mean"), "feature").limit(n)


def top_bottom_sensitivity(elasticity: DataFrame, n: int = 12) -> DataFrame:
    """The n highest and the n lowest elasticities, marked by `side`."""
    keys = entity_keys(elasticity)
    scored = elasticity.where(F.col("elasticity").isNotNull()).select(*keys, "elasticity")
    high = scored.orderBy(F.desc("elasticity"), *keys).limit(n)
    low = scored.orderBy(F.asc("elasticity"), *keys).limit(n)
    return high.withColumn("side", F.lit("high")).unionByName(low.withColumn("side", F.lit("low")))


def _series_of(predictions: DataFrame, chosen: DataFrame) -> DataFrame:
    # `chosen` is a handful of buildings by construction (limit).
    keys = entity_keys(predictions)
    return predictions.join(F.broadcast(chosen.select(*keys)), keys, "left_semi")


def worst_entities_series(predictions: DataFrame, n: int = 3) -> DataFrame:
    """All predictions of the n buildings with the highest MAE."""
    worst = metric_mae_by_entity(predictions).orderBy(F.desc("mae"), *entity_keys(predictions)).limit(n)
    return _series_of(predictions, worst)


def top_entities_by_count(predictions: DataFrame, n: int = 3) -> DataFrame:
    """All predictions of the n buildings with most rows."""
    keys = entity_keys(predictions)
    counts = predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return _series_of(predictions, counts.orderBy(F.desc("n"), *keys).limit(n))


def downsample_every_nth(
    df: DataFrame,
    *,
    keys: Sequence[str] | None = None,
    ts: str = "full_timestamp",
    max_points: int = 1000,
    **series_options,
) -> DataFrame:
    """Every k-th row in time order, k = rows // max_points, for series longer than max_points.

    Rows of equal time are ordered by their other columns.
    """
    keys = list(keys or entity_keys(df))
    ties = series_options.pop("ties", [quoted(c) for c in df.columns if c not in (*keys, ts)])
    placed = with_positions(df, keys, ts, ties=ties, **series_options)
    step = F.greatest(F.floor(F.col("series_rows") / max_points), F.lit(1))
    step = F.when(F.col("series_rows") > max_points, step).otherwise(F.lit(1))
    return placed.where(F.col("position") % step == 0).drop("position", "series_rows")
