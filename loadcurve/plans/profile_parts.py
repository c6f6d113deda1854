"""A profile that grows with its table: one stored part for each append, merged when asked for.

A part has a row for each region, with a sketch of its buildings; or, if `exact`, a row for each region and building, so that the merged
number of buildings is that of the whole table at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadcurve.functions.columns import quoted

#: Two to this power cells a sketch; relative error about 1.04 / sqrt(cells), none in practice below an eighth as many buildings.
LOG_CELLS = 16


def profile_part(
    df: DataFrame, *, ts: str = "full_timestamp", by: str = "region", log_cells: int = LOG_CELLS, exact: bool = False
) -> DataFrame:
    """What can be merged of `profile_dataset`: rows, buildings (by name or as a sketch), and the time range of each region."""
    building, facts = F.col("building_name").cast("string"), [F.min(ts).alias("time_start"), F.max(ts).alias("time_end")]
    keys, n_rows = [F.col(quoted(by)).alias("by_value")], F.count(F.lit(1)).alias("n_rows")
    if exact:
        return df.groupBy(*keys, building.alias("building")).agg(n_rows, *facts)
    return df.groupBy(*keys).agg(n_rows, F.hll_sketch_agg(building, log_cells).alias("buildings"), *facts)


def store_part(rows: DataFrame, path: str, part: str, **options) -> None:
    """Profile appended rows and store the result as `part`; a repeated append replaces its own part only."""
    if not part or any(c in part for c in "/\\=:%*?") or part[0] in "._":
        raise ValueError(f"not a name of a part: {part!r}")
    profiled = profile_part(rows, **options)
    if not options.get("exact"):
        profiled = profiled.coalesce(1)
    profiled.write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def merged_profile(spark: SparkSession, path: str, *, by: str = "region") -> DataFrame:
    """The profile over all stored parts, with the columns of `profile_dataset`; no appended row is read again.

    All parts are exact or none is. Of exact parts buildings are counted by name; else their number is the sketch's estimate, rounded.
    """
    parts = spark.read.parquet(path).withColumnRenamed("by_value", by)
    if "building" in parts.columns:
        buildings = F.count_distinct("building")
    else:
        buildings = F.hll_sketch_estimate(F.hll_union_agg("buildings"))
    return parts.rollup(by).agg(
        F.sum("n_rows").alias("n_rows"),
        buildings.alias("n_buildings"),
        F.min("time_start").alias("time_start"),
        F.max("time_end").alias("time_end"),
    )
