"""A feature table that grows by new hours: each append reads the last day of each building, and no earlier features.

Below the table's path lie `features/append=<k>` (the rows that append k made), and, for the newest k, what the next one needs:
`tail` (the last 25 readings of each building), `limits` (usage limits by building) and `regions`. The tail is written last and is what
makes an append count: one that broke off is made again under the same number.

Scaling follows the hours that a building first came with, so later hours do not reach earlier features: n appends give the rows of
one `build_features` run that is fitted on these hours. The newest reading of a building has no target yet; its features come with the
next append. Readings at or before a building's newest stored one are late and left out; a building has one reading an hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.functions.columns import entity_keys
from loadcurve.operators.normalize import entity_limits, scale_by_limits
from loadcurve.operators.sized import join_lookup
from loadcurve.plans.features import add_lags, finished_features, typed_readings
from loadcurve.session import cut_lineage

#: The newest reading of a building, and what its lags and rolling mean reach back to.
TAIL_ROWS = K.ROLLING_ROWS + 1
_COLUMNS = [
    "building_name", "full_timestamp", "region", "usage_kwh_norm", "apparent_temperature_norm", "precipitation", "is_day", "is_holiday", "is_weekend",
]


def _last_append(spark: SparkSession, path: str) -> int:
    """Number of the last append that counts; -1 before the first."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tail/append=*/_SUCCESS")
    found = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jvm_path) or []
    return max((int(s.getPath().getParent().getName().split("=")[1]) for s in found), default=-1)


def _regions(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    """(region, region_id): those known keep their number, new labels follow in their order. A few rows."""
    labels = rows.select("region").distinct()
    if known is None:
        known = rows.sparkSession.createDataFrame([], "region string, region_id int")
    new = labels.join(F.broadcast(known), "region", "left_anti")
    first = known.agg(F.coalesce(F.max("region_id") + 1, F.lit(0))).first()[0]
    numbered = new.agg(F.array_sort(F.collect_set("region")).alias("l")).select(F.posexplode("l").alias("i", "region"))
    return known.select("region", "region_id").unionAll(numbered.select("region", (F.col("i") + first).cast("int").alias("region_id")))


def append_features(readings: DataFrame, path: str, *, hemisphere: str = "south") -> int:
    """Add the features of further readings to the table at `path`, which the first call makes; the number of the append."""
    spark = readings.sparkSession
    before = _last_append(spark, path)
    number = before + 1

    def stored(name: str) -> DataFrame | None:
        return spark.read.parquet(f"{path}/{name}/append={before}") if before >= 0 else None

    def store(name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{path}/{name}/append={number}")
        return spark.read.parquet(f"{path}/{name}/append={number}")

    typed = typed_readings(readings)
    typed = typed.withColumns({c: F.lit(None).cast("double") for c in _COLUMNS if c not in typed.columns}).select(*_COLUMNS)
    keys, tail, limits = entity_keys(typed), stored("tail"), stored("limits")
    if tail is not None:
        newest = tail.where("back = 1").select(*keys, F.col("full_timestamp").alias("__newest"))
        typed = join_lookup(typed, newest, keys, "left").where(F.col("__newest").isNull() | (F.col("full_timestamp") > F.col("__newest"))).drop("__newest")
    arrived = cut_lineage(typed)
    touched = cut_lineage(arrived.select(*keys).distinct())

    regions = store("regions", _regions(arrived, stored("regions")))
    fresh = entity_limits(arrived, "usage_kwh_norm", keys)
    if limits is not None:
        fresh = limits.unionByName(fresh.join(limits.select(*keys), keys, "left_anti"))
    limits = store("limits", fresh)

    rows = arrived.withColumn("back", F.lit(None).cast("int"))
    if tail is not None:
        rows = join_lookup(tail, touched, keys).select(*rows.columns).unionByName(rows)
    rows = cut_lineage(rows)
    scaled = scale_by_limits(rows, limits, "usage_kwh_norm", "usage_pb", keys).withColumnRenamed("usage_kwh_norm", "usage_kwh_norm_orig")
    lagged = add_lags(scaled, keys, unique_hours=True).where(F.col("back").isNull() | (F.col("back") == 1)).drop("back")
    store("features", finished_features(lagged, regions, hemisphere))

    newest_first = Window.partitionBy(*keys).orderBy(F.desc("full_timestamp"))
    kept = rows.withColumn("back", F.row_number().over(newest_first)).where(F.col("back") <= TAIL_ROWS)
    if tail is not None:
        kept = kept.unionByName(tail.join(touched, keys, "left_anti").select(*kept.columns))
    store("tail", kept)
    return number


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """All features of the table, without those of an append that broke off."""
    return spark.read.parquet(f"{path}/features").where(F.col("append") <= _last_append(spark, path)).drop("append")
