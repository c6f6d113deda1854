"""Taking in new meter files as they arrive, instead of re-reading all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loadcurve import constants as K
from loadcurve.functions.columns import resolve_column
from loadcurve.plans.unify import standardize_readings


def stream_readings(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    region: str,
    *,
    pattern: str = "*.csv",
    max_files: int = 1000,
) -> DataFrame:
    """Canonical readings from the CSV files of a folder, as a stream.

    Usage and temperature must come scaled: limits over a whole source are not known before its
    last file. All steps are row by row, so there is no state to keep and no late data.
    """
    for candidates in (K.USAGE_NORM, K.TEMPERATURE_NORM):
        if resolve_column(schema.fieldNames(), candidates) is None:
            raise ValueError(f"a stream of readings needs one of {candidates}")
    files = (
        spark.readStream.schema(schema)
        .option("header", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files)
        .csv(folder)
    )
    return standardize_readings(files, region)


def append_readings(readings: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived since the last run to a Parquet table; each file is taken once."""
    return (
        readings.writeStream.format("parquet")
        .outputMode("append")
        .partitionBy("region")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(target)
    )
