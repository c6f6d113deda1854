"""Reading meter and weather files. CSV is read as text columns; types come from `coerce`."""

from __future__ import annotations

import csv
from collections import defaultdict
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.columns import quoted
from loadcurve.operators.sized import join_lookup
from loadcurve.session import cut_lineage
from loadcurve.sources.heads import files_of, first_lines

PREAMBLE_FALLBACK_ROW = 3


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm_path)
    return bool(found)


def scan_source(
    spark: SparkSession, path: str, region: str | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """One source by suffix: Parquet, else CSV with header. A missing path gives an empty frame."""
    if not path_exists(spark, path):
        df = spark.createDataFrame([], schema or T.StructType([]))
    elif path.rstrip("/").lower().endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        reader = spark.read.option("header", True)
        df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    return df if region is None else df.withColumn("region", F.lit(region))


def scan_column_pruned(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a source, those that exist; only they are read from Parquet."""
    df = scan_source(spark, path)
    return df.select([F.col(quoted(c)) for c in columns if c in df.columns])


def _lines(spark: SparkSession, pattern: str | list[str]) -> DataFrame:
    """Non-blank lines with file, block start and an id that rises within a block."""
    return (
        spark.read.text(pattern)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block_start"),
        )
        .where(F.length(F.trim("value")) > 0)
        .withColumn("line_id", F.monotonically_increasing_id())
    )


def _split_header(line: str) -> list[str]:
    return next(csv.reader([line.lstrip("﻿")]))


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _files_by_header(spark: SparkSession, pattern: str) -> dict[tuple[str, ...], list[str]]:
    """Names of the columns -> addresses of files; one row per file on the driver, which holds the list of paths for any scan."""
    files = files_of(spark, pattern)
    heads = first_lines(spark, files)
    found = None if heads is None else {r["file"]: r["value"] for r in heads.where("line = 0").toLocalIterator()}
    if found is None or any(f not in found for f in files):  # also an empty file, or a header of over a block
        missing = [f for f in files if f not in (found or {})]
        scanned = _lines(spark, [unquote(f) for f in missing]).where(F.col("block_start") == 0)
        headers = scanned.groupBy("file").agg(F.min_by("value", "line_id").alias("header"))
        found = (found or {}) | {r["file"]: r["header"] for r in headers.toLocalIterator()}
    out: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for file, header in found.items():
        out[tuple(_split_header(header))].append(unquote(file))
    return dict(out)


def scan_multi_file(
    spark: SparkSession,
    pattern: str,
    *,
    required: Sequence[str] = (),
    same_layout: bool = False,
    source_column: str = "source_file",
) -> Iterator[DataFrame]:
    """The files of a glob as text frames, one frame per distinct header.

    Headers come from the first block of each file (see `heads`); where the store does not allow that, or a header is longer
    than a block, from a pass over the text. Empty files have no header and fall out; files lacking a `required` column
    (case-blind) are skipped. `same_layout=True` promises that all files have one header and saves the header pass.
    """
    if not path_exists(spark, pattern):
        return
    if same_layout:
        groups = {tuple(spark.read.option("header", True).csv(pattern).columns): [pattern]}
    else:
        groups = _files_by_header(spark, pattern)
    for names, paths in sorted(groups.items()):
        lower = {n.strip().lower() for n in names}
        if not set(required) <= lower:
            continue
        yield (
            spark.read.schema(_text_schema(names))
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .csv(sorted(paths))
            .withColumn(source_column, F.col("_metadata.file_path"))
        )


def scan_weather_skip_preamble(
    spark: SparkSession, pattern: str, *, header_cell: str = "time"
) -> Iterator[DataFrame]:
    """Weather CSV files with lines before the header, as text frames, one per distinct header.

    The header is the first line of a file's first block that has a cell equal to `header_cell`
    (case-blind), however many lines stand before it; without one it is the fourth line, and
    `prepare_weather` raises if that names no weather columns. One small row per file, size-checked, is
    joined to the lines, so lines are not shuffled; only the distinct headers reach the driver.

    The first block is read by itself (see `heads`) and the data once: the lines up to the header are left out by their text, with
    repeats of them in the first block. Where such a line could be one of data, having as many cells as the header, or the first block
    cannot be read alone, lines are numbered in a pass of its own and left out by their number.
    """
    files = files_of(spark, pattern) if path_exists(spark, pattern) else []
    heads = _weather_heads(spark, files, header_cell) if files else None
    lines = _lines(spark, pattern)
    if heads is not None:
        layouts = [r["header"] for r in heads.select("header").distinct().collect()]
        joined = join_lookup(lines.withColumn("file", _address("file")), heads, ["file"])
        data = joined.where((F.col("block_start") > 0) | ~F.array_contains("before", F.col("value")))
        yield from _weather_frames(data, layouts)
        return
    cells = F.transform(F.split(F.lower("value"), ","), lambda c: F.trim(F.translate(c, '"', "")))
    leading = lines.where(F.col("block_start") == 0)
    named = F.when(F.array_contains(cells, header_cell), F.struct("line_id", "value"))
    starts = cut_lineage(
        leading.groupBy("file").agg(F.min("line_id").alias("first_id"), F.min(named).alias("named"))
    )
    found = starts.where("named is not null").select("file", "named.*").toDF("file", "header_id", "header")
    unnamed = starts.where("named is null").select("file", (F.col("first_id") + PREAMBLE_FALLBACK_ROW).alias("line_id"))
    if unnamed.limit(1).count():
        fourth = join_lookup(leading, unnamed, ["file", "line_id"]).select("file", "line_id", "value")
        found = found.unionAll(fourth)
    headers = cut_lineage(found)
    layouts = [r["header"] for r in headers.select("header").distinct().collect()]
    joined = join_lookup(lines, headers, ["file"])
    data = joined.where((F.col("block_start") > 0) | (F.col("line_id") > F.col("header_id")))
    yield from _weather_frames(data, layouts)


def _address(file: str) -> Column:
    """An address with one slash after its scheme, of which file systems write one to three."""
    return F.regexp_replace(file, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def _weather_heads(spark: SparkSession, files: list[str], header_cell: str) -> DataFrame | None:
    """file, header, and the lines up to the header (`before`); None where lines must be numbered instead."""
    head = first_lines(spark, files)
    if head is None:
        return None
    cells = F.transform(F.split(F.lower("value"), ","), lambda c: F.trim(F.translate(c, '"', "")))
    named = F.when(F.array_contains(cells, header_cell), F.col("line"))
    all_lines = F.array_sort(F.collect_list(F.struct("line", "value"))).alias("lines")
    found = head.groupBy("file").agg(F.coalesce(F.min(named), F.lit(PREAMBLE_FALLBACK_ROW)).alias("at"), all_lines)
    text = F.transform("lines", lambda x: x["value"])
    found = found.select("file", F.get(text, F.col("at")).alias("header"), F.slice(text, F.lit(1), F.col("at") + 1).alias("before"))
    found = cut_lineage(found.where("header is not null").withColumn("file", _address("file")))
    width = lambda c: F.size(F.split(c, ","))
    unsure = F.exists(F.slice("before", F.lit(1), F.size("before") - 1), lambda x: width(x) == width("header"))
    known = found.agg(F.count(F.lit(1)).alias("n"), F.max(unsure).alias("unsure")).first()
    return found if known["n"] == len(files) and not known["unsure"] else None


def _weather_frames(data: DataFrame, layouts: list[str]) -> Iterator[DataFrame]:
    for header in sorted(layouts):
        names = [n.strip().lower() for n in _split_header(header)]
        ddl = ", ".join(f"{quoted(n)} STRING" for n in names)
        rows = data if len(layouts) == 1 else data.where(F.col("header") == header)
        yield rows.select(F.from_csv("value", ddl).alias("r")).select("r.*")
