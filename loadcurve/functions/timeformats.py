"""Which format the time column of a file has: told from all of its values, in one aggregate over all files.

A format is possible for a file if it reads every value that any of the formats reads. Possible formats that give the same times
are as one. Where day-first and month-first are both possible and give other times, no value has decided: the caller says which it is
(`day_first`), or it is an error. Values that no format reads are NULL, as elsewhere; a file whose values need several formats is an
error, since reading them one by one would take 03/04 for one day in one row and 04/03 for it in the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadcurve.functions.columns import quoted
from loadcurve.operators.onerow import attach_row
from loadcurve.operators.sized import join_lookup

# Formats that are tried, by name; the order only matters between formats that read the same times.
FORMATS = {
    "iso": None,
    "day_first": "d/M/yyyy[ H:mm[:ss]]",
    "month_first": "M/d/yyyy[ H:mm[:ss]]",
    "day_first_dots": "d.M.yyyy[ H:mm[:ss]]",
    "day_first_dashes": "d-M-yyyy[ H:mm[:ss]]",
    "month_first_dashes": "M-d-yyyy[ H:mm[:ss]]",
    "compact": "ddMMMyyyy[ H:mm[:ss]]",
    "digits": "yyyyMMdd[ HHmm[ss]]",
}
# A year alone would also be read as a time.
_ISO = r"^\s*\d{4}-\d"


class UndecidedFormatError(ValueError):
    """The values of a file allow several readings, or need several formats."""


def read_time(text: Column, name: str) -> Column:
    """The zone-free time that one of FORMATS reads in a text; NULL where it reads none."""
    text = F.trim(text)
    if FORMATS[name] is None:
        return F.when(text.rlike(_ISO), text.try_cast("timestamp_ntz"))
    return F.try_to_timestamp(text, F.lit(FORMATS[name])).cast("timestamp_ntz")


def format_counts(df: DataFrame, column: str, by: Sequence[str], formats: Sequence[str] = tuple(FORMATS)) -> DataFrame:
    """For each group its number of values (`n`), of values that some format reads (`readable`), and of each format the values it
    reads with a sum over their times that tells equal readings from others (`fits`, an array in the order of the formats)."""
    text = F.col(quoted(column)).cast("string")
    times = [read_time(text, f) for f in formats]
    packed = df.where(text.isNotNull()).select(*[F.col(quoted(c)) for c in by], F.array(*times).alias("__times"))
    one = lambda i: F.get("__times", F.lit(i))
    fits = [
        F.struct(
            F.lit(f).alias("format"), F.count(one(i)).alias("n"),
            F.sum(F.when(one(i).isNotNull(), F.xxhash64(one(i)).cast("decimal(38,0)"))).alias("mark"),
        )
        for i, f in enumerate(formats)
    ]
    some = F.exists("__times", lambda t: t.isNotNull())
    return packed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(some).alias("readable"), F.array(*fits).alias("fits"))


def infer_formats(df: DataFrame, column: str, by: Sequence[str], *, day_first: bool | None = None, formats: Sequence[str] = tuple(FORMATS)) -> DataFrame:
    """(by, format) for each group with a readable value; raises UndecidedFormatError where none or several readings are possible."""
    counts = format_counts(df, column, by, formats).where("readable > 0")
    possible = F.filter("fits", lambda x: x["n"] == F.col("readable"))
    counts = counts.withColumn("__possible", possible)
    if day_first is not None:
        kept = F.filter("__possible", lambda x: ~x["format"].startswith("month_first" if day_first else "day_first"))
        counts = counts.withColumn("__possible", F.when(F.size(kept) > 0, kept).otherwise(F.col("__possible")))
    readings = F.size(F.array_distinct(F.transform("__possible", lambda x: x["mark"])))
    judged = counts.select(*by, F.get("__possible", F.lit(0))["format"].alias("format"), readings.alias("__readings"))
    wrong = judged.where("__readings <> 1").limit(3).collect()
    if wrong:
        said = [f"{[r[c] for c in by]}: {'no one format' if not r['__readings'] else 'day or month may come first'}" for r in wrong]
        raise UndecidedFormatError(f"times in {column!r}: " + "; ".join(said))
    return judged.drop("__readings")


def coerce_inferred(df: DataFrame, column: str, by: Sequence[str], **options) -> DataFrame:
    """The frame with `column` as zone-free times, each group read by the format that its own values tell."""
    found = infer_formats(df, column, by, **options).withColumnRenamed("format", "__format")
    if by:
        joined = join_lookup(df, found, list(by), "left", null_safe=True)
    else:
        joined = attach_row(df, found, "__found").withColumn("__format", F.col("__found.__format"))
    text, value = F.col(quoted(column)).cast("string"), F.lit(None).cast("timestamp_ntz")
    for name in FORMATS:
        value = F.when(F.col("__format") == name, read_time(text, name)).otherwise(value)
    return joined.withColumn(column, value).drop("__format").select(*df.columns)
