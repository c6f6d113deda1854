"""Tables stored by building: joins and series windows of them need no shuffle.

A bucketed table has the rows of a building in one file of its bucket, in order of time. Two tables with the same keys and number of
buckets are joined bucket by bucket, also on further columns, and windows over a building's series run within a bucket. The layout is kept
beside the files, so a table can be opened by its path in another session, whatever its catalog knows.

A bucket holds whole buildings: choose as many buckets as make a task of each. A building of a large share of all rows stays in one
task here; store such tables with `sink_parquet`, whose readers cut long series.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.columns import quoted

KEYS = ("region", "building_name")
_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def sink_bucketed(df: DataFrame, path: str, buckets: int, *, keys: Sequence[str] = KEYS, order: Sequence[str] = ("full_timestamp",)) -> DataFrame:
    """Write the rows in `buckets` files by a hash of the keys, sorted by keys and `order`, and open the table."""
    keys, order = list(keys), list(order)
    name = _name()
    # the shuffle deals rows as buckets do, so that each task writes the one file of its bucket
    dealt = df.repartition(buckets, *[F.col(quoted(k)) for k in keys])
    dealt.write.mode("overwrite").format("parquet").option("path", f"{path}/rows").bucketBy(buckets, keys).sortBy([*keys, *order]).saveAsTable(name)
    layout = json.dumps({"schema": df.schema.jsonValue(), "buckets": buckets, "keys": keys, "order": order})
    df.sparkSession.createDataFrame([(layout,)], "layout string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")
    return df.sparkSession.table(name)


def open_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """The table that `sink_bucketed` wrote at this path, in its buckets."""
    layout = json.loads(spark.read.text(f"{path}/layout").first()[0])
    schema = T.StructType.fromJson(layout["schema"])
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
    keys, order = (", ".join(map(quoted, layout[c])) for c in ("keys", "order"))
    name = _name()
    place = f"{path}/rows".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}, {order}) INTO {layout['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(name)


def _name() -> str:
    return f"bucketed_{uuid.uuid4().hex}"


@contextmanager
def joined_by_bucket(spark: SparkSession) -> Iterator[None]:
    """Within: a join on the bucket keys and further columns takes the buckets as they are, where Spark would deal the rows anew by all columns."""
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)
