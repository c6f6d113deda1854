"""Merkle fixity audit of WARC records held in two replicas.

Each record has a digest; records of one range of offsets are hashed in order into the digest of the range, and
ranges into wider ranges, up to the root of the file. The audit compares roots, and goes down only from ranges
that differ to the ranges and at last the records below them. Files that agree cost one comparison each.

A replica is a frame of records: file, offset, length, digest. Offsets come from the index of the archive, so
a record that one replica lacks leaves the other records in their ranges.

Records of one place are summed up before they meet (their digests in order, with counts), a lowest range has
few offsets, and each wider range has at most FANOUT children, so no task holds a whole file.

Defined cases: null file, offset, length or digest are values of their own (the empty text, -1, -1, the empty
text); repeated records count, so a record stored twice in one replica differs from one stored once; an
empty replica makes every record of the other missing or extra; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.llm.common import stored

#: Bytes of offsets in a lowest range: 2 to this power. Each wider range is FANOUT of the one below: 2 to this power.
LEAF_BITS = 16
FANOUT_BITS = 6
#: Levels of ranges above the lowest; the root holds offsets below 2 ** (16 + 6 * 4).
LEVELS = 4
#: Records of one volume of the archive that `warc_records` lays out.
VOLUME_RECORDS = 1000


def header(url: Column, page: Column, body: Column) -> Column:
    """The header of a WARC response record."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )


def record(url: Column, page: Column, body: Column) -> Column:
    body = F.coalesce(body, F.lit(""))
    return F.concat(header(url, page, body), body, F.lit("\r\n\r\n"))


def warc_records(pages: DataFrame, replicas: dict[str, Column]) -> DataFrame:
    """Lay pages out as volumes of WARC records: file, offset, length, page_id, and a digest for each replica.

    `replicas` has the body of each replica as a column of `pages`; null is a record that the replica has lost.
    The first one's length counts, as the index was written from it. A volume has about VOLUME_RECORDS page
    ids; repeated pages of one id go on to further parts of their volume, so that no volume is long.
    """
    first = next(iter(replicas))
    text = {name: record(F.col("url"), F.col("page_id"), body) for name, body in replicas.items()}
    digests = [F.when(body.isNotNull(), F.sha2(text[name], 256)).alias(f"digest_{name}") for name, body in replicas.items()]
    narrow = pages.select("page_id", F.octet_length(text[first]).cast("bigint").alias("length"), *digests)
    narrow = narrow.withColumn("volume", F.coalesce(F.floor(F.col("page_id") / VOLUME_RECORDS), F.lit(-1)))
    # Equal records are laid one after the other: first how many there are, then where each begins.
    same = ["volume", "page_id", "length", *[f"digest_{n}" for n in replicas]]
    counted = stored(narrow.groupBy(*same).agg(F.count("*").alias("copies")))
    wide = counted.groupBy("volume").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("page_id", *[f"digest_{n}" for n in replicas]), F.greatest(F.lit(1), F.ceil(F.col("n") / (4 * VOLUME_RECORDS))))
    placed = counted.join(wide, "volume").withColumn("file", F.concat_ws("-", F.lit("pages"), F.col("volume").cast("string"), part.cast("string")))
    order = [F.col("page_id").asc_nulls_first(), *[F.col(f"digest_{n}").asc_nulls_first() for n in replicas]]
    before = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") * F.col("copies")).over(before), F.lit(0)).cast("bigint")
    return placed.select("file", offset.alias("offset"), "length", "page_id", "copies", *[f"digest_{n}" for n in replicas])


def leaves(records: DataFrame) -> DataFrame:
    """One row for each place of a replica: its digest covers offset, lengths, digests and counts of what lies there."""
    filled = records.select(
        F.coalesce(F.col("file"), F.lit("")).alias("file"), F.coalesce(F.col("offset"), F.lit(-1)).cast("bigint").alias("offset"),
        F.coalesce(F.col("length"), F.lit(-1)).cast("bigint").alias("length"), F.coalesce(F.col("digest"), F.lit("")).alias("digest"),
    )
    counted = filled.groupBy("file", "offset", "length", "digest").agg(F.count("*").alias("n"))
    # A sum of hashes does not ask for the records of a place together; several at one place are rare, and all may be.
    one = F.sha2(F.concat_ws("|", "offset", "length", "digest", "n"), 256)
    lanes = [F.sum(F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")).alias(f"s{k}") for k in range(4)]
    summed = counted.select("file", "offset", "length", "digest", "n").groupBy("file", "offset").agg(*lanes, F.max("digest").alias("digest"), F.sum("n").alias("n_records"))
    leaf = F.sha2(F.concat_ws("|", "offset", "n_records", *[F.col(f"s{k}").cast("string") for k in range(4)]), 256)
    return summed.select("file", "offset", "digest", "n_records", leaf.alias("node"))


def wider(nodes: DataFrame, place: str, bits: int) -> DataFrame:
    """The level above: nodes of one range hashed in order of their place."""
    children = F.array_sort(F.collect_list(F.struct(F.col(place), F.col("node"))))
    joined = F.concat_ws(";", F.transform(children, lambda c: F.concat_ws(":", c[place].cast("string"), c["node"])))
    return nodes.withColumn("__range", F.shiftright(place, bits)).groupBy("file", "__range").agg(F.sha2(joined, 256).alias("node")).withColumnRenamed("__range", "range")


def tree(records: DataFrame) -> list[DataFrame]:
    """Levels from the root down: roots (file, node), wider to lowest ranges (file, range, node), then leaves."""
    low = stored(leaves(records))
    levels = [low, stored(wider(low, "offset", LEAF_BITS))]
    for _ in range(LEVELS):
        levels.append(stored(wider(levels[-1], "range", FANOUT_BITS)))
    return levels[::-1]


def _differing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    a, b = left.select(*keys, F.col("node").alias("a")), right.select(*keys, F.col("node").alias("b"))
    return a.join(b, keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys)


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Places where the replicas differ: file, offset, kind (changed, missing in the right, extra in the right),
    left_digest, right_digest, n_left, n_right."""
    a, b = tree(left), tree(right)
    found = stored(_differing(a[0], b[0], ["file", "range"]))
    for level in range(1, len(a)):
        last = level == len(a) - 1
        place, bits = ("offset", LEAF_BITS) if last else ("range", FANOUT_BITS)
        above = found.withColumnRenamed("range", "__above")
        sides = []
        for nodes in (a[level], b[level]):
            below = nodes.withColumn("__above", F.shiftright(place, bits))
            sides.append(below.join(above, ["file", "__above"], "left_semi").drop("__above"))
        if last:
            break
        found = stored(_differing(*sides, ["file", "range"]))
    x = sides[0].select("file", "offset", F.col("node").alias("__a"), F.col("digest").alias("left_digest"), F.col("n_records").alias("n_left"))
    y = sides[1].select("file", "offset", F.col("node").alias("__b"), F.col("digest").alias("right_digest"), F.col("n_records").alias("n_right"))
    kind = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "extra").otherwise("changed")
    differ = x.join(y, ["file", "offset"], "full_outer").where(~F.col("__a").eqNullSafe(F.col("__b")))
    return differ.select(
        "file", "offset", kind.alias("kind"), "left_digest", "right_digest",
        F.coalesce("n_left", F.lit(0)).alias("n_left"), F.coalesce("n_right", F.lit(0)).alias("n_right"),
    )


def replica(records: DataFrame, name: str) -> DataFrame:
    """The records that one replica of `warc_records` holds."""
    held = records.where(F.col(f"digest_{name}").isNotNull())
    return held.select("file", "offset", F.col("length"), F.concat_ws("x", f"digest_{name}", "copies").alias("digest"))
