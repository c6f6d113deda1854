"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are stored once and numbered; blocks of consecutive numbers are the source partitions. The matrix says how
many rows of each block go to each shard. Its rows follow the multivariate hypergeometric law given the block
sizes and the shard sizes, as a uniform shuffle of all rows would make them. Each block permutes its rows and
deals them out by its counts; after the exchange each shard permutes again, by random keys in ranges, so that no
task sorts a whole shard.

The matrix is drawn in two steps: groups of blocks on the driver, then the blocks of each group in a task, so
neither sees more than its part. Shard sizes are at most one row apart.

Defined cases: nulls, empty texts, repeated rows and equal texts are rows like any other; an empty table gives
no rows; result columns replace input columns of the same name. The result follows from the seed and the layout
of the stored rows, and stays the same when tasks run again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loadcurve.llm.common import stored, without

SHARDS = 16
#: Rows of a source block: 2 to this power at the most.
BLOCK_BITS = 12
#: Blocks whose counts one task draws, on average.
BLOCKS_A_GROUP = 1024
#: Rows of a range in the second permutation, on average.
RANGE_ROWS = 4096
SEED = 20


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """Number of good ones among `drawn`. Beyond the generator's limit the law is inverted around its mode."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, drawn))
    total = good + bad
    low, high = max(0, drawn - bad), min(drawn, good)
    mode = int((drawn + 1) * (good + 1) / (total + 2))
    wide = int(12 * np.sqrt(max(1.0, drawn * (good / total) * (bad / total) * (total - drawn) / max(1, total - 1)))) + 10
    k = np.arange(max(low, mode - wide), min(high, mode + wide) + 1, dtype=float)
    steps = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[1:]) - np.log(bad - drawn + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    p = np.cumsum(p / p.sum())
    return int(k[min(len(k) - 1, np.searchsorted(p, rng.random()))])


def draw_matrix(rng: np.random.Generator, sizes: list[int], capacities: list[int]) -> np.ndarray:
    """Counts with these row sums (sizes) and column sums (capacities), drawn one row after the other."""
    left = [int(c) for c in capacities]
    out = np.zeros((len(sizes), len(left)), np.int64)
    for i, size in enumerate(sizes):
        need, others = int(size), sum(left)
        for j, c in enumerate(left):
            others -= c
            out[i, j] = hypergeometric(rng, c, others, need) if need else 0
            need -= int(out[i, j])
        left = [c - int(d) for c, d in zip(left, out[i], strict=True)]
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def _random(seed: int, what: str) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(what), F.col("__row"))


def matrix(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """For each row (__block, __n) the array `__upto`: rows of the block for the shards up to each, running sums."""
    n_blocks = blocks.count()
    groups = max(1, -(-n_blocks // BLOCKS_A_GROUP))
    dealt = blocks.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "__block"), F.lit(groups)))
    sizes = {r["__group"]: r["n"] for r in dealt.groupBy("__group").agg(F.sum("__n").alias("n")).collect()}
    order = sorted(sizes)
    counts = draw_matrix(np.random.default_rng(seed), [sizes[g] for g in order], shard_sizes(sum(sizes.values()), shards))
    of_group = blocks.sparkSession.createDataFrame(
        [(g, [int(x) for x in c]) for g, c in zip(order, counts, strict=True)], "__group bigint, __share array<bigint>"
    )

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__block")
        rng = np.random.default_rng([seed, int(key[0]) + 1])
        made = draw_matrix(rng, pdf["__n"].tolist(), list(pdf["__share"].iloc[0]))
        return pd.DataFrame({"__block": pdf["__block"].to_numpy(), "__upto": list(np.cumsum(made, axis=1))})

    return dealt.join(of_group, "__group").groupBy("__group").applyInPandas(draw, "__block bigint, __upto array<bigint>")


def uniform_shuffle(df: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add `shard` and `slot`, the place in the shard from 0 without gaps, as a uniform shuffle of all rows."""
    kept = without(df, ["shard", "slot"])
    rows = stored(kept.withColumn("__row", F.monotonically_increasing_id())).withColumn("__block", F.shiftright("__row", BLOCK_BITS))
    blocks = stored(rows.groupBy("__block").agg(F.count("*").alias("__n")))
    total = blocks.agg(F.sum("__n")).first()[0] or 0
    if not total:
        return kept.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("bigint")}).where(F.lit(False))
    counts = stored(matrix(blocks, shards, seed))  # drawn once for all that follows
    local = F.row_number().over(Window.partitionBy("__block").orderBy(_random(seed, "deal"), "__row")) - 1
    dealt = (
        rows.withColumn("__place", local)
        .join(counts, "__block")
        .withColumn("shard", F.size(F.filter("__upto", lambda u: u <= F.col("__place"))))
        .drop("__upto", "__place", "__block")
    )
    # The second permutation orders a shard by random keys. Its ranges are equal parts of the keys.
    ranges = max(1, total // shards // RANGE_ROWS)
    key = F.shiftrightunsigned(_random(seed, "place"), 1)
    dealt = dealt.withColumn("__key", key).withColumn("__range", F.floor(F.col("__key") / (2.0**63) * ranges))
    placed = stored(dealt)
    before = Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "__range").agg(F.count("*").alias("__n")).select("shard", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("shard", "__range").orderBy("__key", "__row")) - 1
    return placed.withColumn("__inside", inside).join(starts, ["shard", "__range"]).select(*kept.columns, "shard", (F.col("__before") + F.col("__inside")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document; texts themselves are not moved."""
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    placed = uniform_shuffle(narrow, shards, seed)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
