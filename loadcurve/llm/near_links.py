"""Links of the n-gram Jaccard join: how many other documents each one links with, and the links between different texts.

`near_join` gives components. All links lie within one, so the sets of each component (one document of each set is read
again) are compared exactly by lists of the sets that hold a shingle. A component too large for one task is cut into blocks by a hash
of the set, and every two blocks meet in a task of their own; a pair of sets of one block is compared where the block meets itself.
Copies are not compared: a set counts as often as it has documents.

The work of a component grows with the square of its different sets, as the number of its links may.

Defined cases are those of `near_join`: null and empty texts have no links, copies and repeated rows link with each other, and other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadcurve.llm import near_join
from loadcurve.llm.common import stored, without
from loadcurve.llm.near_join import linked

#: Shingles of a block of a component.
BLOCK = 500_000


def near_of_each(sets: list[np.ndarray], part: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each set the places of the sets that it links with, within its `part`; with two blocks only those of the other."""
    for p in np.unique(part):
        members = np.flatnonzero(part == p)
        size = np.array([len(sets[m]) for m in members])
        elements = np.concatenate([sets[m] for m in members])
        holders = np.repeat(np.arange(len(members)), size)
        order = np.argsort(elements, kind="stable")
        elements, holders = elements[order], holders[order]
        two = len(np.unique(block[members])) > 1
        for i, m in enumerate(members):
            lo, hi = np.searchsorted(elements, sets[m], "left"), np.searchsorted(elements, sets[m], "right")
            n = hi - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(holders[at], minlength=len(members))
            near = linked(shared, size[i], size) & (shared > 0)
            near[i] = False
            if two:
                near &= block[members] != block[m]
            yield int(m), members[near]


def _met(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[int, np.ndarray]]]:
    pdf = pdf.drop_duplicates("a").sort_values("a")
    blocks = pdf["block"].to_numpy()
    crossing = pdf["crossing"].to_numpy(bool)
    if crossing.any() and len(np.unique(blocks)) < 2:  # the other block holds no set
        return pdf["a"].to_numpy(), pdf["copies"].to_numpy(), iter(())
    sets = [np.frombuffer(b, np.uint64) for b in pdf["shingles"]]
    own = blocks if crossing.any() else np.zeros(len(pdf), np.int64)
    return pdf["a"].to_numpy(), pdf["copies"].to_numpy(), near_of_each(sets, pdf["root"].to_numpy(), own)


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    names, copies, found = _met(pdf)
    rows = [(names[i], copies[near].sum()) for i, near in found if len(near)]
    return pd.DataFrame(rows, columns=["set", "links"]).astype("int64")


def _pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    names, _, found = _met(pdf)
    pairs = [np.stack([np.full(len(near), names[i]), names[near]], axis=1)[names[near] > names[i]] for i, near in found]
    return pd.DataFrame(np.concatenate([np.empty((0, 2), np.int64), *pairs]), columns=["a", "b"])


def _dealt(named: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Documents (doc_id, key, n, set), sets (set, root, doc_id, copies), and the sets of components with their texts by task."""
    members, roots = near_join.similar_sets(named)
    members = stored(members)
    own = members.where("n > 0").groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.max("n").alias("n"), F.count("*").alias("copies")
    )
    sets = stored(own.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set")))
    components = sets.groupBy("root").agg(F.count("*").alias("sets"), F.sum("n").alias("total")).where("sets > 1")
    components = stored(components.withColumn("blocks", F.ceil(F.col("total") / F.lit(BLOCK))))
    total = components.agg(F.sum("total")).first()[0]
    if total is None:
        return members, sets, None
    placed = sets.join(components.select("root", "blocks"), "root").select(F.col("set").alias("a"), "root", "copies", "blocks", "key")
    texts = named.withColumn("key", F.col("key").cast("bigint")).join(placed.select("key").distinct(), "key", "left_semi").select("text")
    whole = texts.mapInArrow(near_join._sets, "a bigint, shingles binary").join(placed.drop("key"), "a")
    bundles = max(1, int(total) // BLOCK)
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))
    meets = F.when(F.col("blocks") == 1, F.concat(F.lit("s"), F.pmod(F.xxhash64("root"), F.lit(bundles)).cast("string"))).otherwise(
        F.concat_ws("-", F.col("root").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
    )
    dealt = whole.withColumn("block", F.pmod(F.xxhash64("a"), "blocks")).withColumn("other", other).withColumn("meets", meets)
    return members, sets, dealt.withColumn("crossing", F.col("block") != F.col("other")).select("meets", "root", "a", "copies", "block", "crossing", "shingles")


def _named(docs: DataFrame) -> DataFrame:
    return without(docs, ["key"]).withColumn("key", F.xxhash64("doc_id", "text")).select("doc_id", "key", "text")


def link_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id as `near_duplicates` gives them, and n_links: other documents that it links with, copies included."""
    members, sets, dealt = _dealt(_named(docs))
    smallest = sets.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_set = sets.join(smallest, "root").select("set", "component_id", "copies")
    if dealt is not None:
        counted = dealt.groupBy("meets").applyInPandas(_count, "set bigint, links bigint")
        of_set = of_set.join(counted.groupBy("set").agg(F.sum("links").alias("links")), "set", "left")
    else:
        of_set = of_set.withColumn("links", F.lit(None).cast("bigint"))
    has = F.col("n") > 0
    n_links = F.when(has, F.coalesce("links", F.lit(0).cast("bigint")) + F.col("copies") - 1).otherwise(F.lit(0).cast("bigint"))
    component = F.when(has, F.col("component_id")).otherwise(F.col("doc_id"))
    return members.join(of_set, "set", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), n_links.alias("n_links"))


def links(docs: DataFrame) -> DataFrame:
    """Links between different sets, each once: (doc_a, doc_b), the smallest doc_id of either set, doc_a the smaller."""
    _, sets, dealt = _dealt(_named(docs))
    if dealt is None:
        return docs.sparkSession.createDataFrame([], "doc_a bigint, doc_b bigint")
    pairs = dealt.groupBy("meets").applyInPandas(_pairs, "a bigint, b bigint")
    for side in ("a", "b"):
        pairs = pairs.join(sets.select(F.col("set").alias(side), F.col("doc_id").alias(f"doc_{side}")), side)
    return pairs.select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b"))
