"""Merkle manifest of a dataset as a persistent tree: each changed leaf is a version that shares all untouched nodes.

Every row is a leaf; leaves of one group (language) ascend by key, and every FANOUT consecutive nodes become one, until a group has
one node, its subroot. Subroots, ordered by group, make the root in the same way. The tree is cut into aligned blocks of
FANOUT ** BLOCK_LEVELS nodes: a block is one row with its nodes in order, its subtree is built within one task, and its root is a
node of the next level's blocks. So a group of any size is spread over tasks, and the levels grow with the logarithm of the rows.

On the way down each block gets the siblings on the path from its root to the top, and makes a version for each of its changed leaves:
only the ancestors within the block are copied, and the version is carried on through the upper levels from the block's root and
those siblings. No version is ever held beyond its block's task; the upper nodes of a version are as many digests as there are levels.

Defined results: a null field is written `-`; a null group comes first; null keys come first, rows of one key are ordered by
their digest; a null key's row is never changed by `lower_case_of_thirds`; an empty table gives no rows. Only the columns named are read.
"""

from __future__ import annotations

import hashlib
import string
from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.llm.common import stored
from loadcurve.operators.sized import join_lookup

FANOUT = 8
BLOCK_LEVELS = 3
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of the fields in order: `-` for null, else the number of bytes, a colon, and the value."""
    parts = []
    for c in fields:
        c = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def lower_case_of_thirds(key: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Which rows are tampered with (3 divides the crc32 of the decimal key), and their text after that."""
    touched = F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 0, F.lit(False))
    return touched, F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)


class Versions:
    """A tree as nodes that never change; a write adds copies of the ancestors of one leaf and returns a new top."""

    def __init__(self, leaves: Sequence[str], levels: int | None = None):
        """So many levels, of which the last may be of one node; by default until one node remains."""
        self.digests, self.children, self.height = list(leaves), [()] * len(leaves), 0
        nodes = list(range(len(leaves)))
        while len(nodes) > 1 if levels is None else self.height < levels:
            nodes = [self._node(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
            self.height += 1
        self.top = nodes[0]

    def _node(self, children: Sequence[int]) -> int:
        self.digests.append(digest("".join([self.digests[c] for c in children])))
        self.children.append(tuple(children))
        return len(self.digests) - 1

    def path(self, at: int) -> list[tuple[int, int]]:
        """(node, place of the next one among its children) from the top to the parent of leaf `at`."""
        node, steps = self.top, []
        for level in range(self.height - 1, -1, -1):
            place = at // FANOUT**level % FANOUT
            steps.append((node, place))
            node = self.children[node][place]
        return steps

    def siblings(self, at: int) -> list[tuple[str, str]]:
        """Digests left and right of the path of leaf `at`, level by level upwards."""
        out = []
        for node, place in reversed(self.path(at)):
            run = [self.digests[c] for c in self.children[node]]
            out.append(("".join(run[:place]), "".join(run[place + 1 :])))
        return out

    def write(self, at: int, changed: str) -> int:
        """The top of the version whose leaf `at` is `changed`."""
        steps = self.path(at)
        self.digests.append(changed)
        self.children.append(())
        node = len(self.digests) - 1
        for parent, place in reversed(steps):
            run = self.children[parent]
            node = self._node([*run[:place], node, *run[place + 1 :]])
        return node


def placed(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """The rows with `at`, their place within their tree in this order, and `n`, the rows of their tree; no tree is in one task.

    Rows are sorted by ranges of (tree, order), ranges are counted, and a row's place is that of its range and its place therein.
    """
    tie = F.xxhash64(F.monotonically_increasing_id()).alias("__tie")
    rows = stored(rows.select("*", tie))
    names = [tree, *order, "__tie"]
    ranged = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("*", F.monotonically_increasing_id().alias("__mark"))
    ranged = stored(ranged.drop("__tie").withColumn("__range", F.expr("__mark >> 33")))
    starts = ranged.groupBy(tree, "__range").agg(F.min("__mark").alias("__first"), F.count("*").alias("__rows"))
    every = Window.partitionBy(tree)
    before = F.sum("__rows").over(every.orderBy("__range")) - F.col("__rows") - F.col("__first")
    starts = starts.select(tree, "__range", before.alias("__shift"), F.sum("__rows").over(every).alias("n"))
    rows = join_lookup(ranged, starts, [tree, "__range"])
    return rows.withColumn("at", F.col("__mark") + F.col("__shift")).drop("__mark", "__range", "__shift")


def _blocks(nodes: DataFrame, extra: Sequence[str]) -> DataFrame:
    """One row for each aligned block of the nodes (tree, n, at, digest and extra columns), with its `top`."""
    items = F.array_sort(F.collect_list(F.struct("at", "digest", *extra))).alias("items")
    rows = nodes.groupBy("tree", "n", F.expr(f"at div {BLOCK}").alias("block")).agg(items)

    def run(batches):
        for batch in batches:
            roots = []
            for n, leaves in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                tree = Versions(leaves.values.field("digest").to_pylist(), None if n <= BLOCK else BLOCK_LEVELS)
                roots.append(tree.digests[tree.top])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], names=[*batch.schema.names, "top"])

    return stored(rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("top", T.StringType())])))


def grow(nodes: DataFrame, extra: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """The levels of blocks over the nodes, lowest first, and the top of each tree (tree, digest)."""
    levels = [_blocks(nodes, extra)]
    while True:
        upper = levels[-1].where(F.col("n") > BLOCK)
        if upper.isEmpty():
            break
        upper = upper.select("tree", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}").alias("n"), F.col("block").alias("at"), F.col("top").alias("digest"))
        levels.append(_blocks(upper, []))
    tops = [level.where(F.col("n") <= BLOCK).select("tree", F.col("top").alias("digest")) for level in levels]
    return levels, stored(reduce(DataFrame.unionAll, tops))


#: Digests left and right of a path from some node to the root, level by level; subroot and root of the whole.
_WAY = "sides array<struct<left: string, right: string>>, subroot string, root string"


def _with_ways(level: DataFrame, tops: DataFrame, inner: DataFrame | None) -> DataFrame:
    """The blocks of a level, each with the way from its root on: from `tops` if it is the top of its tree, else from the level above."""
    single = level.where(F.col("n") <= BLOCK).join(tops.select("tree", "sides", "subroot", "root"), "tree")
    if inner is None:
        return single
    rest = level.where(F.col("n") > BLOCK).join(inner.withColumnRenamed("at", "block"), ["tree", "block"])
    return single.unionByName(rest)


def _ways_of_nodes(blocks: DataFrame) -> DataFrame:
    """(tree, at, digest, sides, subroot, root) of each node of the blocks."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                tree = Versions([x["digest"] for x in r["items"]], None if r["n"] <= BLOCK else BLOCK_LEVELS)
                for i, x in enumerate(r["items"]):
                    sides = [{"left": a, "right": b} for a, b in tree.siblings(i)] + r["sides"]
                    out.append({"tree": r["tree"], "at": x["at"], "digest": x["digest"], "sides": sides, "subroot": r["subroot"], "root": r["root"]})
            yield pa.RecordBatch.from_pylist(out, schema=_WAY_ARROW)

    side = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    _WAY_ARROW = pa.schema([("tree", pa.string()), ("at", pa.int64()), ("digest", pa.string()), ("sides", side), ("subroot", pa.string()), ("root", pa.string())])
    slim = blocks.select("tree", "n", F.transform("items", lambda x: F.struct(x["at"].alias("at"), x["digest"].alias("digest"))).alias("items"), "sides", "subroot", "root")
    return slim.mapInArrow(run, f"tree string, at bigint, digest string, {_WAY}")


def descend(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest blocks, each with the way from its root to the root of the whole."""
    inner = None
    for level in levels[:0:-1]:
        inner = stored(_ways_of_nodes(_with_ways(level, tops, inner)).drop("digest"))
    return _with_ways(levels[0], tops, inner)


def _verdicts(blocks: DataFrame, key: T.StructField) -> DataFrame:
    """A row for each leaf of the blocks: its proof, and the root that its own version folds to."""
    made = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
    kinds = [pa.string()] * len(made) + [pa.bool_(), pa.int32()]

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                rows = list(verdicts(r))
                arrays = [pa.array([x[0] for x in rows], batch.schema.field("items").type.value_type.field("key").type)]
                arrays += [pa.array([x[i + 1] for x in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=[key.name, *made, "verified", "copied"])

    def verdicts(r):
        tree = Versions([x["digest"] for x in r["items"]], None if r["n"] <= BLOCK else BLOCK_LEVELS)
        upper = [(s["left"], s["right"]) for s in r["sides"]]
        rest = "".join([a + b for a, b in upper])
        for i, x in enumerate(r["items"]):
            proof = digest("".join([a + b for a, b in tree.siblings(i)]) + rest)
            before = len(tree.digests)
            folded = tree.digests[tree.top if x["changed"] is None else tree.write(i, x["changed"])]
            copied = len(tree.digests) - before
            for left, right in upper:
                folded = digest(left + folded + right)
            yield x["key"], x["digest"], r["subroot"], r["root"], proof, folded, folded == r["root"], copied

    texts = [T.StructField(c, T.StringType()) for c in made]
    schema = T.StructType([key, *texts, T.StructField("verified", T.BooleanType()), T.StructField("copied", T.IntegerType())])
    return blocks.select("n", "items", "sides", "subroot", "root").mapInArrow(run, schema)


def audit_versions(
    docs: DataFrame, changed: tuple[Column, Column], fields: Sequence[str] = FIELDS, key: str = "doc_id", group: str = "lang", altered: str = "text"
) -> DataFrame:
    """Each row's leaf, subroot, root, digest of its proof, and the root that its version gives.

    `changed` says which rows are altered, and the altered value of the column `altered`. `copied` counts the nodes that the row's
    version has of its own within its block (0: it is the first version).
    """
    touched, value = changed
    plain = [F.col(f"`{c}`") for c in fields]
    rows = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit("")).alias("tree"), F.col(key).alias("key"), leaf(plain).alias("digest"),
        F.when(touched, leaf([value if c == altered else p for c, p in zip(fields, plain, strict=True)])).alias("changed"),
    )
    levels, subroots = grow(placed(rows, "tree", ["key", "digest"]), ["key", "changed"])
    over = placed(subroots.withColumnRenamed("tree", "member").withColumn("tree", F.lit("")), "tree", ["member"])
    upper, top = grow(over, ["member"])
    top = top.select("tree", F.array().cast("array<struct<left: string, right: string>>").alias("sides"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    ways = stored(_ways_of_nodes(descend(upper, top)).drop("tree", "subroot"))
    ways = ways.join(over.select("at", F.col("member").alias("tree")), "at").select("tree", "sides", F.col("digest").alias("subroot"), "root")
    return _verdicts(descend(levels, stored(ways)), T.StructField(key, docs.schema[key].dataType))
