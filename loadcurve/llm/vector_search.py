"""Nearest neighbours by inner product: a navigable small-world graph per shard, answers of all shards merged.

Rows are dealt over shards of about SHARD_ROWS by a hash, whatever their values, so that no cluster or group of copies makes a large
shard; a shard's graph (`hnsw`) is built by one task and stored as one row for each node: its vector, the ids that have just this vector,
and its neighbours in all layers as one flat array. Every query is put to every shard, in blocks of at most QUERY_ROWS:
a task holds one shard, and streams the queries of one block. A shard answers with its best `k`; the best `k` of all shards stay.

What is found is approximate (a graph may miss a neighbour), every score is exact: the inner product of the original vectors in
double precision. Work grows with queries x shards, and per pair with the logarithm of a shard's rows; raise `shard_rows` as far
as memory allows (some 500 bytes a row of 64 components) for tables of very many rows.

Defined results: rows without an id take no part, nor vectors that are null, empty, zero, or hold null or non-finite components; vectors meet
those of their own length alone. Rows alike in id and vector count once. Rows of one id with other vectors are queries and candidates of
their own, but never answer to their own id. Equal vectors are one node, so copies crowd nothing out; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loadcurve.llm import hnsw
from loadcurve.llm.common import release_caches, stored
from loadcurve.operators.sized import join_lookup

K = 20
SHARD_ROWS = 1 << 14
QUERY_ROWS = 1 << 16
#: Nodes that a search keeps in view; of more, more neighbours are found at more cost.
EF = 96


def usable(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """Columns id, vector and dim of the rows that take part, each (id, vector) once."""
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = rows.schema[vector].dataType.elementType
    v = F.col(f"`{vector}`") if isinstance(kind, T.FloatType) else F.col(f"`{vector}`").cast("array<double>")
    rows = rows.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), v.alias("vector"))
    good = rows.where(F.col("id").isNotNull() & F.forall("vector", real) & F.exists("vector", lambda x: x != 0))
    return good.distinct().withColumn("dim", F.size("vector"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Stored graphs of usable rows: dim, shard, shards (of this dim), node, vector, ids (ascending), links (flat; lowest layer first)."""
    vectors = stored(vectors)
    sizes = vectors.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    rows = join_lookup(vectors, sizes, ["dim"]).withColumn("shard", F.pmod(F.xxhash64("id", "vector"), F.col("shards")).cast("int"))
    kind = vectors.schema["vector"].dataType
    schema = T.StructType([
        T.StructField("dim", T.IntegerType()), T.StructField("shard", T.IntegerType()), T.StructField("shards", T.IntegerType()), T.StructField("node", T.IntegerType()),
        T.StructField("vector", kind), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("links", T.ArrayType(T.IntegerType())),
    ])

    def one_shard(part: pa.Table) -> pa.Table:
        release_caches()
        part = part.combine_chunks()
        dim, shard, shards = (part[c][0].as_py() for c in ("dim", "shard", "shards"))
        values = _matrix(part["vector"].chunk(0), dim)
        nodes, group = np.unique(values, axis=0, return_inverse=True)
        graph, order = hnsw.build(nodes)
        node_of = np.empty(len(order), np.int64)
        node_of[order] = np.arange(len(order))
        group, ids = node_of[group.ravel()], part["id"].to_numpy()
        by = np.lexsort((ids, group))
        starts = np.append(np.searchsorted(group[by], np.arange(len(nodes))), len(ids))
        count = len(nodes)
        flat = [np.concatenate([layer[i] for layer in graph.layers if i < len(layer)]) for i in range(len(graph.layers[1]) if len(graph.layers) > 1 else 0)]
        rest = graph.layers[0][len(flat) :]
        lengths = np.array([len(x) for x in flat] + [rest.shape[1]] * len(rest), np.int64)
        links = np.concatenate([*flat, rest.ravel()]).astype(np.int32)
        lists = lambda ends, values: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))
        number = lambda x: pa.array(np.full(count, x, np.int32))
        arrays = [
            number(dim), number(shard), number(shards), pa.array(np.arange(count, dtype=np.int32)), lists(np.arange(count + 1) * dim, nodes[order].ravel()),
            lists(starts, ids[by]), lists(np.append(0, np.cumsum(lengths)), links),
        ]
        return pa.Table.from_arrays(arrays, names=schema.names)

    return stored(rows.groupBy("dim", "shard").applyInArrow(one_shard, schema))


class Shard:
    """A shard's graph, read back from its rows."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], links: np.ndarray, lengths: np.ndarray, k: int):
        self.vectors = vectors
        starts = np.append(0, np.cumsum(lengths))
        layers, at, width = [], 0, hnsw.BASE_WIDTH
        while True:
            count = int((lengths > at).sum())
            if not count:
                break
            layers.append(links[starts[:count, None] + at + np.arange(width)])
            at, width = at + width, hnsw.UPPER_WIDTH
        self.graph = hnsw.Graph(hnsw.lifted(vectors), layers)
        most = min(k + 1, max(map(len, ids)))
        self.ids = np.full((len(ids), most), np.iinfo(np.int64).max)
        for i, x in enumerate(ids):
            self.ids[i, : len(x)] = x[:most]
        self.held = np.minimum([len(x) for x in ids], most)

    def answer(self, own: np.ndarray, queries: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the query, id and score of the up to `k` best of this shard for each query."""
        out = [self._some(own[at:end], queries[at:end], k, ef, at) for at, end in self._slices(queries, ef)]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _slices(self, queries: np.ndarray, ef: int):
        step = max(16, (1 << 22) // (ef * queries.shape[1]))
        return [(at, min(len(queries), at + step)) for at in range(0, len(queries), step)]

    def _some(self, own, queries, k, ef, first):
        exact = queries.astype(np.float64)
        nodes = hnsw.search(self.graph, exact, ef)
        none = nodes < 0
        nodes = np.maximum(nodes, 0)
        score = (self.vectors[nodes].astype(np.float64) * exact[:, None, :]).sum(-1)
        ids = self.ids[nodes]
        gone = none[:, :, None] | (np.arange(ids.shape[2]) >= self.held[nodes][:, :, None]) | (ids == own[:, None, None])
        score = np.where(gone, -np.inf, score[:, :, None]).reshape(len(own), -1)
        ids, gone = ids.reshape(len(own), -1), gone.reshape(len(own), -1)
        order = np.lexsort((ids, -score, gone))[:, :k]
        keep = ~np.take_along_axis(gone, order, 1)
        number = np.broadcast_to(np.arange(len(own))[:, None] + first, keep.shape)[keep]
        return number, np.take_along_axis(ids, order, 1)[keep], np.take_along_axis(score, order, 1)[keep]


def search_index(index: DataFrame, queries: DataFrame, k: int = K, ef: int = EF, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the `k` best that the graphs find for each of the queries (id, vector, dim)."""
    kind = index.schema["vector"].dataType
    queries = stored(queries.select("id", F.col("vector").cast(kind).alias("vector"), "dim"))
    shards = index.groupBy("dim").agg(F.max("shards").alias("shards"))
    blocks = queries.groupBy("dim").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
    none = lambda t: F.lit(None).cast(t)
    nodes = join_lookup(index, blocks, ["dim"]).select(
        "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "node", none("bigint").alias("id"), "vector", "ids", "links"
    )
    asked = join_lookup(join_lookup(queries, shards, ["dim"]), blocks, ["dim"])
    asked = asked.select(
        "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("id", "vector", F.lit(7)), F.col("blocks")).cast("int").alias("block"),
        none("int").alias("node"), "id", "vector", none("array<bigint>").alias("ids"), none("array<int>").alias("links"),
    )
    key = ["dim", "shard", "block"]
    # a shard's nodes come first, in order, then the queries of the block
    dealt = nodes.unionByName(asked).repartition(*key).sortWithinPartitions(*key, F.col("node").asc_nulls_last())

    def run(batches):
        release_caches()
        at, held, shard = None, [], None
        for batch in batches:
            for place, part in _runs(batch):
                if place != at:
                    at, held, shard = place, [], None
                asked_from = part.column("node").null_count
                node_rows = part.num_rows - asked_from
                if node_rows:
                    held.append(part.slice(0, node_rows))
                if asked_from:
                    if shard is None:
                        shard, held = _read(held, at[0], k), []
                    yield _answered(shard, part.slice(node_rows), at[0])

    def _answered(shard, part, dim):
        own, vectors = part.column("id").to_numpy(), _matrix(part.column("vector"), dim)
        number, ids, score = shard.answer(own, vectors, k, ef)
        marks = part.column("mark").to_numpy()
        return pa.RecordBatch.from_arrays([pa.array(own[number]), pa.array(marks[number]), pa.array(ids), pa.array(score)], names=["query_id", "mark", "vec_id", "score"])

    found = dealt.withColumn("mark", F.xxhash64("vector")).mapInArrow(run, "query_id bigint, mark bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def _runs(batch: pa.RecordBatch):
    """The parts of a batch that belong to one (dim, shard, block)."""
    keys = np.stack([batch.column(c).to_numpy() for c in ("dim", "shard", "block")], 1)
    cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield tuple(keys[a].tolist()), batch.slice(a, b - a)


def _read(parts: list[pa.RecordBatch], dim: int, k: int) -> Shard:
    rows = pa.Table.from_batches(parts).combine_chunks()
    vectors, ids, links = (rows[c].chunk(0) for c in ("vector", "ids", "links"))
    lengths = links.value_lengths().to_numpy()
    offsets = ids.offsets.to_numpy()
    values = ids.values.to_numpy()
    return Shard(_matrix(vectors, dim), [values[a:b] for a, b in zip(offsets, offsets[1:], strict=False)], links.flatten().to_numpy(), lengths, k)


def nearest(
    rows: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding", k: int = K, ef: int = EF, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """The `k` nearest rows of each row whose id meets `is_query` (a condition on the column `id`), its own id left out."""
    index = build_index(usable(rows, id_column, vector), shard_rows)
    queries = index.select(F.explode("ids").alias("id"), "vector", "dim").where(is_query)
    return search_index(index, queries, k, ef)
