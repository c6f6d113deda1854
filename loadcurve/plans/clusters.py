"""k-means from several starts at once: every pass over the rows serves all starts.

A pass is one scan whose tasks keep sums for each (start, cluster), or one candidate for each start; these few rows are
merged by an aggregate, and only starts x k centres reach the driver. Rows are named by a hash of their keys, so the
first centres do not depend on the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loadcurve.functions.columns import quoted
from loadcurve.session import cut_lineage, let_workers_import

# Fixed values of the splitmix64 generator.
_STEP, _MIX_1, _MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _uniform(names: np.ndarray, salt: int) -> np.ndarray:
    """A number in (0, 1) from the name of each row and a salt."""
    z = names.view(np.uint64) + np.uint64((salt + 1) * _STEP % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(_MIX_1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(_MIX_2)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53 + 2.0**-54


def _points(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each centre of each start: (rows, starts, k)."""
    starts, k, width = centres.shape
    out = np.empty((len(x), starts, k))
    for s in range(starts):
        for c in range(k):
            away = x - centres[s, c]
            out[:, s, c] = np.einsum("ij,ij->i", away, away)
    return out


def _next_centres(rows: DataFrame, centres: np.ndarray | None, starts: int, width: int, salt: int) -> np.ndarray:
    """One more centre for each start, drawn with odds in proportion to the squared distance to its nearest centre."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[float, int, list[float]] | None] = [None] * starts
        for batch in batches:
            if not batch.num_rows:
                continue
            x, names = _points(batch, width), batch.column("name").to_numpy()
            near = None if centres is None else distances(x, centres).min(axis=2)
            for s in range(starts):
                odds = np.ones(len(x)) if near is None else near[:, s]
                with np.errstate(divide="ignore"):
                    score = -np.log(_uniform(names, salt + s)) / odds
                i = np.lexsort((names, score))[0]
                found = (float(score[i]), int(names[i]), x[i].tolist())
                if best[s] is None or found[:2] < best[s][:2]:
                    best[s] = found
        held = [(s, *b) for s, b in enumerate(best) if b is not None]
        if held:
            yield pa.RecordBatch.from_pylist(
                [{"start": s, "score": v, "name": n, "x": p} for s, v, n, p in held],
                schema=pa.schema([("start", pa.int32()), ("score", pa.float64()), ("name", pa.int64()), ("x", pa.list_(pa.float64()))]),
            )

    drawn = rows.mapInArrow(draw, "start int, score double, name bigint, x array<double>")
    won = drawn.groupBy("start").agg(F.min_by("x", F.struct("score", "name")).alias("x")).collect()
    return np.array([r["x"] for r in sorted(won, key=lambda r: r["start"])]).reshape(-1, 1, width)


def _sums(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """Rows, cost and sum of each dimension for each start and cluster."""
    starts, k, width = centres.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, cost, total = np.zeros((starts, k), np.int64), np.zeros((starts, k)), np.zeros((starts, k, width))
        for batch in batches:
            x = _points(batch, width)
            away = distances(x, centres)
            own, least = away.argmin(axis=2), away.min(axis=2)
            for s in range(starts):
                for c in range(k):
                    mine = own[:, s] == c
                    n[s, c] += mine.sum()
                    cost[s, c] += least[mine, s].sum()
                    total[s, c] += x[mine].sum(axis=0)
        s, c = np.divmod(np.arange(starts * k, dtype=np.int32), np.int32(k))
        yield pa.RecordBatch.from_arrays(
            [pa.array(s), pa.array(c), pa.array(n.ravel()), pa.array(cost.ravel()), pa.array(list(total.reshape(-1, width)))],
            names=["start", "cluster", "n", "cost", "total"],
        )

    parts = rows.mapInArrow(add, "start int, cluster int, n bigint, cost double, total array<double>")
    return parts.groupBy("start", "cluster").agg(
        F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total")
    )


def fit_starts(
    rows: DataFrame, width: int, *, k: int, starts: int, seed: int, steps: int = 100, tolerance: float = 1e-4
) -> tuple[np.ndarray, np.ndarray]:
    """Centres (starts, k, width) and costs of Lloyd's steps from each start; `rows` has `name` and `x`.

    Start s of a fit with `seed` is start 0 of a fit with `seed + s`. A start has ended when none of its centres moves further
    than `tolerance`; later passes leave it out. An empty cluster keeps its centre. With fewer distinct rows than k some centres
    are equal, and those after the first are empty.
    """
    centres = None
    for step in range(k):
        more = _next_centres(rows, centres, starts, width, (step << 32) + seed)
        if not len(more):
            return np.empty((0, k, width)), np.empty(0)
        centres = more if centres is None else np.concatenate([centres, more], axis=1)
    costs, active = np.full(starts, np.inf), np.arange(starts)
    for step in range(steps + 1):
        new, cost = centres[active].copy(), np.zeros(len(active))
        for r in _sums(rows, centres[active]).collect():  # starts x k rows
            cost[r["start"]] += r["cost"]
            if r["n"]:
                new[r["start"], r["cluster"]] = np.array(r["total"]) / r["n"]
        costs[active] = cost
        moved = np.sqrt(((new - centres[active]) ** 2).sum(axis=2)).max(axis=1)
        ended = moved <= tolerance
        if step < steps:
            centres[active[~ended]] = new[~ended]
            active = active[~ended]
        if not len(active):
            break
    return centres, costs


def assign(rows: DataFrame, keys: Sequence[str], centres: np.ndarray) -> DataFrame:
    """The keys of each row with the `cluster` of its nearest centre, the first of equally near ones."""
    width = centres.shape[1]
    schema = T.StructType([*rows.select(*[quoted(c) for c in keys]).schema.fields, T.StructField("cluster", T.IntegerType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = distances(_points(batch, width), centres[None])[:, 0].argmin(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], pa.array(own)], names=[*keys, "cluster"])

    return rows.mapInArrow(place, schema)


def cluster_rows(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], *, k: int, starts: int, seed: int, **options
) -> tuple[DataFrame, np.ndarray, float]:
    """Clusters of rows by columns without gaps: (keys with cluster, centres, cost) of the start with the lowest cost."""
    spark = df.sparkSession
    let_workers_import(spark)
    values = F.array(*[F.col(quoted(c)).cast("double") for c in columns])
    own = [F.col(quoted(c)) for c in keys]
    rows = cut_lineage(df.dropna(subset=list(columns)).select(*own, F.xxhash64(*own).alias("name"), values.alias("x")))
    centres, costs = fit_starts(rows, len(columns), k=k, starts=starts, seed=seed, **options)
    if not len(centres):
        return rows.select(*own, F.lit(0).alias("cluster")), np.empty((0, len(columns))), 0.0
    best = int(costs.argmin())
    return cut_lineage(assign(rows, keys, centres[best])), centres[best], float(costs[best])
