import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcurve.llm import hnsw
from loadcurve.llm import vector_search as vs

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"


def _frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, score string, rank string, id string")


def _rows(vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return [(int(i), None if v is None else [None if x is None else float(x) for x in v], "x", "y", "z") for i, v in zip(ids, vectors, strict=True)]


def _plain(rows, k=20, kind=np.float32):
    """Best `k` of each query by a look at every candidate; a set of (query, vector) to its list."""
    good = {(r[0], tuple(r[1])) for r in rows if r[0] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])}
    out = {}
    for q, v in good:
        if q % 20 == 0:
            near = [(-float((np.array(w, kind).astype(float) * np.array(v, kind).astype(float)).sum()), i) for i, w in good if i != q and len(w) == len(v)]
            out.setdefault(q, []).append([(i, -s) for s, i in sorted(near)[:k]])
    return out


def _found(frame, **more):
    out = {}
    for r in vs.nearest(frame, F.col("id") % 20 == 0, **more).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def _recall(found, want):
    hits = total = 0
    for q, (near,) in want.items():
        hits += len({i for i, _ in near} & {i for i, _ in found.get(q, [])})
        total += len(near)
    return hits / total


@pytest.mark.parametrize("shape", ["spread", "clustered", "lengths"])
def test_recall_and_exact_scores(spark, shape):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 32))
    if shape == "clustered":
        vectors[:1500] = vectors[0] + 0.05 * rng.normal(size=(1500, 32))
    if shape == "lengths":
        vectors *= rng.lognormal(0, 1, size=(3000, 1))
    rows = _rows(vectors.astype(np.float32))
    want, found = _plain(rows), _found(_frame(spark, rows), shard_rows=700)
    assert set(found) == set(want) and all(len(x) == 20 for x in found.values())
    assert _recall(found, want) >= 0.95
    point = {r[0]: np.array(r[1], np.float32).astype(float) for r in rows}
    for q, near in found.items():
        assert q not in {i for i, _ in near} and near == sorted(near, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - float((point[q] * point[i]).sum())) < 1e-12 for i, s in near)


def test_few_rows_are_all_found_in_order(spark):
    rng = np.random.default_rng(4)
    rows = _rows(np.round(rng.normal(size=(45, 3))).astype(np.float32))
    good = [r for r in rows if any(r[1])]
    assert _found(_frame(spark, rows)) == {q: near for q, (near,) in _plain(good).items()}
    assert {q: len(x) for q, x in _found(_frame(spark, good[:9])).items()} == {r[0]: 8 for r in good[:9] if r[0] % 20 == 0}


def test_copies_crowd_nothing_out(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(1200, 8))
    vectors[400:1000] = vectors[400]
    rows = _rows(vectors.astype(np.float32))
    found, want = _found(_frame(spark, rows + rows[:300]), shard_rows=400), _plain(rows)
    assert found[400] == want[400][0] == [(i, found[400][0][1]) for i in range(401, 421)]
    assert _recall(found, want) >= 0.97


def test_what_takes_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = _rows([[1, 0], None, [], [0, 0], [nan, 1], [inf, 1], [1, None], [2, 0], [3, 0], [1, 2, 3], [-1, 0]], [0, 1, 20, 40, 60, 80, 100, 7, 8, 9, 10])
    rows.append((None, [1.0, 0.0], "x", "y", "z"))
    assert _found(_frame(spark, rows)) == {0: [(8, 3.0), (7, 2.0), (10, -1.0)]}
    assert _found(_frame(spark, rows, "double")) == {0: [(8, 3.0), (7, 2.0), (10, -1.0)]}
    assert _found(_frame(spark, rows).limit(0)) == {}
    assert _found(_frame(spark, rows[:1])) == {}


def test_repeated_ids(spark):
    rows = _rows([[1, 0], [1, 0], [0, 1], [2, 2], [2, 2], [3, 1]], [0, 0, 0, 5, 5, 6])
    got = [tuple(r) for r in vs.nearest(_frame(spark, rows), F.col("id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 5, 2.0), (0, 1, 6, 3.0), (0, 2, 5, 2.0), (0, 2, 6, 1.0)]


def test_index_is_the_same_however_rows_lie(spark):
    rng = np.random.default_rng(6)
    rows = _rows(rng.normal(size=(600, 6)).astype(np.float32))
    made = [
        sorted(map(str, vs.build_index(vs.usable(_frame(spark, r).repartition(n), "vec_id", "embedding"), 250).collect())) for r, n in ((rows, 1), (rows[::-1], 7))
    ]
    assert made[0] == made[1]


def test_query_blocks(spark):
    rng = np.random.default_rng(7)
    frame = _frame(spark, _rows(rng.normal(size=(900, 5)).astype(np.float32)))
    index = vs.build_index(vs.usable(frame, "vec_id", "embedding"), 300)
    queries = index.select(F.explode("ids").alias("id"), "vector", "dim").where("id % 20 = 0")
    one, many = (sorted(map(tuple, vs.search_index(index, queries, query_rows=n).collect())) for n in (1000, 7))
    assert one == many and len(one) == 900


def test_graph_layers():
    rng = np.random.default_rng(8)
    graph, order = hnsw.build(rng.normal(size=(2500, 12)))
    assert sorted(order.tolist()) == list(range(2500)) and len(graph.layers) >= 2
    for layer in graph.layers:
        assert layer.max() < len(layer)
        for i, links in enumerate(layer):
            real = links[links >= 0]
            assert i not in real and len(set(real.tolist())) == len(real)
    assert hnsw.build(np.zeros((0, 4)))[0].layers == []
