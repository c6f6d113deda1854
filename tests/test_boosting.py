import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.plans import boosting, explain, models
from loadcurve.plans.trees import FlatTrees, tree_of_description

NAMES = ["a", "b", "c"]


def _data(n=4000, seed=1, missing=0.15):
    """A smooth target with noise; `b` is missing at times, and that matters."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 3))
    x[:, 2] = np.floor(x[:, 2] * 7)
    lost = rng.random(n) < missing
    y = np.sin(6 * x[:, 0]) + np.where(lost, 1.5, x[:, 1]) + 0.3 * (x[:, 2] > 3) + 0.05 * rng.standard_normal(n)
    x[lost, 1] = np.nan
    return x, y


def _frame(spark, x, y):
    rows = [(*[None if math.isnan(v) else float(v) for v in r], float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double")


def _plain_fit(x, y, rounds, step, max_depth, max_leaves, min_leaf, edges):
    """The same learning on one machine: nodes are split one after the other, the one that wins most first."""
    codes = np.stack([np.where(np.isnan(v), 255, np.searchsorted(e, v, "left")) for v, e in zip(x.T, edges, strict=True)])
    score = np.full(len(y), y.mean())
    for _ in range(rounds):
        g = y - score

        def cut(rows):
            best = (0.0,)
            for f in range(len(codes)):
                c, r = codes[f, rows], g[rows]
                for missing_left in (False, True):
                    for at in range(len(edges[f]) + 1):
                        left = np.where(c == 255, missing_left, c <= at)
                        n = left.sum()
                        if min(n, len(rows) - n) >= min_leaf:
                            s, t = r[left].sum(), r.sum()
                            gain = s * s / n + (t - s) ** 2 / (len(rows) - n) - t * t / len(rows)
                            if gain > best[0] + 1e-9:
                                best = (gain, rows[left], rows[~left])
            return best

        open_nodes, leaves = [(cut(np.arange(len(y))), np.arange(len(y)), 0)], []
        while open_nodes:
            open_nodes.sort(key=lambda o: -o[0][0])
            best, rows, depth = open_nodes.pop(0)
            if best[0] <= 0 or len(open_nodes) + len(leaves) + 2 > max_leaves:
                leaves.append(rows)
                continue
            for part in best[1:]:
                open_nodes.append((cut(part) if depth + 1 < max_depth else (0.0,), part, depth + 1))
        for rows in leaves:
            score[rows] += step * g[rows].mean()
    return score


def test_equal_to_a_plain_fit(spark):
    x, y = _data(700)
    options = {"max_depth": 3, "max_leaves": 6, "min_leaf": 10}
    model = boosting.fit_boosted_trees(_frame(spark, x, y), "y", NAMES, rounds=6, step_size=0.3, max_bins=20, **options)
    edges = boosting._edges(_frame(spark, x, y), NAMES, 20)
    want = _plain_fit(x, y, 6, 0.3, edges=edges, **options)
    assert np.abs(model.predict(x.T) - want).max() < 1e-6
    assert all((t.feature < 0).sum() <= 6 for t in model.trees)


def test_missing_values_go_to_their_own_side(spark):
    x, y = _data(3000)
    model = boosting.fit_boosted_trees(_frame(spark, x, y), "y", NAMES, rounds=25, step_size=0.3)
    lost = np.isnan(x[:, 1])
    error = np.abs(model.predict(x.T) - y)
    assert error[lost].mean() < 0.1 and error[~lost].mean() < 0.1
    assert any((t.missing_left & (t.feature == 1)).any() for t in model.trees) or any((~t.missing_left & (t.feature == 1)).any() for t in model.trees)


def test_all_rounds_at_any_number_of_rows(spark):
    x, y = _data(12_000)
    train = _frame(spark, x, y).withColumnRenamed("y", K.TARGET)
    model = models.train_gradient_boosting(train, max_iter=14, max_depth=2, max_leaves=3, features=NAMES)
    assert len(model.trees) == 14


def test_rounds_end_when_held_out_rows_gain_nothing(spark):
    rng = np.random.default_rng(2)
    x = rng.random((1500, 3))
    train = _frame(spark, x, rng.standard_normal(1500)).withColumnRenamed("y", K.TARGET)
    model = models.train_gradient_boosting(train, max_iter=200, step_size=0.5, features=NAMES, holdout=0.2)
    assert 10 < len(model.trees) < 80


def test_trees_do_not_depend_on_the_partitioning(spark, monkeypatch):
    x, y = _data(3000)
    x = np.round(x, 2)
    made = []
    for parts, block in ((1, 1 << 15), (9, 100)):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        monkeypatch.setattr(boosting, "REWRITE", 3)
        made.append(boosting.fit_boosted_trees(_frame(spark, x, y).repartition(parts), "y", NAMES, rounds=5))
    for one, other in zip(made[0].trees, made[1].trees, strict=True):
        assert (one.feature == other.feature).all() and (one.threshold == other.threshold).all()
    assert np.abs(made[0].predict(x.T) - made[1].predict(x.T)).max() < 1e-9


def test_odd_inputs(spark):
    rows = [(None, 1.0, 1.0, None), (None, float("nan"), 2.0, 3.0), (None, None, None, 3.0)]
    frame = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = boosting.fit_boosted_trees(frame, "y", NAMES, rounds=5)
    assert model.trees == [] and model.base == 3.0
    assert [r["y_pred"] for r in model.score(frame).collect()] == [3.0] * 3
    assert boosting.fit_boosted_trees(frame.limit(0), "y", NAMES).base == 0.0
    assert model.score(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def fitted(spark):
    x, y = _data(2500)
    t = explain.TEMPERATURE
    frame = _frame(spark, x, y).withColumnsRenamed({"a": t, "b": "precipitation", "c": "hour", "y": K.TARGET}).withColumn("id", F.monotonically_increasing_id()).cache()
    features = [t, "precipitation", "hour"]
    return frame, {
        "boosted": models.train_gradient_boosting(frame, max_iter=12, features=features),
        "forest": models.train_random_forest(frame, num_trees=12, max_depth=7, max_bins=32, features=features),
    }


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind", ["boosted", "forest"])
def test_response_is_the_curve_without_copies(fitted, kind):
    frame, made = fitted
    scorer, grid = models.model_scorer(made[kind]), explain.unit_grid(11)
    curves = explain.ice_curves(frame, scorer, grid, ids=["id"])
    want = {}
    for r in curves.collect():
        want.setdefault(r["id"], {})[r["grid"]] = r["y_pred"]
    slopes = {r["id"]: r["slope"] for r in explain.ice_slope(curves, ["id"], 11).collect()}
    steps = explain.ice_steps(frame, scorer, grid)
    assert "Generate" not in _plan(steps) and "Generate" not in _plan(explain.response_slopes(frame, scorer, grid))
    rows = steps.collect()
    assert len(rows) == 2500
    for r in rows:
        assert max(abs(a - want[r["id"]][g]) for g, a in zip(grid, r["response"], strict=True)) < 1e-9
    assert len({tuple(r["response"]) for r in rows}) > 30
    for r in explain.response_slopes(frame, scorer, grid).collect():
        assert abs(r["slope"] - slopes[r["id"]]) < 1e-9


def test_flat_forest_predicts_as_the_pipeline(spark, fitted):
    frame, made = fitted
    scorer = models.model_scorer(made["forest"])
    one = {r["id"]: r["y_pred"] for r in scorer(frame).collect()}
    other = {r["id"]: r["y_pred"] for r in scorer.trees(spark).score(frame).collect()}
    assert max(abs(one[i] - other[i]) for i in one) < 1e-9


def test_a_forest_is_read_without_a_job(spark, fitted):
    """Its stored form is written by one task that holds the whole forest, which the driver has to send."""
    forest = fitted[1]["forest"]
    spark.sparkContext.setJobGroup("reads the forest", "")
    try:
        flat = models.model_scorer(forest).trees(spark)
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("reads the forest")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sum(len(t.feature) for t in flat.trees) == forest.stages[-1].totalNumNodes


def test_a_tree_of_its_description():
    cut = "  If (feature 1 <= -1.5E-4)\n   Predict: 0.25\n  Else (feature 1 > -1.5E-4)\n"
    inner = "   If (feature 0 <= 2.0)\n    Predict: 1.0\n   Else (feature 0 > 2.0)\n    Predict: -3.0E-5\n"
    tree = tree_of_description(f"DecisionTreeRegressionModel: depth=2, numNodes=5\n{cut}{inner}", 5)
    assert (tree.feature == [1, -1, 0, -1, -1]).all() and (tree.left == [1, -1, 3, -1, -1]).all() and (tree.right == [2, -1, 4, -1, -1]).all()
    x = np.array([[2.0, 2.0, 2.1], [-1.5e-4, 0.0, 0.0]])
    assert tree.predict(x).tolist() == [0.25, 1.0, -3e-5]
    assert tree_of_description("head\n  Predict: 7.0\n", 1).predict(x).tolist() == [7.0] * 3
    with pytest.raises(ValueError, match="categories"):
        tree_of_description("head\n  If (feature 0 in {1.0})\n   Predict: 1.0\n  Else (feature 0 not in {1.0})\n   Predict: 2.0\n", 3)


def test_stored_trees_are_the_same(spark, fitted, tmp_path):
    frame, made = fitted
    models.save_model(made["boosted"], str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert isinstance(again, FlatTrees) and again.names == made["boosted"].names
    order = lambda m: [r["y_pred"] for r in models.model_scorer(m)(frame).orderBy("id").collect()]
    assert order(again) == order(made["boosted"])


def test_only_an_input_by_itself_is_varied(fitted):
    frame, made = fitted
    with pytest.raises(ValueError, match="by itself"):
        explain.ice_steps(frame, models.model_scorer(made["forest"]), [0.0, 1.0], column="precipitation")


def test_of_siblings_only_the_smaller_is_counted():
    rng = np.random.default_rng(6)
    codes, residual = rng.integers(0, 20, (3, 2000)).astype(np.uint8), rng.integers(-1000, 1000, 2000)
    codes[1, ::9] = boosting.MISSING
    asked = []

    def cells_of(tree, frontier):
        node = boosting._nodes_of(codes, tree)
        asked.append(sum(int((node == i).sum()) for i in frontier))
        out = np.zeros((len(frontier), 3, boosting.MISSING + 1, 2), np.int64)
        for slot, i in enumerate(frontier):
            for f in range(3):
                np.add.at(out[slot, f], codes[f, node == i], np.stack([np.ones(2000, np.int64), residual], 1)[node == i])
        return out

    limits = boosting._Limits((19, 19, 19), 1.0, 0.1, 5, 31, 10)
    tree = boosting._grow(cells_of, limits)
    assert asked[0] == 2000 and all(rows <= 1000 for rows in asked[1:])
    node = boosting._nodes_of(codes, tree.arrays())
    for leaf in set(node.tolist()):
        assert tree.rows[leaf] == (node == leaf).sum() and tree.sums[leaf] == residual[node == leaf].sum()


def test_a_level_walks_no_earlier_tree(spark, monkeypatch):
    """Predictions are carried with the blocks from round to round: what a level is given does not grow with the rounds."""
    x, y = _data(1200)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 300)
    sizes, cells = [], boosting._histograms
    monkeypatch.setattr(boosting, "_histograms", lambda *given: sizes.append([len(g) for g in given if isinstance(g, list)]) or cells(*given))
    model = boosting.fit_boosted_trees(_frame(spark, x, y), "y", NAMES, rounds=6, max_depth=2)
    assert len(model.trees) == 6 and all(s == [] for s in sizes) and len(sizes) == 6


def test_one_task_gives_the_trees_of_many(spark, monkeypatch):
    """Far more rows than a stored block has are fitted without a job for each level, to the trees that many tasks add up."""
    x, y = _data(3000)
    x = np.round(np.column_stack([x, x[:, 0] > 0.5, np.floor(x[:, 0] * 4), np.ones(3000)]), 2)
    names = [*NAMES, "d", "e", "f"]
    rows = [(*[None if math.isnan(v) else float(v) for v in r], float(t), i % 11 == 0) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    frame = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*names, "y"]) + ", held boolean").repartition(5).cache()
    made, jobs = [], []
    for block, stored in ((1 << 22, 200), (200, 1 << 16)):
        monkeypatch.setattr(boosting, "BLOCK_ROWS", block)
        monkeypatch.setattr(boosting, "STORED_ROWS", stored)
        for held in (None, "held"):
            spark.sparkContext.setJobGroup(f"{block} {held}", "")
            made.append(boosting.fit_boosted_trees(frame, "y", names, rounds=6, max_depth=5, held_out=held, patience=50))
            jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"{block} {held}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for one, other in zip(made[:2], made[2:], strict=True):
        for a, b in zip(one.trees, other.trees, strict=True):
            assert (a.feature == b.feature).all() and (a.threshold == b.threshold).all() and (a.rows == b.rows).all() and (a.missing_left == b.missing_left).all()
        assert np.abs(one.predict(x.T) - other.predict(x.T)).max() < 1e-9
    assert max(jobs[:2]) <= 16 < min(jobs[2:])
