import numpy as np
import pytest
from pyspark.sql import functions as F

from loadcurve import constants as K
from loadcurve.plans import forest, models
from loadcurve.plans.trees import Tree

NAMES = ["a", "b", "c", "d", "e"]


def _data(n=3000, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, len(NAMES))), 2)
    x[:, 2] = np.floor(x[:, 2] * 5)
    return x, np.sin(6 * x[:, 0]) + x[:, 1] * (x[:, 2] > 2) + 0.05 * rng.standard_normal(n)


def _frame(spark, x, y, parts=3):
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*NAMES, K.TARGET])).repartition(parts)


def _fit(frame, **options):
    return forest.fit_forest(frame, K.TARGET, {n: n for n in NAMES}, names=NAMES, **{"num_trees": 6, "max_depth": 8} | options)


def test_trees_do_not_depend_on_where_they_are_grown(spark, monkeypatch):
    """Large nodes are split over all blocks, small ones within a task: to the same trees, however the line between them is drawn."""
    x, y = _data()
    frame, made = _frame(spark, x, y).cache(), []
    monkeypatch.setattr(forest, "BLOCK_ROWS", 400)
    for local, dealt in ((1 << 19, 1 << 27), (700, 1 << 27), (40, 7000), (0, 1 << 27)):
        monkeypatch.setattr(forest, "LOCAL_ROWS", local)
        monkeypatch.setattr(forest, "DEALT_ROWS", dealt)
        model = _fit(frame)
        made.append([sorted(zip(t.threshold.tolist(), t.feature.tolist(), t.rows.tolist(), strict=True)) for t in model.trees])
        made[-1].append(model.predict(x.T).tolist())
    assert made[0] == made[1] == made[2] == made[3]


def test_a_tree_is_grown_to_its_end(spark):
    x, y = _data()
    model = _fit(_frame(spark, x, y), num_trees=30, max_depth=12)
    assert model.getNumTrees == 30 and model.totalNumNodes == sum(len(t.feature) for t in model.trees)
    for t in model.trees:
        leaf = t.feature < 0
        assert t.rows[leaf].min() >= 5 and t.rows[leaf].sum() == t.rows[0] and abs(t.rows[0] - len(y)) < 300
        assert leaf.sum() > 150 and abs(t.value[leaf] @ t.rows[leaf] / t.rows[0] * 30 - y.mean()) < 0.2
    assert np.abs(model.predict(x.T) - y).mean() < 0.15 * np.abs(y - y.mean()).mean()
    assert len({t.feature[0] for t in model.trees}) > 2


def test_a_split_is_the_best_of_the_inputs_looked_at(spark):
    """Against a search through all cuts, over the rows as the tree drew them."""
    x, y = _data(400)
    frame = _frame(spark, x, y, 1)
    model = _fit(frame, num_trees=3, max_depth=1, max_bins=256)
    # one partition, one block: rows in their order
    x, y = (np.array(frame.select(*c).collect(), float) for c in (NAMES, [K.TARGET]))
    for number, t in enumerate(model.trees):
        drawn = np.repeat(np.arange(400), forest._drawn(forest._Limits(5, 3, 1, 1, 5, 42), number, 0, 400))
        best = (np.inf, None, None)
        for f in forest._chosen_inputs(forest._Limits(5, 3, 1, 1, 5, 42), number, np.array([1]))[0]:
            for cut in np.unique(x[drawn, f])[:-1]:
                left = x[drawn, f] <= cut
                if min(left.sum(), (~left).sum()) >= 5:
                    error = sum(((part - part.mean()) ** 2).sum() for part in (y[drawn][left], y[drawn][~left]))
                    best = min(best, (error, int(f), cut))
        assert t.feature[0] == best[1] and best[2] < t.threshold[0] <= best[2] + 1 and t.rows.tolist()[0] == len(drawn)
        assert t.rows[t.left[0]] == (x[drawn, best[1]] <= best[2]).sum()


def test_a_fit_is_a_few_jobs(spark):
    """A tree's rows are moved once. MLlib sends the statistics of every node of every level between tasks, in jobs that grow with depth and trees."""
    x, y = _data()
    frame = _frame(spark, x, y)
    spark.sparkContext.setJobGroup("fits a forest", "")
    try:
        models.train_random_forest(frame, num_trees=40, features=NAMES)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("fits a forest")) <= 16
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_missing_inputs_are_an_error_but_missing_rain_is_an_input(spark):
    x, y = _data(300)
    frame = _frame(spark, x, y)
    holed = frame.withColumn("b", F.when(F.col("a") > 0.1, F.col("b")))
    with pytest.raises(ValueError, match="missing values"):
        models.train_random_forest(holed, num_trees=2, features=NAMES)
    rain = holed.withColumnRenamed("b", "precipitation")
    model = models.train_random_forest(rain, num_trees=2, max_depth=3, features=["a", "precipitation", "c"])
    assert len(model.inputs) == 4 and model.names == ["a", "c"]
    assert models.model_scorer(model)(rain).where("y_pred is null").count() == 0
    with pytest.raises(ValueError, match="missing values"):
        model.predict(np.full((4, 1), np.nan))


def test_few_and_equal_rows(spark):
    frame = _frame(spark, np.ones((7, 5)), np.full(7, 2.5))
    model = _fit(frame)
    assert model.totalNumNodes == 6 and abs(model.predict(np.ones((5, 2))) - 2.5).max() < 1e-12
    with pytest.raises(ValueError, match="no rows"):
        _fit(frame.where("a > 1"))


def test_coded_trees_predict_as_the_plain_walk():
    """Missing values to either side, values on a threshold, thresholds without end, more thresholds than a byte counts."""
    rng = np.random.default_rng(9)
    trees = []
    for k in range(40):
        threshold = np.array([np.inf if k % 9 == 0 else rng.integers(0, 400) / 4, rng.random(), 0.0, 0.0, 0.0])
        feature, side = np.array([k % 2, 2, -1, -1, -1], np.int32), np.array([k % 3 == 0, k % 3 == 1, False, False, False])
        trees.append(Tree(feature, threshold, side, np.array([1, 2, -1, -1, -1], np.int32), np.array([4, 3, -1, -1, -1], np.int32), rng.random(5), np.zeros(5, np.int64)))
    x = np.stack([rng.integers(0, 400, 9000) / 4, rng.integers(0, 400, 9000) / 4, rng.random(9000)])
    x[rng.random(x.shape) < 0.1] = np.nan
    for some in (trees, trees * 12):
        want = sum(t.predict(x) for t in some)
        assert np.abs(forest.FlatTrees(["p", "q", "r"], ["p", "q", "r"], 0.0, some).predict(x) - want).max() < 1e-9
