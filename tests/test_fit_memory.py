"""What a fit holds outside Spark's accounting, and that a query fits no model that it does not use."""

import numpy as np

from loadcurve.catalog import modelling
from loadcurve.plans import models


def _frame(spark, n=600):
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(float(a), float(b), float(a + 0.1 * b)) for a, b in rng.random((n, 2))], "a double, b double, y_next double")


def test_statistics_of_a_pass_fit_four_tasks_of_an_executor(spark):
    model = models.train_random_forest(_frame(spark), num_trees=4, max_depth=4, features=["a", "b"])
    # Four tasks at once, with half of a 3 GB executor's heap of 60 % for all else.
    assert 4 * model.stages[-1].getMaxMemoryInMB() * 2 <= 0.7 * 3000


def test_one_forecast_fits_its_own_model_only(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(modelling, "_model", lambda spark, sf, kind: fitted.append(kind))
    for kind in ("naive", "boosted"):
        modelling._scorer(spark, "", kind)
    assert fitted == ["boosted"]
