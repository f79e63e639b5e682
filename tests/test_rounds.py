"""Boosted trees end by validation, not at their number of rounds."""

import random

import numpy as np
import pytest

from gaugeline.operators import models
from gaugeline.plans import QUERIES, checks_samples


@pytest.mark.parametrize("name", ["gbt_regression", "gbt_classification"])
def test_rounds_that_end_training_are_an_error(spark, monkeypatch, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    monkeypatch.setattr(checks_samples, "_ROUNDS", 1)
    with pytest.raises(ValueError):
        QUERIES[name](spark, "/root/testdata/sf0.001")


def test_best_round_is_the_first_least_loss():
    assert models.best_round([3.0, 2.0, 2.0, 2.5, 1.0], 2) == (2, True)  # the fifth is not looked at
    assert models.best_round([3.0, 2.0, 2.0, 1.5, 1.6], 2) == (4, False)
    assert models.best_round([3.0, 2.0, 1.0], 5) == (3, False)
    assert models.best_round([1.0, 1.0, 1.0], 2) == (1, True)


def test_patience_ends_where_the_whole_curve_says(spark):
    draw = random.Random(2)
    rows = [(i, [float(i % 7), float(i % 3), None if i % 5 == 0 else 1.0], [float(i % 7) * 2 + draw.random() * 20]) for i in range(400)]
    data = spark.createDataFrame(rows, "sample_id int, features array<double>, target array<double>")
    train, test = data.where("sample_id % 4 > 0").cache(), data.where("sample_id % 4 = 0").cache()
    options = {"rounds": 16, "depth": 2, "subsample": 1.0, "feature_share": 1.0, "rate": 0.4}
    found = models.train_regressor(train, test, patience=2, **options)
    whole = models.train_regressor(train, **options)
    losses = models.loss_per_round(whole.model, test)
    best, ended = models.best_round(losses, 2)
    assert ended and found.best_round == best == found.model.stages[-1].getNumTrees
    assert [x for part, _, x in found.curve if part == "test"] == pytest.approx(losses[: best + 2])
    short = models.train_regressor(train, **{**options, "rounds": best}).model
    a, b = ({r.sample_id: r.pred for r in models.predict(m, test).collect()} for m in (found.model, short))
    assert a == pytest.approx(b)


def test_stored_models(spark, tmp_path):
    path = str(tmp_path / "model")
    models.store_model(spark, b"\x02", path)
    data = spark.createDataFrame([(1, [1.0, 2.0], [0.0]), (2, [3.0, None], [1.0])], "sample_id int, features array<double>, target array<double>")
    make = models.stored_model(spark, path, lambda held: lambda x: np.nansum(x, axis=1, keepdims=True) * held[0])
    assert {r.sample_id: r.pred for r in models.score_batches(data, make, size=2).collect()} == {1: [6.0], 2: [6.0]}
    models.store_model(spark, b"", path)
    with pytest.raises(ValueError):
        models.stored_model(spark, path, lambda held: held)
