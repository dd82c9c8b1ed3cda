"""Recourse by a fitted model: the closed form of a logistic one, and every step tried on trees."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import model, recourse
from evenhand.sources import register


@pytest.fixture(scope="module")
def ready(spark):
    apps = register.applications(spark, "/root/testdata/sf0.001")
    train, test, scaler = model.prepared(apps, 2000)
    return train.persist(), test.persist(), scaler


def moved(x, scaler, added):
    """One row's features with income added, by hand."""
    at = {n: i for i, n in enumerate(scaler.names)}
    x = list(x)
    i, r = at["income"], at["loan_to_income"]
    if x[at["income_missing"]] > 0 or added == 0:
        return x
    income = x[i] * scaler.sd[i] + scaler.mean[i]
    x[i] = (income + added - scaler.mean[i]) / scaler.sd[i]
    if not x[at["loan_to_income_missing"]] > 0:
        ratio = (x[r] * scaler.sd[r] + scaler.mean[r]) * income / (income + added)
        x[r] = (ratio - scaler.mean[r]) / scaler.sd[r]
    return x


GRID = [0.0, *map(float, recourse.FINE), *recourse.coarse_grid()]


def first_below(scores, cut):
    below = np.flatnonzero(scores < cut)
    return None if not len(below) else GRID[below[0]]


def test_logistic_model_equals_its_closed_form(ready):
    train, test, scaler = ready
    fit = model.logistic(train, train.count())
    cut = model.scores(fit, test).agg(F.expr("percentile(score, 0.4)")).first()[0]
    rows = test.where("y = 1").select("app_id", "g", "features")
    got = {r["app_id"]: r["increase"] for r in recourse.model_increase(fit, rows, scaler, cut).collect()}
    w, b = np.array(fit.coefficients.toArray()), fit.intercept
    given = rows.collect()
    assert len(got) == len(given)
    kinds = set()
    for r in given:
        scores = 1 / (1 + np.exp(-(np.array([moved(r["features"].toArray(), scaler, a) for a in GRID]) @ w + b)))
        if np.abs(scores - cut).min() > 1e-9:
            want = first_below(scores, cut)
            assert got[r["app_id"]] == want
            kinds.add(None if want is None else want > 0)
    assert kinds == {None, True, False}


def test_trees_equal_every_step_tried(ready):
    train, test, scaler = ready
    forest = model.boosted(model.missing_as_nan(train, scaler), trees=30, rate=0.2)
    cut = model.scores(forest, model.missing_as_nan(test, scaler)).agg(F.expr("percentile(score, 0.5)")).first()[0]
    rows = test.where("y = 1").select("app_id", "features").limit(500)
    got = {r["app_id"]: r["increase"] for r in recourse.model_increase(forest, rows, scaler, cut, steps=30).collect()}
    flags = {scaler.names.index(n): scaler.names.index(f"{n}_missing") for n in scaler.flags}
    for r in rows.collect():
        x = np.array([moved(r["features"].toArray(), scaler, a) for a in GRID])
        for i, f in flags.items():
            x[x[:, f] > 0, i] = np.nan
        assert got[r["app_id"]] == first_below(1 / (1 + np.exp(-forest.margin(x))), cut)
    assert len({v for v in got.values()}) > 3


def test_stability_follows_md5(spark):
    import hashlib

    found = spark.createDataFrame([(f"k{i}", float(1000 * (i % 17))) for i in range(300)], "app_id string, increase double")
    got = {r["replicate"]: r["median_increase"] for r in recourse.stability(found, 3).collect()}
    for k in range(3):
        values = []
        for i in range(300):
            u = (int(hashlib.md5(f"k{i}:{k}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
            values += [1000.0 * (i % 17)] * (sum(u > e for e in recourse.POISSON) if i % 17 else 0)
        assert got[k] == np.median(values)
