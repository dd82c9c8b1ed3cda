"""Fits of many lenders at once against one fit after another, and the logistic model against Newton's steps in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.operators import model
from evenhand.operators.screen import keep
from evenhand.sources import register


@pytest.fixture(scope="module")
def apps(spark):
    return register.applications(spark, "/root/testdata/sf0.001").persist()


def newton(x, y):
    """L2 with C = 1 on scaled columns, the intercept free."""
    x = np.c_[np.ones(len(x)), x]
    w, penalty = np.zeros(x.shape[1]), np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(25):
        p = 1 / (1 + np.exp(-x @ w))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return w


def test_lenders_at_once_equal_single_fits(spark, apps):
    names = [r[0] for r in apps.select("lei").distinct().orderBy("lei").limit(4).collect()]
    # One lender without any income, one with one outcome only.
    odd = apps.withColumn("income", F.when(F.col("lei") == names[2], "NA").otherwise(F.col("income"))).withColumn("action_taken", F.when(F.col("lei") == names[3], "1").otherwise(F.col("action_taken")))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("fits", "fits")
    got = {r["lei"]: r for r in model.lender_controlled_gaps(odd, [*names, "nobody"], "derived_race", "BUILDING", "FURNITURE").collect()}
    jobs = len(tracker.getJobIdsForGroup("fits"))
    spark.sparkContext.setJobGroup("other", "other")
    rows = keep(odd, "not_purchased")
    for n in names:
        one = model.controlled_gap(rows.where(F.col("lei") == n), "derived_race", "BUILDING", "FURNITURE")
        assert got[n]["controlled_gap_pp"] == (None if one is None else pytest.approx(one, abs=1e-3)), n
    assert not got[names[2]]["estimable"] and got[names[3]]["controlled_gap_pp"] == 0.0
    assert tuple(got["nobody"]) == ("nobody", None, False)
    assert jobs > 0
    # Twice the lenders, no more steps.
    spark.sparkContext.setJobGroup("more", "more")
    model.lender_controlled_gaps(apps, apps.select("lei"), "derived_race", "BUILDING", "FURNITURE").collect()
    assert len(tracker.getJobIdsForGroup("more")) <= jobs + 12
    spark.sparkContext.setJobGroup("other", "other")


def test_logistic_equals_newton(apps):
    train, _, _ = model.prepared(apps, 2000)
    rows = train.select("features", "y").collect()
    x, y = np.stack([r["features"].toArray() for r in rows]), np.array([r["y"] for r in rows])
    fit = model.logistic(train, len(rows))
    w = newton(x, y)
    assert np.allclose(np.r_[fit.intercept, fit.coefficients.toArray()], w, atol=2e-4)


def test_dummies_come_from_the_training_levels(spark):
    train = spark.createDataFrame([("1",), ("2",)], "loan_type string")
    hot = model.one_hot(model.levels(train, ("loan_type",)))
    got = spark.createDataFrame([("2",), ("7",), (None,)], "loan_type string").select(*(c.alias(n) for n, c in hot.items())).collect()
    assert [r.asDict() for r in got] == [{"loan_type_1": 0.0, "loan_type_2": 1.0}, {"loan_type_1": 0.0, "loan_type_2": 0.0}, {"loan_type_1": 0.0, "loan_type_2": 0.0}]


def test_groups_stay_beside_their_rows(apps):
    train, test, _ = model.prepared(apps, 2000)
    both = model.scores(model.logistic(train, train.count()), test).select("app_id", "g", "score").join(apps.select("app_id", "derived_race"), "app_id")
    assert both.count() == test.count() and both.where("not g <=> derived_race").count() == 0


def test_groups_at_once_equal_single_fits(apps):
    rows = keep(apps, "not_purchased")
    found = model.controlled_disparity(apps).collect()
    assert sum(r["status"] == "OK" for r in found) >= 3
    for r in found:
        if r["status"] == "OK":
            one = model.controlled_gap(rows, "derived_race", r["group_value"], r["reference_group"])
            assert r["controlled_gap_pp"] == pytest.approx(one, abs=1e-3)
        else:
            assert r["controlled_gap_pp"] is None


def test_tail_and_places(spark):
    import math

    from evenhand.functions.clean import normal_tail
    from evenhand.operators.sampling import places

    z = [-9.5, -3.0, -0.1, 0.0, 0.5, 1.96, 4.0, 6.0, 12.0]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", normal_tail(F.col("z")).alias("t")).collect():
        assert r["t"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), abs=1e-12)
    values = [(f"k{i}", None if i % 50 == 0 else float((i * 37) % 11) - 5) for i in range(400)]
    got = {r["k"]: r["place"] for r in places(spark.createDataFrame(values, "k string, v double"), "v", "k").collect()}
    order = sorted(values, key=lambda x: (x[1] is None, -(x[1] or 0), x[0]))
    assert got == {k: i for i, (k, _) in enumerate(order, 1)}
