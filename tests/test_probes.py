"""Drivers, layer read-outs, paired-anew labels and top counts."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from evenhand.operators import model, recourse


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    data = [(f"k{i:04d}", "ab"[i % 2], [float(v) for v in r], float(r[0] + 0.2 * rng.normal() > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(data, "app_id string, g string, x array<double>, y double")
    return df.withColumn("features", array_to_vector("x")).drop("x").persist()


def test_read_out_ends_in_the_models_own_probability(rows):
    layers = [3, 64, 32, 2]
    net = model.network(rows, 3, rounds=5)
    weights = np.asarray(net.weights.toArray())
    last = recourse.hidden(rows, weights, layers, 2).select("app_id", vector_to_array("features").alias("h"))
    w, b = weights[-66:-2].reshape(32, 2), weights[-2:]
    both = model.scores(net, rows).join(last, "app_id").select("score", "h").collect()
    for r in both:
        z = np.array(r["h"]) @ w + b
        assert 1 / (1 + np.exp(z[0] - z[1])) == pytest.approx(r["score"], abs=1e-9)
    assert len(both) == 600 and len(recourse.untrained(layers)) == len(weights)
    assert np.array_equal(recourse.untrained(layers, 5), recourse.untrained(layers, 5))


def test_repaired_labels_are_the_same_labels_elsewhere(rows):
    got = recourse.repaired_labels(rows, "y", "app_id", "z").select("app_id", "y", "z").collect()
    assert len({r["app_id"] for r in got}) == len(got) == 600
    assert sum(r["y"] for r in got) == sum(r["z"] for r in got)
    same = np.mean([r["y"] == r["z"] for r in got])
    assert 0.4 < same < 0.6
    assert recourse.repaired_labels(rows.where("false"), "y", "app_id", "z").count() == 0


def test_probe_tells_the_label_but_not_the_control(rows):
    found = {r["what"]: r["auc"] for r in recourse.race_probe(rows.withColumn("denial_score", F.lit(0.5))).collect()}
    assert found["inputs"] > 0.95 and abs(found["shuffled"] - 0.5) < 0.1 and found["denial_score"] == 0.5


@pytest.mark.parametrize("kind", ["trees", "logistic"])
def test_model_drivers_rank_what_the_model_uses(rows, kind):
    fit = model.boosted(rows, trees=5, leaves=4) if kind == "trees" else model.logistic(rows, 600)
    names = ["income", "loan_type_1", "loan_type_2"]
    found = recourse.model_drivers(fit, rows, names, "g").orderBy("group_value", "rank").collect()
    assert [(r["group_value"], r["parent"], r["rank"]) for r in found] == [(g, p, i) for g in "ab" for i, p in ((1, "income"), (2, "loan_type"))]
    assert found[0]["label"] == "income" and found[0]["contribution"] > 5 * found[1]["contribution"]
    assert recourse.model_drivers(fit, rows, names, "g", floor=301).count() == 0


def test_drivers_sum_absolute_terms_of_a_parent(spark):
    df = spark.createDataFrame([(0.0, 1.0), (1.0, 0.0)], "a double, b double")
    found = recourse.drivers(df, {"a": 2.0, "b": 2.0}, {"a": "loan_type", "b": "loan_type"}, floor=2).first()
    assert found["contribution"] == 2.0 and found["label"] == "loan type"  # the terms do not cancel
    groups = {r["group_value"]: tuple(r)[1:] for r in recourse.driver_groups(df, "a", 2).collect()}
    assert groups == {0.0: (1, True), 1.0: (1, True)}


def test_names():
    assert recourse.readable("loan_purpose_31") == "loan purpose: refinancing"
    assert recourse.readable("open_end_line_of_credit_2") == "open-end credit line: no"
    assert recourse.readable("income_missing") == "income (missing)"
    assert recourse.parent_of("debt_to_income_rank_missing") == "debt_to_income_ratio"
    assert recourse.parent_of("loan_to_income") == "loan_to_income" and recourse.parent_of("total_units_1") == "total_units"


def test_top_counts(spark):
    runs = spark.createDataFrame([("a", 1, 3.0), ("b", 1, -4.0), ("c", 1, 1.0), ("a", 2, 1.0), ("b", 2, 1.0), ("c", 2, None)], "name string, seed int, v double")
    found = {r["name"]: (r["runs"], r["top"], r["mean"]) for r in recourse.top_counts(runs, "name", "v", k=1).collect()}
    assert found == {"a": (2, 1, 2.0), "b": (2, 1, -1.5), "c": (2, 0, 1.0)}


def test_probe_runs_side_by_side_equal_single_probes(rows):
    scored = rows.withColumn("denial_score", F.lit(0.25) + F.col("y") / 2)
    runs = recourse.probe_runs(scored, (0, 1))
    got = {(r["what"], r["seed"]): r["auc"] for r in runs.collect()}
    one = {r["what"]: r["auc"] for r in recourse.race_probe(scored).collect()}
    assert {w for w, _ in got} == set(one)
    for what in one:
        assert got[what, 0] == pytest.approx(one[what], abs=2e-3)
    assert got["inputs", 1] > 0.95 and abs(got["shuffled", 1] - 0.5) < 0.12 and got["shuffled", 1] != got["shuffled", 0]
    found = {r["what"]: r for r in recourse.probe_summary(runs).collect()}
    assert found["inputs - shuffled"]["mean"] == pytest.approx(sum(got["inputs", s] - got["shuffled", s] for s in (0, 1)) / 2, abs=1e-4)
    assert found["denial_score"]["low"] == found["denial_score"]["high"] == 1.0


def test_fits_side_by_side_equal_the_logistic_model(rows):
    long = rows.select(F.lit("a").alias("fit"), vector_to_array("features").alias("x"), "y").union(rows.select(F.lit("b"), vector_to_array("features"), 1 - F.col("y")))
    fits = model.logistic_fits(long, ["a", "b"])
    fit = model.logistic(rows, 600)
    assert np.allclose(fits["a"], np.r_[fit.intercept, fit.coefficients.toArray()], atol=2e-4) and np.allclose(fits["a"], -fits["b"], atol=1e-8)
