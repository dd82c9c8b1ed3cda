"""What round 4's findings changed, each against a plain count or fit of the same."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from evenhand.operators import mitigate, model, recourse, trees
from evenhand.sources import register


def test_a_table_of_several_files_has_one_header(spark, tmp_path):
    spark.range(6).selectExpr("id as a", "cast(id as string) as b").repartition(3).write.parquet(str(tmp_path / "many.parquet"))
    import duckdb

    duckdb.sql(f"copy (select 1 as x, 2 as y) to '{tmp_path}/one.parquet' (format parquet)")
    found = sorted(tuple(r) for r in register.headers(spark, str(tmp_path)).collect())
    assert found == [("many.parquet", 1, "a"), ("many.parquet", 2, "b"), ("one.parquet", 1, "x"), ("one.parquet", 2, "y")]


def grown(rng, leaves):
    """A made tree: splits at random, over inputs of 5, 3, 2 and 65 bins."""
    sizes, growth = np.array([5, 3, 2, 65]), [[-1, 0, False, -1, -1]]
    while sum(n[0] < 0 for n in growth) < leaves:
        n = int(rng.choice([i for i, x in enumerate(growth) if x[0] < 0]))
        f = int(rng.integers(4))
        growth[n] = [f, int(rng.integers(1, sizes[f])), bool(rng.integers(2)), len(growth), len(growth) + 1]
        growth += [[-1, 0, False, -1, -1], [-1, 0, False, -1, -1]]
    f, c, m, a, b = (np.array(x) for x in zip(*growth, strict=True))
    return trees.Tree(f, c, m, a, b, rng.normal(size=len(f))), sizes


@pytest.mark.parametrize("leaves", [1, 2, 31, 32, 33, 64, 70])
def test_tables_find_the_leaf_that_a_walk_finds(leaves):
    rng = np.random.default_rng(leaves)
    tree, sizes = grown(rng, leaves)
    codes = trees.Codes(sizes)
    bins = np.stack([rng.integers(0, s, 500) for s in sizes], axis=1).astype(np.uint8)
    x = codes.pack(bins)
    assert codes.bytes < 4 and (codes.unpack(x) == bins).all()
    look = trees.Lookup(tree, codes)
    assert (look.node[look.place(x)] == tree.leaf(bins)).all()


def test_changes_along_the_grid_and_without_a_parent_equal_whole_scores():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[rng.random(300) < 0.2, 1] = np.nan
    edges = trees.cut_points(x, 9)
    made = []
    for _ in range(6):
        tree, _ = grown(rng, 12)
        made.append(trees.Tree(tree.feature, np.minimum(tree.cut, 8), tree.lost, tree.left, tree.right, tree.value))
    forest = trees.Forest(edges, 0.3, made)
    steps = [[x[:, 1] + k, x[:, 2] - k] for k in range(3)]
    for got, (a, b) in zip(forest.along(x, [1, 2], steps), steps, strict=True):
        other = x.copy()
        other[:, 1], other[:, 2] = a, b
        assert np.allclose(got, forest.probability(other))
    other = x.copy()
    other[:, [0, 3]] = 0.0
    assert np.allclose(forest.without(x, {"p": [0, 3]})["p"], np.abs(forest.probability(other) - forest.probability(x)))


def test_slopes_of_the_network_are_those_of_its_loss():
    rng = np.random.default_rng(2)
    layers, x, y = [3, 4, 3, 2], rng.normal(size=(20, 3)), (rng.random(20) < 0.5).astype(float)
    w = rng.normal(size=3 * 4 + 4 + 4 * 3 + 3 + 3 * 2 + 2)
    found = model._loss(w, layers, x, y)
    p = model.Network(w, layers).probability(x)
    assert found[0] == pytest.approx(-(y * np.log(p) + (1 - y) * np.log(1 - p)).sum())
    for i in range(len(w)):
        step = np.eye(len(w))[i] * 1e-6
        assert found[1 + i] == pytest.approx((model._loss(w + step, layers, x, y)[0] - model._loss(w - step, layers, x, y)[0]) / 2e-6, abs=1e-4)
    least = model.lowest(lambda v: (((v - 3) ** 2 * [1, 10]).sum(), 2 * (v - 3) * [1, 10]), np.zeros(2), 60, 1e-12)
    assert np.allclose(least, 3, atol=1e-4)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    data = [(f"k{i}", "abc"[i % 3], [float(v) for v in r], float(r[0] + rng.normal() > 0), 1.0 + i % 2, float(i % 4 > 0)) for i, r in enumerate(x)]
    return spark.createDataFrame(data, "app_id string, g string, x array<double>, y double, weight double, some double").withColumn("features", array_to_vector("x")).persist()


def test_fits_of_weighted_rows_side_by_side(spark, rows):
    got = model.side_by_side(rows, {"some": ("y", "some"), "twice": ("y", "weight")})
    alone = model.logistic(rows.where("some = 1"), 300)
    assert np.allclose(got["some"], np.r_[alone.intercept, alone.coefficients.toArray()])
    twice = model.logistic(rows.unionByName(rows.where("weight = 2")), 600)
    assert np.allclose(got["twice"], np.r_[twice.intercept, twice.coefficients.toArray()])
    same = model.logistic(rows.withColumn("y", F.lit(1.0)), 400)
    assert same.intercept == np.inf and not same.coefficients.toArray().any()


def test_weights_by_group_and_label_equal_those_by_row(spark, rows):
    scored = rows.select("app_id", "g", "y", (F.col("x")[1] / 6 + 0.5).alias("score"), F.lit(1.0).alias("weight"))
    groups = spark.createDataFrame([("a",), ("b",)], "group_value string")
    cells = scored.select("g", "y", "weight").distinct()
    for _ in range(2):
        cells = mitigate._weights_again(cells, scored, 0.55, 0.6, groups)
        each = mitigate.constrained_round(scored, 0.55, 0.6, groups)
        want = {(r["g"], r["y"]): r["weight"] for r in each.select("g", "y", "weight").distinct().collect()}
        got = {(r["g"], r["y"]): r["weight"] for r in cells.collect()}
        assert set(got) == {(g, y) for g, y in want} and all(got[k] == pytest.approx(v) for k, v in want.items())
        scored = each.join(scored.select("app_id", "score"), "app_id")


def test_the_grid_goes_through_one_pass_and_writes_nothing(spark):
    apps = register.applications(spark, "/root/testdata/sf0.001")
    train, test, scaler = model.prepared(apps, 2000)
    fit = model.logistic(train, train.count())
    plan = recourse.model_increase(fit, test.where("y = 1").select("app_id", "features"), scaler, 0.2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan
