"""Guards and checks: allowed inputs, required columns, releases, parity, provenance, exact ranks, file checks."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evenhand.functions import clean
from evenhand.operators import mitigate, model, sampling, verify
from evenhand.sources import register


@pytest.fixture(scope="module")
def apps(spark):
    return register.applications(spark, "/root/testdata/sf0.001")


@pytest.mark.parametrize(
    ("name", "why"),
    [(n, "leaking") for n in model.LEAKING]
    + [(n, "proxy") for n in model.PROXIES]
    + [(f"{p}{s}", "protected") for p in ("applicant_", "co-applicant_") for s in ("race-1", "race_observed", "ethnicity-5", "sex", "age", "age_above_62")]
    + [(f"derived_{s}", "protected") for s in ("race", "ethnicity", "sex")]
    + [("Derived_RACE", "protected"), ("INTEREST_RATE", "leaking"), ("lei", "unknown"), ("state_code", "unknown"), ("activity_year", "unknown")],
)
def test_inputs_that_are_refused(name, why):
    assert model.family(name) == why
    with pytest.raises(ValueError, match=why):
        model.check_allowed(["loan_amount", name])


def test_inputs_that_are_allowed():
    assert len(model.ALLOWED) == len(set(model.ALLOWED)) == 16
    assert model.check_allowed(list(model.ALLOWED)) == list(model.ALLOWED)


def test_required_columns(apps):
    assert len(register.REQUIRED) == 25
    frame, n, label = register.open_source(apps, "orders")
    assert n == 6000 and label == "orders" and set(register.REQUIRED) <= set(frame.columns)
    with pytest.raises(ValueError, match="census_tract"):
        register.open_source(apps.drop("census_tract"), "orders")


def test_releases_name_no_lender(spark, tmp_path):
    ok = spark.createDataFrame([("A", 3)], "group_value string, applications long")
    register.write_release(ok, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 1
    for bad in (ok.withColumn("LEI", F.lit("x")), ok.withColumn("who", F.lit("549300ABCDEFGHIJKL12")), ok.withColumn("who", F.lit("L000012"))):
        with pytest.raises(ValueError, match="lender"):
            register.releasable(bad)
    register.write_named(ok, f"{tmp_path}/named")
    assert spark.read.csv(f"{tmp_path}/named", header=True).columns == ok.columns


def test_manifest_is_sorted_json_lines(spark, tmp_path):
    import hashlib

    (tmp_path / "AL_2023.csv").write_text("state_code,activity_year\nAL,2023\nAK,2023\n")
    register.write_manifest(register.manifest(spark, f"{tmp_path}/AL_2023.csv"), f"{tmp_path}/manifest")
    (line,) = [x for p in (tmp_path / "manifest").glob("*.json") for x in p.read_text().splitlines()]
    raw = (tmp_path / "AL_2023.csv").read_bytes()
    assert line == json.dumps({"bytes": len(raw), "file": "AL_2023.csv", "sha256": hashlib.sha256(raw).hexdigest()}, separators=(",", ":"), sort_keys=True)
    assert register.misplaced(spark.read.csv(f"{tmp_path}/AL_2023.csv", header=True)).first()[0] == 1


def test_set_differences_are_explained(spark):
    a, b, u = (spark.createDataFrame([(x,) for x in xs], "lei string") for xs in (["p", "q", "r"], ["q", "s"], ["p", "q"]))
    assert tuple(verify.set_parity(a, b, "lei", u).first()) == (3, 2, 1, 3, 1, 2)


def test_parity_looks_at_status_too(spark):
    a = spark.createDataFrame([("x", "OK", 0.5), ("y", "OK", 0.5), ("z", "SUPPRESSED", None)], "k string, status string, ratio double")
    b = spark.createDataFrame([("x", "OK", 0.5 + 1e-14), ("y", "UNDEFINED", 0.5), ("z", "SUPPRESSED", None)], "k string, status string, ratio double")
    assert tuple(verify.table_parity(a, b, ["k"], ["status", "ratio"], 1e-12).first()) == (0, 0, 1, 2)


def test_facts_count_the_inputs(apps):
    found = {r["fact"]: (r["value"], r["basis"]) for r in verify.facts(apps).collect()}
    assert found["features"] == (16.0, "declared") and found["rows"] == (6000.0, "counted")


def test_provenance_needs_a_label(spark):
    df = spark.range(1)
    assert verify.with_provenance(df, "orders", 7, 3, 1).first()["source_rows"] == 7
    with pytest.raises(ValueError, match="label"):
        verify.with_provenance(df, "", 7)


def test_exact_auc_against_pairs(spark):
    rng = np.random.default_rng(1)
    y, x = rng.integers(0, 2, 300), np.round(rng.normal(size=300) * 10.0 ** rng.integers(-3, 9, 300), 1)
    x[:40] = 7.0
    pairs = [(a > b) + (a == b) / 2 for a, i in zip(x, y) if i for b, j in zip(x, y) if not j]
    df = spark.createDataFrame([(float(a), int(i)) for a, i in zip(x, y)], "x double, y int")
    want = float(np.mean(pairs))
    assert sampling.feature_auc(df, {"x": F.col("x"), "one": F.lit(1.0)}, F.col("y")).collect()[0]["auc"] == pytest.approx(max(want, 1 - want))
    unit = df.withColumn("s", 1 / (1 + F.exp(-F.col("x") / 100)))
    got = sampling.exact_auc(unit, "s", "y").first()
    with np.errstate(over="ignore"):
        s = 1 / (1 + np.exp(-x / 100))
    assert got["auc"] == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a, i in zip(s, y) if i for b, j in zip(s, y) if not j]))
    assert (got["positives"], got["negatives"]) == (int(y.sum()), int((1 - y).sum()))


def test_debt_to_income_rank_of_every_form(spark):
    given = {"<20%": 0, "20%-<30%": 1, "30%-<36%": 2, "36": 3, "49": 16, "12": 3, "90": 16, "50%-60%": 17, ">60%": 18, "NA": None, "Exempt": None, "": None, "odd": None, " 40 ": 7}
    df = spark.createDataFrame([(k,) for k in given], "debt_to_income_ratio string")
    assert {r[0]: r[1] for r in df.select("debt_to_income_ratio", clean.debt_to_income_rank()).collect()} == given


def test_controlled_gaps_come_with_the_share_without_a_race(apps):
    rows = model.controlled_disparity(apps, "derived_race").collect()
    share = apps.where("action_taken <> '6'").agg(F.avg((F.col("derived_race") == "Race Not Available").cast("int"))).first()[0]
    assert [r["race_not_reported_share"] for r in rows] == pytest.approx([share] * len(rows))
    assert all((r["raw_gap_pp"] is None) == (r["status"] != "OK") for r in rows)


def test_order_statistics_equal_percentiles(spark):
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 0.0, -1e9, 1e12, rng.gauss(0, 5), rng.random(), -rng.random() * 1e-6]), rng.randint(1, 3)) for _ in range(400)]
    df = spark.createDataFrame([*rows, ("empty", None, 1)], "g string, v double, w int")
    places = {"low": 0.0, "third": 1 / 3, "half": 0.5, "high": 0.97, "top": 1.0}
    for weight in (None, F.col("w")):
        got = {r["g"]: tuple(r)[1:] for r in sampling.order_statistics(df, F.col("v"), places, ("g",), weight).collect()}
        frequency = F.lit(1) if weight is None else weight
        want = df.groupBy("g").agg(F.sum(F.when(F.col("v").isNotNull(), frequency).otherwise(0)), *(F.percentile("v", p, frequency) for p in places.values())).collect()
        assert set(got) == {"a", "b", None, "empty"}
        for r in want:
            assert got[r["g"]][0] == r[1]
            for a, b in zip(got[r["g"]][1:], tuple(r)[2:], strict=True):
                assert (a is None and b is None) or a == pytest.approx(b, rel=1e-12)
    assert tuple(sampling.order_statistics(df.where("g = 'empty'"), F.col("v"), {"m": 0.5}).first()) == (0, None)
    assert sampling.order_statistics(df.where("false"), F.col("v"), {"m": 0.5}).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),), (1.0,), (2.0,)], "v double")
    assert sampling.order_statistics(odd, F.col("v"), {"m": 0.5}).first()["m"] == 2.0


def test_folder_of_files_with_other_columns(spark, tmp_path):
    spark.createDataFrame([("1", "x")], "a string, b string").write.parquet(f"{tmp_path}/in/one")
    spark.createDataFrame([("z", "2")], "c string, a string").write.parquet(f"{tmp_path}/in/two")
    for _ in range(2):  # a second run gives the same table
        assert register.load_parquet_dir(spark, f"{tmp_path}/in/*", f"{tmp_path}/out") == 2
    rows = {(r["a"], r["b"], r["c"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert rows == {("1", "x", None), ("2", None, "z")}
    with pytest.raises(ValueError, match="'b', 'c'"):
        register.same_header({"one": spark.read.parquet(f"{tmp_path}/in/one"), "two": spark.read.parquet(f"{tmp_path}/in/two")})


def test_frame_by_name(spark):
    register.register(spark.createDataFrame([("3",)], "action_taken string"), "by_name")
    assert register.from_catalog(spark, "by_name").count() == 1


def test_full_audit_agrees_with_its_parts(apps):
    from evenhand.plans.audit import full_audit

    found = full_audit(apps)
    assert set(found) == {"waterfall", "screen", "flagged", "controlled", "drift"}
    screened = found["screen"].where("flagged").select("lei").distinct().count()
    assert found["flagged"].count() == screened
    assert found["drift"].where("columns_checked <> 10").count() == 0
    controlled = {r["group_value"]: r for r in found["controlled"].collect()}
    assert sum(r["status"] == "REFERENCE" for r in controlled.values()) == 1


def test_controlled_gaps_of_lenders_without_both_groups_are_not_estimable(apps):
    found = model.lender_controlled_gaps(apps, ["nobody"], "derived_race", "BUILDING", "FURNITURE").first()
    assert tuple(found) == ("nobody", None, False)


def test_comparison_of_techniques(apps):
    found = {r["technique"]: r for r in mitigate.compare(apps, 1998, rounds=2, trees=2, floor=10).collect()}
    assert set(found) == {"baseline", "reweighing", "constrained", "group_cutoffs"}
    base = found["baseline"]
    assert base["gap_cut_pp"] == 0 and base["accuracy_change"] == 0 and base["margin_change"] == 0
    for r in found.values():
        assert r["gap_cut_pp"] == pytest.approx(base["approval_gap_pp"] - r["approval_gap_pp"]) and 0 <= r["approval_rate"] <= 1
