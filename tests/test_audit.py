"""Hand-computed numbers and boundary contracts of the audit operators."""

import pytest
from pyspark.sql import functions as F

from evenhand.functions import clean as C
from evenhand.operators import model, recourse, sampling, screen, shrink, verify
from evenhand.sources import register


def frame(spark, cells):
    rows = [(code, g, lei) for lei, g, n, denied in cells for code in ["3"] * denied + ["1"] * (n - denied)]
    return spark.createDataFrame(rows, "action_taken string, derived_sex string, lei string")


def ratios(df, **k):
    return {r["group_value"]: r for r in screen.adverse_impact(df, "derived_sex", **k).collect()}


def test_screen_by_hand(spark):
    got = ratios(frame(spark, [("L", "A", 8, 2), ("L", "B", 10, 1), ("L", "C", 5, 4), ("L", "D", 1, 0)]), floor=2)
    assert got["B"]["ratio"] == 1 and not got["B"]["flagged"]
    assert got["A"]["ratio"] == pytest.approx(0.75 / 0.9)
    assert got["C"]["flagged"] and got["C"]["ratio"] == pytest.approx(0.2 / 0.9)
    assert got["D"]["status"] == "SUPPRESSED" and got["D"]["ratio"] is None


def test_exactly_four_fifths_is_not_flagged(spark):
    got = ratios(frame(spark, [("L", "A", 10, 2), ("L", "B", 10, 0)]), floor=10)
    assert got["A"]["ratio"] == pytest.approx(0.8) and not got["A"]["flagged"]


def test_all_denied_is_undefined_and_nothing_is_dropped(spark):
    got = ratios(frame(spark, [("L", "A", 150, 150)]))
    assert got["A"]["status"] == "UNDEFINED" and not got["A"]["flagged"]
    assert ratios(frame(spark, [("L", "A", 5, 1)]))["A"]["reference_group"] == "NONE_ELIGIBLE"


def test_purchases_never_matter(spark):
    df = spark.createDataFrame([("3", "A"), ("6", "A"), ("1", "A"), (None, "A")], "action_taken string, derived_sex string")
    r = screen.group_rates(df, "derived_sex").first()
    assert (r["applications"], r["denials"], r["denial_rate"]) == (2, 1, 0.5)


def test_group_column_must_be_allowed(spark):
    with pytest.raises(ValueError, match="state"):
        screen.check_group("state")
    with pytest.raises(ValueError):
        model.check_allowed(["derived_race_x"])
    with pytest.raises(ValueError):
        screen.add_filter("not_purchased", "x", "y", lambda: F.lit(True))


def lenders(spark, each):
    return spark.createDataFrame(each, "lei string, group_value string, applications long, denials long")


def test_shrinkage_guards_and_flat_case(spark):
    flat = [(f"L{i}", g, 1000, 100) for i in range(5) for g in ("G", "R")]
    got = shrink.shrunken_gaps(lenders(spark, flat), "G", "R").collect()
    assert all(r["weight"] == 0 and r["p_above_typical"] == 0 and not r["on_watch_list"] for r in got)
    with pytest.raises(ValueError):
        shrink.shrunken_gaps(lenders(spark, flat[:4]), "G", "R")
    with pytest.raises(ValueError):
        shrink.shrunken_gaps(lenders(spark, flat), "G", "R", level=1.0)


def test_shrinkage_pulls_small_lenders_in(spark):
    each = [(f"L{i}", g, 1000, d) for i in range(20) for g, d in (("G", 150 + 10 * (i % 5)), ("R", 100))]
    each += [("SMALL", "G", 10, 6), ("SMALL", "R", 10, 1), ("LARGE", "G", 5000, 3000), ("LARGE", "R", 5000, 500)]
    got = {r["lei"]: r for r in shrink.shrunken_gaps(lenders(spark, each), "G", "R").collect()}
    assert got["SMALL"]["weight"] < got["L0"]["weight"] < got["LARGE"]["weight"]
    assert got["LARGE"]["on_watch_list"] and got["SMALL"]["raw_gap_pp"] == pytest.approx(50) and got["SMALL"]["shrunk_gap_pp"] < got["LARGE"]["shrunk_gap_pp"]


def test_normal_tail(spark):
    from statistics import NormalDist

    rows = spark.createDataFrame([(x / 4,) for x in range(-20, 21)], "z double").select("z", C.normal_tail(F.col("z")).alias("t")).collect()
    assert all(abs(r["t"] - (1 - NormalDist().cdf(r["z"]))) < 1e-7 for r in rows)


def test_debt_to_income_raises_on_unmapped(spark):
    with pytest.raises(ValueError, match="17"):
        C.check_debt_to_income(spark.createDataFrame([("17",), ("NA",)], "debt_to_income_ratio string"))


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(0.1, 0), (0.5, 1), (0.5, 0), (0.9, 1)], "s double, y int")
    assert sampling.exact_auc(df, "s", "y").first()["auc"] == pytest.approx(3.5 / 4)


def test_quotas_and_draw(spark):
    counts = spark.createDataFrame([("a", 5), ("b", 3), (None, 2)], "stratum string, rows long")
    assert sum(r["quota"] for r in sampling.quotas(counts, 7).collect()) == 7
    df = spark.createDataFrame([(str(i), "ab"[i % 2]) for i in range(10)], "k string, s string")
    assert sampling.stratified_draw(df, "s", "k", 4).count() == 4
    assert sampling.stratified_draw(df, "s", "k", 99).count() == 10
    with pytest.raises(ValueError):
        sampling.quotas(counts, 0)


def test_parity_sees_a_changed_row(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    b = spark.createDataFrame([("x", 1), ("y", 3)], "k string, n int")
    assert verify.table_parity(a, b, ["k"], ["n"]).first()["mismatched"] == 1


def test_recourse_of_a_step(spark):
    df = spark.createDataFrame([("a", 50_000.0), ("b", 90_500.0), ("c", 5e6)], "app_id string, inc double")
    got = {r["app_id"]: r["increase"] for r in recourse.required_increase(df, lambda x: F.when(F.col("inc") + x < 91_000, 1.0).otherwise(0.0), 0.5).collect()}
    assert got == {"a": 41_000.0, "b": 1_000.0, "c": 0.0}


def test_controlled_gap_recovers_no_residual(spark):
    import numpy as np

    rng, rows = np.random.default_rng(0), []
    for g, mean in (("A", 120), ("B", 70)):
        income = rng.normal(mean, 25, 3000).clip(10)
        p = 1 / (1 + np.exp(2.5 + 0.02 * (income - 100)))
        rows += [("3" if d else "1", g, f"{i:.3f}", "80", "<20%", "1", "1") for i, d in zip(income, rng.random(3000) < p)]
    df = spark.createDataFrame(rows, "action_taken string, derived_race string, income string, loan_to_value_ratio string, debt_to_income_ratio string, loan_purpose string, lien_status string")
    raw = df.groupBy("derived_race").agg(F.avg(C.denied()).alias("r")).orderBy("derived_race").collect()
    gap = model.controlled_gap(df, "derived_race", "B", "A")
    assert 100 * (raw[1]["r"] - raw[0]["r"]) > 5 and abs(gap) < 2.5


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "CA_2023.csv").write_text('x,y\n1,"a,b"\nNA,\n')
    assert register.csv_to_parquet(spark, str(tmp_path / "a"), str(tmp_path / "p")) == 2
    assert [t for _, t in spark.read.parquet(str(tmp_path / "p")).dtypes] == ["string", "string"]
    assert register.manifest(spark, str(tmp_path / "a")).first()["bytes"] == (tmp_path / "a" / "CA_2023.csv").stat().st_size
    assert register.load_parquet_dir(spark, str(tmp_path / "p"), str(tmp_path / "t")) == 2
    with pytest.raises(ValueError, match="missing"):
        register.open_source(spark.range(1), "x")
    with pytest.raises(ValueError):
        register.releasable(spark.createDataFrame([("L",)], "lei string"))
    with pytest.raises(ValueError, match="z"):
        register.same_header({"a": spark.range(1).toDF("x"), "b": spark.range(1).toDF("z")})


def test_incremental_ingest_reads_once(spark, tmp_path):
    from evenhand.streaming.ingest import ingest_new

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.csv").write_text("a,b\n1,2\n")
    run = lambda: ingest_new(spark, str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "c"), ["a", "b"])
    assert run() == 1 and run() == 0
    (tmp_path / "in" / "two.csv").write_text("a,b\n3,4\n")
    assert run() == 1 and spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_comparison_defaults():
    from inspect import signature

    from evenhand.operators import mitigate

    p = signature(mitigate.compare).parameters
    assert (p["rounds"].default, p["trees"].default) == (8, 300)


def test_draw_of_more_than_there_is_takes_all(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("app_id"), F.lit("2001").alias("activity_year"))
    assert sampling.stratified_draw(rows, "activity_year", "app_id", 1_500_000, 0).count() == 50
