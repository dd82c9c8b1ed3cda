"""Streamed ingest, digests of files, cubes, sketches, buckets and digest parity."""

import hashlib
import tracemalloc

import duckdb
import pytest
from pyspark.sql import functions as F

from evenhand.operators import drift, profile, screen, verify
from evenhand.plans import audit
from evenhand.sources import digests, register
from evenhand.streaming.ingest import ingest_register

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def apps(spark):
    return register.applications(spark, DATA).persist()


def rows(df):
    return sorted(map(repr, df.select(sorted(df.columns)).collect()))


def test_ingest_outlives_broken_files(spark, tmp_path):
    place = {n: f"file://{tmp_path}/{n}" for n in ("in", "table", "aside", "checkpoint")}
    run = lambda: ingest_register(spark, place["in"], place["table"], place["aside"], place["checkpoint"], ["a", "b"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "CA_2020.csv").write_text('a,b\n1,"x, ""y"""\n2,\n')
    (tmp_path / "in" / "notes.txt").write_text("not a table")
    assert run() == 1 and run() == 0
    (tmp_path / "in" / "NY_2020.csv").write_text("a,b\n3,z\n")
    (tmp_path / "in" / "TX_2020.csv").write_text("a,c\n4,z\n")  # another header
    (tmp_path / "in" / "WA_2020.csv.gz").write_bytes(b"\x1f\x8b broken")
    assert run() == 3 and run() == 0
    table = spark.read.parquet(place["table"])
    assert sorted((r["a"], r["b"], r["file"]) for r in table.collect()) == [("1", 'x, "y"', "CA_2020.csv"), ("2", None, "CA_2020.csv"), ("3", "z", "NY_2020.csv")]
    aside = spark.read.json(place["aside"]).collect()
    assert sorted(r["file"].rpartition("/")[2] for r in aside) == ["TX_2020.csv", "WA_2020.csv.gz"] and all(r["reason"] for r in aside)
    (tmp_path / "in" / "OR_2020.csv").write_text("b\n")  # alone in its batch
    assert run() == 1 and run() == 0 and spark.read.parquet(place["table"]).count() == 3 and spark.read.json(place["aside"]).count() == 3


def test_digests_equal_duckdb(spark):
    want = duckdb.sql(f"select size, parse_filename(filename), sha256(content) from read_blob('{DATA}/*.parquet')").fetchall()
    assert sorted(map(tuple, register.manifest(spark, DATA).collect())) == sorted(want)


def test_digest_holds_a_piece_of_a_large_file(spark, tmp_path):
    size = 400 << 20
    with open(tmp_path / "sparse.bin", "wb") as f:
        f.truncate(size)
    (tmp_path / "_hidden").write_text("x")
    reader = digests.DigestReader(str(tmp_path))
    (part,) = reader.partitions()
    tracemalloc.start()
    ((n, name, digest),) = reader.read(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    h = hashlib.sha256()
    for _ in range(size >> 20):
        h.update(bytes(1 << 20))
    assert (n, name, digest) == (size, "sparse.bin", h.hexdigest()) and peak < 4 * digests.PIECE
    (tmp_path / "none").mkdir()
    assert register.manifest(spark, str(tmp_path / "none")).count() == 0


def test_cubes_add_up_and_the_register_is_read_once(apps):
    df = register.applications(apps.sparkSession, DATA)
    whole = audit.cube(df)
    assert df.select(*audit.NEEDED)._jdf.queryExecution().optimizedPlan().toString().count("l_orderkey#") >= 1
    parts = [audit.cube(df.where(w)) for w in ("action_taken = '3'", "action_taken <> '3' or action_taken is null")]
    assert rows(audit.merged(*parts)) == rows(whole)
    found = audit.full_audit(df)
    for name in ("waterfall", "screen", "flagged", "drift"):
        assert "lineitem" not in found[name]._jdf.queryExecution().toString(), name
    assert rows(found["screen"]) == rows(screen.lender_screen(apps))
    assert rows(found["waterfall"]) == rows(screen.waterfall(apps, list(screen.FILTERS)))
    assert rows(found["drift"]) == rows(drift.drift_counts(drift.drift(apps)))
    empty = audit.from_cube(audit.cube(apps.where("false")))
    assert {n: d.count() for n, d in empty.items()} == {"waterfall": len(screen.FILTERS) + 1, "screen": 0, "flagged": 0, "drift": 0}


def test_a_year_without_values_keeps_its_place(spark, apps):
    names = [n for n, _, _ in drift.cells() if n != drift.YEAR]
    lost = apps.where("activity_year in ('1995', '1996', '1997')")
    for n in names:
        lost = lost.withColumn(n, F.when(F.col("activity_year") == "1996", F.lit("NA")).otherwise(F.col(n)))
    pairs = {(r["year_a"], r["year_b"]) for r in drift.drift(lost).collect()}
    assert pairs == {(1995, 1996), (1996, 1997)}


def test_sketches_unite(apps):
    stored = profile.sketches(apps, "app_id", ["activity_year", "state_code"])
    for by in (["activity_year"], ["state_code"], []):
        exact = {tuple(r)[:-1]: r[-1] for r in apps.groupBy(*by).agg(F.countDistinct("app_id")).collect()}
        for r in profile.distinct_from_sketches(stored, by).collect():
            assert abs(r["estimate"] - exact[tuple(r)[: len(by)]]) <= 0.02 * exact[tuple(r)[: len(by)]]


def test_buckets_spare_the_exchange(spark, apps):
    table = register.bucketed(apps.select("lei", "action_taken", *screen.PROTECTED), "bucketed_register", 4)
    try:
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        counts = table.groupBy("lei").count()
        assert "Exchange" not in plan(counts) and "Exchange" in plan(apps.groupBy("lei").count())
        assert "Exchange" not in plan(screen.lender_screen(table))
        assert rows(screen.lender_screen(table)) == rows(screen.lender_screen(apps))
        one = spark._jvm.PythonSQLUtils.explainString(table.where("lei = 'L000001'").groupBy("lei").count()._jdf.queryExecution(), "formatted")
        assert "SelectedBucketsCount: 1 out of 4" in one
    finally:
        spark.sql("drop table bucketed_register")


def test_equal_tables_join_nothing(spark):
    a = spark.range(5000).select("id", (F.col("id") % 7).alias("v"))
    counts, odd = verify.parity_by_digests(a, a.orderBy(F.desc("id")), ["id"], ["v"], 64)
    assert tuple(counts.first()) == (0, 0, 0, 5000) and odd.count() == 0
    assert "Join" not in odd._jdf.queryExecution().optimizedPlan().toString()
    b = a.where("id <> 17").withColumn("v", F.when(F.col("id") == 4000, 99).otherwise(F.col("v"))).union(spark.range(9000, 9001).select("id", F.lit(1)))
    counts, odd = verify.parity_by_digests(a, b, ["id"], ["v"], 64)
    assert tuple(counts.first()) == tuple(verify.table_parity(a, b, ["id"], ["v"]).first()) == (1, 1, 1, 4998)
    assert sorted((r["id"], r["side"]) for r in odd.collect()) == [(17, "only_left"), (4000, "mismatched"), (9000, "only_right")]


def test_headers_of_files(spark, tmp_path):
    for name, columns in (("CA_2020", "1 as a, 2 as b"), ("NY_2020", "1 as a, 2 as c")):
        spark.sql(f"select {columns}").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    found = register.headers(spark, str(tmp_path))
    assert found.count() == 4
    assert sorted(map(tuple, register.columns_on_one_side(found).collect())) == [("b", 1), ("c", 1)]


def test_recounts_leave_no_view_behind(spark, apps):
    before = {t.name for t in spark.catalog.listTables()}
    assert verify.recount(apps).count() > 0 and {t.name for t in spark.catalog.listTables()} == before
