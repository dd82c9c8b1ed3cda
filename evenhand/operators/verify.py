"""Checks that results agree: with each other, with a recount, and with what was claimed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.operators.kept import written


def table_parity(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float | None = None) -> DataFrame:
    """(only_left, only_right, mismatched, matched) of two tables joined on null-safe keys."""
    rows = parity_rows(left, right, keys, values, tolerance)
    return rows.agg(*(F.count_if(F.col("side") == s).alias(s) for s in ("only_left", "only_right", "mismatched", "matched")))


def parity_rows(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], tolerance: float | None = None) -> DataFrame:
    """The joined keys with ``side``; values are equal exactly, or (numbers) within the tolerance."""
    a = left.select(*(F.col(k).alias(f"{k}_a") for k in keys), *(F.col(v).alias(f"{v}_a") for v in values), F.lit(True).alias("in_a"))
    b = right.select(*(F.col(k).alias(f"{k}_b") for k in keys), *(F.col(v).alias(f"{v}_b") for v in values), F.lit(True).alias("in_b"))
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(f"{k}_a").eqNullSafe(F.col(f"{k}_b"))
    same: Column = F.lit(True)
    for v in values:
        x, y = F.col(f"{v}_a"), F.col(f"{v}_b")
        exact = tolerance is None or left.schema[v].dataType.typeName() in ("string", "boolean")
        same = same & (x.eqNullSafe(y) if exact else (x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False))))
    side = F.when(F.col("in_b").isNull(), "only_left").when(F.col("in_a").isNull(), "only_right").when(same, "matched").otherwise("mismatched")
    return a.join(b, on, "full_outer").select(*(F.coalesce(f"{k}_a", f"{k}_b").alias(k) for k in keys), side.alias("side"))


def digests(df: DataFrame, keys: list[str], values: list[str], ranges: int) -> DataFrame:
    """(range, rows, digest) of ranges of the keys' hashes: sums of row hashes, the same in any order."""
    key, row = F.xxhash64(*(F.col(k) for k in keys)), F.xxhash64(*(F.col(c) for c in [*keys, *values]))
    return df.groupBy(F.pmod(key, F.lit(ranges)).alias("range")).agg(F.count("*").alias("rows"), F.sum(row.cast("decimal(20,0)")).alias("digest"))


def parity_by_digests(left: DataFrame, right: DataFrame, keys: list[str], values: list[str], ranges: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(``table_parity``, the rows that differ), where only ranges of keys whose digests differ are joined.

    Digests are two map-side combined aggregates of ``ranges`` rows each.  If
    they all agree, no row is joined.  Agreement is that of 64-bit hashes,
    summed; types of both sides must agree.  Values are compared exactly.
    """
    a, b = digests(left, keys, values, ranges), digests(right, keys, values, ranges)
    both = written(a.join(b.toDF("range", "rows_b", "digest_b"), "range", "full_outer"))
    same = F.col("rows").eqNullSafe(F.col("rows_b")) & F.col("digest").eqNullSafe(F.col("digest_b"))
    agreed = both.agg(F.coalesce(F.sum(F.when(same, F.col("rows"))), F.lit(0)).alias("n"), F.count_if(~same).alias("apart")).first()
    if not agreed["apart"]:
        rows = left.select(*keys).limit(0).withColumn("side", F.lit(""))
    else:
        apart = F.broadcast(both.where(~same).select("range"))  # ``ranges`` numbers at most
        part = lambda df: df.withColumn("range", F.pmod(F.xxhash64(*(F.col(k) for k in keys)), F.lit(ranges))).join(apart, "range", "left_semi").drop("range")
        rows = parity_rows(part(left), part(right), keys, values)
    names = ("only_left", "only_right", "mismatched", "matched")
    counts = rows.agg(*((F.count_if(F.col("side") == s) + (agreed["n"] if s == "matched" else 0)).alias(s) for s in names))
    return counts, rows.where("side <> 'matched'")


def set_parity(left: DataFrame, right: DataFrame, key: str, undefined: DataFrame | None = None) -> DataFrame:
    """(left_size, right_size, both, differ[, explained, unexplained]) of two sets.

    With ``undefined``, the keys that have a ratio of 0 to 0, a difference is
    explained if its key is one of those.
    """
    a, b = (x.select(key).distinct().withColumn(c, F.lit(1)) for x, c in ((left, "a"), (right, "b")))
    rows, differs = a.join(b, key, "full_outer"), F.col("a").isNull() | F.col("b").isNull()
    counts = [F.count("a").alias("left_size"), F.count("b").alias("right_size"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"), F.count_if(differs).alias("differ")]
    if undefined is not None:
        rows = rows.join(undefined.select(key).distinct().withColumn("u", F.lit(1)), key, "left")
        counts += [F.count_if(differs & F.col("u").isNotNull()).alias("explained"), F.count_if(differs & F.col("u").isNull()).alias("unexplained")]
    return rows.agg(*counts)


def recount(df: DataFrame) -> DataFrame:
    """Screen counts by a second route: grouping sets instead of the unpivot."""
    from .screen import PROTECTED

    rows = df.where("action_taken <> '6' and lei is not null")
    sets = ", ".join(f"(lei, {c})" for c in PROTECTED)
    name = " ".join(f"when grouping({c}) = 0 then '{c}'" for c in PROTECTED)
    value = " ".join(f"when grouping({c}) = 0 then {c}" for c in PROTECTED)
    return df.sparkSession.sql(
        f"select lei, case {name} end as group_column, case {value} end as group_value, count(*) as applications, count_if(action_taken = '3') as denials"
        f" from {{rows}} group by grouping sets ({sets})",
        rows=rows,
    )


def totals_agree(df: DataFrame, keys: list[str]) -> DataFrame:
    """(key, parts, total, agrees): the rows by each key add up to all rows; one scan with grouping sets."""
    from functools import reduce

    total = df.agg(F.count("*").alias("total"))
    cells = df.groupBy(*keys).count()
    parts = reduce(DataFrame.union, (cells.groupBy(k).agg(F.sum("count").alias("n")).agg(F.lit(k).alias("key"), F.count("*").alias("parts"), F.coalesce(F.sum("n"), F.lit(0)).alias("sum")) for k in keys))
    return parts.crossJoin(F.broadcast(total)).select("key", "parts", "sum", "total", (F.col("sum") == F.col("total")).alias("agrees"))


def claims_hold(results: DataFrame, claims: DataFrame) -> DataFrame:
    """(name, value, passes) of claims (name, op, expected) against results (name, value); a claim without a result fails."""
    v, e = F.col("value"), F.col("expected")
    ok = F.when(F.col("op") == "=", F.abs(v - e) < 1e-9).when(F.col("op") == ">=", v >= e).when(F.col("op") == "<=", v <= e)
    return claims.join(results, "name", "left").select("name", "value", F.coalesce(ok, F.lit(False)).alias("passes"))


def facts(df: DataFrame) -> DataFrame:
    """(fact, value, basis): the table's size in single numbers, and how many inputs the models may use."""
    from .model import ALLOWED

    one = df.agg(
        F.count("*").alias("rows"), F.countDistinct("lei").alias("lenders"), F.countDistinct("activity_year").alias("years"), F.min(F.col("activity_year").try_cast("int")).alias("first_year"),
        F.max(F.col("activity_year").try_cast("int")).alias("last_year"), (F.count_if(F.col("derived_race") == "Race Not Available") / F.count("*")).alias("not_available_share"),
    )
    rows = [F.struct(F.lit(c).alias("fact"), F.col(c).cast("double").alias("value"), F.lit("counted").alias("basis")) for c in one.columns]
    declared = F.struct(F.lit("features").alias("fact"), F.lit(float(len(ALLOWED))).alias("value"), F.lit("declared").alias("basis"))
    return one.select(F.inline(F.array(*rows, declared)))


def with_provenance(df: DataFrame, label: str, rows: int, sample: int | None = None, seed: int | None = None) -> DataFrame:
    """Columns that say where a sample-based result comes from; a frame without a label is refused."""
    if not label:
        raise ValueError("a result needs the label of its source")
    return df.withColumns({"source_label": F.lit(label), "source_rows": F.lit(rows), "sample_n": F.lit(sample).cast("long"), "sample_seed": F.lit(seed).cast("int")})
