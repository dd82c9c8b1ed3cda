"""Counts and summaries of the register's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.clean import sentinels


def sentinel_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, sentinel, rows) for every pair, zero included, and a TOTAL row per column; one scan."""
    pairs = [(c, s) for c in columns for s in sentinels(c)]
    one = df.agg(*(F.count_if(F.col(c) == s).alias(f"n{i}") for i, (c, s) in enumerate(pairs)), F.count("*").alias("all"))
    each = [F.struct(F.lit(c).alias("column"), F.lit(s).alias("sentinel"), F.col(f"n{i}").alias("rows")) for i, (c, s) in enumerate(pairs)]
    totals = [F.struct(F.lit(c).alias("column"), F.lit("TOTAL").alias("sentinel"), F.col("all").alias("rows")) for c in columns]
    return one.select(F.inline(F.array(*each, *totals)))


def dictionary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, type, distinct_values, null_rows, sentinel_rows): one scan; values are counted apart by column."""
    one = df.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("d", F.countDistinct), ("n", lambda c: F.count_if(F.col(c).isNull())), ("s", lambda c: F.count_if(F.col(c).isin(sentinels(c)))))))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("type"), F.col(f"d{i}").alias("distinct_values"), F.col(f"n{i}").alias("null_rows"), F.col(f"s{i}").alias("sentinel_rows")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def share_of(df: DataFrame, column: str, value: str) -> DataFrame:
    """Share of rows with a value; 0 for an empty frame."""
    return df.agg(F.coalesce(F.try_divide(F.count_if(F.col(column) == value).cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("share"))


def suspicious_code(df: DataFrame, column: str) -> DataFrame:
    """(value, n, ratio): each integer code's count against the mean of its neighbours'.

    The distinct codes are few against the rows; the window is over those.
    """
    hist = df.select(F.col(column).try_cast("bigint").alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    w = Window.orderBy("value")
    return hist.select("value", "n", F.lag("n").over(w).alias("before"), F.lead("n").over(w).alias("after")).select(
        "value", "n", F.try_divide(F.col("n").cast("double"), (F.coalesce("before", "after") + F.coalesce("after", "before")) / 2.0).alias("ratio")
    )


def missing_gap(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, missing_denied, missing_other, gap): missing rates by outcome, one scan."""
    from evenhand.functions.clean import to_float

    is_denied = F.col("action_taken") == "3"
    one = df.agg(*(F.avg(F.when(is_denied if k == "d" else ~is_denied, to_float(c).isNull().cast("double"))).alias(f"{k}{i}") for i, c in enumerate(columns) for k in "do"))
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("missing_denied"), F.col(f"o{i}").alias("missing_other"), (F.col(f"d{i}") - F.col(f"o{i}")).alias("gap")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def summary_over_seeds(runs: DataFrame, by: str, value: str) -> DataFrame:
    """(by, mean, sd, low, high) rounded to 4; a null value (an undefined cut) is left out."""
    v = F.col(value)
    return runs.groupBy(by).agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.stddev_samp(v), 4).alias("sd"), F.round(F.min(v), 4).alias("low"), F.round(F.max(v), 4).alias("high"))


def sketches(df: DataFrame, column: str, by: list[str], bits: int = 15) -> DataFrame:
    """(by, rows, sketch): an HLL sketch of a column's distinct values per cell of ``by``, to be stored and united."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.hll_sketch_agg(column, bits).alias("sketch"))


def distinct_from_sketches(stored: DataFrame, by: list[str]) -> DataFrame:
    """(by, rows, estimate) for any coarser cells, without another look at the rows."""
    return stored.groupBy(*by).agg(F.sum("rows").alias("rows"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
