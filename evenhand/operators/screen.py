"""Rates by group, and the four-fifths screen built on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that may be grouped by.
PROTECTED = ("derived_race", "derived_ethnicity", "derived_sex")
#: Labels that name no group (fixed values).
NO_GROUP = ("Race Not Available", "Joint", "Free Form Text Only", "NA", "")
FLOOR, THRESHOLD = 100, 0.8

FILTERS: dict[str, tuple[str, str, Callable[[], Column]]] = {}


def add_filter(name: str, column: str, rule: str, keep: Callable[[], Column]) -> None:
    """A named filter; a name is given once."""
    if name in FILTERS:
        raise ValueError(f"filter {name} exists")
    FILTERS[name] = (column, rule, keep)


add_filter("not_purchased", "action_taken", "drop purchased loans (6) and null codes", lambda: F.col("action_taken") != "6")
add_filter("decisions_only", "action_taken", "keep originated, approved and denied (1, 2, 3)", lambda: F.col("action_taken").isin("1", "2", "3"))
add_filter("income_known", "income", "drop missing income", lambda: F.col("income") != "NA")
add_filter("lender_known", "lei", "drop rows without a lender", lambda: F.col("lei").isNotNull())


def keep(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        if n not in FILTERS:
            raise ValueError(f"no filter {n}; there are {sorted(FILTERS)}")
        df = df.where(FILTERS[n][2]())
    return df


def check_group(column: str) -> str:
    if column not in PROTECTED:
        raise ValueError(f"{column} is not one of {PROTECTED}")
    return column


def group_rates(df: DataFrame, group: str, by: tuple[str, ...] = (), lei: str | None = None, decisions: bool = False) -> DataFrame:
    """Applications, denials and rates by group (and ``by``); combined map-side."""
    check_group(group)
    df = keep(df, "decisions_only" if decisions else "not_purchased")
    if lei is not None:
        df = df.where(F.col("lei") == lei)
    return with_rates(df.groupBy(*by, F.col(group).alias("group_value")).agg(F.count("*").alias("applications"), F.sum(F.when(F.col("action_taken") == "3", 1).otherwise(0)).alias("denials")))


def with_rates(counts: DataFrame) -> DataFrame:
    denied = F.coalesce(F.try_divide(F.col("denials").cast("double"), F.col("applications").cast("double")), F.lit(0.0))
    return counts.withColumns({"denial_rate": denied, "approval_rate": F.lit(1.0) - denied})


def all_group_rates(df: DataFrame, by: tuple[str, ...] = ("lei",), decisions: bool = False) -> DataFrame:
    """Rates for the three protected columns in one scan.

    Rows are first counted by all three together, so only those counts are unpivoted.
    """
    df = keep(df, "decisions_only" if decisions else "not_purchased")
    cells = df.groupBy(*by, *PROTECTED).agg(F.count("*").alias("n"), F.sum(F.when(F.col("action_taken") == "3", 1).otherwise(0)).alias("d"))
    long = cells.select(*by, "n", "d", F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in PROTECTED))).alias("g"))
    return with_rates(
        long.groupBy(*by, F.col("g.c").alias("group_column"), F.col("g.v").alias("group_value")).agg(F.sum("n").alias("applications"), F.sum("d").alias("denials"))
    )


def screened(rates: DataFrame, by: tuple[str, ...] = (), floor: int = FLOOR, threshold: float = THRESHOLD) -> DataFrame:
    """Each group against the best-approved group above the floor, among rows that agree in ``by``.

    Ties go to the least group value, null last.  Below the floor, or without
    a group above it: SUPPRESSED.  A reference rate of 0: UNDEFINED.  No row
    is dropped.
    """
    clears = F.col("applications") >= floor
    order = Window.partitionBy(*(by or (F.lit(1),))).orderBy(clears.desc(), F.col("approval_rate").desc(), F.col("group_value").asc_nulls_last())
    best = lambda c: F.first(c).over(order)
    rows = rates.withColumns({"any_clears": best(clears), "best_group": best("group_value"), "best_rate": best("approval_rate")})
    status = F.when(~clears | ~F.col("any_clears"), "SUPPRESSED").when(F.col("best_rate") == 0, "UNDEFINED").otherwise("OK")
    rows = rows.withColumn("status", status)
    ratio = F.when(F.col("status") == "OK", F.try_divide("approval_rate", "best_rate"))
    return rows.withColumns(
        {
            "ratio": ratio,
            "flagged": F.coalesce(ratio < threshold, F.lit(False)),
            "reference_group": F.when(F.col("any_clears"), F.col("best_group")).otherwise("NONE_ELIGIBLE"),
            "reference_rate": F.when(F.col("any_clears"), F.col("best_rate")),
        }
    ).drop("any_clears", "best_group", "best_rate")


def adverse_impact(df: DataFrame, group: str, floor: int = FLOOR, lei: str | None = None, decisions: bool = False) -> DataFrame:
    return screened(group_rates(df, group, lei=lei, decisions=decisions), floor=floor)


def lender_screen(df: DataFrame, floor: int = FLOOR) -> DataFrame:
    """All lenders and protected columns: one scan, a count, and a window per lender and column."""
    return screened(all_group_rates(keep(df, "lender_known")), ("lei", "group_column"), floor)


def flagged_lenders(screen: DataFrame) -> DataFrame:
    return screen.groupBy("lei").agg(F.bool_or("flagged").alias("f"), F.sum(F.col("flagged").cast("int")).alias("flags")).where("f").select("lei", "flags")


def fixed_reference(df: DataFrame, group: str, reference: str) -> DataFrame:
    """Ratio to a group that the caller names, without a floor."""
    rates = group_rates(df, group)
    one = rates.where(F.col("group_value") == reference).select(F.col("approval_rate").alias("reference_rate"))
    return rates.crossJoin(F.broadcast(one)).select(  # one row
        "group_value", "applications", F.round("approval_rate", 4).alias("approval_rate"), F.round(F.try_divide("approval_rate", "reference_rate"), 4).alias("ratio")
    )


def decisions_only_summary(df: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Ratios on decisions alone for the three columns, with the groups below the threshold counted."""
    rows = screened(all_group_rates(df, (), decisions=True), ("group_column",), floor)
    below = rows.where(F.col("flagged"))
    named = ~F.col("group_value").isin("Free Form Text Only")
    totals = rows.groupBy("group_column").agg(F.sum("applications").alias("applications"), F.sum("denials").alias("denials"))
    counts = below.groupBy("group_column").agg(F.count("*").alias("below"), F.sum(named.cast("int")).alias("below_named"))
    return totals.join(counts, "group_column", "left").select("group_column", "applications", "denials", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("below", "below_named")))


def waterfall(df: DataFrame, names: list[str]) -> DataFrame:
    """Rows before and after each named filter, in one pass."""
    passed, columns = F.lit(True), [F.count("*").alias("n0")]
    for i, n in enumerate(names, 1):
        if n not in FILTERS:
            raise ValueError(f"no filter {n}; there are {sorted(FILTERS)}")
        passed = passed & F.coalesce(FILTERS[n][2](), F.lit(False))
        columns.append(F.count_if(passed).alias(f"n{i}"))
    one = df.agg(*columns)
    steps = [F.struct(F.lit(0).alias("step"), F.lit("raw").alias("filter"), F.col("n0").alias("rows_before"), F.col("n0").alias("rows_after"))]
    steps += [F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"n{i - 1}").alias("rows_before"), F.col(f"n{i}").alias("rows_after")) for i, n in enumerate(names, 1)]
    return one.select(F.inline(F.array(*steps)))
