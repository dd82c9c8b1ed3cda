"""The full audit from one mergeable cube of counts.

The cube counts what every branch needs in one pass: rows by lender, group and
outcome for the screen, by year and value for drift, by the filters they pass
for the waterfall.  Cubes of arriving files add up, so a new file is counted
alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.operators import drift, model, screen
from evenhand.operators.kept import written

#: Columns that the audit reads of the register.
NEEDED = [
    "app_id", "action_taken", "lei", *screen.PROTECTED, "activity_year", "income", "debt_to_income_ratio", "loan_to_value_ratio", "property_value", "loan_amount",
    "loan_type", "loan_purpose", "lien_status", "occupancy_type", "preapproval",
]
KEYS = ["part", "owner", "column", "value", "x", "mark"]


def cube(df: DataFrame) -> DataFrame:
    """(part, owner, column, value, x, mark, n): the counts of ``df``, small against its rows.

    part ``screen``: owner is the lender, column and value the group, mark 1
    for denials; part ``values``: owner is the year, value or x the input's;
    part ``passes``: mark has a bit for each filter that a row passes.
    """
    text, number = lambda c: c.cast("string"), lambda c: c.cast("double")
    null = F.lit(None)

    def cell(part: str, owner, column, value, x, mark):
        return F.struct(F.lit(part).alias("part"), text(owner).alias("owner"), text(column).alias("column"), text(value).alias("value"), number(x).alias("x"), mark.cast("int").alias("mark"))

    known = (F.col("action_taken") != "6") & F.col("lei").isNotNull()
    denied = F.when(F.col("action_taken") == "3", 1).otherwise(0)
    year = F.col("activity_year").try_cast("int")
    cells = [F.when(known, cell("screen", F.col("lei"), F.lit(c), F.col(c), null, denied)) for c in screen.PROTECTED]
    cells += [F.when(year.isNotNull() & (value.isNotNull() | x.isNotNull() | (F.lit(n) == drift.YEAR)), cell("values", year, F.lit(n), value, x, F.lit(0))) for n, x, value in drift.cells()]
    bits = sum((F.when(F.coalesce(f[2](), F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(screen.FILTERS.values())), F.lit(0))
    cells.append(cell("passes", null, null, null, null, bits))
    rows = df.select(F.inline(F.filter(F.array(*cells), lambda c: c.isNotNull())))
    return rows.groupBy(*KEYS).agg(F.count("*").alias("n"))


def merged(*cubes: DataFrame) -> DataFrame:
    """The cube of all their rows together."""
    return reduce(DataFrame.unionByName, cubes).groupBy(*KEYS).agg(F.sum("n").alias("n"))


def from_cube(counts: DataFrame, floor: int = 100) -> dict[str, DataFrame]:
    """Waterfall, screen, flagged lenders and drift, without another look at the rows."""
    seen = counts.where("part = 'screen'").groupBy(F.col("owner").alias("lei"), F.col("column").alias("group_column"), F.col("value").alias("group_value"))
    rates = screen.with_rates(seen.agg(F.sum("n").alias("applications"), F.sum(F.col("n") * F.col("mark")).alias("denials")))
    rows = screen.screened(rates, ("lei", "group_column"), floor)
    values = counts.where("part = 'values'").select(F.col("owner").cast("int").alias("year"), "column", "x", F.col("value").alias("code"), "n")
    names = list(screen.FILTERS)
    steps, passed = [F.lit(True)], 0
    for i in range(len(names)):
        passed |= 1 << i
        steps.append(F.col("mark").bitwiseAND(passed) == passed)
    one = counts.where("part = 'passes'").agg(*(F.coalesce(F.sum(F.when(s, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, s in enumerate(steps)))
    fall = [F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), F.col(f"n{max(i - 1, 0)}").alias("rows_before"), F.col(f"n{i}").alias("rows_after")) for i, n in enumerate(["raw", *names])]
    return {"waterfall": one.select(F.inline(F.array(*fall))), "screen": rows, "flagged": screen.flagged_lenders(rows), "drift": drift.drift_counts(drift.drift_from_counts(values))}


def full_audit(df: DataFrame, floor: int = 100) -> dict[str, DataFrame]:
    """Results by name: the register is read once, into a written projection; all but the controlled gaps come from its cube."""
    rows = written(df.select(*NEEDED))
    return from_cube(written(cube(rows)), floor) | {"controlled": model.controlled_disparity(rows)}


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """(branch, name, value): the audit in long form, without naming a lender."""
    n = lambda c: F.col(c).cast("bigint").alias("value")
    parts = [
        found["waterfall"].select(F.lit("waterfall").alias("branch"), F.col("filter").alias("name"), n("rows_after")),
        found["screen"].groupBy("status").agg(F.count("*").alias("c")).select(F.lit("screen").alias("branch"), F.col("status").alias("name"), n("c")),
        found["flagged"].agg(F.count("*").alias("c")).select(F.lit("flagged").alias("branch"), F.lit("lenders").alias("name"), n("c")),
        found["drift"].select(F.lit("drift").alias("branch"), F.concat_ws("-", "year_a", "year_b").alias("name"), n("columns_shifted")),
    ]
    return reduce(DataFrame.union, parts)
