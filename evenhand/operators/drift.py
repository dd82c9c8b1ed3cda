"""Shift of the inputs' distributions between years, by the population stability index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evenhand.functions.clean import debt_to_income_rank, income_dollars, loan_to_value, psi_term, replace_sentinels, to_float
from evenhand.operators.kept import written
from evenhand.operators.sampling import order_statistics

THRESHOLD = 0.2


def numeric_inputs() -> dict[str, Column]:
    return {"loan_amount": to_float("loan_amount"), "income": income_dollars(), "loan_to_value_ratio": loan_to_value(), "property_value": to_float("property_value"), "debt_to_income_ratio": debt_to_income_rank()}


def coded_inputs(columns: tuple[str, ...] = ("loan_type", "loan_purpose", "lien_status", "occupancy_type", "preapproval")) -> dict[str, Column]:
    return {c: replace_sentinels(c) for c in columns}


def adjacent_years(df: DataFrame) -> DataFrame:
    """(year_a, year_b) of neighbouring years that occur."""
    years = df.select(F.col("activity_year").try_cast("int").alias("year_a")).where("year_a is not null").distinct()
    return years.withColumn("year_b", F.lead("year_a").over(Window.orderBy("year_a"))).where("year_b is not null")


def bin_of(value: Column, edges: Column) -> Column:
    """Number of inner edges below the value: bins are right-closed, the outer ones open."""
    return F.size(F.filter(edges, lambda e: e < value))


def drift(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(year_a, year_b, column, psi, shifted) for every adjacent pair of years and every input.

    Numeric inputs are cut at the deciles of both years together, equal edges
    once; missing values are left out; fewer than two bins, one value alone or
    an empty side give 0.  One unpivot of value counts, written once, feeds all
    pairs and both of their uses.
    """
    return drift_from_counts(written(value_counts(df)), threshold)


#: The name of the cell that keeps a year known where all its inputs are missing.
YEAR = "year"


def cells() -> list[tuple[str, Column, Column]]:
    """(input, number, code) of every input; one of number and code is null."""
    null = F.lit(None)
    numbers = [(n, c.cast("double"), null.cast("string")) for n, c in numeric_inputs().items()]
    return [*numbers, *((n, null.cast("double"), c) for n, c in coded_inputs().items()), (YEAR, null.cast("double"), F.lit(""))]


def value_counts(df: DataFrame) -> DataFrame:
    """(year, column, x, code, n): how often each value of each input occurs, by year; one unpivot of the rows."""
    each = [F.struct(F.lit(n).alias("column"), x.alias("x"), code.alias("code")) for n, x, code in cells()]
    counts = df.select(F.col("activity_year").try_cast("int").alias("year"), F.inline(F.array(*each))).where("year is not null and (x is not null or code is not null)")
    return counts.groupBy("year", "column", "x", "code").agg(F.count("*").alias("n"))


def drift_from_counts(counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``drift`` of the rows that ``counts`` (``value_counts``, a written table) has counted."""
    years = counts.where(F.col("column") == YEAR).select(F.col("year").alias("year_a")).distinct()
    pairs = F.broadcast(years.withColumn("year_b", F.lead("year_a").over(Window.orderBy("year_a"))).where("year_b is not null"))  # a row per year
    counts = counts.where(F.col("column") != YEAR)
    sided = counts.join(pairs, (F.col("year") == F.col("year_a")) | (F.col("year") == F.col("year_b"))).withColumn("is_a", F.col("year") == F.col("year_a"))
    keys = ["year_a", "year_b", "column"]
    # Edges from the value counts, not the rows.
    deciles = {f"d{i}": i / 10 for i in range(11)}
    edges = order_statistics(sided.where("x is not null"), F.col("x"), deciles, tuple(keys), F.col("n")).select(*keys, F.array_distinct(F.array(*deciles)).alias("edges"))
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    binned = sided.where("x is not null").join(F.broadcast(edges), keys).select(*keys, "is_a", bin_of(F.col("x"), inner).cast("string").alias("bin"), "n", (F.size("edges") >= 3).alias("usable"))
    coded_rows = sided.where("code is not null").select(*keys, "is_a", F.col("code").alias("bin"), "n", F.lit(True).alias("usable"))
    sides = lambda s: F.coalesce(F.sum(F.when(F.col("is_a") == s, F.col("n"))), F.lit(0))
    bins = binned.union(coded_rows).groupBy(*keys, "bin", "usable").agg(sides(True).alias("a"), sides(False).alias("b"))
    whole = Window.partitionBy(*keys)
    shares = bins.withColumns({"ta": F.sum("a").over(whole), "tb": F.sum("b").over(whole)})
    term = F.when(F.col("usable") & (F.col("ta") > 0) & (F.col("tb") > 0), psi_term(F.try_divide(F.col("a").cast("double"), F.col("ta")), F.try_divide(F.col("b").cast("double"), F.col("tb")))).otherwise(0.0)
    psi = shares.groupBy(*keys).agg(F.sum(term).alias("psi"))
    return psi.withColumn("shifted", F.col("psi") > threshold)


def drift_counts(found: DataFrame) -> DataFrame:
    """(year_a, year_b, columns_checked, columns_shifted)."""
    return found.groupBy("year_a", "year_b").agg(F.count("*").alias("columns_checked"), F.count_if("shifted").alias("columns_shifted"))
