"""Empirical-Bayes shrinkage of lenders' gaps, and the watch list."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.clean import normal_tail
from evenhand.operators.kept import written


def both_groups(rates: DataFrame, group: str, reference: str, min_each: int = 5) -> DataFrame:
    """Lenders with enough of both groups, by conditional sums instead of a self-join."""
    pick = lambda g, c: F.sum(F.when(F.col("group_value") == g, F.col(c)))
    rows = rates.where(F.col("group_value").isin(group, reference)).groupBy("lei")
    rows = rows.agg(pick(group, "applications").alias("n_g"), pick(group, "denials").alias("d_g"), pick(reference, "applications").alias("n_r"), pick(reference, "denials").alias("d_r"))
    return rows.where((F.col("n_g") >= min_each) & (F.col("n_r") >= min_each))


def shrunken_gaps(rates: DataFrame, group: str, reference: str, min_each: int = 5, level: float = 0.95) -> DataFrame:
    """Each lender's gap in points, shrunk to the typical gap by DerSimonian and Laird's moments.

    Raises for a level outside (0, 1), fewer than 3 lenders, or pooled rates
    of 0 or 1 in both groups.  The moments are three sums over lenders, each
    brought back as one row.
    """
    if not 0 < level < 1:
        raise ValueError("level must be between 0 and 1")
    rows = written(both_groups(rates, group, reference, min_each))  # a row per lender, for four aggregates
    pooled = rows.agg(F.count("*").alias("k"), F.sum("n_g"), F.sum("d_g"), F.sum("n_r"), F.sum("d_r")).first()
    if pooled[0] < 3:
        raise ValueError(f"only {pooled[0]} lenders have both groups")
    p_g, p_r = pooled[2] / pooled[1], pooled[4] / pooled[3]
    if p_g * (1 - p_g) + p_r * (1 - p_r) == 0:
        raise ValueError("the pooled rates are 0 or 1 in both groups")
    gap = (F.col("d_g").cast("double") / F.col("n_g") - F.col("d_r").cast("double") / F.col("n_r")) * 100.0
    variance = (F.lit(p_g * (1 - p_g)) / F.col("n_g") + F.lit(p_r * (1 - p_r)) / F.col("n_r")) * 1e4
    rows = rows.withColumns({"gap": gap, "v": variance})
    w = F.lit(1.0) / F.col("v")
    sums = rows.agg(F.sum(w).alias("sw"), F.sum(w * F.col("gap")).alias("swg"), F.sum(w * F.col("gap") * F.col("gap")).alias("swgg"), F.sum(w * w).alias("sww")).first()
    q = sums["swgg"] - sums["swg"] ** 2 / sums["sw"]
    tau2 = max(0.0, (q - (pooled[0] - 1)) / (sums["sw"] - sums["sww"] / sums["sw"]))
    wide = F.lit(1.0) / (F.col("v") + tau2)
    mu = rows.agg(F.sum(wide * F.col("gap")) / F.sum(wide)).first()[0]
    weight = F.lit(tau2) / (F.col("v") + tau2) if tau2 > 0 else F.lit(0.0)
    rows = rows.withColumn("weight", weight)
    rows = rows.withColumns({"shrunk_gap_pp": F.col("weight") * F.col("gap") + (1.0 - F.col("weight")) * mu, "posterior_sd_pp": F.sqrt(F.col("weight") * F.col("v"))})
    z = (F.col("shrunk_gap_pp") - mu) / F.col("posterior_sd_pp")
    sure = F.col("posterior_sd_pp") > 0
    return rows.select(
        "lei", F.col("n_g").alias("n_group"), F.col("n_r").alias("n_reference"), F.col("gap").alias("raw_gap_pp"), F.sqrt("v").alias("se_pp"), "shrunk_gap_pp", "posterior_sd_pp", "weight",
        F.lit(mu).alias("mu_pp"), F.lit(tau2**0.5).alias("tau_pp"),
        F.when(sure, normal_tail(-z)).otherwise(0.0).alias("p_above_typical"),
        F.when(sure, z >= NormalDist().inv_cdf(level)).otherwise(False).alias("on_watch_list"),
    )


def watch_summary(gaps: DataFrame, flagged: DataFrame, flagged_any: DataFrame) -> DataFrame:
    """Counts of the watch list and of its overlap with lenders flagged with and without a floor."""
    f1, f2 = (x.select("lei").distinct().withColumn(c, F.lit(True)) for x, c in ((flagged, "f1"), (flagged_any, "f2")))
    rows = gaps.select("lei", "mu_pp", "tau_pp", "on_watch_list", F.lit(True).alias("scored")).join(f1, "lei", "full_outer").join(f2, "lei", "full_outer")
    w, a, b = (F.coalesce(c, F.lit(False)) for c in ("on_watch_list", "f1", "f2"))
    return rows.agg(
        F.count_if(F.coalesce("scored", F.lit(False))).alias("scored"), F.max("mu_pp").alias("mu_pp"), F.max("tau_pp").alias("tau_pp"), F.count_if(w).alias("watch"),
        F.count_if(a).alias("flagged_floor"), F.count_if(b).alias("flagged_any"), F.count_if(w & a).alias("both_floor"), F.count_if(w & ~a).alias("watch_only"), F.count_if(a & ~w).alias("flagged_only"), F.count_if(w & b).alias("both_any"),
    )
