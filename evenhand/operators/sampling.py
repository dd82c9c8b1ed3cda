"""Seeded stratified draws, and exact ranking measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quotas(counts: DataFrame, n: int) -> DataFrame:
    """``counts`` (stratum, rows) with ``quota``: n apportioned by largest remainders, ties to the lesser stratum."""
    if n <= 0:
        raise ValueError("n must be above 0")
    total = counts.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("total"))
    rows = counts.crossJoin(F.broadcast(total))  # one row
    n_ = F.least(F.lit(n).cast("bigint"), F.col("total"))
    rows = rows.withColumns({"base": F.floor(F.col("rows") * n_ / F.col("total")), "rest": (F.col("rows") * n_) % F.col("total"), "n": n_})
    everything = Window.partitionBy(F.lit(1))  # one row per stratum
    rows = rows.withColumns({"left": F.col("n") - F.sum("base").over(everything), "rank": F.row_number().over(everything.orderBy(F.col("rest").desc(), F.col("stratum").asc_nulls_first()))})
    return rows.select("stratum", "rows", (F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def stratified_draw(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0, parts: int = 64) -> DataFrame:
    """n rows, in proportion to the strata, chosen by a seeded hash of the key: the same at any parallelism.

    A stratum's rows are ranked within hash ranges first, each keeping no more
    than the quota, so a hot stratum is not ranked in one task.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key)))
    rows = df.withColumns({"_s": F.col(stratum), "_o": order})
    share = quotas(df.groupBy(F.col(stratum).alias("stratum")).agg(F.count("*").alias("rows")), n)
    rows = rows.join(share, F.col("_s").eqNullSafe(F.col("stratum"))).withColumn("_p", F.pmod(F.xxhash64("_o"), F.lit(parts)))
    first = Window.partitionBy("_s", "_p").orderBy("_o", key)
    rows = rows.withColumn("_r", F.row_number().over(first)).where("_r <= quota")
    last = Window.partitionBy("_s").orderBy("_o", key)
    return rows.withColumn("_r", F.row_number().over(last)).where("_r <= quota").select(*df.columns)


def exact_auc(scores: DataFrame, score: str, label: str, by: tuple[str, ...] = (), part: Column | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half, per ``by``.

    Rows are counted by distinct score first.  Running sums go by ranges of
    scores, then within a range, so no task sees them all; ``part`` numbers
    the ranges, in the order of the scores ``s`` (for scores from 0 to 1, 4,096
    even ones).  Both uses of the counts read the same columns, so Spark
    computes them once.
    """
    each = scores.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.sum((1 - F.col(label)).cast("bigint")).alias("neg"))
    each = each.withColumn("part", F.floor(F.col("s") * 4096) if part is None else part)
    parts = each.groupBy(*by, "part").agg(F.sum("neg").alias("n"), F.sum("pos").alias("p"))
    whole = Window.partitionBy(*(by or (F.lit(1),)))  # a row per range
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below_part"), F.sum("n").over(whole).alias("negatives"), F.sum("p").over(whole).alias("positives"))
    inside = Window.partitionBy(*by, "part").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    rows = each.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0))).join(parts, [*by, "part"])
    hits = F.sum(F.col("pos") * (F.col("below") + F.col("below_part") + F.col("neg") / 2.0))
    out = rows.groupBy(*by) if by else rows.groupBy()
    return out.agg(hits.alias("hits"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives")).select(
        *by, F.try_divide("hits", F.col("positives").cast("double") * F.col("negatives")).alias("auc"), "positives", "negatives"
    )


def feature_auc(df: DataFrame, features: dict, label) -> DataFrame:
    """(feature, auc): the better direction's AUC of each input alone; constants are left out, missing rows too."""
    long = df.select(label.alias("y"), F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), c.cast("double").alias("x")) for n, c in features.items()))).alias("f"))
    long = long.select("y", "f.feature", F.col("f.x").alias("x")).where("x is not null")
    spread = long.groupBy("feature").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b").select("feature")
    # Ranges by magnitude, 64 to a doubling: the values themselves are ranked.
    part = (F.floor(F.log2(1.0 + F.abs("s")) * 64) * F.signum("s")).cast("bigint")
    found = exact_auc(long.join(F.broadcast(spread), "feature"), "x", "y", ("feature",), part)  # one row per feature
    return found.select("feature", F.greatest("auc", 1.0 - F.col("auc")).alias("auc"))


def order_statistics(df: DataFrame, value: Column, places: dict[str, float], by: tuple[str, ...] = (), weight: Column | None = None) -> DataFrame:
    """(by, n, a column per place): exact quantiles with linear interpolation, and the number of values, per ``by``.

    ``places`` names quantiles from 0 to 1; ``weight`` counts a row more than
    once.  Values are counted by distinct value, then by ranges of magnitude
    (1,024 to a doubling): running sums over the ranges tell which ranges hold a
    wanted place, and only those are ranked, each in a task of its own.  Nulls
    are left out; a group without values keeps its row, with nulls.
    """
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    weight = F.lit(1) if weight is None else weight
    each = df.select(key.alias("_k"), value.cast("double").alias("_v"), weight.cast("bigint").alias("_w")).groupBy("_k", "_v")
    each = each.agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_w"))), F.lit(0)).alias("_n"))
    size = F.floor(F.least(F.log2(1.0 + F.abs("_v")), F.lit(2000.0)) * 1024) * F.signum("_v")
    part = F.when(F.isnan("_v"), F.lit(1 << 40)).otherwise(F.coalesce(size, F.lit(0.0)).cast("bigint"))
    each = each.withColumn("_part", part)
    whole = Window.partitionBy("_k")  # a row per range
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = each.groupBy("_k", "_part").agg(F.sum("_n").alias("_m"))
    parts = parts.select("_k", "_part", "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_low"), F.sum("_m").over(whole).alias("_all"))
    place = {n: F.lit(float(q)) * (F.col("_all") - 1) for n, q in places.items()}
    ends = {n: (F.floor(p), F.ceil(p)) for n, p in place.items()}
    holds = lambda i, n: (F.col("_low") <= i) & (i < F.col("_low") + F.col(n))
    wanted = F.col("_all") == 0
    for i in (i for pair in ends.values() for i in pair):
        wanted = wanted | holds(i, "_m")
    inside = Window.partitionBy("_k", "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    rows = each.join(parts.where(wanted).drop("_m"), ["_k", "_part"])
    rows = rows.withColumn("_low", F.col("_low") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    at = lambda i: F.max(F.when(holds(i, "_n"), F.col("_v")))
    found = rows.groupBy("_k").agg(F.max("_all").alias("_all"), *(at(i).alias(f"_{n}{k}") for n, pair in ends.items() for k, i in enumerate(pair)))

    def between(n: str) -> Column:
        low, high, share = F.col(f"_{n}0"), F.col(f"_{n}1"), place[n] - F.floor(place[n])
        return F.when(low == high, low).otherwise((1.0 - share) * low + share * high).alias(n)

    return found.select(*(F.col(f"_k.`{c}`").alias(c) for c in by), F.col("_all").alias("n"), *(between(n) for n in places))


def places(df: DataFrame, value: str, tie: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place by ``value``, the greatest first and ties by the lesser ``tie``.

    Rows are ranked within ranges of magnitude (1,024 to a doubling); running
    counts of the ranges carry the places on, so no task ranks all rows.
    Missing values come last.
    """
    size = F.floor(F.least(F.log2(1.0 + F.abs(value)), F.lit(2000.0)) * 1024) * F.signum(value)
    rows = df.withColumn("_part", F.coalesce(size.cast("bigint"), F.lit(-(1 << 40))))
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col(value).desc_nulls_last(), tie)
    return rows.join(parts, "_part").withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_part", "_before")
