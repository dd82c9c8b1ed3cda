"""Three ways to lessen a gap, decided and measured on the same held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evenhand.functions.clean import expected_value
from evenhand.operators import model as M
from evenhand.operators.kept import dropped, stored
from evenhand.operators.sampling import order_statistics
from evenhand.operators.trees import boost

ROUNDS, STEP = 8, 2.0


def reweighing(rows: DataFrame, group: str = "g", label: str = "y") -> DataFrame:
    """(g, y, weight): P(g) P(y) / P(g, y) for each cell that occurs."""
    cells = rows.groupBy(group, label).agg(F.count("*").alias("n"))
    by_g = cells.groupBy(group).agg(F.sum("n").alias("ng"))
    by_y = cells.groupBy(label).agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n").alias("total"))
    out = cells.join(F.broadcast(by_y), label).join(by_g, group).crossJoin(F.broadcast(total))  # two labels; one row
    weight = F.col("ng").cast("double") * F.col("ny").cast("double") / F.col("total") / F.col("n")
    return out.select(F.col(group).alias("g"), F.col(label).alias("y"), weight.alias("weight"))


def group_cutoffs(train_scores: DataFrame, rate: float, floor: int = 100) -> DataFrame:
    """(g, cutoff): each eligible group's own score quantile."""
    fit = order_statistics(train_scores, F.col("score"), {"cutoff": 1.0 - rate}, ("g",))
    return fit.where((F.col("n") >= floor) & ~F.col("g").isin(*M.NO_GROUP)).select("g", "cutoff")


def decide(scored: DataFrame, cut: float, by_group: DataFrame | None = None) -> DataFrame:
    """``approve``: 1 where the score is below the cut-off, the group's own if it has one."""
    if by_group is None:
        return scored.withColumn("approve", (F.col("score") < cut).cast("int"))
    rows = scored.join(F.broadcast(by_group), "g", "left")  # a row per eligible group
    return rows.withColumn("approve", (F.col("score") < F.coalesce("cutoff", F.lit(cut))).cast("int")).drop("cutoff")


def measure(decided: DataFrame, technique: str, groups: DataFrame) -> DataFrame:
    """One row: gap of the widest pair of eligible groups, accuracy, approval rate, principal, margin per 1,000.

    One aggregate by group feeds all but the median.
    """
    paid = F.when(F.col("approve") == 1, F.col("principal"))
    each = decided.groupBy("g").agg(
        F.count("*").alias("n"), F.sum("approve").alias("yes"), F.sum((F.col("approve") == 1 - F.col("y")).cast("bigint")).alias("right"), F.sum(paid).alias("paid"), F.count(paid).alias("loans"),
    )
    each = each.join(F.broadcast(groups.select(F.col("group_value").alias("g"), F.lit(True).alias("eligible"))), "g", "left")  # a row per group
    pair = F.when(F.col("eligible"), F.struct((F.col("yes").cast("double") / F.col("n")).alias("rate"), F.col("g")))
    whole = each.agg(
        ((F.max(pair)["rate"] - F.min(pair)["rate"]) * 100.0).alias("approval_gap_pp"), F.max(pair)["g"].alias("high_group"), F.min(pair)["g"].alias("low_group"),
        (F.sum("right").cast("double") / F.sum("n") * 100.0).alias("accuracy_pct"), (F.sum("yes").cast("double") / F.sum("n")).alias("approval_rate"),
        F.coalesce(F.try_divide(F.sum("paid"), F.sum("loans")), F.lit(0.0)).alias("mean_principal"),
    )
    median = order_statistics(decided, paid, {"m": 0.5}).select(F.coalesce("m", F.lit(0.0)).alias("median_principal"))
    out = whole.crossJoin(F.broadcast(median)).select("accuracy_pct", "approval_rate", "mean_principal", "median_principal", "approval_gap_pp", "high_group", "low_group")  # one row each
    return out.select(F.lit(technique).alias("technique"), "*", (F.col("approval_rate") * 1000.0 * expected_value(F.col("mean_principal"))).alias("margin_per_1000"))


def constrained_round(scored: DataFrame, cut: float, target: float, groups: DataFrame, step: float = STEP) -> DataFrame:
    """The weights of the next round: against groups approved too rarely, renormalised to a mean of 1."""
    rates = scored.groupBy("g").agg(F.avg((F.col("score") < cut).cast("double")).alias("rate"))
    rates = rates.join(groups.select(F.col("group_value").alias("g")), "g", "left_semi")
    adjust = F.exp(F.lit(step) * (F.lit(target) - F.col("rate")))
    rows = scored.join(F.broadcast(rates), "g", "left")  # a row per group
    rows = rows.withColumn("weight", F.col("weight") * F.coalesce(F.when(F.col("y") == 0, adjust).otherwise(1.0 / adjust), F.lit(1.0))).drop("rate", "score")
    mean = rows.agg(F.avg("weight").alias("m"))
    return rows.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.col("m")).drop("m")


def _weights_again(cells: DataFrame, scored: DataFrame, cut: float, target: float, groups: DataFrame, step: float = STEP) -> DataFrame:
    """``constrained_round`` for weights that depend on group and label alone: (g, y, weight) of the next round."""
    counts = scored.groupBy("g", "y").agg(F.count("*").alias("n"), F.sum((F.col("score") < cut).cast("double")).alias("yes")).join(cells, ["g", "y"])
    rates = counts.groupBy("g").agg((F.sum("yes") / F.sum("n")).alias("rate")).join(groups.select(F.col("group_value").alias("g")), "g", "left_semi")
    adjust = F.exp(F.lit(step) * (F.lit(target) - F.col("rate")))
    weight = F.col("weight") * F.coalesce(F.when(F.col("y") == 0, adjust).otherwise(1.0 / adjust), F.lit(1.0))
    counts = counts.join(rates, "g", "left").withColumn("weight", weight)
    mean = counts.agg((F.sum(F.col("weight") * F.col("n")) / F.sum("n")).alias("m"))
    return counts.crossJoin(F.broadcast(mean)).select("g", "y", (F.col("weight") / F.col("m")).alias("weight"))  # one row


def compare(df: DataFrame, year: int, rounds: int = ROUNDS, trees: int = 300, floor: int = 100) -> DataFrame:
    """The baseline and the three techniques, always together, with their cut of the gap.

    Baseline and reweighed trees grow side by side; the constrained rounds
    follow each other, each on the weights that the one before left.  Those
    depend on group and label alone, so a round moves a row per group and
    label, never the register.  What is written is given back.
    """
    spark = df.sparkSession
    train, test, scaler = M.prepared(df, year)
    groups = M.eligible_groups(test.withColumnRenamed("g", "gv"), "gv", floor).persist()
    rate = train.agg(F.avg("y")).first()[0]
    fairly = reweighing(train).persist()
    train, test = (M.missing_as_nan(x, scaler) for x in (train, test))

    def weighed(cells: DataFrame) -> DataFrame:
        """The training rows with the weight of their group and label."""
        table = cells.collect()  # a row per group and label
        kinds = [c.dataType for c in (cells.schema["g"], cells.schema["y"])]
        small = spark.createDataFrame([tuple(r) for r in table], f"g {kinds[0].simpleString()}, y {kinds[1].simpleString()}, weight double")
        same = F.col("g").eqNullSafe(F.col("_g")) & F.col("y").eqNullSafe(F.col("_y"))
        return train.join(F.broadcast(small.toDF("_g", "_y", "weight")), same).drop("_g", "_y")

    base, fair = boost(weighed(fairly.select("g", "y", "weight")), weights=[None, "weight"], trees=trees)

    def outcome(name: str, fitted, by_group: bool = False) -> tuple:
        own, other = stored(M.scores(fitted, train).select("g", "score")), stored(M.scores(fitted, test).select("app_id", "g", "y", "principal", "score"))
        cut = M.cutoff(own, rate)
        found = measure(decide(other, cut, group_cutoffs(own, rate, floor) if by_group else None), name, groups).first()  # one row
        dropped(own, other)
        return found

    cells, fitted = fairly.select("g", "y", F.lit(1.0).alias("weight")), base
    for _ in range(rounds):
        own = stored(M.scores(fitted, train).select("g", "y", "score"))  # for the cut-off and for the weights
        again = _weights_again(cells, own, M.cutoff(own, rate), 1.0 - rate, groups)
        cells = spark.createDataFrame(again.collect(), again.schema)  # a row per group and label
        dropped(own)
        fitted = boost(weighed(cells), weights=["weight"], trees=trees)[0]
    parts = [outcome("baseline", base), outcome("reweighing", fair), outcome("constrained", fitted), outcome("group_cutoffs", base, True)]
    for x in (fairly, groups):
        x.unpersist()
    return gap_cuts(spark.createDataFrame(parts, OUTCOME))


OUTCOME = "technique string, accuracy_pct double, approval_rate double, mean_principal double, median_principal double, approval_gap_pp double, high_group string, low_group string, margin_per_1000 double"


def gap_cuts(outcomes: DataFrame) -> DataFrame:
    """Outcomes with their distance from the baseline's; the percentage is null if that has no gap."""
    base = outcomes.where("technique = 'baseline'").select(F.col("approval_gap_pp").alias("bg"), F.col("accuracy_pct").alias("ba"), F.col("margin_per_1000").alias("bm"))
    rows = outcomes.crossJoin(F.broadcast(base))  # one row
    cut = F.col("bg") - F.col("approval_gap_pp")
    return rows.select(*outcomes.columns, cut.alias("gap_cut_pp"), F.when(F.col("bg") > 0, cut / F.col("bg") * 100.0).alias("gap_cut_pct"), (F.col("accuracy_pct") - F.col("ba")).alias("accuracy_change"), (F.col("margin_per_1000") - F.col("bm")).alias("margin_change"))


def frontier(cuts: DataFrame) -> DataFrame:
    """(technique, cut range, accuracy range) over runs; the baseline is the anchor at 0, undefined cuts are left out."""
    return cuts.groupBy("technique").agg(
        F.min("gap_cut_pct").alias("cut_low"), F.max("gap_cut_pct").alias("cut_high"), F.min("accuracy_change").alias("accuracy_low"), F.max("accuracy_change").alias("accuracy_high")
    )
