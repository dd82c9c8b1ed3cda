"""Denial models on the full table with Spark ML: features, fits, paired evaluation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evenhand.functions.clean import category, debt_to_income_midpoint, debt_to_income_rank, denied, income_dollars, loan_to_income, number_or_null, replace_sentinels, to_float
from evenhand.operators.kept import stored, written
from evenhand.operators.sampling import exact_auc, order_statistics, stratified_draw
from evenhand.operators.screen import NO_GROUP, keep
from evenhand.operators.trees import Forest, boost, matrix, probability_of

CODES = ("loan_type", "loan_purpose", "lien_status", "occupancy_type", "preapproval", "conforming_loan_limit", "construction_method", "total_units", "open-end_line_of_credit", "business_or_commercial_purpose", "reverse_mortgage")
NUMBERS = ("loan_amount", "income", "debt_to_income_ratio", "loan_to_value_ratio", "property_value")
#: The only columns that may become inputs.
ALLOWED = (*NUMBERS, *CODES)
#: Columns that tell the outcome (fixed values).
LEAKING = (
    "action_taken", "denial_reason-1", "denial_reason-2", "denial_reason-3", "denial_reason-4", "purchaser_type", "interest_rate", "rate_spread", "hoepa_status",
    "total_loan_costs", "total_points_and_fees", "origination_charges", "discount_points", "lender_credits", "loan_term", "prepayment_penalty_term", "intro_rate_period",
    "negative_amortization", "interest_only_payment", "balloon_payment", "other_nonamortizing_features", "aus-1", "aus-2", "aus-3", "aus-4", "aus-5",
    "initially_payable_to_institution",
)
#: Places that stand in for protected groups (fixed values).
PROXIES = ("tract_minority_population_percent", "census_tract", "county_code")


def family(name: str) -> str:
    """``allowed``, or why a column may not be an input: protected, leaking, proxy or unknown; whatever the case."""
    low = name.lower()
    if re.match(r"(derived_|applicant_|co-applicant_).*(race|ethnicity|sex|age)", low):
        return "protected"
    return "leaking" if low in LEAKING else "proxy" if low in PROXIES else "allowed" if low in ALLOWED else "unknown"


def check_allowed(names: list[str]) -> list[str]:
    """``names``, if each is on the list of allowed inputs; else an error that says which is not, and why."""
    odd = [f"{n} ({family(n)})" for n in names if family(n) != "allowed"]
    if odd:
        raise ValueError(f"inputs not allowed: {', '.join(odd)}")
    return names


def numeric_features() -> dict[str, Column]:
    return {"loan_amount": to_float("loan_amount"), "income": to_float("income") * 1000.0, "loan_to_value_ratio": to_float("loan_to_value_ratio"), "property_value": to_float("property_value"), "debt_to_income_rank": debt_to_income_rank(), "loan_to_income": loan_to_income()}


def levels(df: DataFrame, columns: tuple[str, ...] = CODES, clean=replace_sentinels) -> dict[str, list[str]]:
    """The codes of each column in the training rows: one small job over all columns."""
    one = df.select(*(clean(c).alias(f"c{i}") for i, c in enumerate(columns))).agg(*(F.array_sort(F.collect_set(f"c{i}")) for i in range(len(columns)))).first()
    return {c: list(v) for c, v in zip(columns, one, strict=True)}


def one_hot(known: dict[str, list[str]], clean=replace_sentinels, drop_first: bool = False) -> dict[str, Column]:
    """A 0/1 column per level that the training rows have; other levels give zeros in all of them."""
    return {f"{c}_{v}".replace("-", "_"): F.coalesce((clean(c) == v).cast("double"), F.lit(0.0)) for c, vs in known.items() for v in (vs[1:] if drop_first else vs)}


def feature_columns(df: DataFrame) -> dict[str, Column]:
    check_allowed([*NUMBERS, *CODES])
    return {**numeric_features(), **one_hot(levels(df))}


def time_split(df: DataFrame, year: int) -> tuple[DataFrame, DataFrame]:
    """Rows before ``year`` and from it on; a year that is no number, or an empty side, raises."""
    y = F.col("activity_year").try_cast("int")
    n = df.agg(F.count_if(y.isNull()), F.count_if(y < year), F.count_if(y >= year)).first()
    if n[0]:
        raise ValueError(f"{n[0]} rows have no readable year")
    if not (n[1] and n[2]):
        raise ValueError("one side of the split is empty")
    return df.where(y < year), df.where(y >= year)


class Scaled:
    """Median imputation, missing flags and population scaling, fitted on the training rows alone."""

    def __init__(self, train: DataFrame, columns: dict[str, Column], flags: list[str]):
        self.columns, self.flags = columns, flags
        names = list(columns)
        rows = train.select(*(c.cast("double").alias(n) for n, c in columns.items()))
        med = {}
        if flags:
            long = rows.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").alias("x")) for n in flags))))
            med = {r["name"]: r["m"] for r in order_statistics(long, F.col("x"), {"m": 0.5}, ("name",)).collect()}  # a row per flag
        self.medians = {n: 0.0 if med.get(n) is None else med[n] for n in flags}
        filled = rows.select(*self._filled(names, rows=True))
        self.names = filled.columns
        one = filled.agg(*(f(n) for n in self.names for f in (F.avg, F.stddev_pop))).first()
        self.mean = [one[2 * i] or 0.0 for i in range(len(self.names))]
        self.sd = [one[2 * i + 1] or 1.0 for i in range(len(self.names))]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "columns"}  # tasks need the numbers alone

    def _filled(self, names: list[str], rows: bool = False) -> list[Column]:
        source = {n: F.col(f"`{n}`") for n in names} if rows else {n: c.cast("double") for n, c in self.columns.items()}
        value = [F.coalesce(source[n], F.lit(self.medians.get(n, 0.0))).alias(n) for n in names]
        return value + [source[n].isNull().cast("double").alias(f"{n}_missing") for n in self.flags]

    def apply(self, df: DataFrame, *also: Column) -> DataFrame:
        rows = df.select(*also, *self._filled(list(self.columns)))
        scaled = [((F.col(f"`{n}`") - m) / s).alias(n) for n, m, s in zip(self.names, self.mean, self.sd, strict=True)]
        kept = [c for c in rows.columns if c not in self.names]
        rows = rows.select(*(F.col(f"`{c}`") for c in kept), *scaled)
        return rows.select(*(F.col(f"`{c}`") for c in kept), array_to_vector(F.array(*(F.col(f"`{n}`") for n in self.names))).alias("features"))


class Linear:
    """A logistic model: an intercept and a weight for each input."""

    def __init__(self, weights: np.ndarray):
        self.intercept, self.coefficients = float(weights[0]), DenseVector(weights[1:])

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(x @ self.coefficients.toArray() + self.intercept)))


def logistic(rows: DataFrame, n: int, label: str = "y", weight: str | None = None) -> Linear:
    """L2 with C = 1, by ``side_by_side``; the penalty is 1 beside the sum of losses, scaled by weights' mean."""
    return Linear(side_by_side(rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"), *([F.col(weight).cast("double").alias("w")] if weight else [])), {"one": ("y", "w" if weight else None)}, None if weight is None else n)["one"])


def side_by_side(rows: DataFrame, looks: dict[str, tuple[str, str | None]], n: int | None = None, rounds: int = 25, near: float = 1e-8) -> dict[str, np.ndarray]:
    """Intercept and weights of an L2 logistic model for each of ``looks``: a name, its 0/1 label and its weight (None: 1).

    Newton steps, all fits in one pass over the rows: tasks add up loss, X'WX
    and X'W(y - p), which are summed by fit and cell.  Nothing is cached or
    written; the driver gets a matrix a fit.  A step that does not lower the
    loss is halved.  The intercept has no penalty; a fit whose labels are all
    alike has weights of 0 and an infinite intercept.  With ``n`` the loss is
    the weighted mean and the penalty 1 / n.
    """
    columns = sorted({c for pair in looks.values() for c in pair if c})
    rows = rows.select("x", *(F.col(c).cast("double").alias(c) for c in columns))
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("a logistic model needs rows")
    d = first["d"] + 1
    place = {c: k + 1 for k, c in enumerate(columns)}

    def sums(at: dict[str, np.ndarray]) -> dict[str, tuple]:
        """(loss, gradient, curvature, weight in all, weight of label 1) of each fit at its weights."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[str, np.ndarray] = {}
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.c_[np.ones(b.num_rows), matrix(b.column(0))]
                number = {c: b.column(k).to_numpy(zero_copy_only=False) for c, k in place.items()}
                for f, v in at.items():
                    y, w = number[looks[f][0]], np.ones(len(x)) if looks[f][1] is None else number[looks[f][1]]
                    mine = w > 0
                    own, y, w = (x, y, w) if mine.all() else (x[mine], y[mine], w[mine])
                    z = own @ v
                    p = 1.0 / (1.0 + np.exp(-z))
                    loss = (w * (np.logaddexp(0.0, z) - y * z)).sum()
                    found = np.concatenate([((own * (w * p * (1 - p))[:, None]).T @ own).ravel(), own.T @ (w * (y - p)), [loss, w.sum(), (w * y).sum()]])
                    total[f] = total.get(f, 0) + found
            for f, v in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([f] * v.size), pa.array(range(v.size), pa.int32()), pa.array(v)], ["fit", "cell", "v"])

        out = {}
        for r in rows.mapInArrow(step, "fit string, cell int, v double").groupBy("fit", "cell").agg(F.sum("v").alias("v")).groupBy("fit").agg(F.array_sort(F.collect_list(F.struct("cell", "v"))).alias("cells")).collect():
            v = np.array([c["v"] for c in r["cells"]])
            out[r["fit"]] = (v[d * (d + 1)], v[d * d : d * (d + 1)], v[: d * d].reshape(d, d), v[-2], v[-1])
        return out

    penalty = np.r_[0.0, np.ones(d - 1)]
    best = {f: (np.inf, np.zeros(d)) for f in looks}
    trial, moves, done = {f: np.zeros(d) for f in looks}, {}, {}
    for _ in range(rounds):
        if not trial:
            break
        found, later = sums(trial), {}
        for f, v in trial.items():
            if f not in found:
                raise ValueError(f"no rows for the fit {f}")
            loss, gradient, curvature, weight, ones = found[f]
            if ones in (0.0, weight):
                done[f] = np.r_[np.inf if ones else -np.inf, np.zeros(d - 1)]
                continue
            share = 1.0 if n is None else weight / n
            loss += 0.5 * share * (penalty * v * v).sum()
            if loss > best[f][0] + 1e-12 * abs(loss):
                moves[f] = moves[f] / 2
            else:
                best[f] = (loss, v)
                moves[f] = np.linalg.lstsq(curvature + np.diag(share * penalty), gradient - share * penalty * v, rcond=None)[0]
            if np.abs(moves[f]).max() > near:
                later[f] = best[f][1] + moves[f]
            else:
                done[f] = best[f][1] + moves[f]
        trial = later
    return {f: done[f] if f in done else trial[f] for f in looks}


def boosted(rows: DataFrame, trees: int = 300, rate: float = 0.05, leaves: int = 31, seed: int = 0, label: str = "y", weight: str | None = None) -> Forest:
    """Boosted trees of at most ``leaves`` leaves of 50 rows or more; each sees 0.9 of the inputs and of the rows it is grown on."""
    return boost(rows, label, [weight], [seed], trees, rate, leaves)[0]


class Network:
    """A perceptron: sigmoid layers and a softmax of two; weights per layer as inputs by outputs, then the offsets."""

    def __init__(self, weights: np.ndarray, layers: list[int]):
        self.weights, self.layers = DenseVector(weights), layers

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = x
        parts = _parts(self.weights.toArray(), self.layers)
        for k, (w, b) in enumerate(parts):
            z = z @ w + b
            if k + 1 < len(parts):
                z = 1.0 / (1.0 + np.exp(-z))
        return 1.0 / (1.0 + np.exp(z[:, 0] - z[:, 1]))


def _parts(weights: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix and offsets of each layer."""
    out, at = [], 0
    for a, b in zip(layers[:-1], layers[1:], strict=True):
        out.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def _loss(weights: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Summed cross-entropy of some rows, and its slope in every weight, by going back through the layers."""
    parts = [(w.astype(x.dtype), b.astype(x.dtype)) for w, b in _parts(weights, layers)]
    outs = [x]
    for w, b in parts[:-1]:
        z = outs[-1] @ w
        z += b
        np.negative(z, out=z)
        np.exp(z, out=z)
        z += 1
        outs.append(np.reciprocal(z, out=z))
    z = outs[-1] @ parts[-1][0] + parts[-1][1]
    margin = (z[:, 1] - z[:, 0]).astype(float)
    loss = (np.logaddexp(0.0, margin) - y * margin).sum()
    up = (1.0 / (1.0 + np.exp(-margin)) - y).astype(x.dtype)
    delta, slopes = np.stack([-up, up], axis=1), []
    for k in range(len(parts) - 1, -1, -1):
        slopes.append(np.concatenate([(outs[k].T @ delta).ravel(), delta.sum(axis=0)]))
        if k:
            delta = (delta @ parts[k][0].T) * outs[k] * (1 - outs[k])
    return np.concatenate([[loss], *slopes[::-1]]).astype(float)


#: Rows whose layers a task holds at a time.
STRIPE = 4_096


def network(rows: DataFrame, inputs: int, seed: int = 0, rounds: int = 60, label: str = "y") -> Network:
    """A small perceptron (sigmoid layers of 64 and 32, softmax) for the nonlinear probe, by full-batch L-BFGS.

    Rows lie in blocks of single-precision inputs; a step is one pass in which
    tasks add up loss and slopes, in double precision, over all rows.
    """
    layers = [inputs, 64, 32, 2]
    columns = rows.select(vector_to_array("features").alias("x"), F.col(label).cast("double").alias("y"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([matrix(b.column(0)).astype("<f4").tobytes()], pa.binary()), pa.array([b.column(1).to_numpy(zero_copy_only=False).astype("<f4").tobytes()], pa.binary())], ["x", "y"])

    packed = columns.mapInArrow(pack, "x binary, y binary")
    parts = max(packed.rdd.getNumPartitions(), rows.sparkSession.sparkContext.defaultParallelism)
    blocks = packed.repartition(parts).rdd.map(lambda r: (np.frombuffer(r["x"], "<f4").reshape(-1, inputs), np.frombuffer(r["y"], "<f4"))).persist(StorageLevel.MEMORY_AND_DISK)
    n = blocks.map(lambda b: len(b[1])).sum()
    if not n:
        raise ValueError("a network needs training rows")

    def look(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def own(part: Iterator[tuple]) -> Iterator[np.ndarray]:
            total = None
            for x, y in part:
                for i in range(0, len(y), STRIPE):
                    found = _loss(weights, layers, x[i : i + STRIPE], y[i : i + STRIPE])
                    total = found if total is None else total + found
            if total is not None:
                yield total

        total = blocks.mapPartitions(own).treeReduce(lambda a, b: a + b, 2) if parts > 64 else sum(blocks.mapPartitions(own).collect())
        return total[0] / n, total[1:] / n

    rng = np.random.default_rng(seed)
    start = np.concatenate([rng.uniform(-2.4, 2.4, a * b + b) / np.sqrt(a) for a, b in zip(layers[:-1], layers[1:], strict=True)])
    found = lowest(look, start, rounds)
    blocks.unpersist()
    return Network(found, layers)


def lowest(look, at: np.ndarray, rounds: int, near: float = 1e-6, memory: int = 10) -> np.ndarray:
    """Where ``look`` (value and slope) is least, by L-BFGS from ``at``; steps that do not lower it enough are cut short."""
    value, slope = look(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, shares = slope.copy(), []
        for s, g in reversed(past):
            shares.append((s @ way) / (s @ g))
            way -= shares[-1] * g
        way *= (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1.0 / max(np.linalg.norm(slope), 1e-12)
        for (s, g), share in zip(past, reversed(shares), strict=True):
            way += (share - (g @ way) / (s @ g)) * s
        down, step = -(slope @ way), 1.0
        for _ in range(20):
            other, steep = look(at - step * way)
            if other <= value + 1e-4 * step * down:
                break
            step *= 0.1 if not np.isfinite(other) else min(0.5, max(0.1, -down * step / (2 * (other - value - down * step))))
        else:
            return at
        if (change := (-step * way) @ (steep - slope)) > 1e-12:
            past = [*past[1 - memory :], (-step * way, steep - slope)]
        still = abs(value - other) <= near * max(abs(value), abs(other), near)
        at, value, slope = at - step * way, other, steep
        if still or np.linalg.norm(slope) <= near * max(1.0, abs(value)):
            break
    return at


def scores(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``score``, the probability of denial."""
    return rows.withColumn("score", probability_of(model, vector_to_array("features")))


def base_rate(train: DataFrame) -> float:
    """The baseline's constant score; an empty training side raises."""
    rate = train.agg(F.avg(denied())).first()[0]
    if rate is None:
        raise ValueError("the baseline needs training rows")
    return rate


def compact(df: DataFrame, group: str = "derived_race") -> DataFrame:
    """The decisions as the models read them, written once: cleaned numbers and codes, year, label y, group g, principal."""
    check_allowed([*NUMBERS, *CODES])
    also = (F.col("app_id"), F.col("activity_year"), denied().cast("double").alias("y"), F.col(group).alias("g"), to_float("loan_amount").alias("principal"))
    return stored(keep(df, "decisions_only").select(*also, *(c.cast("double").alias(n) for n, c in numeric_features().items()), *(replace_sentinels(c).alias(c) for c in CODES)))


def prepared(df: DataFrame, year: int, group: str = "derived_race", floor: int = 100):
    """(train, test, scaler): decisions only, split by time, as feature vectors with label, group and principal."""
    return split(compact(df, group), year)


def split(rows: DataFrame, year: int, *also: str):
    """(train, test, scaler) of the rows of ``compact``; columns of ``also`` stay.  Vectors are made anew by each reader."""
    train, test = time_split(rows, year)
    plain = lambda c: F.col(f"`{c}`")
    columns = {**{n: F.col(n) for n in numeric_features()}, **one_hot(levels(train, clean=plain), plain)}
    scaler = Scaled(train, columns, list(numeric_features()))
    kept = [F.col(c) for c in ("app_id", "y", "g", "principal", *also)]
    return scaler.apply(train, *kept), scaler.apply(test, *kept), scaler


def missing_as_nan(rows: DataFrame, scaler: Scaled) -> DataFrame:
    """``rows`` with NaN in ``features`` where a flag says that the value is missing: trees have a branch for those."""
    name = "_x" if "_x" not in rows.columns else "__x"
    at = {n: i for i, n in enumerate(scaler.names)}
    flag = {n: at[f"{n}_missing"] for n in scaler.flags}
    value = lambda i: F.get(name, F.lit(i))
    values = [F.when(value(flag[n]) > 0, F.lit(float("nan"))).otherwise(value(i)) if n in flag else value(i) for i, n in enumerate(scaler.names)]
    return rows.withColumn(name, vector_to_array("features")).withColumn("features", array_to_vector(F.array(*values))).drop(name)


def evaluate(df: DataFrame, year: int, challengers: dict | None = None) -> DataFrame:
    """(challenger, baseline_auc, auc, gini, better_pct): every challenger beside the baseline on the same fold.

    A challenger is a function of the training rows and their number.
    """
    train, test, scaler = prepared(df, year)
    n = train.count()
    challengers = challengers or {"logistic": logistic, "boosted": lambda rows, n: boosted(rows)}
    found = []
    for name, fit in challengers.items():
        one, other = (missing_as_nan(x, scaler) if name == "boosted" else x for x in (train, test))
        found.append((name, 0.5, exact_auc(scores(fit(one, n), other), "score", "y").first()["auc"]))  # a number each
    return _beside_baseline(df.sparkSession.createDataFrame(found, "challenger string, baseline_auc double, auc double"))


def _beside_baseline(found: DataFrame) -> DataFrame:
    return found.select("*", (F.col("auc") * 2 - 1).alias("gini"), ((F.col("auc") - 0.5) / 0.5 * 100).alias("better_pct"))


def seed_table(df: DataFrame, year: int, n: int, seeds: tuple[int, ...] = (0, 1, 2), trees: int = 300) -> DataFrame:
    """(challenger, baseline_auc, auc, gini, better_pct, seed): ``evaluate`` on a stratified draw of ``n`` rows for each seed.

    The register is prepared once; a draw is a column of 0s and 1s, and the
    boosted trees of all seeds grow side by side, in one pass over the rows, as
    do the logistic models.
    """
    rows = compact(df)
    keys = rows.select("app_id", "activity_year")
    flags = [f"draw_{s}" for s in seeds]
    for s, flag in zip(seeds, flags, strict=True):
        drawn = stratified_draw(keys, "activity_year", "app_id", n, s).select("app_id", F.lit(1.0).alias(flag))
        rows = rows.join(drawn, "app_id", "left").fillna(0.0, [flag])
    train, test, scaler = split(stored(rows), year, *flags)
    lost_train, lost_test = missing_as_nan(train, scaler), missing_as_nan(test, scaler)
    lines = side_by_side(train.select(vector_to_array("features").alias("x"), "y", *flags), {flag: ("y", flag) for flag in flags})
    found = []
    for s, flag, forest in zip(seeds, flags, boost(lost_train, weights=flags, seeds=list(seeds), trees=trees), strict=True):
        looks = {"boosted": scores(forest, lost_test.where(F.col(flag) > 0)), "logistic": scores(Linear(lines[flag]), test.where(F.col(flag) > 0))}
        found += [(name, 0.5, exact_auc(x, "score", "y").first()["auc"], s) for name, x in looks.items()]
    return _beside_baseline(df.sparkSession.createDataFrame(found, "challenger string, baseline_auc double, auc double, seed int"))


def controlled_gap(df: DataFrame, group: str, value: str, reference: str) -> float | None:
    """Average difference, in points, of predicted denial were a row in the group or not; null if a control has no value."""
    two = df.where(F.col(group).isin(value, reference))
    numeric = {"income": number_or_null("income", 1000.0), "loan_to_value_ratio": number_or_null("loan_to_value_ratio"), "debt_to_income_ratio": debt_to_income_midpoint()}
    usable = two.agg(F.count("*"), F.countDistinct(denied()), *(F.count(c) for c in numeric.values())).first()
    if not usable[0] or not all(usable[2:]):
        return None
    if usable[1] < 2:
        return 0.0
    known = levels(two, ("loan_purpose", "lien_status"), category)
    columns = {**numeric, **one_hot(known, category, drop_first=True), "is_group": (F.col(group) == value).cast("double")}
    scaler = Scaled(two, columns, list(numeric))
    rows = scaler.apply(two, denied().cast("double").alias("y")).persist()
    fit = logistic(rows, usable[0])
    i = scaler.names.index("is_group")
    w, m, s = fit.coefficients, scaler.mean[i], scaler.sd[i]
    # The margin without the group term, then with it set to 1 and to 0.
    rest = F.lit(float(fit.intercept))
    x = vector_to_array("features")
    for j, c in enumerate(w):
        if j != i:
            rest = rest + x[j] * float(c)
    sig = lambda z: 1.0 / (1.0 + F.exp(-z))
    out = rows.select(rest.alias("z")).agg(F.avg(sig(F.col("z") + float(w[i]) * (1 - m) / s) - sig(F.col("z") + float(w[i]) * (0 - m) / s))).first()[0]
    rows.unpersist()
    return 100.0 * out


def controlled_disparity(df: DataFrame, group: str = "derived_race", reference: str | None = None, floor: int = 100) -> DataFrame:
    """(group_value, applications, raw_gap_pp, controlled_gap_pp, reference_group, status, race_not_reported_share): both gaps, always together.

    The reference is the least-denied group above the floor unless named;
    groups below the floor keep their row without gaps.  Beside gaps on race
    stands the share of applications that report none, null for other groups.
    All groups' fits go side by side by Newton steps; the reference's rows are
    there once for each of them.
    """
    df = keep(df, "not_purchased").select("action_taken", "income", "loan_to_value_ratio", "debt_to_income_ratio", "loan_purpose", "lien_status", group).persist()
    rates = {r["v"]: (r["n"], r["d"] / r["n"]) for r in df.groupBy(F.col(group).alias("v")).agg(F.count("*").alias("n"), F.sum(denied()).alias("d")).collect()}
    eligible = [v for v, (n, _) in rates.items() if n >= floor and v is not None]
    if reference is None:
        if not eligible:
            raise ValueError("no group reaches the floor")
        reference = min(eligible, key=lambda v: (rates[v][1], v))
    total = sum(n for n, _ in rates.values())
    unknown = rates.get("Race Not Available", (0, 0))[0] / total if group == "derived_race" and total else None
    others = sorted(v for v in eligible if v != reference)
    gaps = {}
    if others:
        own = F.when(F.col(group) == reference, F.array(*map(F.lit, others))).otherwise(F.array(F.col(group)))
        two = df.where(F.col(group).isin(reference, *others)).select("*", F.explode(own).alias("_by"), (F.col(group) != reference).cast("double").alias("_g"))
        gaps = {r[0]: r[1] for r in _newton_gaps(two, 8).collect()}  # a row per group
    rows = []
    for v, (n, r) in sorted(rates.items(), key=lambda x: str(x[0])):
        ok = v in others
        rows.append((v, n, 100 * (r - rates[reference][1]) if ok else None, gaps.get(v) if ok else None, reference, "REFERENCE" if v == reference else "OK" if ok else "SUPPRESSED", unknown))
    df.unpersist()
    return df.sparkSession.createDataFrame(rows, "group_value string, applications long, raw_gap_pp double, controlled_gap_pp double, reference_group string, status string, race_not_reported_share double")


def lender_controlled_gaps(df: DataFrame, lenders: list[str] | DataFrame, group: str, value: str, reference: str, rounds: int = 8) -> DataFrame:
    """(lei, controlled_gap_pp, estimable) for lenders, a list or a column ``lei``: all fits at once, by ``grouped_gaps``."""
    rows = keep(df, "not_purchased")
    wanted = df.sparkSession.createDataFrame([(x,) for x in lenders], "lei string") if isinstance(lenders, list) else lenders.select("lei").distinct()
    found = grouped_gaps(rows.join(wanted, "lei", "left_semi"), "lei", group, value, reference, rounds)
    found = wanted.distinct().join(found, "lei", "left").withColumn("estimable", F.col("controlled_gap_pp").isNotNull())
    return found.select("lei", "controlled_gap_pp", "estimable")


def grouped_gaps(df: DataFrame, by: str, group: str, value: str, reference: str, rounds: int = 8) -> DataFrame:
    """(by, controlled_gap_pp): ``controlled_gap`` of every value of ``by``, each from a fit of its own, in a fixed number of jobs.

    Each Newton step is one map-side combined aggregate of X'WX and X'(y - p)
    per value of ``by``, and a small solve for each of them; an average step
    follows for the gaps.  Levels, medians, means and deviations are those of
    the value's own rows: a column that is constant there is scaled to 0 and
    its coefficient stays 0, as if it were absent.  Null where a control has
    no usable value; 0 where only one outcome occurs.
    """
    two = df.where(F.col(group).isin(value, reference) & F.col(by).isNotNull())
    return _newton_gaps(two.select("*", F.col(by).alias("_by"), (F.col(group) == value).cast("double").alias("_g")), rounds).withColumnRenamed("_by", by)


def _newton_gaps(rows: DataFrame, rounds: int) -> DataFrame:
    """(_by, controlled_gap_pp) of the register's rows with ``_by`` and ``_g``, 1 for the group and 0 for its reference."""
    numeric = {"income": number_or_null("income", 1000.0), "loan_to_value_ratio": number_or_null("loan_to_value_ratio"), "debt_to_income_ratio": debt_to_income_midpoint()}
    two = rows.select("_by", "_g", denied().cast("double").alias("_y"), *(c.cast("double").alias(f"_{n}") for n, c in numeric.items()), category("loan_purpose").alias("_purpose"), category("lien_status").alias("_lien"))
    two = written(two)
    levels_ = two.groupBy("_by").agg(F.count("*").alias("_n"), F.min("_y").alias("_y0"), F.max("_y").alias("_y1"), F.min("_purpose").alias("_purpose0"), F.min("_lien").alias("_lien0"), *(F.count(f"_{n}").alias(f"_c_{n}") for n in numeric))
    long = two.select("_by", F.inline(F.array(*(F.struct(F.lit(n).alias("_name"), F.col(f"_{n}").alias("_v")) for n in numeric))))
    median = order_statistics(long, F.col("_v"), {"_m": 0.5}, ("_by", "_name")).groupBy("_by").agg(*(F.max(F.when(F.col("_name") == n, F.col("_m"))).alias(f"_m_{n}") for n in numeric))
    known = {c: sorted(r[0] for r in two.select(c).distinct().collect()) for c in ("_purpose", "_lien")}  # codes
    usable = " and ".join(f"_c_{n} > 0" for n in numeric)
    rows = two.join(levels_.join(median, "_by"), "_by").where(f"{usable} and _y0 < _y1")
    x = [F.coalesce(F.col(f"_{n}"), F.col(f"_m_{n}")) for n in numeric]
    x += [F.when(F.col(f"{c}0") == v, 0.0).otherwise((F.col(c) == v).cast("double")) for c, vs in known.items() for v in vs]
    x += [F.col("_g"), *(F.col(f"_{n}").isNull().cast("double") for n in numeric)]
    d, at = len(x), len(x) - 1 - len(numeric)
    rows = written(rows.select("_by", "_y", F.array(*x).alias("_x")))
    parts = [f(F.get("_x", F.lit(i))).alias(f"_{k}{i}") for i in range(d) for k, f in (("a", F.avg), ("s", F.stddev_pop))]
    scale = rows.groupBy("_by").agg(F.count("*").alias("_n"), *parts)
    scale = scale.select("_by", "_n", F.array(*(f"_a{i}" for i in range(d))).alias("_mean"), F.array(*(F.when(F.col(f"_s{i}") > 1e-12, F.col(f"_s{i}")) for i in range(d))).alias("_sd"))
    scale = written(scale)
    scaled = F.transform(F.arrays_zip(F.col("_x").alias("v"), F.col("_mean").alias("m"), F.col("_sd").alias("s")), lambda z: F.coalesce((z["v"] - z["m"]) / z["s"], F.lit(0.0)))
    rows = written(rows.join(scale, "_by").select("_by", "_y", scaled.alias("_x")))
    # Row 0 of every fit is the intercept, which has no penalty.
    fits = scale.select("_by", "_n", F.array(*(F.lit(0.0) for _ in range(d + 1))).alias("_w"))
    pairs = [(i, j) for i in range(d + 1) for j in range(i + 1)]
    cell = lambda i: F.lit(1.0) if i == 0 else F.get("_x", F.lit(i - 1))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            h, g, w = np.zeros((d + 1, d + 1)), np.array(r.gradient), np.array(r.old)
            for (i, j), v in zip(pairs, r.hessian, strict=True):
                h[i, j] = h[j, i] = v
            penalty = np.r_[0.0, np.ones(d)]
            out.append((r.by, r.n, list(w + np.linalg.solve(h + np.diag(penalty), g - penalty * w))))
        return pd.DataFrame(out, columns=["_by", "_n", "_w"])

    margin = lambda: F.aggregate(F.zip_with(F.col("_x"), F.slice("_w", 2, d), lambda a, b: a * b), F.get("_w", F.lit(0)), lambda s, v: s + v)
    for _ in range(rounds):
        one = rows.join(fits, "_by").withColumn("_p", 1.0 / (1.0 + F.exp(-margin())))
        slope = F.col("_p") * (1.0 - F.col("_p"))
        sums = one.groupBy("_by").agg(
            F.max("_n").alias("n"), F.first("_w").alias("old"),
            F.array(*(F.sum(slope * cell(i) * cell(j)) for i, j in pairs)).alias("hessian"), F.array(*(F.sum((F.col("_y") - F.col("_p")) * cell(i)) for i in range(d + 1))).alias("gradient"),
        )
        fits = written(sums.withColumnRenamed("_by", "by").mapInPandas(lambda it: (solve(p) for p in it), "_by string, _n long, _w array<double>"))
    w, m, s = F.get("_w", F.lit(at + 1)), F.get("_mean", F.lit(at)), F.get("_sd", F.lit(at))
    rest = margin() - w * F.get("_x", F.lit(at))
    sig = lambda z: 1.0 / (1.0 + F.exp(-z))
    apart = F.when(s.isNull(), 0.0).otherwise(sig(F.col("_rest") + w * (1 - m) / s) - sig(F.col("_rest") - w * m / s))
    gaps = rows.join(fits.join(scale.drop("_n"), "_by"), "_by").withColumn("_rest", rest).groupBy("_by").agg((100.0 * F.avg(apart)).alias("_gap"))
    whole = levels_.where(usable).join(gaps, "_by", "left")
    return whole.select("_by", F.when(F.col("_y0") == F.col("_y1"), 0.0).otherwise(F.col("_gap")).alias("controlled_gap_pp"))


def logistic_fits(rows: DataFrame, fits: list[str], rounds: int = 25) -> dict[str, np.ndarray]:
    """``side_by_side`` for rows with ``fit`` (a name), ``x`` (an array, scaled) and ``y``: each row takes part in its fit alone."""
    own = [(F.col("fit") == f).cast("double").alias(f"w{k}") for k, f in enumerate(fits)]
    return side_by_side(rows.select("x", "y", *own), {f: ("y", f"w{k}") for k, f in enumerate(fits)}, rounds=rounds)


def eligible_groups(df: DataFrame, group: str, floor: int = 100) -> DataFrame:
    return df.groupBy(F.col(group).alias("group_value")).agg(F.count("*").alias("n")).where((F.col("n") >= floor) & ~F.col("group_value").isin(*NO_GROUP))


def cutoff(train_scores: DataFrame, rate: float) -> float:
    """The score at the quantile 1 - rate; deny from it on."""
    return order_statistics(train_scores, F.col("score"), {"cutoff": 1.0 - rate}).first()["cutoff"]
