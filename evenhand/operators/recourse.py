"""The income a denied applicant would need, what drives denials, and the probes."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evenhand.operators.kept import stored, written

#: Names whose words differ from the column's.
WORDS = {"loan_to_value_ratio": "loan to property value", "debt_to_income_ratio": "debts to income", "debt_to_income_rank": "debts to income, by bracket", "loan_to_income": "loan to income", "open-end_line_of_credit": "open-end credit line", "conforming_loan_limit": "within the conforming limit"}
#: Codes of the public register's field reference (fixed values).
CODES = {
    "loan_type": {"1": "conventional", "2": "FHA", "3": "VA", "4": "USDA"},
    "loan_purpose": {"1": "home purchase", "2": "home improvement", "31": "refinancing", "32": "cash-out refinancing", "4": "other", "5": "not applicable"},
    "lien_status": {"1": "first lien", "2": "subordinate lien"},
    "occupancy_type": {"1": "principal residence", "2": "second residence", "3": "investment"},
    "preapproval": {"1": "requested", "2": "not requested"},
    "construction_method": {"1": "site-built", "2": "manufactured"},
    "reverse_mortgage": {"1": "yes", "2": "no"},
    "open-end_line_of_credit": {"1": "yes", "2": "no"},
    "business_or_commercial_purpose": {"1": "yes", "2": "no"},
    "conforming_loan_limit": {"C": "yes", "NC": "no", "U": "undetermined", "NA": "not applicable"},
}


def _inputs() -> tuple[str, ...]:
    from evenhand.operators.model import ALLOWED

    return (*ALLOWED, "loan_to_income")


FINE = [1000 * i for i in range(1, 101)]


def coarse_grid() -> list[float]:
    """40 geometric steps from 110,000 to 1,000,000."""
    return [110_000 * (1_000_000 / 110_000) ** (i / 39) for i in range(40)]


def required_increase(rows: DataFrame, score: Callable[[Column], Column], cut: float, key: str = "app_id") -> DataFrame:
    """(key, increase): the least step of the grid at which the score falls below the cut-off.

    0 if it already is; null if no step does.  ``score`` gives the score for an
    added income; all else stays.  The whole grid is an array in the row, so
    no row is multiplied and nothing is shuffled.  No monotony is assumed.
    """
    grid = F.array(*(F.lit(float(x)) for x in [0, *FINE, *coarse_grid()]))
    first = F.get(F.filter(grid, lambda x: score(x) < cut), 0)
    return rows.select(key, *[c for c in rows.columns if c != key], first.alias("increase"))


#: Rows that a task takes along the grid at a time.
STRIPE = 4_096


def with_income(x: np.ndarray, scaler, added: float) -> tuple[list[int], list[np.ndarray]]:
    """Which inputs of scaled rows move with ``added`` on the income, and their columns: income, ratio to the loan, and that ratio's flag.

    A missing income stays missing, and so does a missing ratio; an income of
    0 after the addition makes the ratio missing (the median, and its flag).
    """
    at = {n: i for i, n in enumerate(scaler.names)}
    i, r, rf = at["income"], at["loan_to_income"], at["loan_to_income_missing"]
    known = lambda n: ~(x[:, at[f"{n}_missing"]] > 0)
    raw = lambda j: x[:, j] * scaler.sd[j] + scaler.mean[j]
    scaled = lambda v, j: (v - scaler.mean[j]) / scaler.sd[j]
    income = raw(i) + float(added)
    moves = known("income") & known("loan_to_income")
    lost = moves & (np.abs(income) < 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(lost, float(scaler.medians["loan_to_income"]), raw(r) * raw(i) / income)
    return [i, r, rf], [np.where(known("income"), scaled(income, i), x[:, i]), np.where(moves, scaled(ratio, r), x[:, r]), np.where(lost, scaled(1.0, rf), x[:, rf])]


def model_increase(model, rows: DataFrame, scaler, cut: float, grid: list[float] | None = None, steps: int = 10) -> DataFrame:
    """``rows`` with ``increase``: the least step of the grid at which the fitted model's score falls below ``cut``.

    0 if it already is; null if no step does; no monotony is assumed.  ``rows``
    has ``features`` as ``scaler`` makes them.  The grid goes by stages of
    ``steps``, the fine steps first; what is solved is left out of the next.
    All of it happens where the row lies: one pass, nothing is written,
    multiplied or shuffled.
    """
    from evenhand.operators import model as M
    from evenhand.operators.trees import _replaced, matrix

    names = [c for c in rows.columns if c != "features"]
    given = [0.0, *map(float, grid if grid is not None else [*FINE, *coarse_grid()])]
    stages = [given[:1], *(given[i : i + steps] for i in range(1, len(given), steps))]
    trees = isinstance(model, M.Forest)
    at = {n: i for i, n in enumerate(scaler.names)}
    flags = [(at[n], at[f"{n}_missing"]) for n in scaler.flags] if trees else []

    def moved(x: np.ndarray, added: float) -> tuple[list[int], list[np.ndarray]]:
        inputs, columns = with_income(x, scaler, added) if added else ([], [])
        own = dict(zip(inputs, columns, strict=True))
        for v, f in flags:  # trees have a branch for what is missing
            if v in own or f in own:
                own[v] = np.where(own.get(f, x[:, f]) > 0, np.nan, own.get(v, x[:, v]))
        return list(own), list(own.values())

    def scored(x: np.ndarray, stage: list[float]) -> np.ndarray:
        changes = [moved(x, added) for added in stage]
        if trees:
            x = _replaced(x, [v for v, _ in flags], [np.where(x[:, f] > 0, np.nan, x[:, v]) for v, f in flags])
            if all(inputs for inputs, _ in changes):
                return model.along(x, changes[0][0], [columns for _, columns in changes])
        return np.stack([model.probability(_replaced(x, *change)) for change in changes])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = matrix(b.column(len(names)))
            found = np.full(b.num_rows, np.nan)
            for start in range(0, b.num_rows, STRIPE):
                x = every[start : start + STRIPE]
                open_ = np.arange(len(x))
                for stage in stages:
                    if not len(open_):
                        break
                    below = scored(x[open_], stage) < cut
                    hit = below.any(axis=0)
                    found[start + open_[hit]] = np.array(stage)[below.argmax(axis=0)[hit]]
                    open_ = open_[~hit]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), pa.array(found, mask=np.isnan(found))], [*names, "increase"])

    schema = T.StructType([rows.schema[n] for n in names]).add("increase", "double")
    return rows.select(*names, vector_to_array("features").alias("_x")).mapInArrow(solve, schema)


def study(df: DataFrame, year: int, fit=None, group: str = "derived_race") -> DataFrame:
    """(app_id, g, increase) of held-out rows denied in the data and by the model: what ``recourse_by_group`` and ``stability`` read.

    ``fit`` takes the training rows (missing values as NaN) and their number
    and gives boosted trees; without it the model is logistic.  The cut-off is the training scores' quantile at 1 - denial rate.
    """
    from evenhand.operators import model as M

    train, test, scaler = M.prepared(df, year, group)
    rows = train if fit is None else M.missing_as_nan(train, scaler)
    size, rate = train.agg(F.count("*"), F.avg("y")).first()
    model = (fit or M.logistic)(rows, size)
    cut = M.cutoff(stored(M.scores(model, rows).select("score")), rate)
    found = model_increase(model, test.where("y = 1").select("app_id", "g", "features"), scaler, cut)
    return written(found.where("increase is null or increase > 0"))


def recourse_by_group(found: DataFrame, group: str = "g", floor: int = 30) -> DataFrame:
    """(group, denied, reachable, unreachable_share, median_increase) of rows denied in the data and by the model.

    The median's buffer holds distinct values: those of the grid at most.
    """
    # No filter on the increase: Spark would push it, and with it the whole grid, below the join.
    each = found.groupBy(group, "increase").agg(F.count("*").alias("n"))
    more = F.col("increase") > 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    out = each.groupBy(group).agg(total(more | F.col("increase").isNull()).alias("denied"), total(more).alias("reachable"), F.percentile(F.when(more, F.col("increase")), 0.5, F.col("n")).alias("m")).where("denied > 0")
    return out.select(group, "denied", "reachable", (1.0 - F.col("reachable") / F.col("denied")).alias("unreachable_share"), F.when(F.col("reachable") >= floor, F.col("m")).alias("median_increase"))


def stability(found: DataFrame, replicates: int = 10, key: str = "app_id") -> DataFrame:
    """(replicate, median_increase): Poisson(1) weights from a hash stand for bootstrap draws; the model stays.

    The hash is the first 32 bits of md5("key:replicate"), so any engine can
    repeat the draw.
    """
    part = F.conv(F.substring(F.md5(F.concat_ws(":", key, "replicate").cast("binary")), 1, 8), 16, 10).cast("bigint")
    u = (part + 0.5) / float(1 << 32)
    weight = sum(((u > e).cast("int") for e in POISSON), F.lit(0))
    rows = found.where("increase > 0").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight).where("w > 0")
    each = rows.groupBy("replicate", "increase").agg(F.sum("w").alias("w"))  # the steps of the grid at most
    return each.groupBy("replicate").agg(F.percentile("increase", 0.5, F.col("w")).alias("median_increase"))


#: Distribution of Poisson(1): where a weight of 1, 2, ... begins.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)


def readable(name: str) -> str:
    """A plain name of an input: its words; a 0/1 column by its parent and what its code means, a missing flag by its parent."""
    if name.endswith("_missing"):
        return f"{readable(name.removesuffix('_missing'))} (missing)"
    parent = parent_of(name)
    if name in WORDS or name == parent:
        return WORDS.get(name, name.replace("_", " "))
    code = name.removeprefix(f"{parent.replace('-', '_')}_")
    return f"{readable(parent)}: {CODES.get(parent, {}).get(code, code)}"


def parent_of(name: str) -> str:
    """The input that a feature column comes from: 0/1 columns and missing flags belong to their parent."""
    name = name.removesuffix("_missing")
    if name == "debt_to_income_rank":
        return "debt_to_income_ratio"
    return name if name in _inputs() else next((p for p in _inputs() if name.startswith(f"{p.replace('-', '_')}_")), name)


def _ranked(long: DataFrame) -> DataFrame:
    w = Window.partitionBy("group_value").orderBy(F.col("contribution").desc(), "parent")
    return long.withColumn("rank", F.row_number().over(w))


def driver_groups(rows: DataFrame, group: str, floor: int = 30) -> DataFrame:
    """(group_value, n, excluded): every group's rows; those below the floor are left out of the drivers."""
    return rows.groupBy(F.col(group).alias("group_value")).agg(F.count("*").alias("n")).withColumn("excluded", F.col("n") < floor)


def drivers(rows: DataFrame, coefficients: dict[str, float], parents: dict[str, str], group: str | None = None, floor: int = 30) -> DataFrame:
    """(group_value, parent, contribution, rank, label): mean absolute contribution w (x - mean), summed over a parent's columns."""
    means = rows.agg(*(F.avg(n).alias(n) for n in coefficients)).first()
    by: dict[str, Column] = {}
    for n, w in coefficients.items():
        term = F.abs((F.col(n) - float(means[n])) * float(w))
        by[parents[n]] = by[parents[n]] + term if parents[n] in by else term
    g = F.col(group) if group else F.lit("ALL")
    one = rows.groupBy(g.alias("group_value")).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"p_{p}") for p, c in by.items())).where(F.col("n") >= floor)
    long = one.select("group_value", F.inline(F.array(*(F.struct(F.lit(p).alias("parent"), F.col(f"p_{p}").alias("contribution"), F.lit(readable(p)).alias("label")) for p in by))))
    return _ranked(long)


def model_drivers(model, rows: DataFrame, names: list[str], group: str | None = None, floor: int = 30) -> DataFrame:
    """(group_value, parent, contribution, rank, label) of any model: mean absolute change of the score when a parent's columns take their mean.

    ``rows`` has ``features`` in the order of ``names``, scaled, so that the
    mean is 0.  Each row is scored once per parent; averages combine map-side.
    Parents without effect on any row keep a contribution of 0.
    """
    from evenhand.operators import model as M
    from evenhand.operators.trees import _moves, matrix

    parents = sorted({parent_of(n) for n in names})
    places = {p: [i for i, n in enumerate(names) if parent_of(n) == p] for p in parents}
    g = F.col(group) if group else F.lit("ALL")
    given = rows.select(g.alias("group_value"), vector_to_array("features").alias("x"))

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows and summed changes of each group and parent."""
        for b in batches:
            groups = b.column(0).dictionary_encode(null_encoding="encode")
            number, x, n = groups.indices.to_numpy(zero_copy_only=False), matrix(b.column(1)), len(groups.dictionary)
            total = {p: np.zeros(n) for p in parents}
            for start in range(0, len(x), STRIPE):
                part = slice(start, start + STRIPE)
                for p, change in (model.without(x[part], places) if isinstance(model, M.Forest) else _moves(model, x[part], places)).items():
                    total[p] += np.bincount(number[part], change, n)
            count = np.bincount(number, minlength=n)
            for p in parents:
                yield pa.RecordBatch.from_arrays([groups.dictionary, pa.array([p] * n), pa.array(count, pa.int64()), pa.array(total[p])], ["group_value", "parent", "n", "total"])

    schema = T.StructType([given.schema["group_value"]]).add("parent", "string").add("n", "long").add("total", "double")
    found = given.mapInArrow(changes, schema).groupBy("group_value", "parent").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where(F.col("n") >= floor)
    labels = F.create_map(*(F.lit(v) for p in parents for v in (p, readable(p))))
    return _ranked(found.select("group_value", "parent", (F.col("total") / F.col("n")).alias("contribution"), labels[F.col("parent")].alias("label")))


def top_counts(runs: DataFrame, name: str, value: str, run: str = "seed", k: int = 5) -> DataFrame:
    """(name, runs, top, mean): in how many runs a name is among the k values of greatest size (ties: the lesser name)."""
    w = Window.partitionBy(run).orderBy(F.abs(F.col(value)).desc_nulls_last(), name)
    rows = runs.withColumn("_place", F.row_number().over(w))
    return rows.groupBy(name).agg(F.count("*").alias("runs"), F.count_if(F.col("_place") <= k).alias("top"), F.avg(value).alias("mean"))


def repaired_labels(rows: DataFrame, label: str, key: str, to: str, seed: int = 0) -> DataFrame:
    """``rows`` with ``to``: the labels themselves, in another order, so that they know nothing of their row.

    Rows are numbered twice, by two hashes of the key; equal numbers meet.
    Numbers come from running counts over ranges of the hash and from the place
    within a range, so no task numbers all rows.  ``key`` must be unique.
    """

    def numbered(df: DataFrame, salt: str) -> DataFrame:
        df = df.withColumn("_h", F.xxhash64(key, F.lit(f"{salt}{seed}"))).withColumn("_p", F.shiftright("_h", 48))
        sizes = df.groupBy("_p").agg(F.count("*").alias("_c"))
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 ranges at most
        sizes = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
        place = F.row_number().over(Window.partitionBy("_p").orderBy("_h", key))
        return df.join(F.broadcast(sizes), "_p").withColumn("_i", F.col("_b") + place).drop("_h", "_p", "_b")

    other = numbered(rows.select(key, F.col(label).alias(to)), "b").drop(key)
    return numbered(rows, "a").join(other, "_i").drop("_i")


def hidden(rows: DataFrame, weights: np.ndarray, layers: list[int], depth: int) -> DataFrame:
    """``rows`` with ``features`` replaced by the outputs of hidden layer ``depth`` of a perceptron.

    ``weights`` are as Spark ML keeps them: per layer the matrix by columns,
    then the offsets; hidden layers are sigmoid.
    """
    from evenhand.operators.trees import matrix

    parts, at = [], 0
    for a, b in zip(layers[:depth], layers[1 : depth + 1], strict=True):
        parts.append((weights[at : at + a * b].reshape(a, b), weights[at + a * b : at + a * b + b]))
        at += a * b + b

    @F.arrow_udf("array<double>")
    def outputs(x: pa.Array) -> pa.Array:
        z = matrix(x)
        for w, b in parts if len(x) else []:
            z = 1.0 / (1.0 + np.exp(-(z @ w + b)))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))

    return rows.withColumn("features", array_to_vector(outputs(vector_to_array("features"))))


def untrained(layers: list[int], seed: int = 0) -> np.ndarray:
    """Seeded random weights of a perceptron, uniform within 1 / sqrt(inputs)."""
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.uniform(-1, 1, a * b + b) / np.sqrt(a) for a, b in itertools.pairwise(layers)])


def _half(key: str, seed: int = 0) -> Column:
    """0 for rows that a probe learns from, 1 for those it is measured on."""
    return F.pmod(F.xxhash64(key, F.lit("half" if seed == 0 else f"half{seed}")), F.lit(2))


def _aucs(rows: DataFrame, looks: dict[tuple[str, int], str], key: str) -> DataFrame:
    """(what, seed, auc): how well ``x`` tells each label on the half of the rows that its fit did not see; all fits side by side."""
    from evenhand.operators import model as M
    from evenhand.operators.sampling import exact_auc
    from evenhand.operators.trees import probability_of

    seeds = sorted({s for _, s in looks})
    rows = rows.select("x", *sorted(set(looks.values())), *((_half(key, s) == 0).cast("double").alias(f"_learn{s}") for s in seeds))
    fits = M.side_by_side(rows, {f"{what}:{s}": (label, f"_learn{s}") for (what, s), label in looks.items()})
    scored = rows.select(
        *(F.struct(F.lit(what).alias("what"), F.lit(s).alias("seed"), probability_of(M.Linear(fits[f"{what}:{s}"]), F.col("x")).alias("score"), F.col(label).cast("int").alias("y"), (F.col(f"_learn{s}") == 0).alias("held")).alias(f"l{k}") for k, ((what, s), label) in enumerate(looks.items()))
    )
    long = scored.select(F.inline(F.array(*scored.columns))).where("held")
    return exact_auc(long, "score", "y", ("what", "seed")).select("what", "seed", "auc")


def probe(rows: DataFrame, label: str = "y", key: str = "app_id") -> DataFrame:
    """(auc): how well ``features`` tell the label: a logistic fit on half of the rows, by hash, measured on the other."""
    return _aucs(rows.withColumn("x", vector_to_array("features")), {("probe", 0): label}, key).select("auc")


def _with_labels(rows: DataFrame, key: str, labels: dict[str, int]) -> DataFrame:
    """``rows`` with ``features`` as ``x``, and y paired anew for each name and seed; written once.

    Only keys and labels are numbered; the inputs move for one join.
    """
    narrow = rows.select(key, "y")
    paired = narrow
    for name, seed in labels.items():
        paired = paired.join(repaired_labels(narrow, "y", key, name, seed).select(key, name), key)
    kept_ = [c for c in ("denial_score",) if c in rows.columns]
    return stored(rows.select(key, *kept_, vector_to_array("features").alias("x")).join(stored(paired), key))


def race_probe(rows: DataFrame, key: str = "app_id") -> DataFrame:
    """(what, auc): how well the inputs tell the group (column y), its labels paired anew (near 0.5), and the denial score alone.

    The last comes only where ``rows`` has ``denial_score``.
    """
    return probe_runs(rows, (0,), key, bare=True).select("what", "auc")


def probe_runs(rows: DataFrame, seeds: tuple[int, ...] = (0, 1, 2), key: str = "app_id", bare: bool = False) -> DataFrame:
    """(what, seed, auc): ``race_probe`` for several seeds, each with its own half and its own labels paired anew.

    All fits go side by side, and so do all measures.
    """
    from evenhand.operators.sampling import exact_auc

    rows = _with_labels(rows, key, {"shuffled" if bare else f"shuffled_{s}": s for s in seeds})
    looks = {("inputs", s): "y" for s in seeds} | {("shuffled", s): "shuffled" if bare else f"shuffled_{s}" for s in seeds}
    found = _aucs(rows, looks, key)
    if "denial_score" in rows.columns:
        alone = exact_auc(rows.select("denial_score", F.col("y").cast("int").alias("y")), "denial_score", "y").select("auc")
        found = found.unionByName(alone.select(F.lit("denial_score").alias("what"), F.explode(F.array(*map(F.lit, seeds))).alias("seed"), "auc"))
    return found


def probe_summary(runs: DataFrame) -> DataFrame:
    """(what, mean, sd, low, high) over seeds, and of the inputs' lead over the labels paired anew, seed by seed."""
    from evenhand.operators.profile import summary_over_seeds

    pick = lambda what: F.max(F.when(F.col("what") == what, F.col("auc")))
    lead = runs.groupBy("seed").agg((pick("inputs") - pick("shuffled")).alias("auc")).select(F.lit("inputs - shuffled").alias("what"), "seed", "auc")
    return summary_over_seeds(runs.select("what", "seed", "auc").unionByName(lead), "what", "auc")


def network_probe(model, rows: DataFrame, layers: list[int], seed: int = 0, key: str = "app_id") -> DataFrame:
    """(what, auc) over a network's layers: inputs, both hidden layers, an untrained network's second, paired-anew labels, the score.

    ``rows`` has ``features``, the group label y and ``denial_score``.
    """
    from evenhand.operators.sampling import exact_auc

    rows = _with_labels(rows, key, {"shuffled": seed})
    vectors = rows.withColumn("features", array_to_vector("x")).drop("x")
    weights = np.asarray(model.weights.toArray())
    layer = lambda w, depth: hidden(vectors, w, layers, depth).withColumn("x", vector_to_array("features"))
    found = _aucs(rows, {("inputs", 0): "y"}, key)
    found = found.unionByName(_aucs(layer(weights, 1), {("hidden_layer_1", 0): "y"}, key))
    found = found.unionByName(_aucs(layer(weights, 2), {("hidden_layer_2", 0): "y", ("shuffled_layer_2", 0): "shuffled"}, key))
    found = found.unionByName(_aucs(layer(untrained(layers, seed + 1000), 2), {("untrained_layer_2", 0): "y"}, key)).select("what", "auc")
    return found.unionByName(exact_auc(rows.select("denial_score", F.col("y").cast("int").alias("y")), "denial_score", "y").select(F.lit("denial_score").alias("what"), "auc"))
