"""Hard negatives by angular triangle filtering.

Each vector stores its angles to a few reference directions.  For an anchor a
and a row x, every reference r bounds their angle by the triangle inequality:
|ar - xr| <= ax <= min(ar + xr, 2 pi - ar - xr).  The cosines of the bounds,
times both norms and widened against rounding, enclose the score; only rows
whose interval overlaps what the anchor still looks for get the exact integer
inner product.  The same intervals, over whole groups of anchors and rows, rule
out group pairs before any row is sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written
from .textarrays import column, tidy

#: Reference directions; rows and anchors of a group, about.
REFERENCES, ROWS, ANCHORS = 16, 8192, 2048
#: Components beyond this size (after scaling) would leave 64-bit scores.
LARGEST = 1 << 24
#: What rounding may do to a stored angle, and to a bound relative to the norms.
ANGLE, SLACK = 1e-6, 1e-9

FIELDS = "vec_id long, label int, dim int, cell int, v binary, norm double, angles array<float>"


def directions(dim: int, count: int = REFERENCES) -> np.ndarray:
    """Seeded unit vectors."""
    d = np.random.default_rng(dim).normal(size=(count, dim))
    return d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-300)


def prepared(vectors: DataFrame, scale: float = 256.0, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, dim, cell, v, norm, angles): floor(scale x) of each vector, and its angles to the references.

    cell is the nearest reference.  Rows with a null key, label or vector, or
    with a component that is null, not finite or beyond LARGEST, are left out;
    repeated rows stay; other columns are ignored.
    """

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels, lists = column(batch, key), column(batch, label), column(batch, vector)
            usable = pc.and_(pc.and_(keys.is_valid(), labels.is_valid()), lists.is_valid())
            dims = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims[usable.to_numpy(zero_copy_only=False)]).tolist():
                at = np.flatnonzero((dims == dim) & usable.to_numpy(zero_copy_only=False))
                flat = pc.list_flatten(lists.take(pa.array(at))).cast(pa.float64())
                x = np.floor(flat.to_numpy(zero_copy_only=False).astype(np.float64) * scale).reshape(len(at), dim)
                good = (np.abs(x) <= LARGEST).all(axis=1)  # false for what is null, too
                at, x = at[good], x[good]
                norm = np.sqrt((x * x).sum(axis=1))
                cos = (x @ directions(dim).T) / np.maximum(norm, 1e-300)[:, None]
                angle = np.arccos(np.clip(cos, -1.0, 1.0))
                raw = x.astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.take(pa.array(at)).cast(pa.int64()), labels.take(pa.array(at)).cast(pa.int32()), pa.array(np.full(len(at), dim, np.int32)), pa.array(angle.argmin(axis=1).astype(np.int32)),
                        pa.array([raw[i : i + 4 * dim] for i in range(0, len(raw), 4 * dim)] if dim else [b""] * len(at), pa.binary()), pa.array(norm), pa.array(list(angle.astype(np.float32)), pa.list_(pa.float32())),
                    ],
                    ["vec_id", "label", "dim", "cell", "v", "norm", "angles"],
                )

    return vectors.select(key, label, vector).mapInArrow(tidy(measure), FIELDS)


def _numbered(rows: DataFrame, name: str, size: int) -> DataFrame:
    """``rows`` with a group of about ``size`` each: small cells together, large ones split by a hash of the id."""
    cells = rows.groupBy("dim", "cell").agg(F.count("*").alias("n"))  # REFERENCES rows for each length of vectors
    before = F.sum("n").over(Window.partitionBy("dim").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumns({"first": F.floor(F.coalesce(before, F.lit(0)) / size), "parts": F.ceil(F.col("n") / size)})
    salt = F.when(F.col("parts") > 1, F.concat_ws(":", "cell", F.pmod(F.xxhash64("vec_id"), "parts"))).otherwise(F.concat(F.lit("s"), "first"))
    return rows.join(cells, ["dim", "cell"]).withColumn(name, F.concat_ws("/", "dim", salt)).drop("n", "first", "parts")


def _extent(rows: DataFrame, name: str) -> DataFrame:
    """A row per group: least and greatest angle to each reference, greatest norm."""
    ends = [f(F.get("angles", F.lit(i))).alias(f"{k}{i}") for i in range(REFERENCES) for k, f in (("l", F.min), ("h", F.max))]
    one = rows.groupBy(name, "dim").agg(F.max("norm").alias("norm"), *ends)
    return one.select(name, "dim", "norm", *(F.array(*(f"{k}{i}" for i in range(REFERENCES))).alias(k) for k in "lh"))


def _bounds(chunks: DataFrame, blocks: DataFrame) -> DataFrame:
    """Group pairs with ``low`` and ``high``, between which all their scores lie.

    A chunk of anchors meets every block of rows here: both are groups, of
    which there are thousands of times fewer than rows.
    """
    a, x = chunks.alias("a"), blocks.alias("x")
    gap = lambda i: F.greatest(F.get("a.l", i) - F.get("x.h", i), F.get("x.l", i) - F.get("a.h", i))
    total = lambda i: F.least(F.get("a.h", i) + F.get("x.h", i), 2 * np.pi - F.get("a.l", i) - F.get("x.l", i))
    refs = [F.lit(i) for i in range(REFERENCES)]
    least = F.greatest(F.greatest(*map(gap, refs)).cast("double") - ANGLE, F.lit(0.0))
    most = F.least(F.least(*map(total, refs)).cast("double") + ANGLE, F.lit(np.pi))
    size = F.col("a.norm") * F.col("x.norm")
    # Norms range from 0 to the greatest, so a bound on one side of 0 reaches to 0.
    high = F.when(F.cos(least) > 0, F.cos(least) * size).otherwise(0.0) + size * SLACK + SLACK
    low = F.when(F.cos(most) < 0, F.cos(most) * size).otherwise(0.0) - size * SLACK - SLACK
    return a.join(x, F.col("a.dim") == F.col("x.dim")).select("chunk", "block", low.alias("low"), high.alias("high"))


def _matrix(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["v"]), "<i4").reshape(len(pdf), dim).astype(np.int64)


def _looked_at(found: np.ndarray, angles: np.ndarray, norm: float, x_angles: np.ndarray, x_norm: np.ndarray, low: float, high: float) -> np.ndarray:
    """Which of the rows ``found`` may score between ``low`` and ``high``."""
    theta = x_angles[found]
    size = norm * x_norm[found]
    slack = size * SLACK + SLACK
    least = np.maximum(np.abs(theta - angles).max(axis=1) - ANGLE, 0.0)
    total = theta + angles
    most = np.minimum(np.minimum(total, 2 * np.pi - total).min(axis=1) + ANGLE, np.pi)
    return found[(np.cos(least) * size + slack >= low) & (np.cos(most) * size - slack <= high)]


def _scores(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Exact integer inner products; in doubles where no sum leaves their 53 bits."""
    if x.size and float(np.abs(x).max()) * float(np.abs(a).max()) * len(a) < 2**53:
        return (x.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return x @ a


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by the lesser id."""
    if len(scores) > 8 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _paired(anchors: DataFrame, rows: DataFrame, pairs: DataFrame, task, schema: str) -> DataFrame:
    """``task`` on each pair of a chunk and a block; a group of rows goes where a pair asks for it, no further."""
    left = anchors.join(pairs, "chunk").groupBy("chunk", "block")
    right = rows.join(pairs, "block").groupBy("chunk", "block")
    return left.cogroup(right).applyInPandas(task, schema)


def _positives(wanted: int):
    """The task that finds the ``wanted`` first rows of the anchor's label, from a score of ``need`` on."""

    def task(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(x):
            dim, ids, labels = int(a["dim"].iloc[0]), x["vec_id"].to_numpy(), x["label"].to_numpy()
            xs, avs, theta, norms = _matrix(x, dim), _matrix(a, dim), np.stack(x["angles"]).astype(np.float64), x["norm"].to_numpy()
            for i, r in enumerate(a.itertuples(index=False)):
                same = np.flatnonzero((labels == r.label) & (ids != r.vec_id))
                at = _looked_at(same, np.asarray(r.angles, np.float64), r.norm, theta, norms, r.need, np.inf)
                s = _scores(xs[at], avs[i])
                for j in _first(s, ids[at], wanted):
                    out.append((r.vec_id, int(ids[at[j]]), int(s[j])))
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score"]).astype("int64")

    return task


def _negatives(wanted: int, least_pct: int, most_pct: int):
    """The task that finds the ``wanted`` first rows of other labels within each positive's window of scores."""

    def task(a: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(a) and len(x):
            dim, ids, labels = int(a["dim"].iloc[0]), x["vec_id"].to_numpy(), x["label"].to_numpy()
            xs, avs, theta, norms = _matrix(x, dim), _matrix(a, dim), np.stack(x["angles"]).astype(np.float64), x["norm"].to_numpy()
            for i, r in enumerate(a.itertuples(index=False)):
                other = np.flatnonzero(labels != r.label)
                at = _looked_at(other, np.asarray(r.angles, np.float64), r.norm, theta, norms, r.need, r.limit)
                s = _scores(xs[at], avs[i])
                for p, score in zip(r.positives, r.positive_scores, strict=True):
                    inside = np.flatnonzero((100 * s >= least_pct * score) & (100 * s <= most_pct * score))
                    for j in inside[_first(s[inside], ids[at[inside]], wanted)]:
                        out.append((r.vec_id, int(p), int(score), int(ids[at[j]]), int(s[j])))
        return pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]).astype("int64")

    return task


POSITIVE = "anchor_id long, positive_id long, positive_score long"


def mined(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, least_pct: int = 50, most_pct: int = 95, rows: int = ROWS, anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id ``every`` divides.  For each, its first
    ``positives`` other rows of its label; for each of those, the first
    ``negatives`` rows of other labels that score from ``least_pct`` to
    ``most_pct`` percent of it.  Higher scores come first, ties by the smaller
    vec_id.  Only vectors of one length are compared; rows with the anchor's
    own vec_id are not its positives; a repeated row counts each time; no
    rows give no rows.  ``vectors`` is what ``prepared`` gives.

    A positive search looks at each chunk's nearest block first; the scores
    found there bound what later blocks have to reach.
    """
    base = written(vectors)
    blocks = written(_numbered(base, "block", rows))
    chunks = written(_numbered(base.where(F.col("vec_id") % every == 0), "chunk", anchors))
    extents = written(_extent(blocks, "block"))
    bounds = written(_bounds(_extent(chunks, "chunk"), extents))
    place = F.row_number().over(Window.partitionBy("chunk").orderBy(F.col("high").desc(), "block"))
    ranked = written(bounds.withColumn("place", place))  # a row per pair of groups
    rows_ = blocks.select("block", "vec_id", "label", "v", "norm", "angles")
    anchor = chunks.select("chunk", "vec_id", "label", "dim", "v", "norm", "angles")
    near = written(_paired(anchor.withColumn("need", F.lit(float("-inf"))), rows_, ranked.where("place = 1").select("chunk", "block"), _positives(positives), POSITIVE))
    bar = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.when(F.count("*") >= positives, F.min("positive_score").cast("double")).alias("bar"))
    known = written(anchor.join(bar.distinct(), "vec_id", "left").withColumn("need", F.coalesce("bar", F.lit(float("-inf")))).drop("bar"))
    least = known.groupBy("chunk").agg(F.min("need").alias("need"))
    rest = ranked.where("place > 1").join(least, "chunk").where("high >= need").select("chunk", "block")
    far = _paired(known, rows_, rest, _positives(positives), POSITIVE)
    order = Window.partitionBy("anchor_id").orderBy(F.col("positive_score").desc(), "positive_id")
    chosen = written(near.union(far).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= positives))
    # What an anchor looks for: from the lowest end of its windows to the highest.
    score = F.col("positive_score")
    windows = chosen.where(score >= 0).groupBy(F.col("anchor_id").alias("vec_id")).agg(
        F.collect_list("positive_id").alias("positives"), F.collect_list("positive_score").alias("positive_scores"),  # ``positives`` at most
        (F.min(score) * least_pct / 100.0).alias("need"), (F.max(score) * most_pct / 100.0).alias("limit"),
    )
    asking = written(anchor.join(windows, "vec_id"))
    span = asking.groupBy("chunk").agg(F.min("need").alias("need"), F.max("limit").alias("limit"))
    worth = ranked.join(span, "chunk").where("high >= need and low <= limit").select("chunk", "block")
    found = _paired(asking, rows_, worth, _negatives(negatives, least_pct, most_pct), f"{POSITIVE}, negative_id long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
