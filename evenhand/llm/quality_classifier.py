"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics come from one pass over the bytes of each text.  The trees are fitted
on a bounded sample of labelled rows, flattened into arrays, and broadcast; every
document is scored by walking all its rows down a tree at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import if_small, written
from .textarrays import LOWER, NOT_SPACE, blocks, column, grams, span, prefix, words

#: Labelled rows to fit on, those of least hash (a documented bound).
SAMPLE = 60_000
BINS = 64

STATISTICS = [
    "log_bytes", "log_words", "word_length", "word_length_sd", "longest_word", "upper", "digits", "punctuation", "symbols", "non_ascii", "spaces",
    "lines", "dup_lines", "distinct_words", "repeated_grams", "bangs", "pipes", "commas", "stops", "capital_words", "short_words", "long_words", "quotes", "words_per_line", "ats", "byte_entropy", "top_word", "vowels",
]


def _share(marks: np.ndarray, at: np.ndarray, per: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(marks)])
    return (sums[at[1:]] - sums[at[:-1]]) / np.maximum(per, 1)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


UPPER, DIGIT, PUNCT, SYMBOL, VOWEL = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".,;:!?'\"()-"), _table("#*$%&|<>@=+~^_\\{}[]/"), _table("aeiouAEIOU")


def statistics(texts: pa.Array) -> np.ndarray:
    """rows x STATISTICS; an empty or null text has zeros, and 1 as its share of distinct words."""
    out = [np.zeros((0, len(STATISTICS)))]
    for b in blocks(texts):
        at, data, n = b.at, b.data, np.diff(b.at).astype(float)
        w = words(b, NOT_SPACE)
        wat = np.searchsorted(w.doc, np.arange(b.docs + 1))
        m = np.diff(wat).astype(float)
        length = (w.end - w.start).astype(float)
        mean = _share(length, wat, m)
        low = b._replace(data=LOWER[data])
        h = span(prefix(low.data), w.start, w.end)
        longest = np.zeros(b.docs)
        np.maximum.at(longest, w.doc, length)

        def repeats(x: np.ndarray, doc: np.ndarray, docs: int = b.docs) -> tuple[np.ndarray, np.ndarray]:
            """Of values in each document: those seen before, and the most frequent one's count."""
            order = np.lexsort((x, doc))
            xs, ds = x[order], doc[order]
            new = np.ones(len(xs), bool)
            new[1:] = (xs[1:] != xs[:-1]) | (ds[1:] != ds[:-1])
            start = np.flatnonzero(new)
            top = np.zeros(docs)
            np.maximum.at(top, ds[start], np.diff(np.append(start, len(xs))))
            return np.bincount(ds[~new], minlength=docs), top

        seen, top = repeats(h, w.doc)
        g, first = grams(h, w.doc, 4)
        again, _ = repeats(g, w.doc[first])
        breaks = data == 10
        cut = np.flatnonzero(breaks)
        edges = np.unique(np.concatenate([at[:-1][n > 0], cut + 1, at[1:][n > 0]])).astype(np.int64)
        ls, le = edges[:-1], edges[1:]
        ld = np.searchsorted(at, ls, side="right") - 1
        full = le - ls > 1
        lh = span(prefix(data), ls[full], le[full] - (data[le[full] - 1] == 10))
        dup, _ = repeats(lh, ld[full])
        lines = np.bincount(ld, minlength=b.docs).astype(float)
        doc = np.repeat(np.arange(b.docs), np.diff(at))
        freq = np.bincount(doc * 256 + data, minlength=256 * b.docs).reshape(b.docs, 256) / np.maximum(n, 1)[:, None]
        entropy = -(freq * np.log2(np.where(freq > 0, freq, 1))).sum(axis=1)
        is_upper = UPPER[data]
        sd = np.sqrt(np.maximum(_share(length**2, wat, m) - mean**2, 0))
        out.append(np.column_stack([
            np.log1p(n), np.log1p(m), mean, sd, np.log1p(longest), _share(is_upper, at, n), _share(DIGIT[data], at, n), _share(PUNCT[data], at, n), _share(SYMBOL[data], at, n),
            _share(data >= 128, at, n), _share(~NOT_SPACE[data], at, n), np.log1p(lines), dup / np.maximum(lines, 1), 1 - seen / np.maximum(m, 1), again / np.maximum(m, 1),
            _share(data == 33, at, n), _share(data == 124, at, n), _share(data == 44, at, n), _share(data == 46, at, n), _share(is_upper[w.start], wat, m), _share(length <= 3, wat, m),
            _share(length >= 12, wat, m), _share(data == 34, at, n), m / np.maximum(lines, 1), _share(data == 64, at, n), entropy, top / np.maximum(m, 1), _share(VOWEL[data], at, n),
        ]))
    return np.concatenate(out)


@dataclass
class Trees:
    """Boosted trees in flat arrays: node i's statistic, threshold and left child (the right one follows it); leaves have child 0."""

    feature: np.ndarray  # trees x nodes
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, t, c, v in zip(self.feature, self.threshold, self.child, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            while (inner := c[at] > 0).any():
                at = np.where(inner, c[at] + (x[rows, f[at]] > t[at]), at)
            total += v[at]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = BINS, least: float = 5.0, l2: float = 1.0) -> Trees:
    """Histogram boosting with the logistic loss; splits by gain over quantile bins.

    Without rows, or with one class only, every score is the smoothed share of label 1.
    """
    n, k = x.shape if len(x) else (0, len(STATISTICS))
    share = (y.sum() + 1) / (len(y) + 2)
    base, size = float(np.log(share / (1 - share))), 2 ** (depth + 1)
    shape = (trees, size)
    model = Trees(np.zeros(shape, np.int64), np.zeros(shape), np.zeros(shape, np.int64), np.zeros(shape), base)
    if n < 2 * least or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    offset = binned + np.arange(k) * bins
    f = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-f))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node, live, used = np.zeros(n, np.int64), [0], 1
        for level in range(depth + 1):
            split = {}
            for q in live:
                at = np.flatnonzero(node == q)
                gs, hs = g[at].sum(), h[at].sum()
                model.value[t, q] = -rate * gs / (hs + l2)
                if level == depth or len(at) < 2 * least:
                    continue
                flat = offset[at].ravel()
                hist = lambda v: np.bincount(flat, np.repeat(v, k), k * bins).reshape(k, bins).cumsum(axis=1)  # noqa: E731, B023
                gl, hl, nl = hist(g[at]), hist(h[at]), hist(np.ones(len(at)))
                gain = gl**2 / (hl + l2) + (gs - gl) ** 2 / (hs - hl + l2) - gs**2 / (hs + l2)
                gain = np.where((nl >= least) & (len(at) - nl >= least), gain, 0)
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] > 1e-6 and b < len(edges[j]):
                    split[q] = (j, b, at)
            live = []
            for q, (j, b, at) in split.items():
                model.feature[t, q], model.threshold[t, q], model.child[t, q] = j, edges[j][b], used
                node[at] = used + (binned[at, j] > b)
                live += [used, used + 1]
                used += 2
        f += model.value[t, node]
    return model


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0):
    """Whether a row is held out: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text", key: str = "doc_id") -> Trees:
    """Trees fitted on at most ``sample`` labelled documents outside the held-out fold.

    Rows without a label or text row teach nothing; contradicting labels both
    count; a null text teaches as an empty one; without any labelled row every
    score is one half.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).select(F.col(key).alias("_k"), F.col(label).cast("int").alias("y"))
    wanted = wanted.orderBy(F.xxhash64("_k"), "_k", "y").limit(sample)
    wanted = written(wanted)
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("t")).join(if_small(wanted), "_k")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(column(batch, "t"))
            yield pa.RecordBatch.from_arrays([column(batch, "_k"), column(batch, "y"), pa.array(list(x), pa.list_(pa.float64()))], ["k", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    measured = written(rows.mapInArrow(measure, f"k {kind}, y int, x array<double>"))
    pdf = measured.orderBy(F.xxhash64("k", "y"), "k").limit(sample).toPandas()  # the bounded sample
    x = np.array(pdf["x"].tolist()).reshape(len(pdf), len(STATISTICS))
    return fit(x, pdf["y"].to_numpy(dtype=float))


def scored(docs: DataFrame, model: Trees, threshold: float = 0.3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, held_out, score, predicted) of every row; narrow, one pass.

    Empty and null texts are scored too; a null id counts as not held out;
    repeated rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(statistics(column(batch, "t")))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(score)], ["id", "score"])

    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(run, f"id {kind}, score double")
    return rows.select(F.col("id").alias(key), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
