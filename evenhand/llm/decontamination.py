"""Benchmark decontamination by a broadcast set of test windows.

The windows of the benchmark go to every task in slices of bounded size; the
documents are scanned where they lie, hits are verified word by word, and
nothing is shuffled unless the benchmark needs more than one slice.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches, fresh, written
from .textarrays import ALNUM, Block, Words, blocks, column, grams, tidy, word_hashes, words

#: Words of a window.
WINDOW = 10
#: Windows in one broadcast slice (about 200 bytes each in a task's memory).
SLICE = 1_000_000


def item_windows(items: DataFrame, window: int = WINDOW, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item, size, gram): distinct windows of the items; a shorter item is one window, one without words has none.

    ``gram`` is the words with a space between each; null ids are kept.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "item").to_pylist()
            out: dict[str, list] = {"item": [], "size": [], "gram": []}
            for block in blocks(column(batch, "t"), lower=True):
                raw, w = block.data.tobytes(), words(block, ALNUM)
                own = defaultdict(list)
                for a, b, d in zip(w.start.tolist(), w.end.tolist(), w.doc.tolist(), strict=True):
                    own[d].append(raw[a:b])
                for d, seq in own.items():
                    n = min(window, len(seq))
                    for g in {b" ".join(seq[i : i + n]) for i in range(len(seq) - n + 1)}:
                        out["item"].append(ids[block.first + d])
                        out["size"].append(n)
                        out["gram"].append(g)
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["size"], pa.int32()), pa.array(out["gram"], pa.binary())], ["item", "size", "gram"])

    return items.select(F.col(key).cast("string").alias("item"), F.col(text).alias("t")).mapInArrow(tidy(cut), "item string, size int, gram binary").distinct()


class Windows:
    """One slice: sorted hashes by window size, and each window's items."""

    def __init__(self, rows: list[tuple[int, bytes, list[str]]]):
        self.items = {gram: found for _, gram, found in rows}
        by_size = defaultdict(list)
        for size, gram, _ in rows:
            by_size[size].append(gram)
        self.hashes = {}
        for size, found in by_size.items():
            h = [grams(word_hashes(b, w), w.doc, size)[0] for b in blocks(pa.array(found, pa.binary())) for w in [words(b, ALNUM)]]
            self.hashes[size] = np.unique(np.concatenate(h))


def scan(docs: DataFrame, shared, text: str, key: str, spans: bool) -> DataFrame:
    """(key, n_words, hits, items[, text spans]) of each row, for one slice of windows."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Windows = shared.value
        for batch in batches:
            n_words, hits, items, bytes_hit = [], [], [], []
            for block in blocks(column(batch, "t"), lower=True):
                w = words(block, ALNUM)
                at = np.searchsorted(w.doc, np.arange(block.docs + 1))
                found: dict[int, list] = defaultdict(list)
                raw = None
                h = word_hashes(block, w) if known.hashes else None
                for size, table in known.hashes.items():
                    g, first = grams(h, w.doc, size)
                    near = np.minimum(np.searchsorted(table, g), len(table) - 1)
                    for i in first[table[near] == g].tolist():
                        raw = block.data.tobytes() if raw is None else raw
                        gram = b" ".join(raw[a:b] for a, b in zip(w.start[i : i + size], w.end[i : i + size], strict=True))
                        if gram in known.items:  # verified
                            found[int(w.doc[i])].append((i, size, known.items[gram]))
                for d in range(block.docs):
                    n_words.append(int(at[d + 1] - at[d]))
                    mark = np.zeros(n_words[-1], bool)
                    own: set = set()
                    for i, size, which in found.get(d, ()):
                        mark[i - at[d] : i - at[d] + size] = True
                        own.update(which)
                    where = np.flatnonzero(mark)
                    hits.append(where.tolist())
                    items.append(sorted(own))
                    if spans:
                        runs = np.split(where, np.flatnonzero(np.diff(where) != 1) + 1) if len(where) else []
                        base = block.at[d]
                        bytes_hit.append([x for r in runs for x in (int(w.start[at[d] + r[0]] - base), int(w.end[at[d] + r[-1]] - base))])
            columns = [column(batch, "id"), pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
            names = ["id", "n_words", "hits", "items"]
            if spans:
                columns.append(pa.array(bytes_hit, pa.list_(pa.int64())))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names)

    fields = f"id {kind}, n_words long, hits array<int>, items array<string>" + ", spans array<long>" * spans
    return docs.select(F.col(key).alias("id"), F.col(text).alias("t")).mapInArrow(tidy(run), fields)


def contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, slice_rows: int = SLICE, text: str = "text", key: str = "doc_id", item_key: str = "item_id", spans: bool = False
) -> DataFrame:
    """(key, n_words, hits, items) of each document: the numbers of its hit words and the ids of the items.

    Every occurrence counts, overlaps included.  Null and empty texts have no
    words; items without words never match; a null item id marks words but is
    no id; repeated items share their ids' place and repeated documents are
    scanned alike; empty tables give no rows or no hits; other columns are
    ignored.  With ``spans``, the byte ranges of the hit runs come along.
    A benchmark beyond ``slice_rows`` windows is scanned in several slices,
    whose hits are united per document.
    """
    grams_by = item_windows(items, window, text, item_key)
    grams_by = written(grams_by.groupBy("gram").agg(F.min("size").alias("size"), F.collect_set("item").alias("items")))
    total = grams_by.count()
    parts = max(1, -(-total // slice_rows))
    sc = docs.sparkSession.sparkContext
    scans = []
    if parts > 1:
        docs = written(docs.select(key, text).withColumn("_row", F.monotonically_increasing_id()))
    for p in range(parts):
        some = grams_by if parts == 1 else grams_by.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == p)
        rows = [(r["size"], bytes(r["gram"]), list(r["items"])) for r in some.collect()]  # at most about slice_rows
        scans.append(scan(docs, sc.broadcast(Windows(rows)), text, key if parts == 1 else "_row", spans))
    if parts == 1:
        return scans[0].withColumnRenamed("id", key)
    both = scans[0]
    for s in scans[1:]:
        both = both.unionByName(s)
    merged = both.groupBy("id").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return docs.select("_row", key).join(merged, F.col("_row") == F.col("id")).drop("_row", "id")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated) of ``contamination``'s rows."""
    return found.select(
        key,
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, max_share: float = 0.5, window: int = WINDOW, slice_rows: int = SLICE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without benchmark passages: hit runs of words are cut out of the text.

    A document of which more than ``max_share`` of the words are hit goes
    entirely.  One narrow pass over the rows; every other column passes
    through.  Texts without a hit are untouched, nulls and empties included;
    repeated rows are cut alike; an empty table stays empty and an empty
    benchmark changes nothing.  A benchmark beyond ``slice_rows`` windows
    takes a pass for each slice, with one slice in memory at a time; the cut
    comes last, on the input's text.
    """
    bounded_batches(docs.sparkSession)
    names, hit = docs.columns, fresh(docs, "_hit")
    grams_by = written(item_windows(items, window, text).groupBy("gram").agg(F.min("size").alias("size")))
    parts = max(1, -(-grams_by.count() // slice_rows))
    sc = docs.sparkSession.sparkContext
    marked = docs.withColumn(hit, F.array().cast("array<int>"))
    for p in range(parts):
        some = grams_by if parts == 1 else grams_by.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == p)
        shared = sc.broadcast(Windows([(r["size"], bytes(r["gram"]), []) for r in some.collect()]))  # at most about slice_rows
        if p + 1 < parts:
            marked = written(_marked(marked, shared, text, hit))
    return _cut(marked, shared, text, hit, max_share).select(*names)


def _hit_words(block: Block, w: Words, known: Windows) -> np.ndarray:
    mark = np.zeros(len(w.start), bool)
    if not known.hashes or not len(mark):
        return mark
    h = word_hashes(block, w)
    raw = None
    for size, table in known.hashes.items():
        g, first = grams(h, w.doc, size)
        near = np.minimum(np.searchsorted(table, g), len(table) - 1)
        for i in first[table[near] == g].tolist():
            raw = block.data.tobytes() if raw is None else raw
            if b" ".join(raw[a:b] for a, b in zip(w.start[i : i + size], w.end[i : i + size], strict=True)) in known.items:
                mark[i : i + size] = True
    return mark


def _with_marks(batch: pa.RecordBatch, known: Windows, text: str, hit: str) -> list:
    """Of each row the numbers of its hit words, those marked before included."""
    seen, hits = column(batch, hit).to_pylist(), []
    for block in blocks(column(batch, text), lower=True):
        w = words(block, ALNUM)
        mark = _hit_words(block, w, known)
        at = np.searchsorted(w.doc, np.arange(block.docs + 1))
        for d in range(block.docs):
            new = np.flatnonzero(mark[at[d] : at[d + 1]])
            old = seen[block.first + d]
            hits.append(np.union1d(old, new).astype(np.int64) if old else new)
    return hits


def _marked(docs: DataFrame, shared, text: str, hit: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = _with_marks(batch, shared.value, text, hit)
            k = batch.schema.get_field_index(hit)
            yield batch.set_column(k, batch.schema.field(k), pa.array(hits, pa.list_(pa.int32())).cast(batch.schema.field(k).type))

    return docs.mapInArrow(tidy(run), docs.schema)


def _cut(docs: DataFrame, shared, text: str, hit: str, max_share: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, hits = column(batch, text), _with_marks(batch, shared.value, text, hit)
            keep = np.ones(batch.num_rows, bool)
            if not any(len(h) for h in hits):
                yield batch
                continue
            out = texts.to_pylist()
            for block in blocks(texts, lower=True):
                busy = [d for d in range(block.docs) if len(hits[block.first + d])]
                if not busy:
                    continue
                w = words(block, ALNUM)
                at = np.searchsorted(w.doc, np.arange(block.docs + 1))
                for d in busy:
                    i = block.first + d
                    where = hits[i]
                    if len(where) > max_share * (at[d + 1] - at[d]):
                        keep[i] = False
                        continue
                    raw, base, kept, last = out[i].encode(), block.at[d], [], 0
                    for run_ in np.split(where, np.flatnonzero(np.diff(where) != 1) + 1):
                        kept.append(raw[last : w.start[at[d] + run_[0]] - base])
                        last = int(w.end[at[d] + run_[-1]] - base)
                    out[i] = (b"".join(kept) + raw[last:]).decode()
            k = batch.schema.get_field_index(text)
            batch = batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidy(run), docs.schema)
