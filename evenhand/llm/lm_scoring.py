"""LM scoring by deleted interpolation of word bigrams.

A token's probability mixes the bigram's maximum-likelihood estimate with the
smoothed unigram, by a weight for the bucket of its context's frequency.  The
weights are learned by expectation-maximisation on a deleted fold of the
training documents, whose own counts are taken out of the estimates.

Documents are dealt to chunks.  A chunk sends its distinct n-grams, sorted,
once to the buckets that count them; each bucket answers with the totals in
the same order, so no n-gram travels back and no document is joined token by
token.  n-grams are known by hashes, of 64 bits for words and 56 for bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written
from .textarrays import NOT_SPACE, P, U, blocks, column, mix, word_hashes, words

#: Training documents, and the deleted fold among them, by crc32 of the id modulo FOLDS.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Bytes of text in a chunk, and of text whose n-grams fill a bucket.
CHUNK, BUCKET = 8 << 20, 8 << 20
#: The end token, which is also the context of a first word.
END = mix(np.array([0x656E64], dtype=np.uint64))[0]
#: Context-frequency buckets (powers of two), and steps of log2(ratio) in the statistics for EM.
CONTEXTS, STEPS = 48, 32
NONE = -(1 << 20)

WORD, PAIR = 0, 1


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens in order, an end after each text, and the texts' offsets among them."""
    parts, counts = [], []
    for block in blocks(texts, lower=True):
        w = words(block, NOT_SPACE)
        n = np.bincount(w.doc, minlength=block.docs)
        out = np.full(len(w.start) + block.docs, END)
        out[np.arange(len(w.start)) + w.doc] = word_hashes(block, w)
        parts.append(out)
        counts.append(n + 1)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)


def contexts(h: np.ndarray) -> np.ndarray:
    """The token before each; the end token before a text's first word."""
    out = np.empty_like(h)
    if len(h):
        out[0], out[1:] = END, h[:-1]
    return out


def pair_hashes(h: np.ndarray) -> np.ndarray:
    return mix(mix(contexts(h) + U(P)) ^ (h * U(P))) >> U(8)


def _cuts(keys: np.ndarray, kind: int, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, first, end) of the bucket ranges that sorted hashes have; as many as there are hashes at most."""
    bucket = (keys // U((1 << (64 if kind == WORD else 56)) // buckets + 1) if buckets > 1 else keys * U(0)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else np.zeros(0, np.int64)
    return list(zip(bucket[first].tolist(), first.tolist(), np.append(first[1:], len(keys)).tolist(), strict=True))


def _write_keys(keys: np.ndarray, kind: int) -> bytes:
    """Sorted hashes: the low part as it is, the high part as steps, which compress."""
    if kind == WORD:
        return keys.tobytes()
    high = (keys >> U(40)).astype(np.int64)
    return keys.astype(np.uint32).tobytes() + (keys >> U(32)).astype(np.uint8).tobytes() + np.diff(high, prepend=0).astype(np.uint16).tobytes()


def _read_keys(data: bytes, kind: int) -> np.ndarray:
    if kind == WORD:
        return np.frombuffer(data, np.uint64)
    n = len(data) // 7
    low, mid, step = np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.uint8, n, 4 * n), np.frombuffer(data[5 * n :], np.uint16)
    return low.astype(np.uint64) | (mid.astype(np.uint64) << U(32)) | (np.cumsum(step.astype(np.uint64)) << U(40))


def _dealt(docs: DataFrame, chunks: int, text: str, key: str) -> DataFrame:
    """(chunk, data): documents packed by chunk, in compressed Arrow; the deleted fold has chunks of its own, from ``chunks`` on."""
    part = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % FOLDS, F.lit(0))
    deleted = part == DELETED
    number = F.xxhash64(key, text)
    chunk = F.when(deleted, chunks + F.pmod(number, F.lit(max(1, chunks // FOLDS)))).otherwise(F.pmod(number, F.lit(chunks))).cast("int")
    rows = docs.select(F.col(key).alias("id"), (part == HELD_OUT).alias("held"), chunk.alias("chunk"), F.col(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            number = np.array(column(batch, "chunk"))
            order = np.argsort(number, kind="stable")
            each, start = np.unique(number[order], return_index=True)
            data = []
            for i, s in enumerate(start):
                sink = pa.BufferOutputStream()
                some = batch.take(pa.array(order[s : start[i + 1] if i + 1 < len(start) else None])).select(["id", "held", "t"])
                with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                    out.write_batch(some)
                data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.int32()), pa.array(data, pa.binary())], ["chunk", "data"])

    return rows.mapInArrow(run, "chunk int, data binary")


def _opened(table: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in table["data"]]).combine_chunks()


def _text(table: pa.Table) -> pa.Array:
    t = table["t"]
    return t.chunk(0) if t.num_chunks == 1 else pa.concat_arrays([c.cast(pa.large_binary()) for c in t.chunks])


def _counted(dealt: DataFrame, chunks: int, buckets: tuple[int, int]) -> DataFrame:
    """(chunk, kind, bucket, total, kept, types, n, n_kept) from the buckets.

    total: training counts of a chunk's n-grams in order; kept, for chunks of
    the deleted fold, those without the fold.  Rows of chunk -1 have the
    number of types and of tokens of the bucket.
    """

    def ask(table: pa.Table) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        docs = _opened(table)
        h, at = tokens(_text(docs))
        learn = np.repeat(~np.array(docs["held"]), np.diff(at))
        out: dict[str, list] = {"bucket": [], "kind": [], "keys": [], "counts": []}
        for kind, x in ((WORD, h), (PAIR, pair_hashes(h))):
            keys, inverse = np.unique(x, return_inverse=True)
            counts = np.bincount(inverse[learn], minlength=len(keys)).astype(np.uint32)
            for b, first, end in _cuts(keys, kind, buckets[kind]):
                s = slice(first, end)
                out["bucket"].append(b)
                out["kind"].append(kind)
                out["keys"].append(_write_keys(keys[s], kind))
                out["counts"].append(counts[s].tobytes())
        n = len(out["bucket"])
        return pa.table([pa.array([chunk] * n, pa.int32()), pa.array(out["kind"], pa.int32()), pa.array(out["bucket"], pa.int32()), pa.array(out["keys"], pa.binary()), pa.array(out["counts"], pa.binary())], ["chunk", "kind", "bucket", "keys", "counts"])

    def answer(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        keys = [_read_keys(x.as_py(), kind) for x in table["keys"]]
        counts = [np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]
        asked = table["chunk"].to_pylist()
        each, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(counts), len(each)).astype(np.int64)
        fold = np.bincount(inverse, np.concatenate([c if a >= chunks else np.zeros_like(c) for a, c in zip(asked, counts, strict=True)]), len(each)).astype(np.int64)
        at = np.cumsum([0, *map(len, keys)])
        totals, kept = [], []
        for i, a in enumerate(asked):
            own = inverse[at[i] : at[i + 1]]
            totals.append(_write_counts(total[own]))
            kept.append(_write_counts((total - fold)[own]) if a >= chunks else None)
        words_ = kind == WORD
        rows = len(asked) + 1
        return pa.table(
            [
                pa.array([*asked, -1], pa.int32()), pa.array([kind] * rows, pa.int32()), pa.array([bucket] * rows, pa.int32()), pa.array([*totals, None], pa.binary()), pa.array([*kept, None], pa.binary()),
                pa.array([0] * (rows - 1) + [int((total > 0).sum()) * words_]), pa.array([0] * (rows - 1) + [int(total.sum()) * words_]), pa.array([0] * (rows - 1) + [int((total - fold).sum()) * words_]),
            ],
            ["chunk", "kind", "bucket", "total", "kept", "types", "n", "n_kept"],
        )

    asked = dealt.groupBy("chunk").applyInArrow(ask, "chunk int, kind int, bucket int, keys binary, counts binary")
    return asked.groupBy("kind", "bucket").applyInArrow(answer, "chunk int, kind int, bucket int, total binary, kept binary, types long, n long, n_kept long")


def _write_counts(x: np.ndarray) -> bytes:
    """One byte each, and the larger ones apart."""
    large = np.flatnonzero(x >= 255)
    return len(large).to_bytes(8, "little") + large.astype("<u4").tobytes() + x[large].astype("<i8").tobytes() + np.minimum(x, 255).astype(np.uint8).tobytes()


def _read_counts(data: bytes) -> np.ndarray:
    k = int.from_bytes(data[:8], "little")
    x = np.frombuffer(data, np.uint8, offset=8 + 12 * k).astype(np.int64)
    x[np.frombuffer(data, "<u4", k, 8)] = np.frombuffer(data, "<i8", k, 8 + 4 * k)
    return x


def _looked_up(docs: pa.Table, counts: pa.Table, which: str) -> tuple[np.ndarray, ...]:
    """(offsets, c(word), c(context), c(pair)) of every token of a chunk."""
    h, at = tokens(_text(docs))
    found = []
    for kind, x in ((WORD, h), (PAIR, pair_hashes(h))):
        rows = [(b, v) for k, b, v in zip(counts["kind"].to_pylist(), counts["bucket"].to_pylist(), counts[which].to_pylist(), strict=True) if k == kind]
        _, inverse = np.unique(x, return_inverse=True)
        found.append(np.concatenate([_read_counts(v) for _, v in sorted(rows, key=lambda r: r[0])])[inverse])
    word = found[0]
    before = np.empty_like(word)
    end = np.flatnonzero(h == END)
    before[0], before[1:] = word[end[0]], word[:-1]
    return at, word, before, found[1]


def context_bucket(c: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), CONTEXTS - 1)


def weights(statistics: list[tuple[int, int, int]], rounds: int = 60) -> np.ndarray:
    """Mixture weights by context bucket from (bucket, step of log2(bigram / unigram), events).

    Each bucket has its own EM; one without events takes its lower neighbour's weight.
    """
    out, last = np.zeros(CONTEXTS), 0.5
    by: dict[int, list] = {}
    for b, x, n in statistics:
        by.setdefault(b, []).append((0.0 if x == NONE else 2.0 ** (x / STEPS), n))
    for b in range(CONTEXTS):
        if b in by:
            r, n = np.array(by[b]).T
            lam = 0.5
            for _ in range(rounds):
                lam = float((n * lam * r / (lam * r + 1 - lam)).sum() / n.sum())
                lam = min(max(lam, 1e-6), 1 - 1e-6)
            last = lam
        out[b] = last
    return out


def scored(docs: DataFrame, text: str = "text", key: str = "doc_id", chunk_bytes: int = CHUNK) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Null and empty texts are an end token alone.  A null key counts as
    training.  Repeated rows count each time; without training documents every
    probability is that of the unseen; an empty table gives no rows; other
    columns are ignored.
    """
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) + F.count("*")).first()[0]
    chunks = max(1, -(-size // chunk_bytes))
    buckets = (max(1, -(-size // (4 * BUCKET))), max(1, -(-size // BUCKET)))
    dealt = _dealt(docs, chunks, text, key)
    counts = written(_counted(dealt, chunks, buckets))
    types, n, n_kept = counts.where("chunk = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("types", "n", "n_kept"))).first()
    asked = counts.where("chunk >= 0").select("chunk", "kind", "bucket", "total", "kept")

    def ratios(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({"b": pa.array([], pa.int32()), "x": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        _, word, before, pair = _looked_up(_opened(left), right, "kept")
        at = before > 0
        r = (pair[at] / before[at]) * ((n_kept + types + 1) / (word[at] + 1))
        x = np.where(r > 0, np.round(np.log2(np.where(r > 0, r, 1)) * STEPS), NONE).astype(np.int64)
        each, count = np.unique(np.stack([context_bucket(before[at]), x]), axis=1, return_counts=True)
        return pa.table({"b": pa.array(each[0].astype(np.int32)), "x": pa.array(each[1].astype(np.int32)), "n": pa.array(count.astype(np.int64))})

    fold, own = dealt.where(F.col("chunk") >= chunks), asked.where(F.col("chunk") >= chunks)
    found = fold.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(ratios, "b int, x int, n long").groupBy("b", "x").agg(F.sum("n").alias("n"))
    lam = weights([tuple(r) for r in found.collect()])  # at most CONTEXTS x some thousand steps
    kind = docs.schema[key].dataType.simpleString()

    def probabilities(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _opened(left)
        at, word, before, pair = _looked_up(table, right, "total")
        base = (word + 1) / (n + types + 1)
        mixed = np.where(before > 0, lam[context_bucket(before)], 0.0)
        p = mixed * pair / np.maximum(before, 1) + (1 - mixed) * base
        add = lambda x: np.add.reduceat(x, at[:-1])
        return pa.table(
            [table["id"], table["held"], pa.array(np.diff(at)), pa.array(add((word > 0).astype(np.int64))), pa.array(np.full(len(at) - 1, n, np.int64)), pa.array(add(np.log10(base))), pa.array(add(np.log10(p)))],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    fields = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = dealt.groupBy("chunk").cogroup(asked.drop("kept").groupBy("chunk")).applyInArrow(probabilities, fields)
    return out.withColumnRenamed("id", key)
