"""Best-fit packing of token pieces into sequences, improved by swaps.

Documents are encoded once; only (piece, length) rows move.  Pieces are packed
in hashed buckets of bounded size: best-fit decreasing first, then a local
search that moves pieces between underfull bins, or exchanges one for one or
two for one, always raising the sum of squared fills, until bins empty or the
bound of ceil(tokens / capacity) is met.  Bins that stay underfull are
dissolved and packed again with those of other buckets, level by level.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoders import WordPieces, loaded
from .tables import bounded_batches, written
from .textarrays import column, tidy

CAPACITY = 4096
END = 1
#: Pieces in a bucket.
BUCKET = 4096
#: Bins filled less than this share are packed again at the next level.
FULL = 0.999


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, piece, start, length, ids_crc32): the ids of each whole text and an end id, cut at ``capacity``.

    A null or empty text is its end id; a long text's ids are in one task's
    memory; repeated rows and null keys are rows like others; an empty table
    gives no rows; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(WordPieces, path)
        end = END.to_bytes(4, "little")
        for batch in batches:
            keys, texts = column(batch, key), column(batch, text)
            for lo in range(0, batch.num_rows, 512):
                row, piece, start, length, crc = [], [], [], [], []
                for i, raw in enumerate(encoder.encode(t.as_py() or "" for t in texts.slice(lo, 512)), lo):
                    raw += end
                    for p, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        row.append(i)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    [key, "piece", "start", "length", "ids_crc32"],
                )

    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(tidy(encode), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the rooms that some bin has, ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = room - n
        if not by_room[left]:
            insort(rooms, left)
        by_room[left].append(b)
    return bins


def _step(a: list[int], b: list[int], sizes: np.ndarray, room: int) -> bool:
    """Best single change that fills bin ``b`` (with ``room`` left) from bin ``a``; False if none does."""
    sa, sb = sizes[a], sizes[b]
    best, change = 0, None
    fits = np.flatnonzero(sa <= room)
    if len(fits):  # move one
        i = int(fits[np.argmax(sa[fits])])
        best, change = int(sa[i]), ([i], None)
    if best < room and len(b):  # one for one
        order = np.argsort(sb, kind="stable")
        want = sa[:, None] - sb[order][None, :]
        gain = np.where((want > best) & (want <= room), want, 0)
        if gain.any():
            i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
            best, change = int(gain[i, j]), ([int(i)], int(order[j]))
    if best < room and len(b) and 2 <= len(a) <= 512:  # two for one
        i, k = np.triu_indices(len(a), 1)
        two = sa[i] + sa[k]
        for j in range(len(b)):
            gain = two - sb[j]
            ok = np.flatnonzero((gain > best) & (gain <= room))
            if len(ok):
                x = int(ok[np.argmax(gain[ok])])
                best, change = int(gain[x]), ([int(i[x]), int(k[x])], j)
                if best == room:
                    break
    if change is None:
        return False
    out, back = change
    moved = [a[i] for i in out]
    returned = [] if back is None else [b.pop(back)]
    a[:] = [x for i, x in enumerate(a) if i not in out] + returned
    b.extend(moved)
    return True


def improve(bins: list[list[int]], sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Swap-based local search over the underfull bins.

    Every change moves tokens from an emptier bin into a fuller one, so the sum
    of squared fills rises and the search ends.
    """
    least = -(-int(sizes.sum()) // capacity)
    fill = [int(sizes[b].sum()) for b in bins]
    while len(bins) > least:
        under = sorted((i for i in range(len(bins)) if fill[i] < capacity), key=lambda i: fill[i])
        if len(under) < 2 or sum(capacity - fill[i] for i in under[1:]) < fill[under[0]]:
            break
        source, changed = under[0], False
        for i in reversed(under[1:]):
            while bins[source] and fill[i] < capacity and fill[i] >= fill[source] and _step(bins[source], bins[i], sizes, capacity - fill[i]):
                changed = True
                fill[i], fill[source] = int(sizes[bins[i]].sum()), int(sizes[bins[source]].sum())
            if not bins[source]:
                break
        if not bins[source]:
            del bins[source], fill[source]
        elif not changed:
            break
    return bins


def _placer(capacity: int, level: int, last: bool):
    """The task of one bucket: sequence_id and offset, and whether the bin is to be dissolved (``_s``)."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        # By content first: the same bins whatever order the rows arrive in.
        pdf = pdf.sort_values([c for c in pdf.columns if c not in ("sequence_id", "offset", "_b", "_s")] + ["sequence_id"]).reset_index(drop=True)
        sizes = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        under = np.zeros(len(pdf), bool)
        first = (level << 56) + (int(pdf["_b"].iloc[0]) << 24)
        for n, b in enumerate(improve(best_fit(sizes, capacity), sizes, capacity)):
            ends = np.cumsum(sizes[b])
            sequence[b], offset[b] = first + n, ends - sizes[b]
            under[b] = not last and ends[-1] < FULL * capacity
        return pdf.assign(sequence_id=sequence, offset=offset, _s=under)

    return place


def pack(cut: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """``cut`` with sequence_id and offset; offsets have no gap in a sequence.

    Repeated rows are pieces of their own; no rows give no rows.  Each level
    shuffles only the pieces that are still in underfull bins.
    """
    rows = written(cut)
    left, level, done = rows.count(), 0, []
    todo = rows.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    fields = todo.schema.simpleString()[7:-1]
    while True:
        buckets = max(1, -(-left // bucket))
        last = buckets == 1 or level == 6

        packed = written(
            todo.withColumn("_b", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(buckets)))
            .withColumn("_s", F.lit(False))
            .groupBy("_b")
            .applyInPandas(_placer(capacity, level, last), f"{fields}, _b long, _s boolean")
        )
        done.append(packed.where("not _s").drop("_b", "_s"))
        if last:
            break
        todo = packed.where("_s").drop("_b", "_s")
        # Pieces of a dissolved bin part ways; a number of their own spreads them.
        todo = written(todo.withColumn("sequence_id", F.monotonically_increasing_id()))
        now = todo.count()
        left = now if now < left else 1 if now <= 4 * bucket else left // 2
        level += 1
        if not now:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
