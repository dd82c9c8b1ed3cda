"""Whole texts as numpy arrays: words, hashes of words and of byte ranges.

Everything works on the UTF-8 bytes that Arrow already holds, in blocks of
whole documents, so memory is bounded by a block or by one long document.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; one longer document is a block of its own.
BLOCK = 1 << 18

U = np.uint64
#: Fixed odd multiplier of the polynomial hash, and its inverse modulo 2**64.
P = 0x9E3779B97F4A7C15
PI = pow(P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


#: One random word per byte value, from the finaliser.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(P))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of ``[^\x20\x09-\x0D]+``: anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: lower-case letters, digits and all beyond ASCII.
ALNUM = np.ones(256, dtype=bool)
ALNUM[:48] = ALNUM[58:97] = ALNUM[123:128] = False

_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**j and P**-j for j up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, BLOCK + 1)
        for i, base in enumerate((P, PI)):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            np.multiply.accumulate(row, out=row)
            if size > 4 * BLOCK:  # a very long document: not kept
                return tuple(np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, b, dtype=np.uint64)])) for b in (P, PI))
            _powers[i] = row
    return _powers[0], _powers[1]


def tidy(run: Callable) -> Callable:
    """A task's function on Arrow batches that gives freed memory back at its end.

    Spark keeps Python workers for the stages to come, where what a worker
    holds on to would add to a full executor.
    """

    @functools.wraps(run)
    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return bounded


class Block(NamedTuple):
    """Documents first..last of a batch: bytes, and len+1 offsets into them."""

    first: int
    data: np.ndarray
    at: np.ndarray

    @property
    def docs(self) -> int:
        return len(self.at) - 1


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def blocks(texts: pa.Array, lower: bool = False) -> Iterator[Block]:
    """The texts in blocks; a null text is empty."""
    raw = pc.fill_null(texts.cast(pa.large_binary()), b"")
    n = len(raw)
    if not n:
        return
    at = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1]
    kept = raw.buffers()[2]
    data = np.frombuffer(kept, dtype=np.uint8) if kept is not None and kept.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + BLOCK, side="right")) - 1)
        part = data[at[i] : at[j]]
        yield Block(i, LOWER[part] if lower else part, at[i : j + 1] - at[i])
        i = j


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span`` takes the hash of any byte range."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the ranges start..end."""
    _, down = powers(len(sums) - 1)
    return mix((sums[end] - sums[start]) * down[start])


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def words(block: Block, kind: np.ndarray) -> Words:
    """Maximal runs of the bytes marked in ``kind``, none across documents."""
    m = kind[block.data]
    n = len(m)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none)
    edge = block.at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = m[:-1], m[1:]
    before[edge] = False
    after[edge - 1] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return Words(start, end, np.searchsorted(block.at, start, side="right") - 1)


def word_hashes(block: Block, w: Words) -> np.ndarray:
    return span(prefix(block.data), w.start, w.end)


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive word hashes within a document, and the first word's number of each."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        total = total * U(P) + h[i : i + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(total[at]), at


def doc_bounds(doc: np.ndarray, docs: int) -> np.ndarray:
    """docs+1 offsets of each document's run in a sorted array of document numbers."""
    return np.searchsorted(doc, np.arange(docs + 1))
