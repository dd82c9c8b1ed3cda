"""Token ids in binary files, range-coded in checksummed blocks.

A file: the mark; the payloads of its blocks, one after the other; then the
index (ids, bytes, crc32 of the payload and of the ids of each block; key and
number of ids of each document), its crc32 and length, and the mark again.
Files are written by tasks through pyarrow's file systems, under names of
their own, and listed by the table that the write returns: a task that ran
twice leaves a file that nobody lists.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import range_coder
from .encoders import BytePieces, loaded
from .tables import bounded_batches, written
from .textarrays import column, tidy

MARK = b"IDBLOCK1"
#: Ids of a block, and blocks that are coded at once.
BLOCK, AT_ONCE = 2048, 4096
END = 2
TAIL = struct.Struct("<IIIQ8s")
MANIFEST = "file int, path string, documents long, ids long, bytes long"


class Writer:
    """Writes one file: ids of documents in order; memory holds AT_ONCE blocks and the index."""

    def __init__(self, out):
        self.out, self.left, self.size = out, bytearray(), len(MARK)
        self.blocks: list[tuple[int, int, int, int]] = []
        self.keys: list[int | None] = []
        self.lengths: list[int] = []
        out.write(MARK)

    def add(self, key: int | None, ids: bytes) -> None:
        """A document of little-endian 16-bit ids."""
        self.keys.append(key)
        self.lengths.append(len(ids) // 2)
        self.left += ids
        whole = 2 * BLOCK * AT_ONCE
        while len(self.left) >= whole:
            self._code(bytes(self.left[:whole]))
            del self.left[:whole]

    def _code(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, "<u2")
        parts = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
        for part, payload in zip(parts, range_coder.encode(parts), strict=True):
            self.blocks.append((len(part), len(payload), zlib.crc32(payload), zlib.crc32(part.tobytes())))
            self.out.write(payload)
            self.size += len(payload)

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the file."""
        if self.left:
            self._code(bytes(self.left))
        null = np.array([k is None for k in self.keys], np.uint8)
        keys = np.array([0 if k is None else k for k in self.keys], "<i8")
        lengths = np.array(self.lengths, "<u8")
        index = np.array(self.blocks, "<u4").reshape(-1, 4).tobytes() + struct.pack("<Q", len(keys)) + null.tobytes() + keys.tobytes() + lengths.tobytes()
        self.out.write(index)
        self.out.write(TAIL.pack(range_coder.TABLES, zlib.crc32(index), len(self.blocks), len(index), MARK))
        return len(keys), int(lengths.sum()), self.size + len(index) + TAIL.size


def documents_of(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(key, ids) of each document of an open file, in order; damage raises."""
    size = source.size()
    source.seek(max(0, size - TAIL.size))
    tail = source.read()
    if len(tail) != TAIL.size:
        raise ValueError("no file of token ids")
    tables, check, blocks, length, mark = TAIL.unpack(tail)
    if mark != MARK or tables != range_coder.TABLES:
        raise ValueError("no file of token ids that this version reads")
    source.seek(size - TAIL.size - length)
    index = source.read(length)
    if zlib.crc32(index) != check:
        raise ValueError("the index is damaged")
    table = np.frombuffer(index, "<u4", 4 * blocks).reshape(-1, 4)
    n = struct.unpack_from("<Q", index, 16 * blocks)[0]
    at = 16 * blocks + 8
    null = np.frombuffer(index, np.uint8, n, at)
    keys = np.frombuffer(index, "<i8", n, at + n)
    lengths = np.frombuffer(index, "<u8", n, at + 9 * n).astype(np.int64)
    source.seek(0)
    if source.read(len(MARK)) != MARK:
        raise ValueError("no file of token ids")
    have, doc = np.zeros(0, np.uint16), 0
    for lo in range(0, blocks, AT_ONCE):
        part = table[lo : lo + AT_ONCE]
        payloads = [source.read(int(b)) for b in part[:, 1]]
        if any(zlib.crc32(p) != c for p, c in zip(payloads, part[:, 2].tolist(), strict=True)):
            raise ValueError("a block's payload is damaged")
        found = range_coder.decode(payloads, part[:, 0].tolist())
        if any(zlib.crc32(x.tobytes()) != c for x, c in zip(found, part[:, 3].tolist(), strict=True)):
            raise ValueError("a block's ids are damaged")
        have, used = np.concatenate([have, *found]), 0
        while doc < n and used + lengths[doc] <= len(have):
            yield (None if null[doc] else int(keys[doc])), have[used : used + lengths[doc]]
            used += int(lengths[doc])
            doc += 1
        have = have[used:]
    if doc < n or len(have):
        raise ValueError("documents and blocks differ in length")


def write_ids(docs: DataFrame, folder: str, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encodes each whole text, adds the end id and writes files in the order of the key; returns their list (MANIFEST).

    ``folder`` is a URI that all executors reach.  A null or empty text is its
    end id; a null key comes first; rows of one key follow each other in the
    order of a hash of their text, and part between files; an empty table
    gives no files; other columns are ignored.  A text's ids are in one task's
    memory.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        encoder, end = loaded(BytePieces, path), END.to_bytes(2, "little")
        system, place = fs.FileSystem.from_uri(folder)
        number, writer = TaskContext.get().partitionId(), None
        name = f"ids-{number:05d}-{uuid.uuid4().hex}.bin"
        out = None
        try:
            for batch in batches:
                if writer is None and batch.num_rows:
                    system.create_dir(place, recursive=True)
                    out = system.open_output_stream(f"{place}/{name}")
                    writer = Writer(out)
                for k, t in zip(column(batch, key), column(batch, text), strict=True):
                    writer.add(k.as_py(), encoder.encode(t.as_py() or "") + end)
            if writer is None:
                return
            counts = writer.close()
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "path", "documents", "ids", "bytes"), (number, f"{folder.rstrip('/')}/{name}", *counts), strict=True))], schema=LISTED)

    bounded_batches(docs.sparkSession)
    ordered = docs.select(F.col(key).cast("long").alias(key), text).withColumn("_tie", F.crc32(F.coalesce(text, F.lit("")).cast("binary")))
    order = [F.col(key).asc_nulls_first(), F.col("_tie")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select(key, text)
    return written(ordered.mapInArrow(tidy(write), MANIFEST))


LISTED = pa.schema([("file", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def read_ids(manifest: DataFrame, key: str = "doc_id", rows: int = 512) -> DataFrame:
    """(key, start, n_tokens, ids) of each document, read back from the listed files, a task per file.

    start: ids of all documents before it; ids: little-endian 32-bit ones.
    Every checksum is verified; damage raises.  No files give no rows.
    """
    spark = manifest.sparkSession
    before = F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = written(manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")))
    count = max(1, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [key, "start", "n_tokens", "ids"]
        for batch in batches:
            for uri, start in zip(column(batch, "path").to_pylist(), column(batch, "base").to_pylist(), strict=True):
                system, place = fs.FileSystem.from_uri(uri)
                with system.open_input_file(place) as source:
                    some: tuple[list, list, list, list] = ([], [], [], [])
                    held = 0
                    for k, ids in documents_of(source):
                        for values, value in zip(some, (k, start, len(ids), ids.astype("<u4").tobytes()), strict=True):
                            values.append(value)
                        start += len(ids)
                        held += len(ids)
                        if len(some[0]) >= rows or held >= 1 << 20:
                            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in some[:3]), pa.array(some[3], pa.binary())], names)
                            some, held = ([], [], [], []), 0
                    if some[0]:
                        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in some[:3]), pa.array(some[3], pa.binary())], names)

    # Round robin from one partition: a file to each.
    return files.coalesce(1).repartition(count).mapInArrow(tidy(read), f"`{key}` long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, folder: str, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files written for it."""
    return read_ids(write_ids(docs, folder, path)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
