"""Suffix-array dedup by prefix doubling: bytes that lie in a repeated string of 400 bytes.

Spark sorts the positions of all texts by pairs of ranks: that of the string
of h bytes at a position and that of the string at the offset h.  The pair's
rank in that order is the rank of 2 h bytes.  A position whose pair is unique
is past and leaves; what is left at 400 bytes is repeated.

Positions travel as runs.  A string of h bytes has a least seed, at the same
place wherever it occurs, and the consecutive positions that share a seed are
its context.  A position's rank is a class, common to the run, and the place
before the seed, so positions that stay together are one row with a mask of
places.  Their pairs are one pair of classes and the shift between the seeds.

* Windows of 400 bytes that share a seed are a stretch.  Stretches alike are
  repeated as they stand; one of each is ranked for the others' sake, if its
  seed has other stretches at all.
* The first classes come from contexts: contexts alike are one class, and only
  where a seed has several are they told apart by the hashes of FIRST bytes.

Ranks are given to distinct pairs, counted with map-side combining.  Pairs that
more than one in HOT rows have (at most HOT) are broadcast when rows look up
their ranks, so a passage that a third of the texts hold stays where it is.
Texts are told apart by 128 bits, stretches and contexts by 64 under a seed of
64, strings by 64 and their place at the first rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .tables import bounded_batches, dropped
from .textarrays import U, Block, blocks, column, mix, prefix, span

LENGTH = 400
SEED = 32
#: Bytes of the first rank; LENGTH is this times a power of two.
FIRST = 100
#: Places that a mask has bits for.
WIDTH = 64
#: Window starts that one sliding minimum takes, and the bits for a place among them.
SEGMENT, PLACE = 1 << 23, U((1 << 24) - 1)
#: A key is hot if more than one in HOT rows has it; so there are at most HOT of them.
HOT = 1_000
#: Positions in an Arrow batch.
BATCH = 1 << 16


#: Spark's switch that deletes an execution's shuffle files at its end.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows as a written table; the shuffle files that they took are deleted."""
    conf = df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        return tables.written(df)
    finally:
        if before is None:
            conf.unset(TIDY)
        else:
            conf.set(TIDY, before)


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    out, have = x, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors(block: Block, sums: np.ndarray, length: int = LENGTH, seed: int = SEED, segment: int = SEGMENT) -> tuple[np.ndarray, ...]:
    """(doc, position, first start, last start, seed hash) of the block's anchors; places count from the document's start.

    An anchor is the least seed of a window, the leftmost of equal ones; the
    window starts it owns are consecutive.  The place is packed under the
    hash, so that one sliding minimum gives both.
    """
    w, n = length - seed + 1, len(block.data)
    out: list[tuple] = []
    at = np.arange(max(0, n - seed + 1))
    h = span(sums, at, at + seed)
    owner = np.repeat(np.arange(block.docs), np.diff(block.at))
    for s in range(0, n - length + 1, segment):
        e = min(s + segment, n - length + 1)
        part = h[s : e - 1 + w]
        least = sliding_least((part & ~PLACE) | np.arange(len(part), dtype=np.uint64), w)
        start = np.arange(s, e)
        doc = owner[s:e]
        inside = start + length <= block.at[doc + 1]
        start, doc, pos = start[inside], doc[inside], (least[inside] & PLACE).astype(np.int64) + s
        if not len(start):
            continue
        first = np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))
        last = np.append(first[1:], len(start)) - 1
        doc, pos = doc[first], pos[first]
        base = block.at[doc]
        out.append((doc, pos - base, start[first] - base, start[last] - base, h[pos].view(np.int64)))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    doc, pos, lo, hi, hashes = (np.concatenate(x) for x in zip(*out, strict=True))
    # An anchor whose starts cross a border of segments came in parts.
    new = np.append(True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1]))
    last = np.append(np.flatnonzero(new)[1:] - 1, len(doc) - 1)
    return doc[new], pos[new], lo[new], hi[last], hashes[new]


def _hot_and_cold(groups: DataFrame, n: str) -> tuple[DataFrame, DataFrame]:
    """Groups (a written table that counts their rows in ``n``): the hot ones, to be broadcast, and the rest."""
    total = groups.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) * HOT > total
    return F.broadcast(groups.where(hot)), groups.where(~hot)


def _looked_up(rows: DataFrame, groups: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of rows with their groups (a written table that counts rows in ``n``), each group once."""
    hot, cold = _hot_and_cold(groups, n)
    return rows.join(hot.select(keys), keys, "left_anti").join(cold, keys).unionByName(rows.join(hot, keys))


def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The positions of the rows (a written table) whose keys occur more than once, with the keys' rank among such keys in place of the keys.

    Bit k of ``mask`` is the place k, at the position ``pos`` - k; without that
    column, rows have the place 0 alone.  A key's places are told apart.
    """
    if "mask" not in rows.columns:
        rows = rows.withColumn("mask", F.lit(1).cast("long"))
    # A key has few kinds of masks: the places are WIDTH at most and mostly in one run.
    masks = rows.groupBy(*keys, "mask").agg(F.count("*").alias("n"))
    once_twice = F.aggregate(
        F.collect_list(F.struct("mask", "n")),
        F.struct(F.lit(0).cast("long").alias("once"), F.lit(0).cast("long").alias("twice")),
        lambda acc, x: F.struct(
            acc["once"].bitwiseOR(x["mask"]).alias("once"),
            acc["twice"].bitwiseOR(F.when(x["n"] > 1, x["mask"]).otherwise(acc["once"].bitwiseAND(x["mask"]))).alias("twice"),
        ),
    )
    kinds = masks.groupBy(keys).agg(F.sum("n").alias("n"), once_twice["twice"].alias("twice")).where("twice <> 0")
    # Numbers by partition and place in it: they grow with the keys, whose ranges the partitions are.
    ranks = written(kinds.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()))
    left = _looked_up(rows, ranks, keys, "n").withColumn("mask", F.col("mask").bitwiseAND(F.col("twice"))).where("mask <> 0")
    return left.drop("n", "twice", *keys).withColumnRenamed("number", "rank")


def _stretches(docs: DataFrame) -> DataFrame:
    """(row, lo, hi, seed, whole): window starts lo..hi of a text, the least seed that they share, and the hash of what they span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = column(batch, "row")
            for block in blocks(column(batch, "t")):
                sums = prefix(block.data)
                doc, pos, lo, hi, seed = anchors(block, sums)
                whole = _whole(sums, block.at[doc], pos, lo, hi, LENGTH)
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(block.first + doc)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(seed), pa.array(whole)], ["row", "lo", "hi", "seed", "whole"])

    long = docs.where(F.octet_length("t") >= LENGTH)
    return long.select("row", "t").mapInArrow(run, f"row {_type(docs)}, lo int, hi int, seed long, whole long")


def _whole(sums: np.ndarray, base: np.ndarray, pos: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> np.ndarray:
    """Hash of the bytes under the starts lo..hi and of where the seed is among them."""
    shape = mix(((pos - lo) * (1 << 32) + (hi - lo)).astype(np.uint64))
    return mix(span(sums, base + lo, base + hi + length) ^ shape).view(np.int64)


def _type(df: DataFrame) -> str:
    return df.schema["row"].dataType.simpleString()


def _seed(first: int) -> int:
    """Bytes of the seeds under strings of ``first`` bytes, so that there are at most WIDTH places."""
    return max(1, first // 3, first - WIDTH + 1)


def _contexts(docs: DataFrame, live: DataFrame, first: int) -> DataFrame:
    """(row, pos, near, far, seed, whole, body): seeds at ``pos`` and the places near..far before them that live windows need."""
    # A text's stretches are bounded by its own length.
    per_text = written(live.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("live")))
    texts = docs.where(F.octet_length("t") >= LENGTH).groupBy("row").agg(F.first("t").alias("t"))
    seed_bytes = _seed(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = column(batch, "row"), column(batch, "live")
            for block in blocks(column(batch, "t")):
                sums, live = prefix(block.data), held.slice(block.first, block.docs)
                owner = np.repeat(np.arange(block.docs), [len(x) for x in live])
                a, b = (np.array(live.flatten().field(i)).astype(np.int64) + block.at[owner] for i in range(2))
                change = np.zeros(len(block.data) + 2, np.int64)
                np.add.at(change, a, 1)
                np.add.at(change, b + LENGTH - first + 1, -1)
                needed = np.concatenate([[0], np.cumsum(np.cumsum(change) > 0)])
                doc, pos, lo, hi, seed = anchors(block, sums, first, seed_bytes)
                base = block.at[doc]
                ok = needed[base + hi + 1] > needed[base + lo]
                doc, pos, lo, hi, seed, base = (x[ok] for x in (doc, pos, lo, hi, seed, base))
                whole = _whole(sums, base, pos, lo, hi, first)
                for s in range(0, len(doc), BATCH):
                    part = slice(s, s + BATCH)
                    size = (hi - lo + first)[part]
                    end = np.cumsum(size)
                    body = block.data[np.repeat((base + lo)[part] - end + size, size) + np.arange(size.sum())]
                    bodies = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.append(0, end).astype(np.int32)), pa.py_buffer(body)])
                    ints = [pa.array(x[part].astype(np.int32)) for x in (pos, pos - hi, pos - lo)]
                    yield pa.RecordBatch.from_arrays([rows.take(pa.array((block.first + doc)[part])), *ints, pa.array(seed[part]), pa.array(whole[part]), bodies], ["row", "pos", "near", "far", "seed", "whole", "body"])

    return texts.join(per_text, "row").mapInArrow(run, f"row {_type(docs)}, pos int, near int, far int, seed long, whole long, body binary")


def _strings(contexts: DataFrame, first: int) -> DataFrame:
    """(context, place, head, copies): the hash of ``first`` bytes at each place of the contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, far, copies = (np.array(column(batch, c)) for c in ("context", "far", "copies"))
            for block in blocks(column(batch, "body")):
                sums, n = prefix(block.data), np.diff(block.at) - first + 1
                doc = np.repeat(np.arange(block.docs), n)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = block.at[doc] + step
                head = span(sums, at, at + first).view(np.int64)
                own = block.first + doc
                yield pa.RecordBatch.from_arrays([pa.array(number[own]), pa.array((far[own] - step).astype(np.int32)), pa.array(head), pa.array(copies[own])], ["context", "place", "head", "copies"])

    return contexts.select("context", "far", "copies", "body").mapInArrow(run, "context long, place int, head long, copies long")


def _first_runs(docs: DataFrame, live: DataFrame, first: int) -> DataFrame:
    """(row, pos, mask, rank): the live positions whose first bytes occur more than once, in runs of a class."""
    contexts = written(_contexts(docs, live, first))
    about = F.first(F.struct("near", "far", "body")).alias("about")
    kinds = written(contexts.groupBy("seed", "whole").agg(F.count("*").alias("copies"), about).select("seed", "whole", "copies", "about.*", F.monotonically_increasing_id().alias("context")))
    seeds = written(kinds.groupBy("seed").agg(F.sum("copies").alias("all"), F.count("*").alias("kinds")))
    seeds = seeds.where("`all` > 1").select("seed", "kinds")
    shared = written(_looked_up(kinds, seeds, ["seed"], "kinds"))
    found = shared.select("seed", "whole", "copies", "context", "kinds", "near", "far")
    rows = written(_looked_up(contexts.select("row", "pos", "seed", "whole"), found, ["seed", "whole"], "copies").drop("seed", "whole", "copies"))
    dropped(contexts, kinds)
    # A seed with one context: all its places are repeated.  Else a place's class is the least context that has its string.
    strings = _strings(shared.where("kinds > 1"), first)
    heads = written(strings.groupBy("head", "place").agg(F.min("context").alias("rank"), F.count("*").alias("n"), F.sum("copies").alias("all")).where("`all` > 1").drop("all"))
    bit = F.expr("bit_or(shiftleft(1L, place))").alias("mask")
    parts = written(_looked_up(strings, heads, ["head", "place"], "n").groupBy("context", "rank").agg(F.max("copies").alias("copies"), bit))
    dropped(shared, heads)
    alone = rows.where("kinds = 1").select("row", "pos", F.col("context").alias("rank"), F.expr("shiftleft(shiftrightunsigned(-1L, 63 - far + near), near)").alias("mask"))
    several = _looked_up(rows.where("kinds > 1").select("row", "pos", "context"), parts, ["context"], "copies")
    return alone.unionByName(several.select("row", "pos", "rank", "mask"))


def _shifted(mask: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Masks with place k + by at place k; ``by`` is between -WIDTH and WIDTH."""
    down, up = np.maximum(by, 0).astype(np.uint64), np.maximum(-by, 0).astype(np.uint64)
    return (mask >> down) << up


def _pairs(positions: DataFrame, offset: int) -> DataFrame:
    """(row, pos, mask, rank, ahead, shift): positions with their rank and that at the offset, where there is one.

    ``shift`` is what the place at the offset has more than the place itself.
    """
    if "mask" not in positions.columns:
        positions = positions.withColumn("mask", F.lit(1).cast("long"))
    # A text's runs are bounded by its own length.
    per_text = positions.groupBy("row").agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "mask", "rank")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = column(batch, "row"), column(batch, "runs")
            doc = np.repeat(np.arange(len(rows)), held.value_lengths().to_numpy(zero_copy_only=False))
            pos, mask, rank = (np.array(held.flatten().field(i)) for i in range(3))
            at = doc * (1 << 34) + pos
            order = np.argsort(at, kind="stable")
            doc, pos, rank, at, mask = doc[order], pos[order], rank[order], at[order], mask[order].view(np.uint64)
            for s in range(0, len(at), BATCH):
                low = np.searchsorted(at, at[s : s + BATCH] + offset - WIDTH + 1)
                n = np.searchsorted(at, at[s : s + BATCH] + offset + WIDTH - 1, side="right") - low
                own = np.repeat(np.arange(s, s + len(n)), n)
                other = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
                shift = at[other] - at[own] - offset
                both = mask[own] & _shifted(mask[other], shift)
                ok = both != 0
                own, other, shift, both = own[ok], other[ok], shift[ok], both[ok]
                yield pa.RecordBatch.from_arrays([rows.take(pa.array(doc[own])), pa.array(pos[own].astype(np.int32)), pa.array(both.view(np.int64)), pa.array(rank[own]), pa.array(rank[other]), pa.array(shift.astype(np.int32))], ["row", "pos", "mask", "rank", "ahead", "shift"])

    return per_text.mapInArrow(run, f"row {_type(positions)}, pos int, mask long, rank long, ahead long, shift int")


def _spelled_out(positions: DataFrame) -> DataFrame:
    """(row, first, last): the masks' runs of consecutive positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.array(column(batch, "mask")).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            edge = np.diff(np.pad(bits.astype(np.int8), ((0, 0), (1, 1))), axis=1)
            own, near = np.nonzero(edge > 0)
            far = np.nonzero(edge < 0)[1] - 1
            pos = np.array(column(batch, "pos")).astype(np.int64)[own]
            yield pa.RecordBatch.from_arrays([column(batch, "row").take(pa.array(own)), pa.array((pos - far).astype(np.int32)), pa.array((pos - near).astype(np.int32))], ["row", "first", "last"])

    return positions.select("row", "pos", "mask").mapInArrow(run, f"row {_type(positions)}, first int, last int")


def repeated_windows(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """(row, first, last, copies): runs of starts of LENGTH bytes that also start elsewhere; ``docs`` has t and, as row, its digest.

    ``copies`` is at least the number of texts alike, if there are several.
    """
    stretches = written(_stretches(docs))
    own = F.min(F.struct("row", "lo", "hi")).alias("own")
    kinds = written(stretches.groupBy("seed", "whole").agg(F.count("*").alias("n"), own))
    alike = _looked_up(stretches, kinds.where("n > 1").select("seed", "whole", "n"), ["seed", "whole"], "n")
    settled = written(alike.groupBy("row", F.col("lo").alias("first"), F.col("hi").alias("last")).agg(F.count("*").alias("copies")))
    dropped(stretches)
    seeds = written(kinds.groupBy("seed").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    live = _looked_up(kinds.select("seed", "own"), seeds, ["seed"], "kinds").select("own.*")
    positions, length = _first_runs(docs, live, first), first
    while length < LENGTH:
        pairs = written(_pairs(positions, length))
        positions = ranked(pairs, ["rank", "ahead", "shift"])
        length *= 2
    assert length == LENGTH, "LENGTH is the first length times a power of two"
    return settled.unionByName(_spelled_out(positions).withColumn("copies", F.lit(1).cast("long")))


def _runs(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open ranges as maximal runs; ranges that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)] if len(ends) else ends


def _with_ranges(docs: DataFrame, first: int = FIRST) -> DataFrame:
    """``docs`` (with t and its digest) and ``ranges``: each row's runs of repeated window starts, null where none is."""
    bounded_batches(docs.sparkSession)
    found = repeated_windows(docs.select(F.col("digest").alias("row"), "t"), first)
    # A text's ranges are bounded by its own length.
    ranges = found.groupBy(F.col("row").alias("digest")).agg(F.max("copies").alias("copies"), F.collect_list(F.struct("first", "last")).alias("ranges"))
    hot, cold = _hot_and_cold(written(ranges), "copies")
    # Null and short texts have no ranges, however many are alike: they take no part in the shuffle.
    short = F.coalesce(F.octet_length("t"), F.lit(0)) < LENGTH
    apart = docs.join(hot, "digest", "left").where(short | F.col("copies").isNotNull())
    rest = docs.where(~short).join(hot.select("digest"), "digest", "left_anti").join(cold, "digest", "left")
    return apart.unionByName(rest).drop("digest", "copies")


def _cut_points(ranges: pa.Scalar, size: int) -> tuple[np.ndarray, np.ndarray]:
    if not ranges.is_valid or not len(ranges.values):
        none = np.zeros(0, np.int64)
        return none, none
    x = ranges.values
    first, last = (np.array(x.field(i)).astype(np.int64) for i in range(2))
    return _runs(first, np.minimum(last, size - LENGTH) + LENGTH)


def repeated_bytes(docs: DataFrame, text: str = "text", key: str = "doc_id", first: int = FIRST) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    A byte goes if a 400-byte string over it also starts anywhere else, in the
    same document too; strings are judged on the input.  Null and empty texts
    have no bytes; equal texts, repeated rows included, are removed alike; an
    empty table gives no rows; other columns are ignored.  ``first`` is the
    length of the first rank, LENGTH divided by a power of two.
    """
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), F.unhex(F.md5(text)).alias("digest"))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ranges = column(batch, "ranges")
            size, removed, spans, digest = [], [], [], []
            for i, t in enumerate(column(batch, "t").cast(pa.large_binary())):
                raw = t.as_py() or b""
                a, b = _cut_points(ranges[i], len(raw))
                size.append(len(raw))
                removed.append(int((b - a).sum()))
                spans.append(len(a))
                kept, last = hashlib.sha256(), 0
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    kept.update(raw[last:x])
                    last = y
                kept.update(raw[last:])
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(digest)], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = _with_ranges(rows, first).select("id", "t", "ranges").mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("id", key)


def without_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text``; a character cut in part goes as a whole.

    Every copy goes, the first included.  Other columns pass through; null texts stay null.
    """
    names = docs.columns
    clash = docs.withColumnsRenamed({c: f"_c_{c}" for c in names})
    rows = clash.select(F.unhex(F.md5(F.col(f"_c_{text}"))).alias("digest"), F.col(f"_c_{text}").alias("t"), *(f"_c_{c}" for c in names if c != text))
    marked = _with_ranges(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            ranges = column(batch, "ranges")
            for i, t in enumerate(column(batch, "t")):
                raw = t.as_py()
                if raw is not None and ranges[i].is_valid:
                    body, kept, last = raw.encode(), [], 0
                    for x, y in zip(*(r.tolist() for r in _cut_points(ranges[i], len(body))), strict=True):
                        kept.append(body[last:x])
                        last = y
                    raw = b"".join([*kept, body[last:]]).decode(errors="ignore")
                out.append(raw)
            k = batch.schema.get_field_index("t")
            yield batch.set_column(k, batch.schema.field(k), pa.array(out, batch.schema.field(k).type)).drop_columns(["ranges"])

    kept = rows.drop("digest")
    done = marked.select(*kept.columns, "ranges").mapInArrow(run, kept.schema)
    return done.select(*(F.col("t" if c == text else f"_c_{c}").alias(c) for c in names))
