"""Grouped prefix join: documents whose word-shingle sets have Jaccard similarity of 0.75 or more.

Two sets that similar share a token among the first n - ceil(0.75 n) + 1 of
each in any one global order (prefix filter).  Documents with the same set
form a class; classes with the same prefix and size form a group.  Groups
that share a prefix token are paired, pairs are filtered by size, and the
members of what is left are verified on their whole sets.

The order puts tokens of many documents last, so that a passage that
thousands share does not pair them.  Large families of near copies are linked
first, to pivots and then to hubs, and verified; then only groups of different
components need pairing, so that a family never expands to all its pairs and
yet no link between two components is missed.

Sets are compared by 64-bit hashes of their tokens, classes and groups by
64-bit hashes of theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches, components, fresh, if_small, written
from .textarrays import NOT_SPACE, P, U, Block, blocks, column, doc_bounds, grams, mix, tidy, word_hashes, words

SHINGLE = 5
#: Similarity as a fraction.
UP, DOWN = 75, 100
#: Documents from which on a token goes to the end of the order, and most such tokens (16 MB with their counts).
OFTEN, MOST_OFTEN = 32, 1 << 20
#: Least hashes kept of a set to find pivots, and how many of them look for one.
SKETCH, PROBES = 24, 6
#: Times that the classes of frequent tokens are linked to a hub.
HUBS = 3
#: Hashes that a task holds before it sends them.
FLUSH = 250_000
#: Hashes in one bucket of a shuffle of packed arrays.
BUCKET = 250_000


def shingle_sets(block: Block) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document; fewer than 5 words are one shingle."""
    w = words(block, NOT_SPACE)
    h = word_hashes(block, w)
    g, first = grams(h, w.doc, SHINGLE)
    at, n = doc_bounds(w.doc[first], block.docs), doc_bounds(w.doc, block.docs)
    out = []
    for d in range(block.docs):
        count = n[d + 1] - n[d]
        if 0 < count < SHINGLE:
            total = np.full(1, count, dtype=np.uint64)
            for x in h[n[d] : n[d + 1]]:
                total = total * U(P) + x
            out.append(mix(total))
        else:
            out.append(np.unique(g[at[d] : at[d + 1]]))
    return out


def prefix_length(n: int) -> int:
    return n + (UP * n) // -DOWN + 1


def class_of(tokens: np.ndarray) -> int:
    """64-bit hash of a set, as a signed long."""
    x = np.array([len(tokens), tokens.sum(), mix(tokens ^ U(P)).sum()], dtype=np.uint64)
    return int((mix(mix(mix(x[:1]) + x[1:2]) + x[2:])).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """A bit for each token's hash modulo the least power of two from len(s) on, 64 at least."""
    size = max(64, 1 << (len(s) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(s & U(size - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def most_shared(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """What sets of these bitmaps and sizes share at most: a bit in one only stands for a token in one only."""
    x, y = (np.frombuffer(v, np.uint8) for v in (x, y))
    size = min(len(x), len(y))
    x, y = (np.bitwise_or.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
    return min(nx - int(np.bitwise_count(x & ~y).sum()), ny - int(np.bitwise_count(y & ~x).sum()))


def _classes(docs: DataFrame) -> DataFrame:
    """(id, c, n, sketch, bits) of each row; c is null for an empty set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, n, sketch, bits = [], [], [], []
            for block in blocks(column(batch, "t"), lower=True):
                for s in shingle_sets(block):
                    c.append(class_of(s) if len(s) else None)
                    n.append(len(s))
                    sketch.append(s[:SKETCH].tobytes())
                    bits.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), pa.array(bits, pa.binary())], ["id", "c", "n", "sketch", "bits"])

    return docs.mapInArrow(tidy(run), f"id {kind}, c long, n long, sketch binary, bits binary")


def _packed(out: list[np.ndarray], buckets: int, *more: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, data, data2...) of the hashes, a bucket being a range of them; only buckets that have some."""
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    order = np.argsort(h, kind="stable")
    h = h[order]
    bucket = (h // U((1 << 64) // buckets + 1)).astype(np.int32)
    cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(h) else np.zeros(0, np.int64), len(h))
    parts = list(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True))
    arrays = [pa.array(bucket[cut[:-1]])] + [pa.array([x[a:b].tobytes() for a, b in parts], pa.binary()) for x in (h, *(m[order] for m in more))]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *(f"d{i}" for i in range(len(arrays) - 1))])


def _often(docs: DataFrame, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the tokens seen OFTEN or more times, at most MOST_OFTEN, of whole sets.

    Counting is lossy: a token met once only in FLUSH hashes isn't sent, so
    singletons stay in their task, and with b such parts of the corpus a token
    of about sqrt(OFTEN * b) documents or more is found.  The order is a matter
    of cost alone: any set of tokens and any counts here give the same links.
    """
    buckets = max(4, -(-entries // BUCKET))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return _packed([h[n > 1]], buckets, n[n > 1].astype(np.uint32))

        for batch in batches:
            for block in blocks(column(batch, "t"), lower=True):
                for s in shingle_sets(block):
                    held.append(s)
                    size += len(s)
                if size > FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    def add(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["d0"]])
        n = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in table["d1"]])
        each, inverse = np.unique(h, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)
        at = total >= OFTEN
        return pa.table({"token": pa.array(each[at].view(np.int64)), "n": pa.array(total[at])})

    packed = docs.select("t").mapInArrow(tidy(count), "bucket int, d0 binary, d1 binary")
    often = written(packed.groupBy("bucket").applyInArrow(add, "token long, n long"))
    top = often.orderBy(F.col("n").desc(), "token").limit(MOST_OFTEN).toPandas()  # bounded
    token = top["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(token)
    return token[order], top["n"].to_numpy(dtype=np.int64)[order]


def _ordered(s: np.ndarray, often: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set: its rare tokens by hash, then its frequent ones by count and hash."""
    token, count = often
    if len(token):
        near = np.minimum(np.searchsorted(token, s), len(token) - 1)
        hot = token[near] == s
    else:
        near, hot = np.zeros(len(s), np.int64), np.zeros(len(s), bool)
    p = prefix_length(len(s))
    rare = s[~hot][:p]
    last = s[hot][np.argsort(count[near[hot]], kind="stable")]
    return rare, last[: p - len(rare)]


def _group_of(n: int, rare: np.ndarray, hot: np.ndarray) -> np.ndarray:
    both = np.concatenate([np.array([n], dtype=np.uint64), rare, hot])
    return mix((mix(both) * (np.arange(len(both), dtype=np.uint64) * U(2) + U(P))).sum(keepdims=True))


def _members(docs: DataFrame, often: Broadcast) -> DataFrame:
    """(c, g, n, rare, hot) of each row with a set: class, group, size, the prefix's number of rare tokens and its frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c, g, n, rare, hot = [], [], [], [], []
            for block in blocks(column(batch, "t"), lower=True):
                for s in shingle_sets(block):
                    if len(s):
                        a, b = _ordered(s, often.value)
                        c.append(class_of(s))
                        g.append(int(_group_of(len(s), a, b).view(np.int64)[0]))
                        n.append(len(s))
                        rare.append(len(a))
                        hot.append(b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(g, pa.int64()), pa.array(n, pa.int64()), pa.array(rare, pa.int64()), pa.array(hot, pa.list_(pa.int64()))], ["c", "g", "n", "rare", "hot"])

    return docs.select("t").mapInArrow(tidy(run), "c long, g long, n long, rare long, hot array<long>")


def _shared_rare(docs: DataFrame, often: Broadcast, entries: int) -> DataFrame:
    """(token, g) of the rare prefix tokens that two or more groups have."""
    buckets = max(4, -(-entries // BUCKET))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: list[np.ndarray] = []
        groups: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for block in blocks(column(batch, "t"), lower=True):
                for s in shingle_sets(block):
                    if len(s):
                        a, b = _ordered(s, often.value)
                        tokens.append(a)
                        groups.append(np.repeat(_group_of(len(s), a, b), len(a)))
                        size += len(a)
                if size > FLUSH:
                    yield _packed(tokens, buckets, np.concatenate(groups))
                    tokens, groups, size = [], [], 0
        if size:
            yield _packed(tokens, buckets, np.concatenate(groups))

    def shared(table: pa.Table) -> pa.Table:
        t = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["d0"]])
        g = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["d1"]])
        order = np.argsort(t, kind="stable")
        t, g = t[order], g[order]
        new = np.ones(len(t), bool)
        new[1:] = t[1:] != t[:-1]
        start = np.flatnonzero(new)
        several = np.minimum.reduceat(g, start) != np.maximum.reduceat(g, start)
        at = np.repeat(several, np.diff(np.append(start, len(t))))
        return pa.table({"token": pa.array(t[at].view(np.int64)), "g": pa.array(g[at].view(np.int64))})

    packed = docs.select("t").mapInArrow(tidy(post), "bucket int, d0 binary, d1 binary")
    return packed.groupBy("bucket").applyInArrow(shared, "token long, g long").distinct()


def _posted(spilt: DataFrame, *keep: str) -> DataFrame:
    """(token, cap) of the prefixes' frequent tokens, with ``keep``; cap: the largest set that can be similar.

    A prefix that reaches frequent tokens has all the rare ones of its set.
    Two such sets that share a rare one meet there; else the first token they
    share, at place k of the frequent ones, leaves n - rare - k to share, and
    the sizes of two similar sets sum to at most 175 / 75 of what they share.
    """
    posts = spilt.select("*", F.posexplode("hot").alias("k", "token"))
    cap = F.floor((UP + DOWN) * (F.col("n") - F.col("rare") - F.col("k")) / UP).cast("long") - F.col("n")
    return posts.select("token", *keep, cap.alias("cap"))


def _alike(a: str, b: str):
    """Size filter: sets of these sizes can be similar enough."""
    return F.expr(f"{DOWN} * least({a}, {b}) >= {UP} * greatest({a}, {b})")


def _pivot_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): a class and the pivot of a bucket of classes that share a least hash and a size band, if their sketches look alike."""
    probes = F.transform(F.sequence(F.lit(0), F.least(F.lit(PROBES), F.col("n")).cast("int") - 1), lambda i: F.hex(F.substring(F.col("sketch"), i * 8 + 1, F.lit(8))))
    band = F.floor(F.log(F.col("n").cast("double")) * 6)
    posts = classes.select("c", "n", F.explode(probes).alias("token"), band.alias("band"))
    pivots = posts.groupBy("token", "band").agg(F.min(F.struct("c", "n")).alias("p"), F.count("*").alias("k")).where("k > 1")
    pairs = posts.join(pivots, ["token", "band"]).where(F.col("c") != F.col("p.c"))
    pairs = pairs.where(_alike("n", "p.n")).select(F.col("c").alias("a"), F.col("p.c").alias("b")).distinct()
    sketch = classes.select("c", "sketch")
    pairs = pairs.join(sketch.withColumnsRenamed({"c": "a", "sketch": "sa"}), "a").join(sketch.withColumnsRenamed({"c": "b", "sketch": "sb"}), "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(column(batch, "sa"), column(batch, "sb"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                union = np.union1d(x, y)[:SKETCH]
                keep.append(2 * len(np.intersect1d(np.intersect1d(x, y, True), union, True)) >= len(union))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(tidy(similar), "a long, b long")


def _hub_pairs(spilt: DataFrame, turn: int) -> DataFrame:
    """(a, b): a class and the hub of those that share a frequent token and a size band, if of different components.

    The hub has the smallest share of rare tokens, so it is near the middle of
    a large family; each turn draws another of those and moves the bands.
    """
    band = F.floor(F.log(F.col("n").cast("double")) * 6 + turn / 2)
    share = F.floor(DOWN * F.col("rare") / F.col("n"))
    posts = _posted(spilt.withColumn("band", band).withColumn("share", share), "c", "comp", "n", "band", "share")
    hub = F.min(F.struct("share", F.xxhash64("c", F.lit(turn)).alias("draw"), "c", "comp", "n", "cap")).alias("p")
    hubs = posts.groupBy("token", "band").agg(hub, F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").drop("x", "y")
    pairs = posts.join(hubs, ["token", "band"]).where("comp <> p.comp and n <= p.cap and p.n <= cap")
    return pairs.where(_alike("n", "p.n")).select(F.col("c").alias("a"), F.col("p.c").alias("b")).distinct()


def _possible(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of classes whose bitmaps allow that they are similar enough."""
    of = classes.select("c", "n", "bits")
    both = pairs.join(of.withColumnsRenamed({"c": "a", "n": "na", "bits": "xa"}), "a").join(of.withColumnsRenamed({"c": "b", "n": "nb", "bits": "xb"}), "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(column(batch, k).to_pylist() for k in ("xa", "xb", "na", "nb")), strict=True)
            keep = [(UP + DOWN) * most_shared(x, y, nx, ny) >= UP * (nx + ny) for x, y, nx, ny in each]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "xa", "xb", "na", "nb").mapInArrow(tidy(similar), "a long, b long")


def _sets_of(part: pa.RecordBatch, name: str) -> tuple[list[np.ndarray], np.ndarray]:
    """The sets of the classes in a column, each hashed once, and each row's place among them."""
    _, first, place = np.unique(np.array(column(part, name)), return_index=True, return_inverse=True)
    texts = column(part, f"t{name}").take(pa.array(first))
    return [s for block in blocks(texts, lower=True) for s in shingle_sets(block)], place


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of classes whose whole sets are similar enough; bitmaps first, so that few texts move."""
    pairs = written(_possible(classes, pairs))
    wanted = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = written(wanted.join(classes, "c").select("c", F.col("rep").alias("r")))
    texts = docs.join(if_small(wanted), F.col("id").eqNullSafe(F.col("r"))).select("c", "t")

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose text is of the class (an id may be repeated)."""
        for batch in batches:
            c = [class_of(s) if len(s) else None for block in blocks(column(batch, "t"), lower=True) for s in shingle_sets(block)]
            yield batch.filter(pa.array([x == y for x, y in zip(c, column(batch, "c").to_pylist(), strict=True)], pa.bool_()))

    texts = texts.mapInArrow(tidy(own), "c long, t string")
    both = pairs.join(texts.withColumnsRenamed({"c": "a", "t": "ta"}), "a").join(texts.withColumnsRenamed({"c": "b", "t": "tb"}), "b")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                # The rows come sorted by b: a class that many are held against is hashed once.
                (left, i), (right, j) = (_sets_of(part, c) for c in "ab")
                keep = []
                for x, y in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = left[x], right[y]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(DOWN * shared >= UP * (len(x) + len(y) - shared))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(tidy(similar), "a long, b long").distinct()


def _labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` with ``comp``: the component of c, or c itself."""
    found = found.select(F.col("id").alias("c"), "component")
    return members.join(found, "c", "left").withColumn("comp", F.coalesce("component", "c")).drop("component")


def _cross_pairs(posts: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): pairs of classes of different components whose groups share a token and whose sizes fit.

    Components meet first; only those that share a token are opened to groups,
    and only group pairs to members, so pairs within a component never arise.
    A posting's cap bounds its partner's size; null is no bound.
    """
    groups = members.groupBy("g", "comp").agg(F.min("n").alias("n"))
    entries = posts.join(groups, "g")
    mixed = entries.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("token")
    entries = written(entries.join(mixed, "token"))
    cap = F.coalesce("cap", F.lit((1 << 63) - 1))
    comps = entries.groupBy("token", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(cap).alias("cap"))
    left, right = (comps.select("token", *(F.col(x).alias(f"{x}{i}") for x in ("comp", "lo", "hi", "cap"))) for i in (1, 2))
    meet = left.join(right, "token").where(f"comp1 < comp2 and {DOWN} * hi1 >= {UP} * lo2 and {DOWN} * hi2 >= {UP} * lo1 and lo1 <= cap2 and lo2 <= cap1")
    meet = meet.select("token", "comp1", "comp2")
    entries = entries.withColumn("cap", cap)
    one, two = (entries.select("token", *(F.col(x).alias(f"{x}{i}") for x in ("comp", "g", "n", "cap"))) for i in (1, 2))
    pairs = meet.join(one, ["token", "comp1"]).join(two, ["token", "comp2"]).where(_alike("n1", "n2") & F.expr("n1 <= cap2 and n2 <= cap1"))
    pairs = pairs.select("g1", "g2", "comp1", "comp2").distinct()
    inside = members.select("g", "comp", "c").distinct()
    pairs = pairs.join(inside.select(F.col("g").alias("g1"), F.col("comp").alias("comp1"), F.col("c").alias("a")), ["g1", "comp1"])
    pairs = pairs.join(inside.select(F.col("g").alias("g2"), F.col("comp").alias("comp2"), F.col("c").alias("b")), ["g2", "comp2"])
    return pairs.select("a", "b").distinct()


def similar_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id) of every row.

    Words are what white space parts, A-Z lower-cased; a set has the distinct
    5-word shingles, or the whole of a shorter text.  Rows with an empty set
    (null, empty or blank text) are linked with nothing and are their own
    component.  Equal texts, repeated rows included, are linked.  The
    component is the least non-null key that links reach; null keys take part.
    An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("t"))
    rows = written(_classes(docs))
    classes = rows.where("c is not null").groupBy("c").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bits").alias("bits"), F.min("id").alias("rep"))
    classes = written(classes)
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    links = written(_verified(docs, classes, _pivot_pairs(classes)))
    found = written(components(links))
    often = docs.sparkSession.sparkContext.broadcast(_often(docs, total // 2))
    members = written(_members(docs, often).groupBy("c", "g", "n", "rare").agg(F.first("hot").alias("hot")))
    spilt = written(members.where(F.size("hot") > 0))
    for turn in range(HUBS):
        pairs = written(_hub_pairs(_labelled(spilt, found), turn))
        if pairs.isEmpty():
            break
        links = written(links.union(_verified(docs, classes, pairs)))
        found = written(components(links))
    members = written(_labelled(members.drop("hot"), found))
    rare = _shared_rare(docs, often, total // 4)
    # A group's own members meet under a token of its own.
    own = members.select(F.xxhash64(F.lit("group"), "g").alias("token"), "g").distinct()
    groups = spilt.groupBy("g").agg(F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("hot").alias("hot"))
    posts = written(rare.union(own).withColumn("cap", F.lit(None).cast("long")).union(_posted(groups, "g")))
    more = _verified(docs, classes, _cross_pairs(posts, members))
    links = written(links.union(more))
    final = components(links).select(F.col("id").alias("c"), "component")
    named = rows.select("c", "id", "n").join(final, "c", "left").withColumn("comp", F.coalesce("component", "c"))
    named = written(named.select("id", "n", "comp"))
    least = named.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    out = named.join(least, "comp", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "id").alias("component_id"))


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component: that of the least key, a null one last; repeats of that row go too.

    A row is known by the hash of key and text, so rows that share a key are
    judged apart and rows without one are judged.  Rows with an empty set stay.
    """
    row = F.xxhash64(key, text)
    name = fresh(docs, "_row")
    found = similar_groups(docs.select(row.alias("_row"), text), text, "_row").where("n_shingles > 0").distinct()
    keys = docs.select(row.alias("_row"), F.col(key).alias("_k")).distinct()
    members = written(found.join(keys, "_row").select("_row", "_k", "component_id"))
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("_k").isNull().alias("none"), "_k", "_row")).alias("first")).select("first._row")
    gone = written(members.select("_row").join(first, "_row", "left_anti").withColumnRenamed("_row", name))
    kept = docs.join(if_small(gone), row == F.col(name), "left_anti")
    repeated = docs.groupBy(row.alias("_row")).count().where("count > 1").join(members, "_row", "left_semi")
    repeated = written(repeated.select(F.col("_row").alias(name)))
    if not repeated.count():
        return kept
    once = kept.join(if_small(repeated), row == F.col(name), "left_semi").withColumn(name, row).dropDuplicates([name]).drop(name)
    return kept.join(if_small(repeated), row == F.col(name), "left_anti").unionByName(once)
