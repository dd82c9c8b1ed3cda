"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible.  A partial partition is a list of k
byte sums; differencing repeatedly takes the two with the largest spread and
adds them in opposite order, which leaves near-equal sums.  Chunks of groups
are differenced in parallel tasks; what each leaves is one partial partition,
and those are differenced again, level by level, until one is left.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

#: Partial partitions that one task combines.
CHUNK = 4096


def difference(sums: np.ndarray) -> np.ndarray:
    """Shard of every part, for n partial partitions of k parts each (sums: n x k).

    A row's parts all get different shards.  Ties fall by position.
    """
    n, k = sums.shape
    order = np.argsort(-sums, axis=1, kind="stable")
    # A partition: its sums descending, and for each the last and first (row, part) of a linked list.
    after = np.full(n * k, -1, dtype=np.int64)
    live = []
    for i in range(n):
        parts = [(int(sums[i, p]), i * k + int(p), i * k + int(p)) for p in order[i]]
        live.append((parts[-1][0] - parts[0][0], i, parts))
    heapq.heapify(live)
    name = n
    while len(live) > 1:
        _, _, a = heapq.heappop(live)
        _, _, b = heapq.heappop(live)
        both = []
        for (x, head, tail), (y, other, end) in zip(a, reversed(b), strict=True):
            after[tail] = other
            both.append((x + y, head, end))
        both.sort(key=lambda p: (-p[0], p[1]))
        heapq.heappush(live, (both[-1][0] - both[0][0], name, both))
        name += 1
    out = np.empty(n * k, dtype=np.int32)
    for shard, (_, at, _) in enumerate(live[0][2]):
        while at >= 0:
            out[at] = shard
            at = after[at]
    return out.reshape(n, k)


def balanced_shards(docs: DataFrame, shards: int = 16, chunk: int = CHUNK, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every row; equal texts share a shard.

    size: UTF-8 bytes of the text plus 1.  A null text has no bytes and goes
    with the empty ones.  Slots run from 0 without a gap in each shard.
    Repeated rows each get a place; an empty table gives no rows; other
    columns are ignored.  Only (hash, sum) pairs are grouped, combined
    map-side, so a hot text costs one row per task.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(body).alias("h"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = written(rows)
    total = rows.count()
    groups = rows.groupBy("h").agg(F.sum("size").alias("size"))
    chunks = max(1, -(-total // chunk))
    first = groups.withColumn("chunk", F.pmod(F.xxhash64("h", F.lit(1)), F.lit(chunks)).cast("long"))

    def first_level(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "h"], ascending=[False, True])
        sums = np.zeros((len(pdf), shards), dtype=np.int64)
        sums[:, 0] = pdf["size"].to_numpy()
        part = difference(sums)[:, 0]
        return pd.DataFrame({"h": pdf["h"].to_numpy(), "size": pdf["size"].to_numpy(), "chunk": pdf["chunk"].to_numpy(), "part": part})

    parts = written(first.groupBy("chunk").applyInPandas(first_level, "h long, size long, chunk long, part int"))
    # One row per chunk and level: sums by part, and the shard of each part so far.
    level = parts.groupBy("chunk").agg(*(F.sum(F.when(F.col("part") == p, F.col("size")).otherwise(0)).alias(f"s{p}") for p in range(shards)))
    level = level.select("chunk", F.array(*(f"s{p}" for p in range(shards))).alias("sums"))
    maps = []
    left = chunks
    while left > 1:
        fewer = -(-left // chunk)

        def combine(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")
            to = difference(np.array(pdf["sums"].tolist(), dtype=np.int64))
            return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "up": pdf["up"].to_numpy(), "sums": pdf["sums"].to_numpy(), "to": list(to)})

        done = written(
            level.withColumn("up", F.pmod("chunk", F.lit(fewer)).cast("long"))
            .groupBy("up")
            .applyInPandas(combine, "chunk long, up long, sums array<long>, to array<int>")
        )
        maps.append(done.select("chunk", "up", "to"))
        level = (
            done.select("up", F.explode(F.arrays_zip("to", "sums")).alias("x"))
            .groupBy("up")
            .agg(*(F.sum(F.when(F.col("x.to") == p, F.col("x.sums")).otherwise(0)).alias(f"s{p}") for p in range(shards)))
            .select(F.col("up").alias("chunk"), F.array(*(f"s{p}" for p in range(shards))).alias("sums"))
        )
        left = fewer
    for m in maps:
        parts = parts.join(m, "chunk").select("h", "size", F.col("up").alias("chunk"), F.element_at("to", F.col("part") + 1).alias("part"))
    placed = rows.join(parts.select("h", F.col("part").alias("shard")), "h")
    return with_slots(placed.drop("h"), total, "id").withColumnRenamed("id", key)


def with_slots(rows: DataFrame, total: int, key: str, per_bucket: int = 50_000) -> DataFrame:
    """``slot``: a gapless number from 0 in each ``shard``.

    Rows are numbered within (shard, bucket), buckets being hashes of the key
    and so of one size; running counts of the buckets carry the numbers on.
    """
    buckets = max(1, -(-total // per_bucket))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)))
    rows = written(rows)
    sizes = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy(key, "text_crc32")
    return (
        rows.withColumn("row", F.row_number().over(inside))
        .join(starts, ["shard", "bucket"])
        .withColumn("slot", (F.col("start") + F.col("row") - 1).cast("long"))
        .drop("bucket", "row", "start")
    )
