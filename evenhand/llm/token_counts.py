"""Token counts: the exact histogram of encoded lengths.

One row per length that occurs answers every question about context limits:
suffix sums give the documents and tokens at or above a length, and from them
totals, quantiles and the tokens left when every document is cut at a limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoders import RankFile, loaded
from .tables import written
from .textarrays import column

#: Lengths are summed in blocks of this many, so that no window holds them all.
SPAN = 1024


def token_lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encoded length of each document, as ``n_tokens``, a row per row.

    A null or empty text has 0; long texts are encoded whole, and special
    tokens as plain text; repeated rows count each time; an empty table gives
    no rows; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(RankFile, path, pattern)
        for batch in batches:
            lengths = [encoder.length(t.as_py() or "") for t in column(batch, text)]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return docs.select(text).mapInArrow(encode, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """The histogram with suffix sums, one row per ``n_tokens`` that occurs.

    n_docs; docs_at_least and tokens_at_least (suffix sums, the row included);
    tokens_cut, the tokens left if every document is cut at n_tokens; and
    quantile, the share of documents of at most this length.  No documents
    give no rows; ties share a row; repeated rows count each time.
    """
    counts = written(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))).withColumn(
        "block", F.expr(f"n_tokens div {SPAN}")
    )
    tokens = F.col("n_tokens") * F.col("n_docs")
    per_block = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    # One row per 1,024 lengths: the longest text bounds their number.
    after = per_block.select(
        "block",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("later_d"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("later_t"),
        F.sum("d").over(everything).alias("all_d"),
        F.sum("t").over(everything).alias("all_t"),
    )
    within = Window.partitionBy("block").orderBy(F.col("n_tokens").desc())
    return (
        counts.join(after, "block")
        .select(
            "n_tokens",
            "n_docs",
            (F.sum("n_docs").over(within) + F.col("later_d")).alias("docs_at_least"),
            (F.sum(tokens).over(within) + F.col("later_t")).alias("tokens_at_least"),
            "all_d",
            "all_t",
        )
        .select(
            "n_tokens",
            "n_docs",
            "docs_at_least",
            "tokens_at_least",
            (F.col("all_t") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias(
                "tokens_cut"
            ),
            (
                (F.col("all_d") - F.col("docs_at_least") + F.col("n_docs")).cast("double") / F.col("all_d")
            ).alias("quantile"),
        )
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens beyond it, and tokens left when cut at it."""
    spark = histogram.sparkSession
    wanted = spark.createDataFrame([(x,) for x in limits], "context int")
    total = F.coalesce(F.sum(F.col("n_tokens") * F.col("n_docs")), F.lit(0))
    over = F.col("n_tokens") > F.col("context")
    return (
        histogram.crossJoin(F.broadcast(wanted))  # the limits are the caller's short list
        .groupBy("context")
        .agg(
            total.alias("tokens"),
            F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_over"),
            F.sum(F.least("n_tokens", "context") * F.col("n_docs")).alias("tokens_cut"),
        )
    )


def length_quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that at least the share ``q`` of documents does not exceed."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))
