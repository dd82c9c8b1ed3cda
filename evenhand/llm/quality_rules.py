"""Quality rules with host verdicts, in SQL expressions only.

Each document is measured in its own row.  Failures are summed by host, each
host's rate is shrunk towards a beta prior fitted to all hosts by moments, and
the verdict is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import fresh, if_small, written

#: Words below which a document fails, and the share of repeated words (percent) above which it does.
MIN_WORDS, MAX_REPEAT = 20, 30
#: Soft rules: percent of symbols in word characters, and percent of duplicate lines in words.
MAX_SYMBOLS, MAX_DUP_LINES = 10, 5
#: Words in a window.
WINDOW = 8
#: A host is bad if its failure rate surely lies above BAD: most of its documents fail.
BAD = 0.5
#: Normal quantile of "surely": 95 % of the posterior's mass lies on the stated side.
SURE = 1.645
#: Prior strength where the hosts do not vary or are too few to fit one.
FLAT = 20.0


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of 8 found at least twice in the array.

    The windows are hashed, sorted with their places, and equal neighbours
    marked; a sort of the marked places then gives the union's length.
    """
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))

    def marked(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            m = F.size(s)
            same = F.filter(
                F.transform(
                    s,
                    lambda x, i: F.when(
                        ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < m - 1) & (F.get(s, i + 1)["h"] == x["h"])), x["i"]
                    ),
                ),
                lambda x: x.isNotNull(),
            )
            return F.array_sort(same)

        def covered(p: Column) -> Column:
            end = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).alias("last"))
            return F.aggregate(
                p,
                end,
                lambda s, x: F.struct((s["sum"] + F.least(F.lit(WINDOW), x - s["last"])).alias("sum"), x.alias("last")),
                lambda s: s["sum"],
            )

        once = lambda value, then: F.element_at(F.transform(F.array(value), then), 1)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(once(once(order, places), covered))

    return F.when(n < WINDOW + 1, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(hashes), marked), 1))


def measures(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of each whole text; null: none."""
    body = F.coalesce(F.col(text), F.lit(""))
    spaces = "\t\n\x0b\x0c\r"
    words = F.filter(F.split(F.translate(body, spaces, " " * 5), " "), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = docs.select(F.col(key).alias("id"), F.col(host).alias("host"), words.alias("words"), lines.alias("lines"), body.alias("body"))
    return rows.select(
        F.col("id").alias(key),
        F.col("host").alias(host),
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("body", " " + spaces, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )


def failures() -> tuple[Column, Column]:
    """(base, soft) rule failures of measured rows."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    soft = (100 * F.col("n_symbols") > MAX_SYMBOLS * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES * F.col("n_words"))
    return base, soft


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_verdict): failure rates shrunk by the empirical beta prior.

    The prior's mean and strength are the moments over hosts; a null host is a
    host of its own.  A host is ``bad`` if its posterior lies above BAD with
    certainty SURE, ``trusted`` if it lies below the prior's mean with it,
    else ``ordinary``: so a few failures of a small host decide nothing.
    Counts are combined map-side, so a hot host costs no more.
    """
    base, soft = failures()
    hosts = measured.groupBy(host).agg(F.count("*").alias("n_docs"), F.sum(F.when(base | soft, 1).otherwise(0)).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("m"), F.var_pop(rate).alias("v"), F.avg(rate * (1 - rate) / F.col("n_docs")).alias("noise"))
    between = F.col("v") - F.col("noise")
    strength = F.when(between > 0, F.greatest(F.col("m") * (1 - F.col("m")) / between - 1, F.lit(1.0))).otherwise(F.lit(FLAT))
    prior = prior.select("m", F.least(strength, F.lit(1000.0)).alias("k"))  # one row
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("host_rate", (F.col("n_failed") + F.col("m") * F.col("k")) / (F.col("n_docs") + F.col("k")))
    p = F.col("host_rate")
    margin = SURE * F.sqrt(p * (1 - p) / (F.col("n_docs") + F.col("k") + 1))
    verdict = F.when(p - margin > BAD, "bad").when(p + margin < F.col("m"), "trusted").otherwise("ordinary")
    return shrunk.select(host, "n_docs", "n_failed", "host_rate", verdict.alias("host_verdict"))


def judged(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """Measures with base_failed, host_rate, host_verdict and kept.

    kept is false for a base failure, for every document of a bad host, and
    for a soft failure unless its host is trusted.  An empty or null text
    fails; an empty table gives no rows; repeated rows are judged alike; a
    null host is a host; other columns are ignored.
    """
    base, soft = failures()
    rows = written(measures(docs, text, key, host))
    h = fresh(rows, "_h")
    hosts = host_rates(rows, host).select(F.col(host).alias(h), "host_rate", "host_verdict")
    kept = ~base & (F.col("host_verdict") != "bad") & (~soft | (F.col("host_verdict") == "trusted"))
    return (
        rows.join(hosts, F.col(host).eqNullSafe(F.col(h)))
        .withColumns({"base_failed": base, "kept": kept})
        .drop(h)
    )


def keep_good(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source") -> DataFrame:
    """``docs`` without the rows that ``judged`` rejects; every column passes through.

    A rejected row is known by the hash of key, text and host, so rows that
    share a key are judged apart and repeated rows together.  Null and empty
    texts go; an empty table stays empty.
    """
    name = fresh(docs, "_row")
    row = F.xxhash64(key, text, host)
    rows = docs.select(text, host, row.alias(name))
    # Judged under the hash; the key itself may be null or repeated.
    gone = written(judged(rows, text, name, host).where("not kept").select(name).distinct())
    return docs.join(if_small(gone), row == F.col(name), "left_anti")
