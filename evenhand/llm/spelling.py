"""Spelling variants by asymmetric q-chunks.

Two words at one edit share a chunk: of two disjoint chunks that the shorter
one is cut into, an edit touches one at most, so the other stands in the longer
word, moved by one place at most.  The shorter word contributes its two chunks,
the longer one its positional grams near their places; they meet on equality
and are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import bounded_batches, written
from .textarrays import column, tidy

#: Maximal runs that count as words (fixed value), after A-Z are lowered.
RUN = re.compile("[a-zÀ-ÿ]+")
#: One run in so many loses a code point, by the hash of its document and itself.
ODDS = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words of a chunk up to which they meet by the chunk alone; beyond, by what is left of the word, too.
OFTEN = 64


def damaged(run: str, h: int) -> str:
    """``run`` without its code point h % length where ODDS divides h."""
    at = h % len(run)
    return run if h % ODDS else run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): occurrences of each result over whole texts, counted per batch, then per word.

    Null and empty texts have none; a null key is an empty one in the hash;
    repeated rows count each time; an empty table gives no rows; other columns
    are ignored.  A task holds the distinct words of a batch.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter[str] = Counter()
            for k, t in zip(column(batch, key).to_pylist(), column(batch, text), strict=True):
                runs = Counter(RUN.findall((t.as_py() or "").encode().lower().decode()))
                start = zlib.crc32(f"{'' if k is None else k}:".encode())
                for run in runs:
                    h = zlib.crc32(run.encode(), start)
                    if not h % ODDS:
                        n = runs[run]
                        total[damaged(run, h)] += n
                        total[run] -= n
                total.update(runs)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    bounded_batches(docs.sparkSession)
    each = docs.select(key, text).mapInArrow(tidy(count), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def _chunks(word: Column, length: Column, shift: int) -> Column:
    """The chunks of a word of ``length`` code points, each read ``shift`` places off its own: (side, chunk, rest)."""
    q = F.floor(length / 2).cast("int")
    size = F.char_length(word)

    def one(side: int, place: Column) -> Column:
        at = place + shift
        chunk = F.substring(word, at + 1, q)
        # What stands before the chunk and after it: where the edit must be.
        rest = F.concat(F.substring(word, F.lit(1), at), F.lit("\x00"), F.substring(word, at + q + 1, size))
        return F.when((at >= 0) & (at + q <= size), F.struct(F.lit(side).alias("side"), chunk.alias("chunk"), rest.alias("rest")))

    return F.array(one(0, F.lit(0)), one(1, (length - q).cast("int")))


def _without_one(rest: Column) -> Column:
    """``rest`` itself and without each of its code points: texts at one edit share one of these."""
    spots = F.sequence(F.lit(0), F.char_length(rest) - 1)
    cut = F.transform(spots, lambda i: F.concat(F.substring(rest, F.lit(1), i), F.substring(rest, i + 2, F.char_length(rest))))
    return F.array_distinct(F.concat(F.array(rest), cut))


def near_words(words: DataFrame, word: str = "word", often: int = OFTEN) -> DataFrame:
    """(a, b): the pairs of distinct words with exactly one inserted, deleted or replaced code point; a is the shorter, then lesser one.

    Exact for words of two code points or more; shorter, null and repeated
    ones are left out.  A chunk of more than ``often`` words on a side, which
    would pair them all, does not join alone: its words meet where what is
    left of them besides the chunk agrees but for one code point, so such a
    group costs rows by its length, not by its square.
    """
    w = written(words.where(F.char_length(word) >= 2).select(F.col(word).alias("w"), F.char_length(word).alias("l")).distinct())
    short = w.select("w", "l", F.inline(F.filter(_chunks(F.col("w"), F.col("l"), 0), lambda x: x.isNotNull())))
    # A longer word's chunk has its place or the next one, one of equal length its place.
    there = F.when(F.col("l") == F.col("for"), _chunks(F.col("w"), F.col("for"), 0)).otherwise(F.concat(*(_chunks(F.col("w"), F.col("for"), x) for x in (0, 1))))
    long = w.select("w", "l", F.explode(F.array(F.col("l"), F.col("l") - 1)).alias("for")).where("for >= 2")
    long = long.select("w", F.col("for").alias("l"), F.inline(F.filter(there, lambda x: x.isNotNull()))).distinct()
    short, long = written(short), written(long)
    keys = ["l", "side", "chunk"]
    hot = short.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > often).union(long.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > often))
    hot = written(hot.select(*keys).distinct())
    a, b = short.withColumnRenamed("w", "a"), long.withColumnRenamed("w", "b")
    few = a.join(hot, keys, "left_anti").drop("rest").join(b.drop("rest"), keys).select("a", "b")
    spread = lambda x, name: x.join(hot, keys, "left_semi").select(*keys, name, F.explode(_without_one(F.col("rest"))).alias("left"))
    many = spread(a, "a").join(spread(b, "b"), [*keys, "left"]).select("a", "b")
    ordered = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    return few.union(many).where(ordered).distinct().where(F.levenshtein("a", "b", 1) == 1)


def variants(counts: DataFrame, length: int = LEAST_LENGTH, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of at least ``length`` code points and ``least`` occurrences.

    form: the near word that occurs most (ties: the lesser in code-point
    order), if at least ``ratio`` times as often; root follows forms to the
    last one.  Occurrences grow along forms, so the way ends; each round
    doubles its length.  No words give no rows.
    """
    words = written(counts.where((F.char_length("word") >= length) & (F.col("n") >= least)))
    pairs = near_words(words)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    other = words.select(F.col("word").alias("near"), F.col("n").alias("m"))
    found = both.join(other, "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("m"), F.col("near"), F.col("m").alias("m"))).alias("best"))
    rows = words.join(found, "word", "left")
    good = F.col("best.m") >= ratio * F.col("n")
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, F.col("best.m")).alias("form_n")))
    way = written(rows.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = way.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = written(way.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        way = longer.select("word", "root")
        if longer.where("moved").isEmpty():
            break
    return rows.join(way, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``variants`` of the words of whole ``docs``."""
    return variants(written(word_counts(docs, text, key)))
