"""From raw documents to packed training sequences, a Spark job per stage.

Each stage works on all that the one before it kept, written as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenhand.llm import decontamination, jaccard_join, packing, pii, quality_rules
from evenhand.llm.queries import PII_KEY
from evenhand.llm.tables import documents, fresh, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does.

    Null and empty texts fail.  A null host is a host; rows that share a key
    are judged apart, repeated rows alike; an empty table stays empty; every
    column passes through, whatever its name.
    """
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, that of the least id, a null id last.

    Texts without words stay; repeated rows with words become one; an empty
    table stays empty; every column passes through, whatever its name.
    """
    return jaccard_join.one_of_each(docs)


def _measured(docs: DataFrame) -> DataFrame:
    """``docs`` with n_chars, where it has that column, counted anew."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; one that is mostly benchmark goes.

    Null and empty texts stay as they are; repeated rows are cut alike; an
    empty table stays empty; other columns pass through, whatever their name.
    """
    return _measured(decontamination.remove_contaminated(docs, documents(spark, sf_dir, "benchmark")))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal values replaced, row for row.

    Null and empty texts stay as they are; repeated rows are rewritten alike;
    other columns pass through, whatever their name.
    """
    found = fresh(docs, "_pii")
    return _measured(pii.pseudonymise(docs, PII_KEY, found=found).drop(found))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences.

    A null or empty text is its end token; repeated rows are pieces of their
    own; an empty table gives no pieces; columns but key and text are ignored.
    """
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonymised),
    ("packing", packed),
]

#: SQL cannot express the tokenizer, nor the keyed permutation; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
