"""The corpus pipeline: quality rules, near-dedup, repeated passages, mixing, packing; each stage a Spark job.

Every stage but the last takes and returns rows with the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackclean.llm import mixing, neardup, packing, quality, substrings
from trackclean.llm.common import WORD, join_same, own_tables, read_table, store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep, each by its own verdict."""
    kept = quality.quality_rules(docs, carry=tuple(COLUMNS)).filter("kept")
    return kept.select(*[f"carried.{c}" for c in COLUMNS])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest doc_id, of those the one whose text's MD5 is least.

    Rows that share a doc_id are documents of their own. Rows without doc_id or without a word all stay.
    """
    worded = F.col("doc_id").isNotNull() & F.coalesce("text", F.lit("")).rlike(WORD)
    x = docs.select(*COLUMNS)
    stay = neardup.representatives(x.filter(worded))
    found = join_same(x.filter(worded).withColumn("text_key", F.md5("text")), stay, ["doc_id", "text_key"])
    return found.dropDuplicates(["doc_id", "text_key"]).select(*COLUMNS).unionByName(x.filter(~worded))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that start earlier; what a cut leaves of a character goes too."""
    left = substrings.remove_repeats(docs, texts=True, carry=("lang", "source")).withColumnRenamed("kept", "text")
    return left.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, in the order of the schedule's slots.

    Where the mix takes a document's first words only, the text ends behind the last of them, white space as it is. Of rows
    that are equal in doc_id, source and text, lang is one's of them.
    """
    x = docs.select(*COLUMNS).withColumn("row_key", mixing.row_key(F.col("doc_id"), F.col("source").cast("string"), F.col("text")))
    x = x.dropDuplicates(["row_key"]).drop("n_chars").join(mixing.taken_documents(docs), "row_key")
    words = F.regexp_extract_all("text", F.lit(f"[ \\t-\\r]*{WORD}"), F.lit(0))
    start = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), "")
    x = x.withColumn("text", F.when(F.col("words") < F.regexp_count("text", F.lit(WORD)), start).otherwise(F.col("text")))
    x = x.orderBy("first_slot", "bucket", "nth")
    return x.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents with their sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources", mix_stage),
    ("best-fit packing", pack_stage),
]
#: Near-duplicate components, byte-level passages and tokens are beyond SQL: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder before the next one reads it.
    What a stage stored on its way is deleted when its result has been written."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with own_tables(spark):
            docs = store(stage(spark, docs, sf_dir), outer=True)
    return STAGES[-1][1](spark, docs, sf_dir)
