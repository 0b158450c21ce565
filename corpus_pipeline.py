"""Corpus preparation: language ID, exact dedup, near-dedup, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm import exact_dedup, language_id, near, packing, repeats
from lanewise.llm.common import saved, table
from lanewise.session import ship


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    ship(spark)
    return language_id.keep_identified(docs, language_id.learn(docs))


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row with the smallest doc_id, also where id and text are both repeated."""
    ship(spark)
    return exact_dedup.first_of_each(docs).select(*docs.columns)


def near_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (Jaccard likeness of 0.8 or more on five words), the row with
    the smallest doc_id. SimHash's tiles propose the first pairs; shingles find those that they miss."""
    ship(spark)
    return near.keep_one_of_each(docs).select(*docs.columns)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand more than once; n_chars follows the text.

    A document that had words and is left with none goes: nothing of it would be packed but its end.

    A passage is a run of ``repeats.PASSAGE`` (49) words or more: unlike op4, whose window of 400
    bytes is fixed, this finds every passage of over 50 words, however short they are.
    """
    ship(spark)
    kept = repeats.remove_passages(docs).withColumn("text", F.make_valid_utf8(F.col("kept").cast("string")))
    kept = kept.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("exact_dedup", first_copies),
    ("simhash_near_dedup", near_first),
    ("suffix_array_dedup", unrepeated),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # fingerprints and tokens are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, in order, each written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
