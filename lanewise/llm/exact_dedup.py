"""Exact duplicates with two Bloom passes, all in DataFrame functions.

Pass one hashes each normalised text to a few slots and counts slots; slots hit at least
twice become a bitmap of at most ``max_bits`` bits (64 MB at the default), which is therefore safe to
broadcast at any corpus size. Pass two tests each row against the bitmap: a row with a slot hit
only once cannot have a copy and passes straight through; the others shuffle by the text's
SHA-256 and are grouped exactly. A full bitmap only sends more rows through the shuffle; it
never changes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.bloom import MAX_BITS, bits_for, flag_shared, shared_slots
from lanewise.llm.common import cut, table, without

FEW = 100_000  # groups broadcast at most, of some 100 bytes each
ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """All rows and columns of ``docs`` plus ``keep_id, group_size, kept, text_sha256``.

    Null text counts as empty; empty texts are equal to each other. Of equal texts the smallest
    id stays (null ids sort after all others; a group of only null ids keeps them). Rows that
    repeat both id and text count in ``group_size`` and share the outcome, since nothing tells
    them apart. Input columns named like an added column are replaced. An empty table gives no
    rows.
    """
    bits = bits_for(docs.count(), max_bits)
    # never null, and said so: else the join's null filter hashes every text a second time
    digest = F.coalesce(F.sha2(normalised(F.col(text_col)), 256), F.lit(""))
    hashed = without(docs, *ADDED).withColumn("text_sha256", digest)
    bitmap = shared_slots(hashed, "text_sha256", bits)
    flagged = flag_shared(hashed, "text_sha256", bitmap, bits)
    alone = flagged.where("NOT _shared").drop("_shared").withColumns(
        {"keep_id": F.col(id_col), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}
    )
    maybe = flagged.where("_shared").drop("_shared")
    # written first, so that the join's sides are plain shuffles, whose hot keys Spark splits; few groups are broadcast
    groups = cut(maybe.groupBy("text_sha256").agg(F.min(id_col).alias("keep_id"), F.count("*").alias("group_size")))
    grouped = maybe.join(F.broadcast(groups) if groups.count() <= FEW else groups, "text_sha256").withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
    return alone.unionByName(grouped).select(*[F.col(f"`{c}`") for c in hashed.columns if c != "text_sha256"], *ADDED)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per text: of equal texts a row with the smallest id, nulls last.

    Of rows that share this id too, the one whose unnormalised text comes first stays. Only
    texts that stand more than once are reduced, with partial aggregates; the others pass.
    """
    found = exact_dedup(docs.withColumn("_all", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), id_col, text_col).where("kept")
    once = found.where("group_size = 1").select("_all.*")
    many = found.where("group_size > 1").groupBy("text_sha256").agg(F.min_by("_all", F.coalesce(F.col(text_col), F.lit(""))).alias("_all"))
    return once.unionByName(many.select("_all.*"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", *ADDED)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
