"""Journals of JSON lines that a writer may have left in the middle of a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.operators.joins import hinted


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, place, value, torn)``: the lines of each file with their order in it.

    A file is read in blocks and a block's lines in order, so block start and row number give a
    line's place. ``torn`` is the last line of a file that does not end in a line feed: the lines
    with one feed each are then longer by one than the file.
    """
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("_size"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("place"), "value",
    )
    ends = text.groupBy("file").agg(F.max("place").alias("_last"), (F.sum(F.octet_length("value") + 1) > F.max("_size")).alias("_open"))
    return text.join(hinted(ends), "file").select("file", "place", "value", (F.col("_open") & (F.col("place") == F.col("_last"))).alias("torn"))


def replayable(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(file, place, record)`` of complete lines. A torn last line is dropped, as its writer will
    write it again; a complete line that is not such a record fails the job."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    parsed = lines(spark, path).where("NOT torn").withColumn("record", F.from_json("value", f"{schema}, _broken string", options))
    whole = F.startswith(F.ltrim("value"), F.lit("{")) & F.col("record").isNotNull() & F.col("record._broken").isNull()
    refused = F.raise_error(F.concat(F.lit("broken journal line in "), F.col("file"), F.lit(": "), F.substring("value", 1, 80)))
    return parsed.select("file", "place", F.when(whole, F.col("record").dropFields("_broken")).otherwise(refused).alias("record"))


def replayed(records: DataFrame, key: str) -> DataFrame:
    """The last record of each key, files in the order of their names."""
    last = records.groupBy(F.col(f"record.{key}").alias("_key")).agg(F.max_by("record", F.struct("file", "place")).alias("record"))
    return last.select("record.*")
