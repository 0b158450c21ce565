"""Writers: playlists, reports, splits, journals, and a publication that is whole or absent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def playlist_lines(entries: DataFrame, order: Sequence[str], header: str = "#EXTM3U") -> DataFrame:
    """``(place, value)`` lines of an M3U file: header, then each entry's lines in order."""
    body = F.concat_ws("\n", F.concat(F.lit('#EXTINF:-1 group-title="'), F.coalesce("group", F.lit("")), F.lit('",'), F.col("name")), F.when(F.col("options") != "", F.col("options")), F.col("url"))
    rows = entries.select(F.struct(F.lit(1).alias("part"), *order).alias("place"), body.alias("value"))
    top = entries.sparkSession.range(1).select(F.struct(F.lit(0).alias("part"), *[F.lit(None).cast(entries.schema[c].dataType).alias(c) for c in order]).alias("place"), F.lit(header).alias("value"))
    return top.unionByName(rows)


def write_playlist(entries: DataFrame, path: str, order: Sequence[str], header: str = "#EXTM3U") -> None:
    """One ordered text file: a published playlist is small and its order is its content."""
    playlist_lines(entries, order, header).orderBy("place").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_csv(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    rows.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_by_status(rows: DataFrame, path: str, status: str) -> None:
    rows.write.mode("overwrite").partitionBy(status).json(path)


def append_journal(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def report(rows: DataFrame, measures: Sequence[Column]) -> DataFrame:
    """``key=json`` lines of one-row aggregates."""
    one = rows.agg(*measures)
    pairs = F.array(*[F.concat(F.lit(f"{c}="), F.to_json(F.struct(F.col(c).alias("v")))) for c in one.columns])
    return one.select(F.explode(pairs).alias("value"))


def publish(spark: SparkSession, files: dict[str, DataFrame], folder: str, digest: str) -> bool:
    """Write all files of one report under a folder named by its digest, then its receipt.

    Readers follow the receipts, so a failure half-way leaves the previous publication in force, and
    a report that has a receipt is not written again. Returns whether anything was written.
    """
    base = f"{folder.rstrip('/')}/{digest}"
    try:
        if spark.read.json(f"{folder.rstrip('/')}/receipts").where(F.col("digest") == digest).limit(1).count():
            return False
    except Exception as e:  # the first publication: no receipt folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    for name, rows in files.items():
        rows.write.mode("overwrite").parquet(f"{base}/{name}")
    receipt = spark.createDataFrame([(digest, sorted(files))], "digest string, files array<string>")
    receipt.withColumn("published", F.current_timestamp()).write.mode("append").json(f"{folder.rstrip('/')}/receipts")
    return True


def promote(rows: DataFrame, path: str, guards: Sequence[tuple[str, DataFrame]]) -> None:
    """Write only if every guard query has no row."""
    for name, broken in guards:
        if broken.limit(1).count():
            raise ValueError(f"guard failed: {name}")
    rows.write.mode("overwrite").parquet(path)
