"""Playlist text as rows: extended M3U, ``name,url`` lists, HLS masters and media lists.

All parsers take lines ``(source, pos, line)`` and work with windows over one source's lines, so
many files are parsed at once and order is carried in ``pos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.functions import text, urls

OPTION = r"^#(EXTVLCOPT|KODIPROP|EXTHTTP)"


def lines_of(documents: DataFrame, source: str, body: str) -> DataFrame:
    """``(source, pos, line)`` of whole texts."""
    return documents.select(F.col(source).alias("source"), F.posexplode(F.split(F.coalesce(body, F.lit("")), r"\r?\n")).alias("pos", "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    return lines_of(whole, "source", "value")


def m3u(lines: DataFrame) -> DataFrame:
    """Entries ``(source, pos, name, group, extinf, options, url, url_options)``.

    A URL belongs to the ``#EXTINF`` line before it if no other URL lies between; its name is what
    follows the last comma. Option lines between the two are joined. ``url$options`` is split.
    """
    line = Window.partitionBy("source").orderBy("pos")
    clean = lines.withColumn("line", F.trim(F.regexp_replace("line", "﻿", "")))
    info, is_url = F.col("line").startswith("#EXTINF"), F.col("line").rlike("^https?://")
    block = clean.withColumn("block", F.sum(info.cast("int")).over(line))
    inside = Window.partitionBy("source", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = (
        block.withColumn("extinf", F.first(F.when(info, F.col("line")), ignorenulls=True).over(inside))
        .withColumn("options", F.concat_ws("\n", F.collect_list(F.when(F.col("line").rlike(OPTION), F.col("line"))).over(inside)))
        .withColumn("nth", F.sum(is_url.cast("int")).over(inside))
    )
    split = urls.split_options(F.col("line"))
    return seen.where(is_url & (F.col("nth") == 1) & F.col("extinf").isNotNull()).select(
        "source", "pos", text.clean_name(F.regexp_extract("extinf", r",([^,]*)$", 1)).alias("name"), text.attribute(F.col("extinf"), "group-title").alias("group"),
        "extinf", "options", split["url"].alias("url"), split["options"].alias("url_options"),
    )


def lists(lines: DataFrame) -> DataFrame:
    """Rows ``(source, pos, part, name, group, url, url_options)`` of ``name,url#url`` lists; a
    line ``group,#genre#`` sets the group of those that follow."""
    line = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    genre = F.regexp_extract("line", r"^\s*([^,]*),\s*#genre#", 1)
    grouped = lines.withColumn("group", F.coalesce(F.last(F.when(F.col("line").contains("#genre#"), genre), ignorenulls=True).over(line), F.lit("")))
    pairs = grouped.where(F.col("line").rlike(r"^[^#,][^,]*,\s*https?://")).select("source", "pos", "group", text.clean_name(F.regexp_extract("line", "^([^,]*),", 1)).alias("name"), F.posexplode(F.split(F.regexp_extract("line", r"^[^,]*,\s*(.*)$", 1), "#")).alias("part", "raw"))
    split = urls.split_options(F.col("raw"))
    return pairs.where(urls.valid(F.col("raw"))).select("source", "pos", "part", "name", "group", split["url"].alias("url"), split["options"].alias("url_options"))


def strict(entries: DataFrame) -> DataFrame:
    """Identical repeats dropped; a name with two URLs fails the job."""
    once = entries.groupBy("name", "url").agg(F.min("pos").alias("pos"))
    several = F.count("*").over(Window.partitionBy("name")) > 1
    return once.withColumn("_bad", several).where(F.assert_true(~F.col("_bad"), "a name has two urls").isNull()).drop("_bad")


def blocks(lines: DataFrame) -> DataFrame:
    """``(source, block, body, pos)``: the header is block 0, then each entry with all its lines."""
    line = Window.partitionBy("source").orderBy("pos")
    marked = lines.withColumn("block", F.sum(F.col("line").startswith("#EXTINF").cast("int")).over(line))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy("source", "block").agg(joined.alias("body"), F.min("pos").alias("pos"))


def variants(lines: DataFrame) -> DataFrame:
    """HLS master: ``(source, pos, width, height, bandwidth, uri)``; the uri is the next plain line."""
    line = Window.partitionBy("source").orderBy("pos")
    plain = lines.where((F.trim("line") != "") & (~F.col("line").startswith("#") | F.col("line").startswith("#EXT-X-STREAM-INF")))
    paired = plain.withColumn("uri", F.lead("line").over(line)).where(F.col("line").startswith("#EXT-X-STREAM-INF"))
    size = lambda k: F.regexp_extract("line", r"RESOLUTION=(\d+)x(\d+)", k).try_cast("int")
    return paired.select("source", "pos", size(1).alias("width"), size(2).alias("height"), F.regexp_extract("line", r"[:,]BANDWIDTH=(\d+)", 1).try_cast("long").alias("bandwidth"), "uri")


def last_segments(lines: DataFrame, n: int) -> DataFrame:
    """HLS media: the last ``n`` different segments, in their order."""
    distinct = lines.where((F.trim("line") != "") & ~F.col("line").startswith("#")).groupBy("source", F.trim("line").alias("uri")).agg(F.max("pos").alias("pos"))
    nth = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("pos")))
    return distinct.withColumn("back", nth).where(F.col("back") <= n)
