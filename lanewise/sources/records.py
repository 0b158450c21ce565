"""JSON, tombstone, wire and rule sources, with the reader behind an interface."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lanewise.functions import urls

Reader = Callable[[SparkSession, str], DataFrame]


def json_rows(spark: SparkSession, path: str, schema: StructType | str, url: str | None = "url") -> DataFrame:
    """JSON lines; blank, malformed and non-object lines are dropped, as are rows without a URL."""
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.where(urls.valid(F.col(url))) if url else rows


def strict_json(spark: SparkSession, path: str, schema: StructType | str, whole: bool = False) -> DataFrame:
    """JSON lines, or one document a file; anything malformed fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", whole).json(path)


def tombstones(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("digest")).where("digest <> ''").distinct()


def union_with_stats(spark: SparkSession, sources: dict[str, str], reader: Reader, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame]:
    """All readable sources' rows with ``source_name``, and ``(source_name, ok, error)`` for every
    source: a failing one is a row, never the end of the run."""
    rows, stats = None, []
    for name, path in sources.items():
        try:
            part = parse(reader(spark, path)).withColumn("source_name", F.lit(name))
            part.limit(1).collect()  # an unreadable path shows here
        except Exception as e:  # any reader's own errors
            stats.append((name, False, type(e).__name__))
            continue
        stats.append((name, True, ""))
        rows = part if rows is None else rows.unionByName(part)
    return rows, spark.createDataFrame(stats, "source_name string, ok boolean, error string")


def wire(lines: DataFrame, line: str, fields: int = 11) -> DataFrame:
    """Tab-separated records, text fields in base64: ``(id, url, status, metrics, problem)``.

    A record with the wrong number of fields or an unreadable identity has ``problem`` identity; one
    with an unreadable metric keeps its identity and becomes UNKNOWN.
    """
    cells = F.split(line, "\t")
    said = lambda i: F.try_to_binary(F.get(cells, F.lit(i)), F.lit("base64")).cast("string")
    metric = F.transform(F.slice(cells, 4, fields - 3), lambda x: x.try_cast("double"))
    broken = (F.size(cells) != fields) | F.coalesce(said(0), F.lit("")).eqNullSafe("") | ~urls.valid(said(1))
    bad_metric = F.exists(metric, lambda x: x.isNull() | (x < 0))
    return lines.select(
        said(0).alias("id"), said(1).alias("url"), F.when(bad_metric, "UNKNOWN").otherwise(F.get(cells, F.lit(2))).alias("status"),
        metric.alias("metrics"), F.when(broken, "identity").when(bad_metric, "metric").alias("problem"),
    )


def rule_counts(lines: DataFrame, line: str) -> DataFrame:
    """Rules by kind: the part before the first comma of list items."""
    kind = F.regexp_extract(line, r"^\s*-\s*'?([A-Z][A-Z-]*),", 1)
    return lines.select(kind.alias("kind")).where("kind <> ''").groupBy("kind").agg(F.count("*").alias("n"))


def changed_files(now: DataFrame, before: DataFrame, path: str, body: str) -> DataFrame:
    """Paths whose bytes and whose parsed lines both differ from the previous revision."""
    a, b = now.select(path, F.col(body).alias("_a")), before.select(path, F.col(body).alias("_b"))
    lines = lambda c: F.array_sort(F.filter(F.split(c, r"\r?\n"), lambda x: F.trim(x) != ""))
    return a.join(b, path).where((F.sha2("_a", 256) != F.sha2("_b", 256)) & (lines(F.col("_a")) != lines(F.col("_b")))).select(path)
