"""The three flows: audited lineup, full build from recorded measurements, incremental report loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import text, urls
from lanewise.operators import aggregates, joins, ranking, scores, updates
from lanewise.plans.policy import DEFAULT, Policy
from lanewise.plans.registry import query, table
from lanewise.sources import playlists


def lineup(pages: DataFrame, vetoed: DataFrame, quota: int, limit: int) -> DataFrame:
    """Audited pool to lineup: hosts, vetoes, best page a route, quotas by language."""
    rows = pages.select("page_id", "url", urls.host(F.col("url")).alias("host"), urls.route_key(F.col("url")).alias("route"), text.attribute(F.col("html"), "lang").alias("lang"), F.length("html").alias("size"))
    clean = joins.veto(rows, vetoed, "host")
    best = aggregates.best_of(clean, ["route"], F.col("size"), "page_id")
    marked = best.withColumn("core", F.col("size") > 20000)
    return ranking.quotas(marked, "lang", "core", F.lit(quota), [F.desc("size"), F.col("page_id")], limit)


@query("lineup_pipeline")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    vetoed = pages.where(F.col("url").contains("spam")).select(urls.host(F.col("url")).alias("host")).distinct()
    return lineup(pages, vetoed, 30, 120).select("page_id", "host", "route", "lang", "phase", "pos")


def build(lines: DataFrame, measured: DataFrame, limit: int, policy: Policy = DEFAULT) -> DataFrame:
    """Playlists to a ranked build: parse, merge sources, join recorded measurements, gate, rank."""
    entries = playlists.m3u(lines).withColumn("station", text.station_key(F.col("name")))
    merged = aggregates.merge_sources(entries.select("name", "station", "group", "url", "pos", "source"), ["name", "url"], "pos", "source")
    joined = merged.join(measured, "url", "left")
    gated = joined.withColumn("fit", F.coalesce("ok", F.lit(False)) & ~scores.weak_h264(F.lit("h264"), F.col("stream_mbps"), policy))
    scored = gated.where("fit").withColumn("score", scores.evidence_score(F.col("height"), F.col("stream_mbps"), F.col("segment_mbps"), F.col("manifest_s")))
    best = aggregates.best_of(scored.withColumn("at", F.xxhash64("url")), ["station"], F.col("score"), "at")
    return ranking.round_robin(best, "group", [F.desc("score"), F.col("station")], limit)


def report(previous: DataFrame, measured: DataFrame, backups: DataFrame, circuit: bool) -> DataFrame:
    """Decisions per channel: KEEP, REPLACE with the best backup, or UNRESOLVED."""
    best = backups.groupBy("channel").agg(F.max_by("backup_url", F.struct("headroom", "backup_url")).alias("backup_url"))
    joined = previous.join(measured, ["channel", "url"], "left").join(best, "channel", "left")
    bad = (F.col("verdict") == "BAD") & ~F.lit(circuit)
    action = F.when(bad & F.col("backup_url").isNotNull(), "REPLACE").when(bad, "UNRESOLVED").otherwise("KEEP")
    return joined.select("channel", "url", action.alias("action"), F.when(action == "REPLACE", F.col("backup_url")).alias("replacement"))


def applied(previous: DataFrame, decisions: DataFrame) -> DataFrame:
    """The next published list: exact swaps only, where the old URL still stands."""
    plan = decisions.where("action = 'REPLACE'").select("channel", F.col("url").alias("old"), F.col("replacement").alias("new"))
    return updates.exact_update(previous, plan, "channel", "url", "old", "new")
