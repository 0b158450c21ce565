"""Journals, staged batches, snapshots, histories and the production step over the given tables."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime, timedelta

from pyspark.sql import functions as F

from lanewise.operators import snapshots
from lanewise.plans import production
from lanewise.plans.policy import DEFAULT
from lanewise.plans.registry import query, table
from lanewise.session import shared_folder
from lanewise.sources import journal, sinks
from lanewise.sources.receipts import Receipts


def _fresh(spark, name):
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("journal_lines", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(spark, d):
    path = _fresh(spark, "journal")
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    sinks.append_journal(rows.repartitionByRange(3, "event_id").sortWithinPartitions("event_id"), path)  # file names follow the ranges
    records = journal.replayable(spark, path, "event_id long, user_id long, event_type string, value double")
    return journal.replayed(records, "user_id").select("user_id", "event_id", "event_type", "value")


@query("staged_batches", "SELECT event_id % 3 AS batch, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def _(spark, d):
    receipts = Receipts(spark, _fresh(spark, "batches"))
    events = table(spark, d, "events").select((F.col("event_id") % 3).alias("batch"), "event_type", "value")
    for batch in (0, 1, 1, 2, 0):  # replays change nothing
        receipts.publish(batch, {"events": events.where(F.col("batch") == batch)})
    events.limit(0).write.parquet(f"{receipts.root}/staged/9-unfinished/events")  # no receipt: nobody sees it
    return receipts.read("events").groupBy("batch", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("snapshot_choice", """
WITH i AS (SELECT DISTINCT l_suppkey, year(l_shipdate) AS stamp, l_returnflag || l_linestatus AS snapshot, l_partkey % 5 AS item FROM lineitem WHERE l_quantity > 45),
t AS (SELECT * FROM i WHERE stamp = (SELECT max(stamp) FROM i j WHERE j.l_suppkey = i.l_suppkey)),
s AS (SELECT DISTINCT l_suppkey, stamp, snapshot FROM t),
f AS (SELECT l_suppkey, stamp, snapshot, NOT EXISTS (SELECT 1 FROM t o WHERE o.l_suppkey = s.l_suppkey AND NOT EXISTS (SELECT 1 FROM t m WHERE m.l_suppkey = s.l_suppkey AND m.snapshot = s.snapshot AND m.item = o.item)) AS full_one FROM s)
SELECT l_suppkey, CAST(stamp AS INTEGER) AS stamp, CASE WHEN count(*) FILTER (full_one) = 1 THEN min(snapshot) FILTER (full_one) END AS snapshot,
 (SELECT count(DISTINCT item) FROM t WHERE t.l_suppkey = f.l_suppkey) AS n_items, count(*) AS ties,
 CASE count(*) FILTER (full_one) WHEN 0 THEN 'tied' WHEN 1 THEN NULL ELSE 'twin' END AS problem FROM f GROUP BY l_suppkey, stamp""")
def _(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity > 45")
    items = lines.select("l_suppkey", F.year("l_shipdate").alias("stamp"), F.concat("l_returnflag", "l_linestatus").alias("snapshot"), (F.col("l_partkey") % 5).alias("item"))
    return snapshots.choice(items, "l_suppkey", "stamp", "snapshot", F.col("item"))


@query("receive_history", f"""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n <= {DEFAULT.reports_kept}""")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id", F.md5(F.col("event_id").cast("string")).alias("digest"))
    odd, late = events.where("event_id % 2 = 1"), events.where("event_id % 2 = 0 OR event_id % 3 = 0")  # some come twice, all out of order
    held = snapshots.received(events.limit(0), odd, "user_id", "ts", "digest")
    return snapshots.received(held, late, "user_id", "ts", "digest").select("user_id", "event_id")


@query("production_day")
def _(spark, d):
    """Four steps of a morning: lease, results for half of the batch, results for the rest, next lease."""
    receipts = Receipts(spark, _fresh(spark, "production"))
    formal = table(spark, d, "supplier").select(F.col("s_name").alias("key"), F.concat(F.lit("http://host"), F.col("s_nationkey"), F.lit("/"), F.col("s_suppkey")).alias("url"))
    manifest = table(spark, d, "customer").select(F.col("c_name").alias("candidate"), F.concat(F.lit("http://host"), F.col("c_nationkey"), F.lit("/c"), F.col("c_custkey")).alias("url"), F.col("c_custkey").alias("priority"))
    none = spark.createDataFrame([], "batch string, task string, url string, verdict string, at timestamp")
    production.begin(receipts, spark)
    now = datetime(2024, 1, 1, 20, 0, tzinfo=UTC)
    for version in range(4):
        told = none
        if version:
            leases = receipts.read("leases", version)
            told = leases.where(F.xxhash64("task") % 2 == version % 2).select("batch", "task", "url", F.lit("GOOD").alias("verdict"), F.lit(now - timedelta(minutes=5)).alias("at"))
        state = production.advance(receipts, version, production.Inputs(now, formal, manifest, told, batch_tasks=60))
        now += timedelta(minutes=20)
    return state["results"].groupBy("batch", "verdict").agg(F.count("*").alias("n")).unionByName(production.history(receipts).select(F.col("said").alias("batch"), F.col("outstanding").alias("verdict"), F.col("version").alias("n")))
