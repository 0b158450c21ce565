"""Queue, pool and delivery queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.operators import queues
from lanewise.plans.pipelines import applied, report
from lanewise.plans.registry import query, table


@query("task_schedule", """
WITH q AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END AS priority FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY priority, event_id) AS n FROM q)
SELECT event_id, user_id, priority FROM f WHERE n = 1 ORDER BY priority, event_id LIMIT 10000""")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    parts = [events.where("event_type = 'error'"), events.where("event_type = 'signup'"), events.where("event_type NOT IN ('error', 'signup')")]
    return queues.scheduled(parts, "user_id", [F.col("event_id")], 10_000).select("event_id", "user_id", "priority")


@query("pending_batches", "SELECT DISTINCT o_custkey AS batch FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    orders = table(spark, d, "orders").withColumnRenamed("o_custkey", "batch")
    return queues.pending(orders.select("batch").distinct(), orders.where("o_orderstatus = 'P'"), "batch")


@query("queue_merge", """
SELECT c_custkey, 'new' AS origin FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_mktsegment = 'MACHINERY' AND NOT c_acctbal > 5000""")
def _(spark, d):
    people = table(spark, d, "customer")
    old = people.where("c_mktsegment = 'MACHINERY'").select("c_custkey", F.lit("old").alias("origin"))
    return queues.merged_queue(old, people.where("c_acctbal > 5000").select("c_custkey", F.lit("new").alias("origin")), "c_custkey")


@query("requeue_once", "SELECT p_partkey FROM part WHERE p_size >= 30 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_type = 'ECONOMY')")
def _(spark, d):
    parts = table(spark, d, "part")
    return queues.requeued(parts, "p_partkey", F.col("p_size") >= 30, parts.where("p_type = 'ECONOMY'")).select("p_partkey")


@query("cycle_changes", """
WITH l AS (SELECT *, lag(o_orderstatus) OVER w AS a, lag(o_orderpriority) OVER w AS b, row_number() OVER w AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT o_orderkey, CAST(sum(CASE WHEN n > 1 AND (a IS DISTINCT FROM o_orderstatus OR b IS DISTINCT FROM o_orderpriority) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS cycle FROM l""")
def _(spark, d):
    return queues.cycles(table(spark, d, "orders"), "o_custkey", [F.col("o_orderkey")], ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "cycle")


@query("job_backoff", """
SELECT l_orderkey, l_linenumber, l_linenumber >= 3 AS stalled FROM lineitem WHERE l_quantity * 100 >= least(3600, 60 * power(2, l_linenumber))""")
def _(spark, d):
    jobs = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.lit(0.0) - F.col("l_quantity") * 100).alias("last"))
    return queues.due(jobs, F.lit(0.0), "last", "l_linenumber").select("l_orderkey", "l_linenumber", "stalled")


@query("probe_pool", """
WITH r AS (SELECT p_partkey, p_type, p_brand, p_retailprice, p_size > 48 AS req, p_size > 45 AS core, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY (p_size = 1) DESC, p_retailprice DESC, p_partkey) AS nth, p_size = 1 AS cur FROM part),
k AS (SELECT *, row_number() OVER (PARTITION BY p_type, nth = 1 ORDER BY p_retailprice DESC, p_partkey) AS kn FROM r),
p AS (SELECT *, CASE WHEN req AND nth <= 24 THEN 0 WHEN core AND nth <= 16 THEN 1 WHEN nth = 1 AND kn <= 45 THEN 2 ELSE 3 END AS phase FROM k)
SELECT p_partkey, phase FROM p QUALIFY phase < 3 OR cur OR row_number() OVER (PARTITION BY p_type ORDER BY phase, nth, p_retailprice DESC, p_partkey) <= 80""")
def _(spark, d):
    parts = table(spark, d, "part").withColumns({"req": F.col("p_size") > 48, "core": F.col("p_size") > 45, "cur": F.col("p_size") == 1})
    return queues.probe_pool(parts, "p_type", "p_brand", "req", "core", "cur", "p_retailprice", "p_partkey", 10).select("p_partkey", "phase")


@query("fallback_fill", """
WITH s AS (SELECT p_partkey, p_brand, p_type, p_retailprice FROM part WHERE p_size > 45), h AS (SELECT p_type, count(*) AS have FROM s GROUP BY 1),
o AS (SELECT * FROM part WHERE p_size <= 45 AND p_brand NOT IN (SELECT p_brand FROM s WHERE p_type = 'ECONOMY') QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_partkey) = 1),
m AS (SELECT p_partkey, p_retailprice, CASE WHEN row_number() OVER (PARTITION BY o.p_type ORDER BY p_retailprice DESC, p_partkey) + coalesce(have, 0) <= 60 THEN 1 ELSE 2 END AS phase FROM o LEFT JOIN h USING (p_type))
SELECT p_partkey, 0 AS phase FROM (SELECT p_partkey FROM s) UNION ALL SELECT p_partkey, phase FROM m""")
def _(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_brand", "p_name", "p_type", "p_retailprice", "p_size")
    stable = parts.where("p_size > 45")
    spare = parts.where("p_size <= 45").join(stable.where("p_type = 'ECONOMY'").select("p_brand").distinct(), "p_brand", "left_anti").select(*parts.columns)
    # names repeat, so keys do; stable keys are kept apart from the reserve's
    keyed = lambda rows, tag: rows.withColumn("station", F.concat(F.lit(tag), "p_name"))
    return queues.filled(keyed(stable, "s:"), keyed(spare, "r:"), "p_type", "station", 60, [F.desc("p_retailprice"), F.col("p_partkey")], 1 << 30).select("p_partkey", "phase")


@query("report_decisions", """
WITH prev AS (SELECT c_custkey AS channel, c_mktsegment AS url FROM customer), m AS (SELECT c_custkey AS channel, CASE WHEN c_acctbal < 0 THEN 'BAD' ELSE 'GOOD' END AS verdict FROM customer),
b AS (SELECT o_custkey AS channel, arg_max(CAST(o_orderkey AS VARCHAR), (o_totalprice, CAST(o_orderkey AS VARCHAR))) AS backup FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT prev.channel, CASE WHEN verdict = 'BAD' AND backup IS NOT NULL THEN 'REPLACE' WHEN verdict = 'BAD' THEN 'UNRESOLVED' ELSE 'KEEP' END AS action,
  CASE WHEN verdict = 'BAD' AND backup IS NOT NULL THEN backup ELSE url END AS url, verdict = 'BAD' AND backup IS NOT NULL AS updated FROM prev JOIN m USING (channel) LEFT JOIN b USING (channel)""")
def _(spark, d):
    people = table(spark, d, "customer")
    previous = people.select(F.col("c_custkey").alias("channel"), F.col("c_mktsegment").alias("url"))
    measured = people.select(F.col("c_custkey").alias("channel"), F.col("c_mktsegment").alias("url"), F.when(F.col("c_acctbal") < 0, "BAD").otherwise("GOOD").alias("verdict"))
    backups = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("channel"), F.col("o_orderkey").cast("string").alias("backup_url"), F.col("o_totalprice").alias("headroom"))
    decided = report(previous, measured, backups, circuit=False)
    return applied(previous, decided).join(decided.select("channel", "action"), "channel").select("channel", "action", "url", "updated")
