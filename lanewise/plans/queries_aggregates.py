"""Deduplication, evidence and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.operators import aggregates as agg
from lanewise.operators import joins
from lanewise.plans.policy import Policy
from lanewise.plans.registry import query, table

STATUS_SQL = "CASE event_type WHEN 'error' THEN 'UNKNOWN' WHEN 'view' THEN 'DEGRADED' ELSE 'GOOD' END"


def status():
    return F.expr(STATUS_SQL)


@query("dedupe_provenance", "SELECT lang, sha256(text) AS text_key, min(doc_id) AS doc_id, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM documents GROUP BY lang, sha256(text)")
def _(spark, d):
    docs = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("text_key"), "doc_id", "source")
    return agg.merge_sources(docs.withColumn("at", F.col("doc_id")), ["lang", "text_key"], "at", "source").select("lang", "text_key", "doc_id", F.array_join("sources", ",").alias("sources"))


@query("best_by_score", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def _(spark, d):
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return agg.best_of(orders, ["o_custkey"], F.col("o_totalprice"), "o_orderkey")


@query("first_labels", """
WITH o AS (SELECT l_partkey, l_suppkey, min(l_orderkey * 8 + l_linenumber) AS seen FROM lineitem GROUP BY 1, 2)
SELECT l_partkey, array_to_string(list_slice(list(l_suppkey ORDER BY seen, l_suppkey), 1, 20), ',') AS labels, count(*) AS n_labels FROM o GROUP BY 1""")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    found = agg.first_labels(lines, "l_partkey", "l_suppkey", "at")
    return found.select("l_partkey", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"), "n_labels")


@query("shared_content", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_identities FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 4")
def _(spark, d):
    return agg.shared_content(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("source_references", "SELECT text_key, n_sources FROM (SELECT sha256(text) AS text_key, count(DISTINCT source) AS n_sources FROM documents GROUP BY 1)")
def _(spark, d):
    return table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("text_key")).agg(F.count_distinct("source").alias("n_sources"))


@query("latest_evidence", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def _(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("worst_of_merge", """
SELECT l_orderkey, count(*) AS checks, min(l_quantity) AS l_quantity, max(l_tax) AS l_tax, min(l_discount) FILTER (l_discount > 0) AS l_discount, bool_or(l_returnflag = 'R') AS returned
FROM lineitem GROUP BY 1""")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumn("returned", F.col("l_returnflag") == "R")
    return agg.worst_of(lines, ["l_orderkey"], low=["l_quantity"], high=["l_tax"], low_positive=["l_discount"], any_true=["returned"])


@query("sample_stats", """
SELECT user_id, count(*) AS n, round(min(value), 4) AS lowest, round(avg(value), 4) AS mean, round(avg(value) FILTER (value > 0), 4) AS mean_positive, round(min(value) / nullif(avg(value), 0), 4) AS steadiness
FROM events GROUP BY 1""")
def _(spark, d):
    found = agg.sample_stats(table(spark, d, "events"), ["user_id"], "value")
    return found.select("user_id", "n", *[F.round(c, 4).alias(c) for c in ("lowest", "mean", "mean_positive", "steadiness")])


@query("height_histogram", "SELECT CASE WHEN p_size >= 40 THEN '40' WHEN p_size >= 20 THEN '20' WHEN p_size >= 10 THEN '10' ELSE 'other' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    return agg.histogram(table(spark, d, "part"), "p_size", [10, 20, 40])


@query("status_counts", f"SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER ({STATUS_SQL} = 'GOOD') AS good, count(*) FILTER ({STATUS_SQL} = 'DEGRADED') AS degraded, count(*) FILTER ({STATUS_SQL} = 'UNKNOWN') AS unknown FROM events GROUP BY 1")
def _(spark, d):
    s = status()
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), *[F.count_if(s == x).alias(x.lower()) for x in ("GOOD", "DEGRADED", "UNKNOWN")])


@query("most_common", "SELECT l_suppkey, count(*) AS n, min(l_orderkey) AS first_seen FROM lineitem GROUP BY 1 ORDER BY n DESC, first_seen LIMIT 12")
def _(spark, d):
    return agg.most_common(table(spark, d, "lineitem"), "l_suppkey", 12, "l_orderkey")


@query("run_circuit", f"""
SELECT CAST(ts AS DATE) AS run, count(*) AS n_rows, count(*) FILTER ({STATUS_SQL} = 'UNKNOWN') AS n_unknown,
  count(*) FILTER ({STATUS_SQL} = 'UNKNOWN') >= 20 AND count(*) FILTER ({STATUS_SQL} = 'UNKNOWN') / count(*) >= 0.18 AS open FROM events GROUP BY 1""")
def _(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("run"), status().alias("status"))
    return agg.run_circuit(events, "run", "status", Policy(circuit_unknown_ratio=0.18))


@query("mass_failure_circuit", f"""
WITH k AS (SELECT CAST(ts AS DATE) AS run, user_id, bool_or({STATUS_SQL} <> 'UNKNOWN') AS reached FROM events GROUP BY 1, 2)
SELECT run, count(*) AS n_keys, count(*) FILTER (NOT reached) AS n_failed, count(*) FILTER (NOT reached) >= 5 AND count(*) FILTER (NOT reached) / count(*) >= 0.05 AS open FROM k GROUP BY 1""")
def _(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("run"), "user_id", status().alias("s"))
    return agg.mass_failure(events, "run", "user_id", F.col("s") != "UNKNOWN", Policy(mass_failure_ratio=0.05))


@query("mass_failure_runs", f"""
WITH k AS (SELECT CAST(ts AS DATE) AS run, user_id, bool_or({STATUS_SQL} <> 'UNKNOWN') AS reached FROM events WHERE day(ts) % 4 > 0 GROUP BY 1, 2),
c AS (SELECT run, count(*) AS n_keys, count(*) FILTER (NOT reached) AS n_failed FROM k GROUP BY 1)
SELECT r.run, coalesce(n_keys, 0) AS n_keys, coalesce(n_failed, 0) AS n_failed, n_keys IS NULL OR n_failed >= 5 AND n_failed / n_keys >= 0.05 AS open FROM (SELECT DISTINCT CAST(ts AS DATE) AS run FROM events) r LEFT JOIN c USING (run)""")
def _(spark, d):
    events = table(spark, d, "events").select(F.to_date("ts").alias("run"), "user_id", "ts", status().alias("s"))
    return agg.mass_failure(events.where(F.day("ts") % 4 > 0), "run", "user_id", F.col("s") != "UNKNOWN", Policy(mass_failure_ratio=0.05), events)


@query("dimension_status", "SELECT n_nationkey, count(c_custkey) AS n, round(max(c_acctbal), 2) AS best FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def _(spark, d):
    people = table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return agg.with_every(table(spark, d, "nation"), people, "n_nationkey", [F.round(F.max("c_acctbal"), 2).alias("best")])


@query("duplicate_report", "SELECT text_key, count(*) AS n, min(doc_id) AS first_member FROM (SELECT sha256(text) AS text_key, doc_id FROM documents) GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    return agg.duplicates(table(spark, d, "documents").select(F.sha2("text", 256).alias("text_key"), "doc_id"), "text_key", "doc_id")


@query("spacing_capacity", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, round((max(epoch(ts)) - min(epoch(ts))) / nullif(count(*) - 1, 0), 3) AS spacing_s FROM (SELECT date_trunc('second', ts) AS ts FROM events) GROUP BY 1")
def _(spark, d):
    found = agg.spacing(table(spark, d, "events").withColumn("day", F.to_date("ts")), ["day"], F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")))
    return found.withColumn("spacing_s", F.round("spacing_s", 3))


@query("contract_violations", """
SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest([CASE WHEN NOT o_totalprice < 400000 THEN 'price' END, CASE WHEN NOT o_orderstatus IN ('F', 'O') THEN 'status' END]) AS rule FROM orders) WHERE rule IS NOT NULL""")
def _(spark, d):
    return agg.violations(table(spark, d, "orders"), ["o_orderkey"], [("price", F.col("o_totalprice") < 400000), ("status", F.col("o_orderstatus").isin("F", "O"))])


@query("set_operations", """
SELECT 'except' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'union_all', count(*) FROM (SELECT c_nationkey FROM customer UNION ALL SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'missing', count(*) FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)""")
def _(spark, d):
    a, b = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    made = {"except": a.subtract(b), "intersect": a.intersect(b), "union": a.union(b).distinct(), "union_all": a.unionByName(b), "missing": joins.veto(table(spark, d, "nation").select(F.col("n_nationkey").alias("k")), b, "k")}
    parts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n") for name, rows in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("rejected_complement", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, d):
    good = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.veto(table(spark, d, "orders").select("o_orderkey"), good, "o_orderkey")


@query("set_digest")
def _(spark, d):
    from lanewise.functions.history import canonical_digest

    rows = table(spark, d, "customer").select("c_nationkey", F.to_json(F.struct("c_custkey", "c_name", "c_mktsegment")).alias("doc"))
    return rows.select("c_nationkey", canonical_digest("doc").alias("digest"))
