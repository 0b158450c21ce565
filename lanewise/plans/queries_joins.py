"""Veto, match, delta and interval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import urls
from lanewise.operators import joins, matching
from lanewise.plans.registry import query, table

HOST_SQL = r"regexp_extract(lower(url), '^https?://(?:[^/@?#]*@)?(\[[^\]]+\]|[^/:?#]+)', 1)"


@query("veto_anti_join", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def _(spark, d):
    bad = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.veto(table(spark, d, "orders"), bad, "o_custkey").select("o_orderkey", "o_custkey", "o_totalprice")


@query("hash_tombstone_anti", "SELECT page_id, url FROM pages WHERE sha256(trim(url)) NOT IN (SELECT sha256(trim(url)) FROM pages WHERE contains(url, 'utm_source'))")
def _(spark, d):
    pages = table(spark, d, "pages")
    gone = pages.where(F.col("url").contains("utm_source")).select(F.upper(F.sha2(F.trim("url"), 256)).alias("digest"))
    return joins.veto_hashed(pages, F.col("url"), gone, "digest").select("page_id", "url")


@query("host_threshold_veto", f"""
WITH p AS (SELECT page_id, url, {HOST_SQL} AS host FROM pages),
bad AS (SELECT host FROM p WHERE contains(url, '?') GROUP BY host HAVING count(DISTINCT url) >= 2)
SELECT page_id, url FROM p WHERE host NOT IN (SELECT host FROM bad)""")
def _(spark, d):
    pages = table(spark, d, "pages")
    return joins.veto_hosts(pages, "url", pages.where(F.col("url").contains("?")), "url").select("page_id", "url")


@query("first_veto_reason", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 45) THEN 'oversize'
       WHEN l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) THEN 'indebted' END AS reason
FROM lineitem""")
def _(spark, d):
    big = table(spark, d, "part").where("p_size > 45").select(F.col("p_partkey").alias("l_partkey"))
    owing = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return joins.first_reason(lines, [("oversize", big, ["l_partkey"]), ("indebted", owing, ["l_suppkey"])])


@query("left_attach", """
SELECT o_orderkey, c_name AS customer_name, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def _(spark, d):
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    joined = joins.attach(table(spark, d, "orders"), people, ["o_custkey"], "who")
    return joined.select("o_orderkey", F.col("who.c_name").alias("customer_name"), F.col("who.c_mktsegment").alias("segment"))


@query("longest_contains_match", """
WITH t(target) AS (VALUES ('ring'), ('small ring'), ('widget'), ('red'), ('bolt'))
SELECT p_partkey, p_name, (SELECT arg_min(target, (-length(target), target)) FROM t WHERE contains(p_name, target)) AS matched_target FROM part""")
def _(spark, d):
    targets = spark.createDataFrame([("ring",), ("small ring",), ("widget",), ("red",), ("bolt",)], "target string")
    return matching.longest_contained(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", targets, "target")


@query("ambiguous_identity", "SELECT l_partkey, count(DISTINCT l_suppkey) AS n_identities FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def _(spark, d):
    return joins.ambiguous(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


@query("consensus_match", "SELECT l_orderkey, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linestatus) = 1")
def _(spark, d):
    return joins.consensus(table(spark, d, "lineitem"), "l_orderkey", "l_linestatus")


LENIENT = "CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END"


@query("consensus_lenient", f"SELECT l_orderkey, min({LENIENT}) AS flag FROM lineitem GROUP BY 1 HAVING count(DISTINCT {LENIENT}) = 1")
def _(spark, d):
    flags = table(spark, d, "lineitem").withColumn("flag", F.expr(LENIENT))
    return joins.consensus(flags, "l_orderkey", "flag", lenient=True)


@query("incremental_delta", """
WITH a AS (SELECT o_orderkey, sha256(concat_ws(chr(10), coalesce(o_orderstatus, ''), coalesce(CAST(o_custkey AS VARCHAR), ''))) AS g FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'),
b AS (SELECT o_orderkey, sha256(concat_ws(chr(10), CASE WHEN o_orderpriority = '1-URGENT' THEN 'P' ELSE coalesce(o_orderstatus, '') END, coalesce(CAST(o_custkey AS VARCHAR), ''))) AS g FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01')
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.g IS NULL THEN 'new' WHEN a.g IS NULL THEN 'gone' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.g IS DISTINCT FROM b.g""")
def _(spark, d):
    orders = table(spark, d, "orders")
    now = orders.where("o_orderdate >= TIMESTAMP_NTZ '1995-01-01'")
    before = orders.where("o_orderdate < TIMESTAMP_NTZ '1999-01-01'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "P").otherwise(F.col("o_orderstatus")))
    return joins.delta(now, before, "o_orderkey", ["o_orderstatus", "o_custkey"])


@query("coverage_diff", """
SELECT l.l_orderkey, l.l_partkey, p.p_brand FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey
WHERE NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = l.l_orderkey AND c.l_partkey = l.l_partkey AND c.l_returnflag = 'A')""")
def _(spark, d):
    lines = table(spark, d, "lineitem")
    core = lines.where("l_returnflag = 'A'").select("l_orderkey", "l_partkey")
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return joins.veto(lines, core, ["l_orderkey", "l_partkey"]).join(brands, "l_partkey", "left").select("l_orderkey", "l_partkey", "p_brand")


@query("set_equality", """
WITH a AS (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal >= 0), b AS (SELECT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal < 5000)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_a, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_b,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) = 0 AND (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) = 0 AS equal""")
def _(spark, d):
    people = table(spark, d, "customer")
    return joins.equivalent_sets(people.where("c_acctbal >= 0").select("c_nationkey", "c_mktsegment"), people.where("c_acctbal < 5000").select("c_nationkey", "c_mktsegment"))


@query("key_set_mismatches", """
WITH a AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority <> '5-LOW'), b AS (SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderpriority <> '1-URGENT')
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'missing' WHEN a.o_orderkey IS NULL THEN 'unexpected' ELSE 'differs' END AS problem
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus IS DISTINCT FROM b.s""")
def _(spark, d):
    orders = table(spark, d, "orders")
    found = orders.where("o_orderpriority <> '1-URGENT'").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("o_orderstatus")))
    return joins.mismatches(orders.where("o_orderpriority <> '5-LOW'"), found, "o_orderkey", "o_orderstatus")


@query("asof_backup", """
SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def _(spark, d):
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof(bought, views, "user_id", "ts", "seen", ["view_id"], tie="view_id").select("event_id", "view_id")


@query("interval_reuse", """
WITH v AS (SELECT p.event_id, x.event_id AS view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY x.ts DESC, x.event_id DESC) AS rn
  FROM events p JOIN events x ON x.user_id = p.user_id AND x.event_type = 'view' AND x.ts <= p.ts AND p.ts - x.ts <= INTERVAL 6 HOUR WHERE p.event_type = 'purchase')
SELECT e.event_id, v.view_id FROM events e LEFT JOIN v ON v.event_id = e.event_id AND v.rn = 1 WHERE e.event_type = 'purchase'""")
def _(spark, d):
    events = table(spark, d, "events")
    views = events.where("event_type = 'view'").select("user_id", F.col("ts").alias("seen"), F.col("event_id").alias("view_id"))
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.asof(bought, views, "user_id", "ts", "seen", ["view_id"], within=F.expr("INTERVAL 6 HOURS"), tie="view_id").select("event_id", "view_id")


@query("semi_join_sources", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(spark, d):
    wanted = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(wanted, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("scope_plan_join", """
SELECT n.n_nationkey, n.n_name, coalesce(s.s_name, '') AS supplier FROM nation n LEFT JOIN supplier s ON s.s_nationkey = n.n_nationkey""")
def _(spark, d):
    makers = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_name")
    return table(spark, d, "nation").join(makers, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("s_name", F.lit("")).alias("supplier"))


@query("evidence_embed", """
SELECT l_orderkey, l_linenumber, o_orderstatus AS status, o_totalprice AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def _(spark, d):
    good = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    joined = joins.attach(table(spark, d, "lineitem"), good, ["l_orderkey"], "evidence").where("evidence IS NOT NULL")
    return joined.select("l_orderkey", "l_linenumber", F.col("evidence.o_orderstatus").alias("status"), F.col("evidence.o_totalprice").alias("total"))


@query("composite_lookup", """
SELECT l_orderkey, l_linenumber, coalesce(a.to_status, l_linestatus) AS new_status FROM lineitem
LEFT JOIN (VALUES ('A', 'F', 'C'), ('R', 'O', 'H')) AS a(flag, status, to_status) ON l_returnflag = a.flag AND l_linestatus = a.status""")
def _(spark, d):
    approved = spark.createDataFrame([("A", "F", "C"), ("R", "O", "H")], "l_returnflag string, l_linestatus string, to_status string")
    joined = table(spark, d, "lineitem").join(F.broadcast(approved), ["l_returnflag", "l_linestatus"], "left")
    return joined.select("l_orderkey", "l_linenumber", F.coalesce("to_status", "l_linestatus").alias("new_status"))


# the same stream under several addresses; VARIANT_SQL makes them, ROUTE_SQL tells them
VARIANT_SQL = """lower(regexp_extract(url, '^(https?://)', 1)) || right(regexp_extract(url, '^https?://([^/?#:]*)', 1), 4) || CASE page_id % 3 WHEN 0 THEN CASE WHEN url LIKE 'https%' THEN ':443' ELSE ':80' END WHEN 1 THEN ':8080' ELSE '' END
 || '/s' || (page_id % 3) || CASE page_id % 4 WHEN 0 THEN '/playlist.m3u8' WHEN 1 THEN '/chunklist_b1.m3u8' WHEN 2 THEN '/index.m3u8' ELSE '/live.m3u8' END
 || CASE page_id % 5 WHEN 0 THEN '?playlive=1&id=7' WHEN 1 THEN '?id=7&authid=2' WHEN 2 THEN '?id=8&checkedby:iptvcat.org' WHEN 3 THEN '' ELSE '?playlive=0' END"""
ROUTE_SQL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(u, '^(http://[^/]*):80/', '\1/'), '^(https://[^/]*):443/', '\1/'), '/(playlist|chunklist_b1|index)\.m3u8', '/<hls>'),
 '\?playlive=.&id=7$|\?id=7&authid=2$', '?id=7')"""
ROUTE_SQL = rf"regexp_replace(regexp_replace({ROUTE_SQL}, '\?id=8&checkedby:iptvcat.org$', '?id=8'), '\?playlive=0$', '')"


@query("route_equivalence", f"SELECT page_id, CASE WHEN page_id % 7 = 0 THEN u ELSE {ROUTE_SQL} END AS route FROM (SELECT page_id, {VARIANT_SQL} AS u FROM pages)")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.expr(VARIANT_SQL).alias("u"))
    return pages.select("page_id", urls.equivalent(F.col("u"), F.col("page_id") % 7 != 0).alias("route"))


@query("safe_urls")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.safe("url").alias("safe"))


@query("equivalent_anti_join", f"""
WITH r AS (SELECT page_id, page_id % 7 <> 0 AS listed, {ROUTE_SQL} AS route FROM (SELECT page_id, {VARIANT_SQL} AS u FROM pages)),
h AS (SELECT route FROM r WHERE listed AND page_id % 9 = 4),
n AS (SELECT *, row_number() OVER (PARTITION BY listed, route ORDER BY page_id) AS k FROM r WHERE page_id % 9 <> 4)
SELECT page_id, CASE WHEN NOT listed THEN NULL WHEN route IN (SELECT route FROM h) THEN 'history' WHEN k > 1 THEN 'batch' END AS reason FROM n""")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.expr(VARIANT_SQL).alias("u"))
    listed = F.col("page_id") % 7 != 0
    return joins.equivalent_reasons(pages.where("page_id % 9 <> 4"), "u", listed, ["page_id"], pages.where("page_id % 9 = 4"), "u", listed).select("page_id", "reason")
