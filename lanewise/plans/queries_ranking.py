"""Selection queries: top-k, diversity, quotas, caps, streaks, retention, greedy folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import urls
from lanewise.operators import greedy, ranking
from lanewise.plans.registry import query, table
from lanewise.plans.queries_joins import HOST_SQL


def pages_by_host(spark, d):
    return table(spark, d, "pages").select("page_id", "url", urls.host(F.col("url")).alias("host"), F.length("html").alias("size"))


PAGES = f"(SELECT page_id, url, {HOST_SQL} AS host, length(html) AS size FROM pages)"


@query("best_per_key", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def _(spark, d):
    top = ranking.top_k(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 1)
    return top.select("o_custkey", "o_orderkey", "o_totalprice")


@query("topk_variants", """
SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER w AS rank FROM lineitem
WINDOW w AS (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_suppkey) QUALIFY row_number() OVER w <= CASE l_returnflag WHEN 'A' THEN 24 WHEN 'R' THEN 16 ELSE 8 END""")
def _(spark, d):
    k = F.when(F.col("l_returnflag") == "A", 24).when(F.col("l_returnflag") == "R", 16).otherwise(8)
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_suppkey")]
    return ranking.top_k(table(spark, d, "lineitem"), ["l_partkey"], order, k).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("diverse_round_robin", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY size DESC, page_id) AS turn, count(*) OVER (PARTITION BY host) AS n FROM {PAGES})
SELECT page_id, host, row_number() OVER (ORDER BY turn, n DESC, host) AS pos FROM p ORDER BY turn, n DESC, host LIMIT 100""")
def _(spark, d):
    return ranking.round_robin(pages_by_host(spark, d), "host", [F.desc("size"), F.col("page_id")], 100).select("page_id", "host", "pos")


@query("diverse_first_then_rest", f"""
WITH p AS (SELECT *, CASE WHEN host <> '' AND row_number() OVER (PARTITION BY host ORDER BY size DESC, page_id) > 1 THEN 1 ELSE 0 END AS later FROM {PAGES})
SELECT page_id, host, row_number() OVER (ORDER BY later, size DESC, page_id) AS pos FROM p ORDER BY later, size DESC, page_id LIMIT 100""")
def _(spark, d):
    return ranking.each_then_rest(pages_by_host(spark, d), "host", [F.desc("size"), F.col("page_id")], 100).select("page_id", "host", "pos")


@query("quota_selection", """
WITH c AS (SELECT c_custkey, c_mktsegment, c_acctbal, c_acctbal > 9000 AS core FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, core ORDER BY c_acctbal DESC, c_custkey) AS nth, count(*) FILTER (core) OVER (PARTITION BY c_mktsegment) AS cores FROM c),
p AS (SELECT *, CASE WHEN core THEN 0 WHEN nth + cores <= 60 THEN 1 ELSE 2 END AS phase FROM r)
SELECT c_custkey, c_mktsegment, phase, row_number() OVER w AS pos FROM p
WINDOW w AS (ORDER BY phase, CASE WHEN phase = 1 THEN c_mktsegment END NULLS FIRST, c_acctbal DESC, c_custkey) QUALIFY row_number() OVER w <= 400""")
def _(spark, d):
    people = table(spark, d, "customer").withColumn("core", F.col("c_acctbal") > 9000)
    chosen = ranking.quotas(people, "c_mktsegment", "core", F.lit(60), [F.desc("c_acctbal"), F.col("c_custkey")], 400)
    return chosen.select("c_custkey", "c_mktsegment", "phase", "pos")


@query("backup_hosts", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS best,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS of_host FROM lineitem)
SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY best) - 1 AS place FROM r WHERE of_host = 1
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY best) - 1 <= 3""")
def _(spark, d):
    order = [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return ranking.backups(table(spark, d, "lineitem"), "l_partkey", "l_suppkey", order, 3).select("l_partkey", "l_suppkey", "place")


@query("host_capped", """
WITH h AS (SELECT *, l_returnflag = 'N' AS current, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY (l_returnflag = 'N') DESC, l_orderkey, l_linenumber) AS h FROM lineitem)
SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER w AS rank FROM h WHERE current OR h <= 2
WINDOW w AS (PARTITION BY l_partkey ORDER BY current DESC, l_orderkey, l_linenumber) QUALIFY row_number() OVER w <= 10""")
def _(spark, d):
    lines = table(spark, d, "lineitem").withColumn("current", F.col("l_returnflag") == "N")
    kept = ranking.capped(lines, "l_partkey", "l_suppkey", "current", [F.col("l_orderkey"), F.col("l_linenumber")], 2, 10)
    return kept.select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("queue_interleave", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS round FROM orders")
def _(spark, d):
    queue = ranking.interleaved(table(spark, d, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], [F.col("o_custkey")])
    return queue.select("o_custkey", "o_orderkey", "round")


@query("build_streak", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS g FROM orders)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus, g ORDER BY o_orderdate, o_orderkey) AS streak FROM l""")
def _(spark, d):
    return ranking.streaks(table(spark, d, "orders"), "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], "o_orderstatus").select("o_custkey", "o_orderkey", "streak")


@query("retention", """
SELECT event_id FROM events QUALIFY ts >= TIMESTAMP '2024-01-16' OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1
  OR row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def _(spark, d):
    return ranking.retained(table(spark, d, "events"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")], F.expr("ts >= TIMESTAMP_NTZ '2024-01-16'")).select("event_id")


@query("stable_move", """
WITH n AS (SELECT *, max(CASE WHEN n_regionkey = 1 THEN n_nationkey END) OVER () AS last FROM nation)
SELECT n_name, row_number() OVER (ORDER BY CASE WHEN n_regionkey = 0 THEN last ELSE n_nationkey END, n_regionkey = 0, n_nationkey) AS pos FROM n""")
def _(spark, d):
    return ranking.moved_after(table(spark, d, "nation"), "n_nationkey", F.col("n_regionkey") == 0, F.col("n_regionkey") == 1).select("n_name", "pos")


@query("preferred_name", "SELECT p_brand, arg_min(p_name, (length(p_name), p_name, p_partkey)) AS name FROM part GROUP BY 1")
def _(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_name", F.struct(F.length("p_name"), "p_name", "p_partkey")).alias("name"))


@query("multi_key_rank", """
SELECT l_partkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_tax, l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem""")
def _(spark, d):
    order = [F.desc("l_quantity"), F.col("l_tax"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    return ranking.top_k(table(spark, d, "lineitem"), ["l_partkey"], order, 1 << 30).select("l_partkey", "l_orderkey", "l_linenumber", "rank")


@query("greedy_balanced", """
WITH RECURSIVE r AS (SELECT c_mktsegment, c_nationkey, c_custkey % 7 AS channel, c_acctbal > 8000 AS urgent, c_custkey FROM customer),
w AS (SELECT DISTINCT c_mktsegment, 0 AS pos, NULL::INTEGER AS c_nationkey, NULL::BIGINT AS channel, NULL::BOOLEAN AS urgent, NULL::BIGINT AS c_custkey,
    []::INTEGER[] AS hosts, []::BIGINT[] AS channels, []::BIGINT[] AS taken FROM r
  UNION ALL
  SELECT c_mktsegment, pos + 1, host, chan, urg, item, list_append(hosts, host), list_append(channels, chan), list_append(taken, item) FROM (
    SELECT w.*, r.c_nationkey AS host, r.channel AS chan, r.urgent AS urg, r.c_custkey AS item, row_number() OVER (PARTITION BY w.c_mktsegment ORDER BY
      len(list_filter(hosts, lambda x: x = r.c_nationkey)), NOT r.urgent, len(list_filter(channels, lambda x: x = r.channel)), r.c_custkey) AS k
    FROM w JOIN r ON r.c_mktsegment = w.c_mktsegment AND NOT list_contains(taken, r.c_custkey) WHERE pos < 80) WHERE k = 1)
SELECT c_mktsegment, c_nationkey, channel, urgent, c_custkey, pos FROM w WHERE pos > 0""")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", (F.col("c_custkey") % 7).alias("channel"), (F.col("c_acctbal") > 8000).alias("urgent"), "c_custkey")
    return greedy.balanced(rows, "c_mktsegment", "c_nationkey", "channel", "urgent", "c_custkey", 80)


@query("greedy_rotating", """
WITH r AS (SELECT c_mktsegment, c_nationkey, CASE WHEN c_acctbal < 0 THEN 3 ELSE 0 END AS rejected, c_custkey FROM customer),
t AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) + least(max(rejected) OVER (PARTITION BY c_mktsegment, c_nationkey) // 2, 2) AS turn FROM r)
SELECT c_mktsegment, c_nationkey, rejected, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY turn, c_custkey) AS pos FROM t QUALIFY pos <= 80""")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", F.when(F.col("c_acctbal") < 0, 3).otherwise(0).alias("rejected"), "c_custkey")
    return greedy.rotating(rows, "c_mktsegment", "c_nationkey", "rejected", "c_custkey", 80)


@query("greedy_penalised", """
WITH RECURSIVE r AS (SELECT c_mktsegment, c_nationkey, c_custkey % 11 AS host, c_acctbal, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS n FROM customer),
w AS (SELECT DISTINCT c_mktsegment, NULL::INTEGER AS c_nationkey, NULL::BIGINT AS host, NULL::DOUBLE AS c_acctbal, 0::BIGINT AS pos, []::BIGINT[] AS used FROM r
  UNION ALL
  SELECT c_mktsegment, nation, h, score, pos + 1, list_append(used, h) FROM (
    SELECT w.c_mktsegment, w.pos, used, r.c_nationkey AS nation, r.host AS h, r.c_acctbal AS score, row_number() OVER (PARTITION BY w.c_mktsegment ORDER BY
      r.c_acctbal - 280.0 * len(list_filter(used, lambda x: x = r.host)) DESC, r.c_acctbal DESC, r.host) AS k
    FROM w JOIN r ON r.c_mktsegment = w.c_mktsegment AND r.n = w.pos + 1) WHERE k = 1)
SELECT c_mktsegment, c_nationkey, host, c_acctbal, pos FROM w WHERE pos > 0""")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_mktsegment", "c_nationkey", (F.col("c_custkey") % 11).alias("host"), "c_acctbal")
    return greedy.penalised(rows, "c_mktsegment", "c_nationkey", "host", "c_acctbal", 280.0)


@query("greedy_capped_category", """
WITH c AS (SELECT p_brand, p_type, p_partkey FROM part QUALIFY p_type <> 'ECONOMY' OR row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) <= 5)
SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS pos FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 40""")
def _(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_type", "p_partkey")
    return greedy.capped_category(rows, "p_brand", "p_type", "ECONOMY", 5, "p_partkey", 40)


@query("greedy_admission", """
WITH RECURSIVE r AS (SELECT c_nationkey, c_custkey, abs(c_acctbal) AS cost, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
w AS (SELECT DISTINCT c_nationkey, NULL::BIGINT AS c_custkey, NULL::DOUBLE AS cost, 0::BIGINT AS n, 0::BIGINT AS pos, 50000.0::DOUBLE AS free, false AS fits FROM r
  UNION ALL
  SELECT r.c_nationkey, r.c_custkey, r.cost, r.n, w.pos + CASE WHEN r.cost <= w.free THEN 1 ELSE 0 END, w.free - CASE WHEN r.cost <= w.free THEN r.cost ELSE 0 END, r.cost <= w.free
  FROM w JOIN r ON r.c_nationkey = w.c_nationkey AND r.n = w.n + 1)
SELECT c_nationkey, c_custkey, cost, pos FROM w WHERE fits""")
def _(spark, d):
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.abs("c_acctbal").alias("cost"))
    return greedy.admitted(rows, "c_nationkey", "cost", "c_custkey", 50000.0)


# checked routes of channels under a few hosts, some of them one stream's variants; the newest are today's
POOL = """SELECT event_id AS item, concat('c', user_id % 30) AS channel, user_id % 3 > 0 AS listed, ts AS last,
 concat('http://h', user_id % 9, '.test/', CASE WHEN event_id % 17 = 0 THEN 0 ELSE user_id END, '-', event_id % 21, CASE event_id % 4 WHEN 0 THEN '/index.m3u8' WHEN 1 THEN '/playlist.m3u8' WHEN 2 THEN '/live.m3u8?playlive=1' ELSE '/live.m3u8' END) AS url"""
TODAY = "TIMESTAMP_NTZ '2024-01-30 00:00:00'"


@query("historical_topup", f"""
WITH a AS ({POOL} FROM events), k AS (SELECT *, replace(replace(replace(url, '/index.m3u8', '/<hls>'), '/playlist.m3u8', '/<hls>'), '?playlive=1', '') AS route FROM a),
t AS (SELECT * FROM k WHERE last >= TIMESTAMP '2024-01-30'), p AS (SELECT * FROM k WHERE last < TIMESTAMP '2024-01-30'),
o AS (SELECT * FROM p WHERE url NOT IN (SELECT url FROM p GROUP BY url HAVING count(DISTINCT channel) > 1) AND url NOT IN (SELECT url FROM t)
  AND NOT (listed AND route IN (SELECT route FROM t WHERE listed))),
s AS (SELECT *, row_number() OVER (PARTITION BY channel, CASE WHEN listed THEN route ELSE CAST(item AS VARCHAR) END ORDER BY last, item) AS n FROM o),
h AS (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '//([^/]*)', 1) ORDER BY last, item) AS turn FROM s WHERE n = 1)
SELECT item, channel, url, row_number() OVER (ORDER BY turn, last, item) AS pos FROM h QUALIFY pos <= 60""")
def _(spark, d):
    pool = spark.sql(f"{POOL} FROM {{events}}", events=table(spark, d, "events"))
    found = greedy.topped_up(pool.where(f"last < {TODAY}"), pool.where(f"last >= {TODAY}"), "channel", "url", "last", "item", "listed", 60)
    return found.select("item", "channel", "url", "pos")


@query("lineup_range", """
WITH p AS (SELECT p_partkey, p_brand, p_size >= 30 AS tall, p_retailprice AS worth FROM part),
k AS (SELECT p_partkey, 1 AS turn FROM p WHERE p_brand = 'Brand#7' ORDER BY NOT tall, worth DESC, p_partkey LIMIT 20),
b AS (SELECT p_partkey, 2 AS turn FROM p WHERE p_brand = 'Brand#9' ORDER BY worth DESC, p_partkey LIMIT 1),
r AS (SELECT p.*, CASE WHEN tall THEN 3 ELSE 4 END AS turn FROM p WHERE p_partkey NOT IN (SELECT p_partkey FROM k) AND p_partkey NOT IN (SELECT p_partkey FROM b)),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY turn, CASE WHEN tall THEN -worth ELSE p_partkey END, p_partkey) AS nth FROM r),
a AS (SELECT p_partkey, p_brand, tall, worth, CASE WHEN p_brand = 'Brand#3' AND nth > 8 THEN turn + 2 ELSE turn END AS turn FROM c
 UNION ALL SELECT p.*, turn FROM p JOIN k USING (p_partkey) UNION ALL SELECT p.*, turn FROM p JOIN b USING (p_partkey)),
o AS (SELECT *, row_number() OVER (ORDER BY turn, CASE WHEN turn = 1 THEN NOT tall END, CASE WHEN turn IN (1, 2, 3, 5) THEN -worth ELSE p_partkey END, p_partkey) AS pos FROM a)
SELECT p_partkey, p_brand, pos FROM o WHERE pos <= CASE WHEN turn <= 3 THEN 500 ELSE 400 END""")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    order = [-F.col("p_retailprice"), F.col("p_partkey")]
    found = ranking.line_up(rows, "p_brand", F.col("p_size") >= 30, order, [F.col("p_partkey")], ("Brand#7", 20), "Brand#9", ("Brand#3", 8), 400, 500)
    return found.select("p_partkey", "p_brand", "pos")
