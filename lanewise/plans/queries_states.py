"""Update, merge, replay and health-state queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import history, times
from lanewise.operators import states, updates
from lanewise.plans.queries_aggregates import STATUS_SQL, status
from lanewise.plans.registry import query, table


@query("exact_update", """
SELECT c_custkey, coalesce(p.new_segment, c_mktsegment) AS c_mktsegment, p.new_segment IS NOT NULL AS updated
FROM customer LEFT JOIN (SELECT c_custkey AS k, 'AUTOMOBILE' AS old_segment, 'RETIRED' AS new_segment FROM customer WHERE c_acctbal < 0) p ON c_custkey = p.k AND c_mktsegment = p.old_segment""")
def _(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    plan = table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", F.lit("AUTOMOBILE").alias("old"), F.lit("RETIRED").alias("new"))
    return updates.exact_update(people, plan, "c_custkey", "c_mktsegment", "old", "new").select("c_custkey", "c_mktsegment", "updated")


@query("update_by_key", "SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(spark, d):
    nations = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return updates.update_by_key(nations, nations.where("n_regionkey = 2").select("n_nationkey", F.lit(9).alias("new")), "n_nationkey", "n_regionkey", "new")


@query("update_or_delete", """
SELECT s_suppkey, CASE WHEN s_acctbal < 1000 THEN upper(s_name) ELSE s_name END AS s_name FROM supplier WHERE NOT (s_acctbal < 1000 AND s_nationkey < 5)""")
def _(spark, d):
    makers = table(spark, d, "supplier").select("s_suppkey", "s_name")
    dead = table(spark, d, "supplier").where("s_acctbal < 1000")
    other = dead.where("s_nationkey >= 5").select("s_suppkey", F.upper("s_name").alias("new"))
    return updates.update_or_delete(makers, dead, other, "s_suppkey", "s_name", "new")


@query("merge_preserve_order", """
WITH r AS (SELECT c_nationkey AS k, c_custkey AS pos, c_name AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer WHERE c_nationkey < 20),
c AS (SELECT n_nationkey AS k, n_nationkey AS pos, n_name AS v FROM nation WHERE n_nationkey >= 10)
SELECT coalesce(r.k, c.k) AS c_nationkey, CASE WHEN c.k IS NOT NULL THEN c.v ELSE r.v END AS v, r.pos IS NULL AS appended, CAST(coalesce(r.pos, c.pos) AS BIGINT) AS at
FROM r FULL JOIN c ON r.k = c.k WHERE c.k IS NULL OR r.nth IS NULL OR r.nth = 1""")
def _(spark, d):
    rows = table(spark, d, "customer").where("c_nationkey < 20").select("c_nationkey", F.col("c_custkey").alias("pos"), F.col("c_name").alias("v"))
    listed = table(spark, d, "nation").where("n_nationkey >= 10").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_nationkey").cast("long").alias("pos"), F.col("n_name").alias("v"))
    merged = updates.merge_in_order(rows, listed, "c_nationkey", "pos", "v")
    return merged.select("c_nationkey", "v", F.col("pos.appended").alias("appended"), F.col("pos.at").alias("at"))


@query("replace_key_set", """
SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('MACHINERY') UNION ALL SELECT c_custkey, 'MACHINERY' FROM customer WHERE c_acctbal > 9500""")
def _(spark, d):
    people = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    fresh = table(spark, d, "customer").where("c_acctbal > 9500").select("c_custkey", F.lit("MACHINERY").alias("c_mktsegment"))
    return updates.replace_keys(people, spark.createDataFrame([("MACHINERY",)], "c_mktsegment string"), fresh, "c_mktsegment").select("c_custkey", "c_mktsegment")


@query("upsert_ttl", """
WITH a AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate AS first_seen, o_orderdate + INTERVAL 700 DAY AS expires FROM orders WHERE o_orderdate + INTERVAL 700 DAY > TIMESTAMP '1998-01-01'),
b AS (SELECT o_orderkey, o_custkey, o_totalprice * 2 AS o_totalprice, TIMESTAMP '1998-01-01' AS first_seen, TIMESTAMP '1999-01-01' AS expires FROM orders WHERE o_orderpriority = '1-URGENT'),
m AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, least(a.first_seen, b.first_seen) AS first_seen, coalesce(b.o_custkey, a.o_custkey) AS o_custkey,
  coalesce(b.o_totalprice, a.o_totalprice) AS o_totalprice, coalesce(b.expires, a.expires) AS expires FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)
SELECT o_orderkey, o_custkey, first_seen, round(o_totalprice, 2) AS o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank
FROM m QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 8""")
def _(spark, d):
    orders = table(spark, d, "orders")
    kept = orders.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").alias("first_seen"), F.expr("o_orderdate + INTERVAL 700 DAYS").alias("expires"))
    fresh = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey", (F.col("o_totalprice") * 2).alias("o_totalprice"), F.expr("TIMESTAMP_NTZ '1998-01-01'").alias("first_seen"), F.expr("TIMESTAMP_NTZ '1999-01-01'").alias("expires"))
    merged = updates.upsert_ttl(kept, fresh, "o_custkey", "o_orderkey", "first_seen", "expires", F.expr("TIMESTAMP_NTZ '1998-01-01'"), [F.desc("o_totalprice"), F.col("o_orderkey")], 8)
    return merged.select("o_orderkey", "o_custkey", "first_seen", F.round("o_totalprice", 2).alias("o_totalprice"), "rank")


@query("delete_by_id", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'error')")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return updates.without_items(events, events.where("event_type = 'error'").select("event_id"), "event_id").select("event_id")


@query("journal_replay", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def _(spark, d):
    journal = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return updates.replayed(journal, "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_type", "value")


@query("first_wins_late", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return updates.first_wins(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", [F.col("ts"), F.col("event_id")]).select("user_id", "event_id")


@query("history_precedence", """
SELECT user_id, arg_max(event_id, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END, ts, event_id)) AS event_id FROM events WHERE event_type IN ('purchase', 'click', 'view') GROUP BY 1""")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    parts = [(level, events.where(F.col("event_type") == kind)) for level, kind in ((3, "purchase"), (2, "click"), (1, "view"))]
    return updates.by_precedence(parts, "user_id", F.struct("ts", "event_id")).select("user_id", "event_id")


@query("publication_replay", """
WITH l AS (SELECT event_type AS run_kind, max(ts) AS t FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1), r AS (SELECT event_id, event_type AS run_kind, ts AS generated FROM events)
SELECT event_id, CASE WHEN l.t IS NULL OR generated > l.t THEN 'publish' WHEN generated < l.t THEN 'skip_older' WHEN event_id % 2 = 0 THEN 'skip_same' ELSE 'conflict' END AS action FROM r LEFT JOIN l USING (run_kind)""")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", F.col("event_type").alias("run_kind"), F.col("ts").alias("generated"), (F.col("event_id") % 2).alias("digest"))
    latest = events.where("generated < TIMESTAMP_NTZ '2024-01-20'").groupBy("run_kind").agg(F.max("generated").alias("generated")).withColumn("digest", F.lit(0))
    return updates.publication(latest, events).select("event_id", "action")


@query("state_compaction", """
SELECT event_id FROM events e WHERE NOT (event_type IN ('purchase', 'signup') AND ts < TIMESTAMP '2024-01-28') OR event_id IN (SELECT min(event_id) FROM events GROUP BY user_id)""")
def _(spark, d):
    events = table(spark, d, "events")
    used = events.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return updates.compacted(events, used, "event_id", F.col("event_type").isin("purchase", "signup"), F.expr("ts < TIMESTAMP_NTZ '2024-01-28'")).select("event_id")


@query("dead_state", f"""
WITH e AS (SELECT event_id, user_id, epoch(date_trunc('second', ts)) AS sec, {STATUS_SQL} AS s, CAST(floor(value / 40) AS INT) AS url FROM events),
b AS (SELECT *, CASE WHEN s <> 'UNKNOWN' OR url IS DISTINCT FROM lag(url) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS br FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
i AS (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY event_id) AS isl FROM b),
c AS (SELECT *, sum(CASE WHEN s = 'UNKNOWN' THEN 1 ELSE 0 END) OVER w AS st, min(CASE WHEN s = 'UNKNOWN' THEN sec END) OVER w AS began FROM i WINDOW w AS (PARTITION BY user_id, isl ORDER BY event_id)),
x AS (SELECT *, max(CASE WHEN s = 'UNKNOWN' AND st >= 3 AND sec - began >= 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY event_id) AS dead FROM c)
SELECT event_id, CASE WHEN s = 'UNKNOWN' THEN CAST(st AS BIGINT) ELSE 0 END AS streak, CASE WHEN s <> 'UNKNOWN' THEN s WHEN dead = 1 THEN 'DEAD' ELSE 'UNKNOWN' END AS effective FROM x""")
def _(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "ts", status().alias("status"), F.floor(F.col("value") / 40).cast("int").alias("url"))
    at = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp"))
    return states.dead_states(events, "user_id", "event_id", at, "url", "status").select("event_id", "streak", "effective")


@query("two_attempt_verdict", f"""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS day, {STATUS_SQL} AS s, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
p AS (SELECT user_id, day, count(*) AS attempts, max(s) FILTER (n = 1) AS a, max(s) FILTER (n = 2) AS b FROM e WHERE n <= 2 GROUP BY 1, 2)
SELECT user_id, day, attempts, CASE WHEN a = 'GOOD' THEN 'GOOD' WHEN b = 'GOOD' THEN 'UNKNOWN' WHEN a = 'DEGRADED' AND b = 'DEGRADED' THEN 'BAD' ELSE 'UNKNOWN' END AS verdict FROM p""")
def _(spark, d):
    events = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", status().alias("s"))
    return states.two_attempts(events, ["user_id", "day"], [F.col("ts"), F.col("event_id")], F.col("s") == "GOOD", F.col("s") == "DEGRADED")


@query("candidate_verdict", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' AND l_quantity > 10 AND p_size >= 20 THEN 'QUALIFIED' WHEN l_returnflag = 'N' THEN 'UNKNOWN' ELSE 'REJECTED' END AS verdict
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def _(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    rows = table(spark, d, "lineitem").join(parts, "l_partkey")
    state = F.when(F.col("l_returnflag") == "A", "GOOD").when(F.col("l_returnflag") == "N", "UNKNOWN").otherwise("UNAVAILABLE")
    return rows.select("l_orderkey", "l_linenumber", states.candidate_verdict(state, F.lit(2), F.col("l_quantity") > 10, F.col("p_size"), F.lit(20)).alias("verdict"))


@query("peak_memory", """
WITH m AS (SELECT user_id, ts, event_id, event_type FROM events WHERE event_type IN ('error', 'purchase')) SELECT user_id FROM m GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) = 'error'""")
def _(spark, d):
    return states.last_set(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") == "error", F.col("event_type") == "purchase").select("user_id")


@query("ledger_settle", """
SELECT event_id, round(sum(CASE event_type WHEN 'purchase' THEN -value WHEN 'signup' THEN value ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events""")
def _(spark, d):
    amount = F.when(F.col("event_type") == "purchase", -F.col("value")).when(F.col("event_type") == "signup", F.col("value")).otherwise(0)
    return states.ledger(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], amount).select("event_id", F.round("balance", 4).alias("balance"))


@query("rolling_history_score", """
WITH r AS (SELECT event_id, list(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 11 PRECEDING) AS recent FROM events),
m AS (SELECT event_id, recent, len(recent) AS n, list_sum(recent) AS ok, coalesce(nullif(list_position(list_reverse(recent), 0), 0) - 1, len(recent)) AS trail FROM r)
SELECT event_id, CAST(trail AS BIGINT) AS trail, round((ok / n - 0.5) * 150 + least(trail, 6) * 9 - CASE WHEN n >= 4 AND ok / n < 0.6 THEN 80 ELSE 0 END - CASE WHEN recent[n] = 0 THEN 45 ELSE 0 END, 6) AS score FROM m""")
def _(spark, d):
    rows = states.rolling(table(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], F.col("event_type") != "error")
    return rows.select("event_id", history.trailing(F.col("recent")).cast("long").alias("trail"), F.round(history.history_score(F.col("recent")), 6).alias("score"))


@query("daily_slots", """
WITH e AS (SELECT event_id, ts + INTERVAL 8 HOUR AS t FROM events)
SELECT event_id, CASE WHEN hour(t) >= 2 AND hour(t) < 11 THEN strftime(t, '%Y%m%d') || '-morning' WHEN hour(t) >= 13 AND hour(t) < 16 THEN strftime(t, '%Y%m%d') || '-noon'
  WHEN hour(t) >= 20 AND hour(t) < 23 THEN strftime(t, '%Y%m%d') || '-peak' END AS slot FROM e""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", times.slot(F.col("ts")).alias("slot"))


@query("freshness_filter", "SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-20') - epoch(date_trunc('second', ts)) BETWEEN -600 AND 64800")
def _(spark, d):
    return table(spark, d, "events").where(times.fresh(F.date_trunc("second", "ts"), F.expr("TIMESTAMP_NTZ '2024-01-20'"), 18)).select("event_id")


@query("rotation_due", """
SELECT user_id, date_diff('day', CAST(max(ts) + INTERVAL 8 HOUR AS DATE), CAST(TIMESTAMP '2024-01-30 20:00:00' + INTERVAL 8 HOUR AS DATE)) >= 3 AS due FROM events GROUP BY 1""")
def _(spark, d):
    last = table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", times.rotation_due(F.col("last"), F.expr("TIMESTAMP_NTZ '2024-01-30 20:00:00'"), 3).alias("due"))
