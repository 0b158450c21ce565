"""Leases, evening failures and budgets: rules folded over each key's events in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.operators import folds, rules
from lanewise.plans.policy import DEFAULT
from lanewise.plans.registry import query, table


@query("lease_ingest", """
WITH e AS (SELECT user_id % 40 AS task, ts AS "at", event_type IN ('signup', 'click') AS lease,
  'b' || CASE WHEN event_type IN ('signup', 'click') THEN event_id % 6 ELSE event_id % 7 END AS batch FROM events),
leases AS (SELECT task, batch, min("at") AS "at", min("at") + INTERVAL 20 HOUR AS expires FROM e WHERE lease GROUP BY 1, 2),
results AS (SELECT e.task, e.batch, e."at", expires, leases."at" IS NOT NULL AND leases."at" <= e."at" AS known FROM e LEFT JOIN leases USING (task, batch) WHERE NOT lease),
ranked AS (SELECT *, row_number() OVER (PARTITION BY task, batch, known ORDER BY "at") AS n FROM results),
taken AS (SELECT task, min("at") AS "at" FROM ranked WHERE known AND n = 1 GROUP BY 1)
SELECT ranked.task, batch, ranked."at", CASE WHEN NOT known THEN 'unknown' WHEN n > 1 THEN 'duplicate' WHEN ranked."at" > taken."at" THEN 'superseded'
  WHEN ranked."at" <= expires THEN 'accepted' ELSE 'accepted_late' END AS outcome FROM ranked LEFT JOIN taken USING (task)
UNION ALL SELECT leases.task, batch, expires, 'expired' FROM leases LEFT JOIN taken USING (task) WHERE taken."at" IS NULL OR taken."at" > expires""")
def _(spark, d):
    events = table(spark, d, "events")
    lease = F.col("event_type").isin("signup", "click")
    batch = F.concat(F.lit("b"), F.when(lease, F.col("event_id") % 6).otherwise(F.col("event_id") % 7))
    at = F.col("ts").cast("timestamp")
    told = events.select(
        (F.col("user_id") % 40).alias("task"), at.alias("at"), F.when(lease, rules.LEASE).otherwise(rules.RESULT).alias("kind"), batch.alias("batch"),
        F.when(~lease, F.md5(batch)).alias("digest"), F.when(lease, at + F.expr("INTERVAL 20 HOURS")).alias("expires"),
    )
    return folds.folded(told, ["task"], rules.LEASED).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("peak_memory_changes", """
WITH e AS (SELECT user_id % 60 AS name, ts AS "at", CAST(event_id % 3 AS VARCHAR) AS url, event_type = 'error' AS bad FROM events
  WHERE hour(ts + INTERVAL 8 HOUR) IN (20, 21, 22) AND (event_type = 'error' AND value > 5 OR event_type = 'purchase')),
i AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY name ORDER BY "at") AS island FROM e),
h AS (SELECT *, max(url) FILTER (bad) OVER (PARTITION BY name, island) AS held FROM i WHERE island > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY name, island, bad, url = held ORDER BY "at") AS k FROM h)
SELECT name, "at", url, CASE WHEN bad THEN "at" END AS failed FROM n WHERE bad OR (url = held AND k = 1)""")
def _(spark, d):
    events = table(spark, d, "events")
    told = events.select(
        (F.col("user_id") % 60).alias("name"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).cast("string").alias("url"),
        F.when(F.col("event_type") == "error", "BAD").when(F.col("event_type") == "purchase", "GOOD").otherwise("UNKNOWN").alias("status"),
        (F.col("value") > 5).alias("confirmed"), F.hour(F.col("ts") + F.expr("INTERVAL 8 HOURS")).isin(20, 21, 22).alias("peak"), F.lit(False).alias("circuit"),
    )
    found = folds.folded(told, ["name"], rules.PEAK)
    return found.withColumns({"at": F.col("at").cast("timestamp_ntz"), "failed": F.col("failed").cast("timestamp_ntz")})


HELD = "list_filter(open, lambda x: x.b = e.batch)"
FITS = f"""CASE WHEN list_contains(seen, e.batch) THEN 'repeated' WHEN s.amount + e.amount > {DEFAULT.daily_amount} THEN 'daily_byte_budget'
 WHEN s.seconds + e.seconds > {DEFAULT.daily_seconds} THEN 'daily_time_budget' WHEN s.cands + e.cands > {DEFAULT.daily_candidates} THEN 'daily_candidate_budget'
 WHEN e.cands > 0 AND (s.f_amount + e.amount > {DEFAULT.discovery_amount} OR s.f_seconds + e.seconds > {DEFAULT.discovery_seconds}) THEN 'discovery_budget' ELSE 'reserved' END"""


@query("budget_ledger", f"""
WITH RECURSIVE e AS (
  SELECT *, row_number() OVER (PARTITION BY account, day ORDER BY "at", settle, batch) AS n FROM (
    SELECT user_id % 20 AS account, CAST(ts AS DATE) AS day, ts AS "at", event_type IN ('purchase', 'error') AS settle, event_type = 'error' AS stopped, 'b' || event_id % 9 AS batch,
      CAST(floor(value * 9000000) AS BIGINT) AS amount, event_id % 400 AS seconds, CASE WHEN event_type IN ('purchase', 'error') THEN 0 ELSE event_id % 3 END AS cands FROM events)),
walked AS (
  SELECT DISTINCT account, day, 0::BIGINT AS n, ''::VARCHAR AS batch, NULL::TIMESTAMP AS "at", ''::VARCHAR AS outcome, 0::BIGINT AS amount, 0::BIGINT AS seconds, 0::BIGINT AS cands,
    0::BIGINT AS f_amount, 0::BIGINT AS f_seconds, []::STRUCT(b VARCHAR, a BIGINT, s BIGINT, c BIGINT)[] AS open, []::VARCHAR[] AS seen FROM e
  UNION ALL
  SELECT account, day, n, batch, "at", outcome,
    amount + CASE WHEN taken THEN e_amount ELSE 0 END - back, seconds + CASE WHEN taken THEN e_seconds ELSE 0 END - back_s, cands + CASE WHEN taken THEN e_cands ELSE 0 END,
    f_amount + CASE WHEN taken AND e_cands > 0 THEN e_amount ELSE 0 END - CASE WHEN held[1].c > 0 THEN back ELSE 0 END,
    f_seconds + CASE WHEN taken AND e_cands > 0 THEN e_seconds ELSE 0 END - CASE WHEN held[1].c > 0 THEN back_s ELSE 0 END,
    CASE WHEN taken THEN list_append(open, {{'b': batch, 'a': e_amount, 's': e_seconds, 'c': e_cands}}) WHEN settle THEN list_filter(open, lambda x: x.b <> batch) ELSE open END,
    CASE WHEN taken THEN list_append(seen, batch) ELSE seen END
  FROM (SELECT *, outcome = 'reserved' AS taken, CASE WHEN outcome = 'settled' THEN greatest(0, held[1].a - e_amount) ELSE 0 END AS back,
      CASE WHEN outcome = 'settled' THEN greatest(0, held[1].s - e_seconds) ELSE 0 END AS back_s
    FROM (SELECT s.account, s.day, e.n, e.batch, e."at", e.settle, e.amount AS e_amount, e.seconds AS e_seconds, e.cands AS e_cands, s.amount, s.seconds, s.cands, s.f_amount, s.f_seconds, s.open, s.seen,
        {HELD} AS held, CASE WHEN NOT e.settle THEN {FITS} WHEN len({HELD}) = 0 THEN 'ignored' WHEN e.stopped THEN 'interrupted' ELSE 'settled' END AS outcome
      FROM walked s JOIN e ON e.account = s.account AND e.day = s.day AND e.n = s.n + 1)))
SELECT account, day, batch, "at", outcome, amount AS spent, seconds AS spent_seconds FROM walked WHERE n > 0""")
def _(spark, d):
    events = table(spark, d, "events")
    settles = F.col("event_type").isin("purchase", "error")
    told = events.select(
        (F.col("user_id") % 20).alias("account"), F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("at"), F.when(settles, rules.SETTLE).otherwise(rules.RESERVE).alias("kind"),
        F.concat(F.lit("b"), F.col("event_id") % 9).alias("batch"), F.floor(F.col("value") * 9000000).alias("amount"), (F.col("event_id") % 400).alias("seconds"),
        F.when(settles, 0).otherwise(F.col("event_id") % 3).cast("int").alias("candidates"), (F.col("event_type") == "error").alias("interrupted"),
    )
    return folds.folded(told, ["account", "day"], rules.budget()).withColumn("at", F.col("at").cast("timestamp_ntz"))
