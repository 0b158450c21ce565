"""Promotions under a host cap, and names matched by rule, by equality and by containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.operators import matching, promotion
from lanewise.plans.registry import query, table

FIT, NOW = "l_quantity >= 10 AND l_tax <= 0.06", "l_quantity >= 10 AND l_linenumber = 7"
MARGIN = 8000


@query("promotion_host_cap", f"""
WITH RECURSIVE best AS (SELECT l_partkey, max(l_extendedprice) AS top, min((-l_extendedprice, l_orderkey, l_linenumber)) AS stop FROM lineitem WHERE {NOW} GROUP BY 1),
offers AS (
  SELECT l_partkey AS k, l_suppkey AS h, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r,
    coalesce(l_extendedprice < top + {MARGIN}, false) AS low
  FROM lineitem LEFT JOIN best USING (l_partkey)
  WHERE {FIT} AND l_linenumber <> 7 AND (stop IS NULL OR (-l_extendedprice, l_orderkey, l_linenumber) < stop)),
left_over AS (
  SELECT 0 AS i, * FROM offers
  UNION ALL
  SELECT i + 1, k, h, l_orderkey, l_linenumber, r, low FROM (
    SELECT *, bool_or(refused) OVER () AS moved FROM (
      SELECT *, coalesce(k > list_sort(list(k) FILTER (first AND NOT low) OVER (PARTITION BY h))[{promotion.HOST_CAP}], false) AS refused
      FROM (SELECT *, r = min(r) OVER (PARTITION BY k) AS first FROM left_over)))
  WHERE moved AND NOT refused),
settled AS (SELECT * FROM left_over WHERE i = (SELECT max(i) FROM left_over))
SELECT k AS l_partkey, h AS l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, r = min(r) OVER (PARTITION BY k) AS first FROM settled) WHERE first AND NOT low""")
def _(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_tax")
    best = lines.where(NOW).groupBy("l_partkey").agg(F.max("l_extendedprice").alias("top"))
    clear = F.col("top").isNull() | (F.col("l_extendedprice") >= F.col("top") + MARGIN)
    order = [-F.col("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    chosen = promotion.promoted(lines.join(best.hint("shuffle_hash"), "l_partkey", "left"), "l_partkey", "l_suppkey", order, F.expr(FIT), F.expr(NOW), clear)
    return chosen.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


# names as catalogues write them, and targets: some brands by number, some whole names, all nouns
NAMED = """CASE WHEN p_partkey % 7 = 0 THEN concat(lower(p_brand), ' ', p_name) WHEN p_partkey % 7 < 3 THEN concat(upper(p_name), ' [HD]')
 WHEN p_partkey % 7 < 6 THEN concat(p_type, '-', p_name, ' 1080p') ELSE p_type END"""
BRAND = r"^brand#?(\d+)"


def _brand_key(c):
    number = F.regexp_extract(F.lower(c), BRAND, 1)
    return F.when(number != "", F.concat(F.lit("Brand#"), number))


def _plain(c):
    return F.regexp_replace(F.lower(c), r"\[hd\]|1080p|[^a-z0-9]+", "")


@query("staged_match", rf"""
WITH named AS (SELECT p_partkey, {NAMED} AS name FROM part),
targets AS (SELECT DISTINCT p_brand AS t FROM part WHERE p_size <= 4 AND CAST(p_brand[7:] AS INT) <= 15 UNION SELECT p_name FROM part WHERE p_size = 9
 UNION SELECT string_split(p_name, ' ')[2] FROM part UNION SELECT p_type FROM part WHERE p_type LIKE 'S%'),
forms AS (SELECT t, regexp_replace(lower(t), '\[hd\]|1080p|[^a-z0-9]+', '', 'g') AS f, t LIKE 'Brand%' AS ruled FROM targets),
keyed AS (SELECT *, nullif(regexp_extract(lower(name), '{BRAND}', 1), '') AS number, regexp_replace(lower(name), '\[hd\]|1080p|[^a-z0-9]+', '', 'g') AS f FROM named),
tried AS (SELECT p_partkey, name, number, (SELECT t FROM targets WHERE t = 'Brand#' || number) AS by_rule, (SELECT max(t) FROM forms WHERE forms.f = keyed.f) AS by_form,
 (SELECT arg_min(t, (-length(t), t)) FROM forms WHERE NOT ruled AND contains(keyed.f, forms.f)) AS by_part FROM keyed)
SELECT p_partkey, CASE WHEN number IS NOT NULL THEN by_rule ELSE coalesce(by_form, by_part) END AS matched,
 CASE WHEN number IS NOT NULL THEN CASE WHEN by_rule IS NOT NULL THEN 'rule' END WHEN by_form IS NOT NULL THEN 'exact' WHEN by_part IS NOT NULL THEN 'contained' END AS stage
FROM tried""")
def _(spark, d):
    part = table(spark, d, "part")
    brands = part.where("p_size <= 4 AND CAST(substring(p_brand, 7) AS INT) <= 15").select("p_brand")
    targets = brands.union(part.where("p_size = 9").select("p_name")).union(part.select(F.split("p_name", " ")[1])).union(part.where("p_type LIKE 'S%'").select("p_type")).distinct().toDF("t")
    named = part.select("p_partkey", F.expr(NAMED).alias("name"))
    return matching.staged(named, "name", targets, "t", F.col("t"), _brand_key, _plain).select("p_partkey", "matched", "stage")
