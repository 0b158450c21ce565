"""Queries over names, URLs, playlists, gates and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewise.functions import history, text, urls
from lanewise.operators import scores
from lanewise.plans.queries_joins import HOST_SQL
from lanewise.plans.registry import query, table
from lanewise.sources import playlists

PATH_SQL = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"
QUERY_SQL = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
PORT_SQL = r"^https?://(?:[^/@?#]*@)?(?:\[[^\]]+\]|[^/:?#]+):([0-9]+)(?:[/?#]|$)"
DAILY = """concat(regexp_extract(url, '^([^#]*)', 1), CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, CASE page_id % 6 WHEN 0 THEN 'wsTime=5&b=2' WHEN 1 THEN 'my_token=x&B=1'
 WHEN 2 THEN 'exp=1&Page=3&a' WHEN 3 THEN 'token_a=1&z=' WHEN 4 THEN 't=1&Access_Token=q' ELSE 'txTime=2' END)"""


@query("url_parts", f"SELECT page_id, {HOST_SQL} AS host, {PATH_SQL} AS path, {QUERY_SQL} AS query, CASE WHEN regexp_matches({HOST_SQL}, '^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$') THEN 4 WHEN contains({HOST_SQL}, ':') THEN 6 ELSE 0 END AS family FROM pages")
def _(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.literal_family(urls.host(u)).alias("family"))


@query("route_key", f"""
WITH u AS (SELECT page_id, url, {HOST_SQL} AS host, url_decode({PATH_SQL}) AS path, TRY_CAST(regexp_extract(url, '{PORT_SQL}', 1) AS INTEGER) AS port FROM pages)
SELECT page_id, CASE WHEN host = '' THEN '' ELSE lower(regexp_extract(url, '^(https?)://', 1)) || '://' || host
  || CASE WHEN port BETWEEN 1 AND 65535 THEN ':' || port ELSE '' END
  || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '/+', '/', 'g') END AS route FROM u""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.route_key(F.col("url")).alias("route"))


@query("drop_volatile_query", f"""
WITH u AS (SELECT page_id, {DAILY} AS url FROM pages),
p AS (SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]*)', 1)) || regexp_replace({PATH_SQL}, '^$', '/') AS base, unnest(string_split({QUERY_SQL}, '&')) AS part FROM u),
k AS (SELECT page_id, base, split_part(part, '=', 1) AS key, split_part(part, '=', 2) AS value FROM p),
f AS (SELECT * FROM k WHERE NOT regexp_matches(lower(key), '^(wstime|exp|txtime|token|token_.*|.*_token)$'))
SELECT b.page_id, b.base || coalesce('?' || (SELECT string_agg(key || '=' || value, '&' ORDER BY lower(key), value) FROM f WHERE f.page_id = b.page_id), '') AS clean FROM (SELECT DISTINCT page_id, base FROM p) b""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.without_volatile(F.expr(DAILY)).alias("clean"))


@query("url_predicates", rf"SELECT page_id, regexp_matches(url, '^https?://[^/?#]+') AS valid, regexp_matches(url, '(?i)[?&](token|auth|auth_key|sign|signature|expires?|wssecret|wstime|txsecret|txtime)=') AS token, len(regexp_extract_all(html, '(https?://[^\s#]+)')) AS n_urls FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", urls.valid(F.col("url")).alias("valid"), urls.token_hint(F.col("url")).alias("token"), F.size(urls.urls_in(F.col("html"))).cast("long").alias("n_urls"))


@query("epoch_token_expiry", """
WITH u AS (SELECT event_id, 'http://h.example.com/a?t=' || CAST(CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN '000' ELSE '' END AS url FROM events)
SELECT event_id, CAST(substring(regexp_extract(url, '=([0-9]+)$', 1), 1, 10) AS BIGINT) AS expires, CAST(substring(regexp_extract(url, '=([0-9]+)$', 1), 1, 10) AS BIGINT) - 1705276800 < 86400 AS short_lived FROM u""")
def _(spark, d):
    seconds = F.unix_timestamp(F.date_trunc("second", "ts").cast("timestamp")).cast("string")
    url = F.concat(F.lit("http://h.example.com/a?t="), seconds, F.when(F.col("event_id") % 2 == 0, "000").otherwise(""))
    return table(spark, d, "events").select("event_id", urls.expiry(url).alias("expires"), urls.short_lived(url, F.lit(1705276800)).alias("short_lived"))


@query("rate_parse", """
WITH r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS a, CAST(l_linenumber % 3 AS INT) AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(a / nullif(b, 0), 6) AS fps FROM r""")
def _(spark, d):
    shown = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/"), (F.col("l_linenumber") % 3).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(text.rate(shown), 6).alias("fps"))


@query("name_normalise", r"""SELECT doc_id, substring(trim(regexp_replace(regexp_replace(text, '["﻿]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 180) AS name FROM documents""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clean_name(F.col("text")).alias("name"))


@query("station_key_case", r"""
WITH n AS (SELECT p_partkey, 'CCTV-' || CAST(p_size AS VARCHAR) || CASE WHEN p_size = 5 THEN '+' WHEN p_size = 4 THEN 'K' ELSE ' HD' END AS name FROM part)
SELECT p_partkey, CASE WHEN name LIKE 'CCTV-4K%' THEN 'cctv4k' WHEN name LIKE 'CCTV-5+%' THEN 'cctv5+' ELSE 'cctv' || regexp_extract(name, '([0-9]+)', 1) END AS station,
  CASE WHEN name LIKE 'CCTV-4K%' THEN 99.0 WHEN name LIKE 'CCTV-5+%' THEN 5.5 ELSE CAST(regexp_extract(name, '([0-9]+)', 1) AS DOUBLE) END AS number FROM n""")
def _(spark, d):
    tail = F.when(F.col("p_size") == 5, "+").when(F.col("p_size") == 4, "K").otherwise(" HD")
    name = F.concat(F.lit("CCTV-"), F.col("p_size").cast("string"), tail)
    return table(spark, d, "part").select("p_partkey", text.station_key(name).alias("station"), text.natural_number(name).alias("number"))


@query("compact_names", r"SELECT p_partkey, regexp_replace(lower(p_name || ' (HD) 1080p'), '(4k|8k|uhd|fhd|hdr|hevc|h\.?26[45]|1080[pi]?|720p?|hd|sd|[\s\-_+·()\[\],.])', '', 'g') AS compact FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.compact(F.concat("p_name", F.lit(" (HD) 1080p"))).alias("compact"))


@query("attr_extract", """SELECT page_id, regexp_extract(html, 'lang="([^"]*)"', 1) AS lang, regexp_extract(html, 'charset="([^"]*)"', 1) AS charset, regexp_extract(html, 'href="([^"]*)"', 1) AS href FROM pages""")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", *[text.attribute(F.col("html"), a).alias(a) for a in ("lang", "charset", "href")])


@query("region_rules", "SELECT n_nationkey, CASE WHEN regexp_matches(n_name, '(?i)^[a-e]') THEN 'first' WHEN regexp_matches(n_name, '(?i)a$') THEN 'ends_a' ELSE 'other' END AS region FROM nation")
def _(spark, d):
    return table(spark, d, "nation").select("n_nationkey", text.first_rule(F.col("n_name"), [("(?i)^[a-e]", "first"), ("(?i)a$", "ends_a")], "other").alias("region"))


@query("labelled_height", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 4320 WHEN 1 THEN 2160 WHEN 2 THEN 1080 WHEN 3 THEN 720 ELSE 0 END AS height FROM part")
def _(spark, d):
    label = F.element_at(F.array(*[F.lit(x) for x in ("news 8K", "news UHD", "news FHD", "news HD", "news")]), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.labelled_height(label).alias("height"))


@query("sha_ids", "SELECT o_orderkey, sha256(o_orderstatus || chr(10) || o_orderpriority || chr(10) || CAST(o_custkey AS VARCHAR)) AS candidate_id FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("\n", "o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")), 256).alias("candidate_id"))


@query("array_functions", """
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, array_to_string(list_slice(list(o_orderkey ORDER BY o_orderkey), -5, -1), ',') AS last_five FROM orders GROUP BY 1""")
def _(spark, d):
    grouped = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderstatus").alias("s"), F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    return grouped.select("o_custkey", F.array_join(history.sorted_set(F.col("s")), ",").alias("statuses"), F.array_join(history.last_n(F.col("k"), 5).cast("array<string>"), ",").alias("last_five"))


@query("quality_gate", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 50 < 720 THEN 'fail_height' WHEN l_returnflag = 'A' AND l_tax * 50 > 0 AND l_tax * 50 < 2.0 THEN 'fail_fake_1080_bitrate' WHEN l_discount = 0.1 THEN 'fail_short_token'
  WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'fail_unlocked_adaptive_master' WHEN l_discount = 0.09 THEN 'fail_suspected_identity'
  WHEN l_linestatus <> 'O' AND l_tax * 40 > 0 AND l_tax * 40 < CASE WHEN l_returnflag = 'A' THEN 1.5 ELSE 1.35 END THEN 'fail_headroom' ELSE 'pass' END AS gate FROM lineitem""")
def _(spark, d):
    core, mainland = F.col("l_returnflag") == "A", F.col("l_linestatus") == "O"
    gate = scores.quality_gate(F.col("l_quantity") * 50, F.lit(720), core, F.lit("h264"), F.col("l_tax") * 50, F.col("l_discount") == 0.1, (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R"), F.col("l_discount") == 0.09, mainland, F.col("l_tax") * 40)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", gate.alias("gate"))


@query("reason_counts", "SELECT CASE WHEN p_size < 5 THEN 'small' WHEN contains(p_name, 'red') THEN 'colour' WHEN p_retailprice > 1800 THEN 'price' ELSE 'pass' END AS reason, count(*) AS n FROM part GROUP BY 1")
def _(spark, d):
    reason = scores.gate([(F.col("p_size") < 5, "small"), (F.col("p_name").contains("red"), "colour"), (F.col("p_retailprice") > 1800, "price")])
    return table(spark, d, "part").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("evidence_score", """
SELECT l_orderkey, l_linenumber, round(100000 + least(l_quantity * 50, 2160) * 10 + least(l_discount * 400, 30) * 220 + least(l_extendedprice / 500, 100) * 15 - least(l_tax * 500, 30) * 30, 3) AS score FROM lineitem""")
def _(spark, d):
    score = scores.evidence_score(F.col("l_quantity") * 50, F.col("l_discount") * 400, F.col("l_extendedprice") / 500, F.col("l_tax") * 500)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query("result_score", """
SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'A' THEN round(round(100000 + least(l_quantity * 50, 2160) * 8 + least(l_discount * 400, 20) * 180 + least(l_extendedprice / 500, 100) * 12 - least(l_tax * 500, 30) * 25, 6)
  - CASE WHEN l_linestatus = 'F' THEN 800 ELSE 0 END - CASE WHEN l_discount < 0.02 THEN 1200 ELSE 0 END, 2) ELSE -1e9 END AS score FROM lineitem""")
def _(spark, d):
    state = F.when(F.col("l_returnflag") == "A", "GOOD").otherwise("UNKNOWN")
    score = scores.result_score(state, F.col("l_quantity") * 50, F.col("l_discount") * 400, F.col("l_extendedprice") / 500, F.col("l_tax") * 500, F.col("l_linestatus") == "F", F.col("l_discount") < 0.02)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", score.alias("score"))


@query("core_score", """
WITH m AS (SELECT l_orderkey, l_linenumber, l_quantity * 50 AS h, l_discount * 100 AS mb, l_linenumber AS ck, l_tax * 1000 - 20 AS hist, l_quantity * 4 - 100 AS st, l_linestatus = 'O' AS ml, l_tax * 200 AS sp, nullif(l_tax * 20, 0) AS la, l_returnflag <> 'R' AS ok FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN NOT ok OR h < 1080 THEN -9999 ELSE CASE WHEN h >= 2160 THEN 220 ELSE 160 END + least(mb, 12) * 32 + least(ck, 3) * 20 + greatest(-60, least(hist, 90)) * CASE WHEN ml THEN 0.08 ELSE 0.30 END
  + greatest(-80, least(st, 80)) * 0.10 + CASE WHEN ml THEN 0 ELSE CASE WHEN mb > 0 THEN CASE WHEN sp / mb >= 1.5 THEN 35 WHEN sp / mb < 1.35 THEN -160 ELSE 0 END ELSE 0 END - coalesce(la, 10) * 6 END END, 4) AS score FROM m""")
def _(spark, d):
    score = scores.core_score(F.col("l_returnflag") != "R", F.col("l_quantity") * 50, F.col("l_discount") * 100, F.col("l_linenumber"), F.col("l_tax") * 1000 - 20, F.col("l_quantity") * 4 - 100, F.col("l_linestatus") == "O", F.col("l_tax") * 200, F.col("l_tax") * 20)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 4).alias("score"))


@query("stability_filter", """
SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity * 50 >= 720 AND NOT (l_linenumber = 1 AND l_discount * 40 > 0 AND l_discount * 40 < 2)
  AND (l_linestatus = 'O' OR (coalesce(nullif(l_tax * 80, 0), 99) <= 5 AND l_extendedprice / 5000 >= greatest(2.2, l_quantity * 20000 / 1000000 * 1.25, l_discount * 40 * CASE WHEN l_linenumber = 1 THEN 1.35 ELSE 1.2 END)))""")
def _(spark, d):
    fit = scores.stable(F.lit(True), F.col("l_quantity") * 50, F.lit(720), F.lit("h264"), F.col("l_discount") * 40, F.col("l_linenumber") == 1, F.col("l_linestatus") == "O", F.col("l_extendedprice") / 5000, F.col("l_tax") * 80, F.col("l_quantity") * 20000, F.col("l_returnflag") == "R")
    return table(spark, d, "lineitem").where(fit).select("l_orderkey", "l_linenumber")


@query("ordered_playlist", "SELECT p_partkey, row_number() OVER (ORDER BY CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'STANDARD' THEN 2 ELSE 9 END, p_retailprice DESC, lower(p_name), p_partkey) AS pos FROM part")
def _(spark, d):
    from pyspark.sql import Window

    order = [F.when(F.col("p_type") == "ECONOMY", 1).when(F.col("p_type") == "STANDARD", 2).otherwise(9), F.desc("p_retailprice"), F.lower("p_name"), F.col("p_partkey")]
    return table(spark, d, "part").select("p_partkey", F.row_number().over(Window.orderBy(*order)).alias("pos"))


PLAYLIST = """(SELECT p_brand AS source, p_partkey, p_name, p_type FROM part)"""


def playlist_texts(spark, d):
    parts = table(spark, d, "part")
    entry = F.concat(F.lit('#EXTINF:-1 group-title="'), F.col("p_type"), F.lit('",a,'), F.col("p_name"), F.lit("\n#EXTVLCOPT:x=1\nhttp://h.example.com/"), F.col("p_partkey").cast("string"), F.lit("$hd\nhttp://spare.example.com/x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda x: x["e"]), "\n")
    return parts.groupBy(F.col("p_brand").alias("source")).agg(F.concat(F.lit("#EXTM3U\n"), body).alias("body"))


@query("m3u_parse", f"SELECT source, 'http://h.example.com/' || CAST(p_partkey AS VARCHAR) AS url, p_name AS name, p_type AS \"group\", '#EXTVLCOPT:x=1' AS options, 'hd' AS url_options FROM {PLAYLIST}")
def _(spark, d):
    return playlists.m3u(playlists.lines_of(playlist_texts(spark, d), "source", "body")).select("source", "url", "name", "group", "options", "url_options")


@query("playlist_blocks", "SELECT p_brand AS source, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS BIGINT) AS block, p_name AS name FROM part")
def _(spark, d):
    found = playlists.blocks(playlists.lines_of(playlist_texts(spark, d), "source", "body")).where("block > 0")
    return found.select("source", "block", F.regexp_extract("body", r"(?m)^#EXTINF.*,([^,\n]*)$", 1).alias("name"))


@query("txt_list_parse", """
SELECT p_brand AS source, p_type AS "group", p_name AS name, 'http://h' || CAST(i AS VARCHAR) || '.example.com/' || CAST(p_partkey AS VARCHAR) AS url, i AS part FROM part, (VALUES (0), (1)) AS v(i)""")
def _(spark, d):
    row = F.concat(F.col("p_type"), F.lit(",#genre#\n"), F.col("p_name"), F.lit(",http://h0.example.com/"), F.col("p_partkey").cast("string"), F.lit("#http://h1.example.com/"), F.col("p_partkey").cast("string"), F.lit("$note"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("e")))), lambda x: x["e"]), "\n")
    texts = table(spark, d, "part").groupBy(F.col("p_brand").alias("source")).agg(body.alias("body"))
    return playlists.lists(playlists.lines_of(texts, "source", "body")).select("source", "group", "name", "url", "part")


@query("hls_last_segments", """
WITH s AS (SELECT l_orderkey, 'seg' || CAST(l_partkey % 5 AS VARCHAR) || '.ts' AS uri, max(l_linenumber) AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY 1, 2)
SELECT l_orderkey AS source, uri, row_number() OVER (PARTITION BY l_orderkey ORDER BY pos DESC) AS back FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pos DESC) <= 2""")
def _(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = lines.select(F.col("l_orderkey").alias("source"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("seg"), (F.col("p") % 5).cast("string"), F.lit(".ts")).alias("line"))
    return playlists.last_segments(rows, 2).select("source", "uri", "back")


@query("label_casefold")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", text.label_key("p_name").alias("label"))
