"""Queries over station and viewer rules, readiness gates, route scores and the joint import."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.operators import joins, scores, stations
from lanewise.plans.registry import query, table

NAMES = (
    "CCTV-1 综合", "CNN International", "Radio FM", "交通广播", "广东广播电视", "大江大河 第二季", "故事（上）", "湖南卫视", "Pearl", "TVB Plus", "iPanda 熊猫", "KBS 드라마", "BBC「英文」", "CGTN 法语", "TDM Sport", "plain words", "2024 春晚",
)
GROUPS = ("卫视台", "电影", "新加坡", "台湾", "澳门", "香港", "其他地方")
URLS = (
    "http://t.freetv.fun/a", "https://a.freetv.fun/x", "http://notfreetv.fun/", "http://h.example.com/audio/1.m3u8", "http://h.example.com/cctv5plus/1.m3u8", "http://h.example.com/cctv4k/1.m3u8",
    "http://h.example.com/cctv2/1.m3u8", "http://bad.example.com/1", "http://h.example.com/wrong/", "http://10.0.0.1:8080/live", "https://h.example.com:443/live",
)


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def listed(values: tuple[str, ...], at: str) -> str:
    return f"[{', '.join(f"'{v}'" for v in values)}][{at} % {len(values)} + 1]"


STATIONS = f"""(SELECT p_partkey, {listed(NAMES, 'p_partkey')} AS name, {listed(GROUPS, 'p_size')} AS grp, {listed(URLS, '(p_partkey + p_size)')} AS url,
  CASE WHEN p_size % 9 = 0 THEN 'tvg-id="x" group-title="中文"' ELSE 'group-title="中文综合"' END AS info, CAST(p_size * 30 AS INTEGER) AS height FROM part)"""


def station_rows(spark, d):
    key, size = F.col("p_partkey"), F.col("p_size")
    info = F.when(size % 9 == 0, 'tvg-id="x" group-title="中文"').otherwise('group-title="中文综合"')
    return table(spark, d, "part").select("p_partkey", pick(NAMES, key).alias("name"), pick(GROUPS, size).alias("grp"), pick(URLS, key + size).alias("url"), info.alias("info"), (size * 30).cast("int").alias("height"))


@query("placeholder_hosts", f"SELECT p_partkey, regexp_matches(url, '^https?://(t\\.freetv\\.fun|epg\\.pw|freetv\\.fun|[^/]*\\.freetv\\.fun)(/|$)') AS placeholder FROM {STATIONS}")
def _(spark, d):
    return station_rows(spark, d).select("p_partkey", stations.placeholder_host(F.col("url")).alias("placeholder"))


@query("viewer_profile", f"""
SELECT p_partkey, CASE WHEN grp = '电影' THEN 'blocked_group' WHEN name IN ('CNN International', 'Pearl', 'BBC「英文」', 'CGTN 法语') THEN 'foreign_service' WHEN name LIKE 'CCTV-%' THEN 'keep'
  WHEN grp = '新加坡' THEN 'language' WHEN grp = '台湾' THEN 'keep' WHEN regexp_matches(name, '[一-龥]') THEN 'keep' WHEN name = 'TDM Sport' THEN 'keep' WHEN name = 'TVB Plus' AND grp <> '澳门' THEN 'keep' ELSE 'language' END AS verdict FROM {STATIONS}""")
def _(spark, d):
    verdict = stations.viewer_verdict(F.col("name"), F.col("info"), F.col("grp"), F.col("name").startswith("CCTV-"))
    return station_rows(spark, d).select("p_partkey", verdict.alias("verdict"))


@query("station_like", f"""
SELECT p_partkey, CASE WHEN url = 'http://h.example.com/wrong/' THEN 'mislabelled' WHEN url LIKE 'http://bad.%' THEN 'user_rejected' WHEN name LIKE 'CCTV-1 %' AND regexp_matches(url, 'cctv[0-9]') THEN 'number_conflict'
  WHEN url LIKE '%/audio/%' THEN 'audio_only' WHEN url LIKE '%/cctv5plus/%' THEN 'other_sports_route' WHEN url LIKE '%/cctv4k/%' THEN 'other_uhd_route' WHEN name IN ('Radio FM', '交通广播') THEN 'radio'
  WHEN name IN ('大江大河 第二季', '故事（上）') THEN 'programme' WHEN info LIKE 'tvg-id%' THEN 'station' WHEN regexp_matches(info || name, '(中文|CCTV|TV)') THEN 'station' ELSE 'unknown' END AS verdict FROM {STATIONS}""")
def _(spark, d):
    verdict = stations.station_verdict(F.col("name"), F.col("info"), F.col("url"), F.lit(False), F.lit(False), ["http://h.example.com/wrong"], ["http://bad."])
    return station_rows(spark, d).select("p_partkey", verdict.alias("verdict"))


@query("lineup_rejects", f"""
SELECT CASE WHEN height < 720 THEN 'below720' WHEN url LIKE '%/live' THEN 'vod_or_loop' WHEN name = 'iPanda 熊猫' THEN 'scenic_or_camera' WHEN name IN ('BBC「英文」', 'CGTN 法语') THEN 'foreign_language_variant'
  WHEN name = 'KBS 드라마' THEN 'korean_station' WHEN name IN ('大江大河 第二季', '2024 春晚') THEN 'not_station_like' ELSE 'pass' END AS reason, count(*) AS n FROM {STATIONS} GROUP BY 1""")
def _(spark, d):
    verdict = stations.lineup_verdict(F.col("name"), F.col("height"), F.col("url").endswith("/live"))
    return station_rows(spark, d).groupBy(verdict.alias("reason")).agg(F.count("*").alias("n"))


@query("static_score", f"""
SELECT p_partkey, 0.0 + CASE WHEN url LIKE 'https://%' THEN 26 ELSE 0 END + CASE WHEN url LIKE 'http://10.0.0.1:8080%' THEN -24 - 12 ELSE 0 END + CASE WHEN regexp_matches(url, '[/.]freetv\\.fun/') AND url <> 'http://notfreetv.fun/' THEN -500 ELSE 0 END
  + CASE WHEN regexp_matches(name, '[一-龥]') THEN 22 ELSE 0 END + CASE WHEN height = 1080 THEN 55 WHEN height = 720 THEN 15 WHEN height > 1080 THEN 25 WHEN height > 0 AND height < 720 THEN -16 ELSE 0 END
  + CASE WHEN name LIKE 'CCTV-%' THEN 110 WHEN name LIKE '%卫视' THEN 55 ELSE 0 END AS score FROM {STATIONS}""")
def _(spark, d):
    signals = {"placeholder": stations.placeholder_host(F.col("url")), "han_name": F.col("name").rlike("[一-龥]")}
    score = scores.static_score(F.col("url"), F.col("height"), signals, F.col("name").startswith("CCTV-"), F.col("name").endswith("卫视"), F.lit(False))
    return station_rows(spark, d).select("p_partkey", score.alias("score"))


LINES = """(SELECT l_orderkey, l_linenumber, CAST(l_quantity * 50 AS INTEGER) AS height, l_discount * 120 AS mbps, l_extendedprice / 2000 AS speed, l_tax * 100 AS late, l_linenumber % 4 AS checks, l_quantity * 4 - 100 AS static,
  l_returnflag = 'R' AS failed, l_linestatus = 'O' AS core, l_discount = 0.03 AS geo, l_discount <> 0.04 AS ok, l_linenumber % 2 = 0 AS v6 FROM lineitem)"""


def measured(spark, d):
    q, disc = F.col("l_quantity"), F.col("l_discount")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", (q * 50).cast("int").alias("height"), (disc * 120).alias("mbps"), (F.col("l_extendedprice") / 2000).alias("speed"), (F.col("l_tax") * 100).alias("late"), (F.col("l_linenumber") % 4).alias("checks"), (q * 4 - 100).alias("static"),
        (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_linestatus") == "O").alias("core"), (disc == 0.03).alias("geo"), (disc != 0.04).alias("ok"), (F.col("l_linenumber") % 2 == 0).alias("v6"))


@query("measured_score", f"""
WITH m AS (SELECT *, least(floor(speed), 40) AS fast, least(floor(speed), 40) / nullif(mbps, 0) AS room, least(mbps, 12) AS q FROM {LINES})
SELECT l_orderkey, l_linenumber, round(CASE WHEN geo THEN static + 10 - 25 WHEN NOT ok THEN -9999 ELSE static + 10 + fast * CASE WHEN core THEN 0.8 ELSE 2.2 END - coalesce(nullif(late, 0), 10) * 7 + CASE WHEN checks >= 2 THEN 35 WHEN failed THEN -65 ELSE 0 END
  + CASE WHEN height = 1080 THEN 70 WHEN height = 720 THEN 20 WHEN height > 1080 THEN 25 WHEN height <> 0 AND height < 720 THEN -30 ELSE 0 END
  + CASE WHEN mbps = 0 THEN 0 WHEN core THEN CASE WHEN mbps < 1.2 THEN -130 WHEN room >= 1.5 THEN q * 25 + least(room, 3) * 7 WHEN room >= 1.25 THEN q * 18 WHEN room >= 1.05 THEN q * 8 - 70 ELSE -260 END ELSE q * 5 - CASE WHEN room < 1.05 THEN 70 ELSE 0 END END
  + CASE WHEN v6 THEN 26 ELSE 0 END END, 6) + 0.0 AS score FROM m""")
def _(spark, d):
    c = F.col
    whole = F.floor(c("speed"))  # whole megabits: no score lies half-way between two rounded ones
    score = scores.measured_score(c("static"), F.lit(10.0), c("ok"), c("geo"), F.lit(False), whole, c("late"), c("height"), c("mbps"), c("checks"), c("failed"), c("core"), c("v6"), c("v6"))
    return measured(spark, d).select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query("mainland_score", f"""
SELECT l_orderkey, l_linenumber, round(CASE WHEN geo THEN -9000 WHEN NOT ok THEN -9999 ELSE greatest(-80, least(static, 80)) * 0.1 + 0.8 + CASE WHEN height >= 2160 THEN 260 WHEN height >= 1080 THEN 190 WHEN height >= 720 THEN 80 WHEN height > 0 THEN -120 ELSE -220 END
  + least(mbps, 12) * 16 - CASE WHEN height >= 1080 AND mbps > 0 AND mbps < 2 THEN 220 ELSE 0 END + CASE WHEN checks >= 3 THEN 65 WHEN checks >= 2 THEN 40 WHEN failed THEN -70 ELSE 0 END + CASE WHEN v6 THEN 12 ELSE 0 END END, 4) + 0.0 AS score FROM {LINES}""")
def _(spark, d):
    c = F.col
    score = scores.mainland_score(c("static"), F.lit(10.0), c("ok"), c("geo"), c("height"), c("mbps"), F.lit("H264"), c("checks"), c("failed"), c("v6"), c("v6"))
    return measured(spark, d).select("l_orderkey", "l_linenumber", F.round(score, 4).alias("score"))


@query("lineup_score", f"""
SELECT l_orderkey, l_linenumber, round(height * 100 + least(mbps, 30) * 250 + least(speed, 150) * 8 - least(late, 30) * 30 + CASE WHEN core THEN 250 ELSE 0 END + CASE WHEN v6 THEN 100 ELSE 0 END, 4) + 0.0 AS score FROM {LINES}""")
def _(spark, d):
    c = F.col
    score = scores.lineup_score(c("height"), c("mbps"), c("speed"), c("late"), F.when(c("core"), "HEVC"), c("v6"))
    return measured(spark, d).select("l_orderkey", "l_linenumber", F.round(score, 4).alias("score"))


KNOWN_SQL = "CASE WHEN v6 THEN 20 ELSE 0 END + CASE WHEN core THEN 10 ELSE 0 END"
PICTURE_SQL = "CASE WHEN height >= 1080 THEN 500 WHEN height >= 720 THEN 100 ELSE 0 END"


@query("frame_rate_scores", f"""
SELECT l_orderkey, l_linenumber,
 round(CASE WHEN ok THEN CASE WHEN failed THEN 1400 ELSE 0 END + {PICTURE_SQL} + least(speed, 40) * 6 + least(mbps, 15) * 18 - late * 28 + {KNOWN_SQL} ELSE -1e9 END, 6) + 0.0 AS frames,
 round(CASE WHEN ok THEN CASE WHEN failed THEN 1550 WHEN geo THEN 1400 ELSE 0 END + {PICTURE_SQL} + least(mbps, 12) * 32 + least(speed, 20) * 1.8 - late * 28 + {KNOWN_SQL}
  + CASE WHEN mbps = 0 THEN 0 ELSE CASE WHEN speed / mbps >= 2 THEN 70 WHEN speed / mbps >= 1.5 THEN 50 WHEN speed / mbps >= 1.35 THEN 30 WHEN speed / mbps >= 1.15 THEN -90 ELSE -320 END
   - CASE WHEN mbps < 1.2 THEN 160 WHEN mbps < 1.8 THEN 80 ELSE 0 END END ELSE -1e9 END, 6) + 0.0 AS fields,
 round(least(height, 2160) * 10 + CASE WHEN static >= 45 THEN 5 ELSE 0 END + CASE WHEN coalesce(nullif(mbps, 0), checks * 3) > 0 THEN least(coalesce(nullif(mbps, 0), checks * 3), 20) * 40 ELSE -20 END + least(speed, 12) * 2 - least(late, 10) * 10 + least(checks, 8) * 2
  - CASE WHEN v6 THEN 8 ELSE 0 END, 3) + 0.0 AS rotation,
 round(CASE WHEN ok THEN CASE checks WHEN 0 THEN 3000 WHEN 1 THEN 2700 WHEN 2 THEN 600 ELSE 0 END + least(CASE WHEN v6 THEN least(speed, mbps + 1) ELSE speed END, 50) * 8 + least(mbps, 20) * 20 - late * 50 ELSE -1e9 END, 6) + 0.0 AS mode
FROM (SELECT * REPLACE (floor(speed) AS speed) FROM {LINES})""")
def _(spark, d):
    c = lambda name: F.floor("speed") if name == "speed" else F.col(name)  # noqa: E731  whole megabits: no score lies half-way between two rounded ones
    frames = scores.fifty_frames_score(c("ok"), c("failed"), c("height"), c("speed"), c("mbps"), c("late"), c("v6"), c("core"))
    fields = scores.fifty_fields_score(c("ok"), c("failed"), c("geo"), c("height"), c("speed"), c("mbps"), c("late"), c("v6"), c("core"))
    rotation = scores.rotation_score(c("height"), c("static"), c("mbps"), c("checks") * 3, c("speed"), c("late"), c("checks"), c("v6"))
    mode = scores.mode_score(c("ok"), pick(("1080p50", "1080i50", "720-other", "other"), c("checks")), c("speed"), F.when(c("v6"), c("mbps") + 1).otherwise(0), c("mbps"), c("late"))
    told = {"frames": frames, "fields": fields, "rotation": rotation, "mode": mode}
    return measured(spark, d).select("l_orderkey", "l_linenumber", *[F.round(v, 3 if k == "rotation" else 6).alias(k) for k, v in told.items()])


RELAYED = """concat(CASE page_id % 3 WHEN 0 THEN 'http://[2409:8087:1::5]:80' WHEN 1 THEN 'http://[2001:db8::1]' ELSE 'https://h.test' END, CASE page_id % 4 WHEN 0 THEN '/PLTV/1' WHEN 1 THEN '/tvod/2' ELSE '/live' END,
 CASE page_id % 5 WHEN 0 THEN '?AuthInfo=1&token=2' WHEN 1 THEN '?love=freedom' WHEN 2 THEN '?timestamp=1&love=freedom' ELSE '' END)"""


@query("ipv6_score", """
SELECT page_id, 0.0 + page_id % 60 + greatest(0, page_id % 4 - 1) * 40 + CASE page_id % 3 WHEN 0 THEN 18 ELSE 0 END + CASE WHEN page_id % 4 < 2 THEN 10 ELSE 0 END
 - CASE WHEN page_id % 5 IN (0, 2) THEN 24 ELSE 0 END + CASE WHEN page_id % 5 IN (1, 2) THEN 4 ELSE 0 END AS score FROM pages""")
def _(spark, d):
    score = scores.ipv6_score(F.expr(RELAYED), F.col("page_id") % 60, F.col("page_id") % 4)
    return table(spark, d, "pages").select("page_id", score.alias("score"))


@query("readiness_gates", f"""
SELECT l_orderkey, l_linenumber, ok AND checks >= 3 AND NOT failed AND NOT geo AND (core OR l_linenumber % 3 <> 0) AS easy, ok AND checks >= 2 AND NOT failed AND NOT geo AS family,
  ok AND height BETWEEN 1080 AND 2159 AND mbps >= 5 AND speed >= greatest(7, mbps * 1.2) AND late <= 2 AS strict, ok AND height BETWEEN 1080 AND 2159 AND mbps >= 2.5 AND speed >= greatest(5, mbps * 1.5) AND late <= 2 AS safe FROM {LINES}""")
def _(spark, d):
    c = F.col
    recent = F.when(c("l_linenumber") % 3 == 0, F.array(*map(F.lit, (1, 0, 1, 0)))).when(c("l_linenumber") % 3 == 1, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return measured(spark, d).select(
        "l_orderkey", "l_linenumber", scores.easy_ready(c("ok"), c("checks"), c("failed"), c("geo"), c("core"), recent).alias("easy"), scores.family_core_usable(c("ok"), c("checks"), c("failed"), c("geo")).alias("family"),
        *[scores.hd_pass(c("ok"), c("height"), c("mbps"), c("speed"), F.lit(0.0), c("late"), strict).alias(name) for name, strict in (("strict", True), ("safe", False))])


@query("household_status", f"""
SELECT l_orderkey, l_linenumber, CASE WHEN NOT ok THEN 'DEAD' WHEN geo OR mbps <= 0 THEN 'UNKNOWN' WHEN speed / mbps < 1.05 OR ((height < 720 OR mbps < CASE WHEN core THEN 2.5 ELSE 3.0 END) AND NOT v6) THEN 'DEGRADED' ELSE 'GOOD' END AS status FROM {LINES}""")
def _(spark, d):
    c = F.col
    sample = F.struct(F.lit(100_000).alias("downloaded_bytes"), F.lit(2.0).alias("elapsed_s"))
    samples = F.when(c("ok"), F.array(sample, sample))
    status = scores.household_status(F.when(c("ok"), "GOOD").otherwise("DEAD"), ~c("geo"), samples, F.lit(262_144), c("mbps"), c("speed"), F.when(c("core"), "hevc").otherwise("h264"), c("height"), F.lit(720), c("v6"))
    return measured(spark, d).select("l_orderkey", "l_linenumber", status.alias("status"))


@query("joint_import", """
WITH c AS (SELECT p_partkey, p_partkey // 2 AS route, p_type AS label, p_size <= 25 AS pending FROM part), bad AS (SELECT route FROM c GROUP BY 1 HAVING count(DISTINCT label) > 1)
SELECT p_partkey, route, label, pending FROM c WHERE pending OR route NOT IN (SELECT route FROM bad)""")
def _(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.expr("p_partkey div 2").alias("route"), F.col("p_type").alias("label"), (F.col("p_size") <= 25).alias("pending"))
    return joins.imported(rows.where("pending"), rows.where("NOT pending"), "p_partkey", lambda both: both.join(joins.ambiguous(both, "route", "label"), "route", "left_anti"))
