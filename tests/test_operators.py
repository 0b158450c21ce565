"""Joins, merges, updates and greedy folds on small literal frames."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lanewise.operators import aggregates, greedy, joins, queues, scores, updates


def test_merge_sources_keeps_the_first_row(spark):
    rows = spark.createDataFrame([("n", "u", 2, "g2", "s2"), ("n", "u", 1, "g1", "s1"), ("m", "u", 3, "g3", "s1")], "name string, url string, pos int, grp string, source string")
    got = {r.name: (r.grp, r.sources) for r in aggregates.merge_sources(rows, ["name", "url"], "pos", "source").collect()}
    assert got == {"n": ("g1", ["s1", "s2"]), "m": ("g3", ["s1"])}


def test_best_of_ties_go_to_the_first(spark):
    rows = spark.createDataFrame([("k", 5, 2), ("k", 5, 1), ("k", 4, 0)], "k string, s int, pos int")
    assert aggregates.best_of(rows, ["k"], F.col("s"), "pos").first().pos == 1


def test_circuits(spark):
    rows = spark.createDataFrame([(1, f"k{i}", "UNKNOWN" if i < 20 else "GOOD") for i in range(40)] + [(2, "k", "UNKNOWN")], "run int, k string, s string")
    got = {r.run: r.open for r in aggregates.run_circuit(rows, "run", "s").collect()}
    assert got == {1: True, 2: False}


def test_host_veto_needs_two_urls(spark):
    bad = spark.createDataFrame([("http://x.test/1",), ("http://x.test/2",), ("http://y.test/1",), ("http://y.test/1",)], "u string")
    rows = spark.createDataFrame([("http://x.test/9",), ("http://y.test/9",)], "url string")
    assert [r.url for r in joins.veto_hosts(rows, "url", bad, "u").collect()] == ["http://y.test/9"]


def test_delta(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    now = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "id int, v string")
    assert {r.id: r.change for r in joins.delta(now, before, "id", ["v"]).collect()} == {1: "gone", 2: "changed", 4: "new"}


def test_asof(spark):
    left = spark.createDataFrame([("k", 5, "l1"), ("k", 1, "l2"), ("j", 9, "l3")], "k string, t int, name string")
    right = spark.createDataFrame([("k", 3, 30), ("k", 5, 50), ("k", 6, 60)], "k string, t int, v int")
    got = {r.name: r.v for r in joins.asof(left, right.withColumnRenamed("t", "rt"), "k", "t", "rt", ["v"]).collect()}
    assert got == {"l1": 50, "l2": None, "l3": None}


def test_update_by_key_is_strict(spark):
    rows = spark.createDataFrame([("a", "u")], "k string, url string")
    plan = spark.createDataFrame([("b", "v")], "k string, new string")
    with pytest.raises(PySparkException):
        updates.update_by_key(rows, plan, "k", "url", "new").collect()
    assert updates.update_by_key(rows, plan, "k", "url", "new", strict=False).first().url == "u"


def test_merge_in_order(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("x", 2, "keep"), ("a", 3, "later")], "k string, pos int, v string")
    listed = spark.createDataFrame([("a", 1, "new"), ("b", 2, "added")], "k string, pos int, v string")
    got = updates.merge_in_order(rows, listed, "k", "pos", "v").orderBy("pos").collect()
    assert [(r.k, r.v) for r in got] == [("a", "new"), ("x", "keep"), ("b", "added")]


def test_first_and_last_write(spark):
    rows = spark.createDataFrame([("k", 1, "first"), ("k", 2, "last")], "k string, t int, v string")
    assert updates.first_wins(rows, "k", [F.col("t")]).first().v == "first" and updates.replayed(rows, "k", [F.col("t")]).first().v == "last"


def test_asserted(spark):
    with pytest.raises(PySparkException):
        aggregates.asserted(spark.range(3), [("small", F.col("id") < 2)]).collect()


def test_greedy(spark):
    rows = spark.createDataFrame([("g", "h1", 0, False, 1), ("g", "h1", 0, False, 2), ("g", "h2", 0, False, 3), ("g", "h1", 0, True, 4)], "g string, h string, c int, p boolean, id int")
    got = greedy.balanced(rows, "g", "h", "c", "p", "id", 3).orderBy("pos").collect()
    assert [r.id for r in got] == [4, 3, 1]


def loop_balanced(rows, limit):
    hosts, channels, left, out = Counter(), Counter(), sorted(rows, key=lambda r: r[4]), []
    while left and len(out) < limit:
        k = min(left, key=lambda r: (hosts[r[1]], not r[3], channels[r[2]], r[4]))
        left.remove(k)
        out.append(k[4])
        hosts[k[1]] += 1
        channels[k[2]] += 1
    return out


def loop_rotating(rows, limit):
    used, left, out = Counter(), sorted(rows, key=lambda r: r[4]), []
    held = {h: min(max([r[5] or 0 for r in rows if r[1] == h] + [0]) // 2, 2) for h in {r[1] for r in rows}}
    while left and len(out) < limit:
        k = min(left, key=lambda r: (used[r[1]] + held[r[1]], r[4]))
        left.remove(k)
        out.append(k[4])
        used[k[1]] += 1
    return out


def loop_penalised(rows, penalty):
    used, out = Counter(), []
    for key in sorted({r[2] for r in rows}):
        k = max(sorted((r for r in rows if r[2] == key), key=lambda r: (-r[6], r[1])), key=lambda r: r[6] - penalty * used[r[1]])
        out.append((k[2], k[1], k[6]))
        used[k[1]] += 1
    return out


def loop_admitted(rows, budget):
    out = []
    for r in sorted(rows, key=lambda r: r[4]):
        if r[6] <= budget:
            budget -= r[6]
            out.append(r[4])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_selections_are_their_loops(spark, seed):
    rng = random.Random(seed)
    hosts, channels, limit = [f"h{i}" for i in range(rng.choice([2, 9, 60]))], range(rng.choice([1, 5, 40])), rng.choice([1, 7, 25])
    rows = [(rng.choice(["g", "g", "k"]), "hot" if rng.random() < 0.4 else rng.choice(hosts), rng.choice(channels), rng.random() < 0.2, i, rng.choice([None, 0, 1, 3, 9]), float(rng.randint(0, 90))) for i in rng.sample(range(5000), 400)]
    frame = spark.createDataFrame(rows, "g string, h string, c int, p boolean, id int, rejected int, score double")

    def told(df, field):
        return {g: [field(r) for r in sorted((r for r in df if r.g == g), key=lambda r: r.pos)] for g in ("g", "k")}

    mine = {g: [r for r in rows if r[0] == g] for g in ("g", "k")}
    assert told(greedy.balanced(frame, "g", "h", "c", "p", "id", limit).collect(), lambda r: r.id) == {g: loop_balanced(v, limit) for g, v in mine.items()}
    assert told(greedy.rotating(frame, "g", "h", "rejected", "id", limit).collect(), lambda r: r.id) == {g: loop_rotating(v, limit) for g, v in mine.items()}
    assert told(greedy.penalised(frame, "g", "c", "h", "score", 13.0).collect(), lambda r: (r.c, r.h, r.score)) == {g: loop_penalised(v, 13.0) for g, v in mine.items()}
    assert told(greedy.admitted(frame, "g", "score", "id", 500.0).collect(), lambda r: r.id) == {g: loop_admitted(v, 500.0) for g, v in mine.items()}
    empty = frame.limit(0)
    for out in (greedy.balanced(empty, "g", "h", "c", "p", "id", 3), greedy.rotating(empty, "g", "h", "rejected", "id", 3), greedy.penalised(empty, "g", "c", "h", "score", 1.0), greedy.admitted(empty, "g", "score", "id", 1.0)):
        assert out.count() == 0


def test_top_up_is_the_loop(spark):
    rng = random.Random(2)
    leaf = ["index.m3u8", "playlist.m3u8", "live.m3u8", "live.m3u8?playlive=1"]
    rows = [(f"c{rng.randint(0, 12)}", f"http://h{rng.choice([0, 0, 0, 1, 2, 3, 4])}.test/{rng.randint(0, 30)}/{rng.choice(leaf)}", rng.randint(0, 40), i, rng.random() < 0.6) for i in range(400)]
    today = [(c, u, 99, 1000 + i, x) for i, (c, u, _, _, x) in enumerate(rng.sample(rows, 10))]
    listed = {c: rng.random() < 0.6 for c in {r[0] for r in rows}}
    rows, today = ([(c, u, last, i, listed[c]) for c, u, last, i, _ in part] for part in (rows, today))
    name = lambda u: u.replace("index.m3u8", "*").replace("playlist.m3u8", "*").replace("?playlive=1", "")
    owners, gone, done = {}, {u for _, u, *_ in today}, {name(u) for _, u, _, _, x in today if x}
    for c, u, *_ in rows:
        owners.setdefault(u, set()).add(c)
    left = sorted((r for r in rows if len(owners[r[1]]) == 1 and r[1] not in gone and not (r[4] and name(r[1]) in done)), key=lambda r: (r[2], r[3]))
    hosts, seen, expected = Counter(), set(), []
    while left and len(expected) < 40:
        k = left.pop(min(range(len(left)), key=lambda i: (hosts[left[i][1].split("/")[2]], i)))
        if k[4] and (k[0], name(k[1])) in seen:
            continue
        seen.add((k[0], name(k[1])))
        expected.append(k[3])
        hosts[k[1].split("/")[2]] += 1
    schema = "channel string, url string, last int, item int, listed boolean"
    got = greedy.topped_up(spark.createDataFrame(rows, schema), spark.createDataFrame(today, schema), "channel", "url", "last", "item", "listed", 40).orderBy("pos").collect()
    assert [r.item for r in got] == expected and len(expected) > 20


def test_gate_order(spark):
    gate = scores.gate([(F.col("id") > 0, "first"), (F.col("id") > 1, "second")])
    assert [r.g for r in spark.range(3).select(gate.alias("g")).collect()] == ["pass", "first", "first"]


def test_schedule_keeps_keys_behind_a_hot_one(spark):
    rows = [(i, "hot") for i in range(50)] + [(100 + i, f"k{i}") for i in range(4)] + [(200, "late")]
    events = spark.createDataFrame(rows, "id int, k string")
    parts = [events.where("id < 200"), events.where("id >= 200 OR k = 'hot'")]
    got = queues.scheduled(parts, "k", [F.col("id")], 5).collect()
    assert [(r.k, r.id, r.priority) for r in got] == [("hot", 0, 0), ("k0", 100, 0), ("k1", 101, 0), ("k2", 102, 0), ("k3", 103, 0)]
    assert [r.k for r in queues.scheduled(parts, "k", [F.col("id")], 9).collect()] == ["hot", "k0", "k1", "k2", "k3", "late"]
    falling = queues.scheduled(parts[:1], "k", [F.desc("id")], 2).collect()
    assert [(r.k, r.id) for r in falling] == [("k3", 103), ("k2", 102)]


def test_route_key(spark):
    from lanewise.functions import urls

    cases = {
        "http://A.test:8080//x//y.m3u8?token=1": "http://a.test:8080/x/y.m3u8", "https://a.test:8080/x/y.m3u8": "https://a.test:8080/x/y.m3u8", "http://a.test": "http://a.test/",
        "http://a.test/a%20b+c": "http://a.test/a b+c", "http://a.test/100%": "http://a.test/100%", "http://u:1@a.test:99999/x": "http://a.test/x", "http://[::1]:81/x": "http://::1:81/x", "rtmp://a.test/x": "",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "url string").select("url", urls.route_key(F.col("url")).alias("k")).collect()
    assert {r.url: r.k for r in rows} == cases
