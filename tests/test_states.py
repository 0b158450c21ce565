"""Health states: cases, batch against a sequential fold, stream against batch."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import states
from lanewise.plans.policy import Policy
from lanewise.streaming import stateful

SCHEMA = "name string, run long, at double, url string, status string, circuit boolean"


def fold(rows, policy):
    memory, out = {}, {}
    for name, run, at, url, status, circuit in sorted(rows, key=lambda r: (r[0], r[1])):
        old_url, streak, began, dead = memory.get(name, (None, 0, None, False))
        if url != old_url or status != "UNKNOWN":
            streak, began, dead = 0, None, False
        if status == "UNKNOWN" and not circuit:
            streak += 1
            began = at if began is None else began
            dead = dead or (streak >= policy.dead_after_runs and at - began >= policy.dead_min_age_hours * 3600)
        memory[name] = url, streak, began, dead
        out[name, run] = streak, status if status != "UNKNOWN" else "DEAD" if dead else "UNKNOWN"
    return out


def random_rows(seed, n=120):
    rng = random.Random(seed)
    return [(f"n{rng.randint(0, 5)}", i, i * 3600.0 * rng.choice([1, 2]), rng.choice("uuuv"), rng.choice(["UNKNOWN"] * 4 + ["GOOD", "DEGRADED"]), rng.random() < 0.1) for i in range(n)]


@pytest.mark.parametrize(
    ("hours", "statuses", "urls", "last"),
    [
        ([0, 4, 8], ["UNKNOWN"] * 3, "aaa", ("DEAD", 3)),
        ([0, 1, 2], ["UNKNOWN"] * 3, "aaa", ("UNKNOWN", 3)),
        ([0, 4], ["UNKNOWN", "DEGRADED"], "aa", ("DEGRADED", 0)),
        ([0, 4, 8], ["UNKNOWN"] * 3, "aab", ("UNKNOWN", 1)),
        ([0, 4, 8, 12], ["UNKNOWN"] * 3 + ["GOOD"], "aaaa", ("GOOD", 0)),
    ],
)
def test_cases(spark, hours, statuses, urls, last):
    rows = [("n", i, h * 3600.0, u, s, False) for i, (h, s, u) in enumerate(zip(hours, statuses, urls, strict=True))]
    got = states.dead_states(spark.createDataFrame(rows, SCHEMA), "name", "run", F.col("at"), "url", "status", "circuit").orderBy(F.desc("run")).first()
    assert (got.effective, got.streak) == last


@pytest.mark.parametrize("seed", range(4))
def test_batch_equals_fold(spark, seed):
    rows = random_rows(seed)
    got = states.dead_states(spark.createDataFrame(rows, SCHEMA), "name", "run", F.col("at"), "url", "status", "circuit").collect()
    assert {(r.name, r.run): (r.streak, r.effective) for r in got} == fold(rows, Policy())


def test_stream_equals_fold(spark, tmp_path):
    rows = random_rows(9, 60)
    for i in range(0, 60, 20):
        spark.createDataFrame(rows[i : i + 20], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    query = stateful.health_stream(stream).writeStream.format("memory").queryName("health").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    expected = fold(rows, Policy())
    got = {(r.name, r.run): (r.streak if r.status == "UNKNOWN" else 0, r.effective) for r in spark.table("health").collect()}
    assert got == expected


def test_two_attempts(spark):
    rows = [("a", 1, "GOOD"), ("b", 1, "BADX"), ("b", 2, "GOOD"), ("c", 1, "BADX"), ("c", 2, "BADX"), ("d", 1, "BADX")]
    df = spark.createDataFrame(rows, "k string, n int, s string")
    got = {r.k: r.verdict for r in states.two_attempts(df, ["k"], [F.col("n")], F.col("s") == "GOOD", F.col("s") == "BADX").collect()}
    assert got == {"a": "GOOD", "b": "UNKNOWN", "c": "BAD", "d": "UNKNOWN"}


def test_once_skips_a_replayed_batch(spark, tmp_path):
    seen = []
    run = stateful.once(lambda batch, i: seen.append((i, batch.count())), str(tmp_path / "receipts"))
    for i in (0, 0, 1):
        run(spark.range(3), i)
    assert seen == [(0, 3), (1, 3)]
