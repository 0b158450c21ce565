"""Receipts stopped between any two steps, torn journals, tied snapshots, bounded histories, the production step."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lanewise.operators import snapshots
from lanewise.plans import production
from lanewise.plans.policy import Policy
from lanewise.sources import journal
from lanewise.sources.receipts import Receipts

STEPS = ["begun", "staged a", "staged b", "drafted", "committed"]


@pytest.mark.parametrize("stop", STEPS)
def test_a_publication_stopped_at_any_step_is_whole_or_absent(spark, tmp_path, stop):
    receipts = Receipts(spark, str(tmp_path))
    tables = {"a": spark.range(5), "b": spark.range(7)}
    receipts.publish("first", {"a": spark.range(100, 102)})

    def fail(name):
        if name == stop:
            raise RuntimeError(name)

    with pytest.raises(RuntimeError, match=stop):
        receipts.publish("second", tables, step=fail)
    assert receipts.read("a").count() == (7 if stop == "committed" else 2)
    assert receipts.publish("second", tables) is (stop != "committed")
    assert receipts.read("a").count() == 7 and receipts.read("b", "second").count() == 7
    assert receipts.publish("second", tables) is False
    assert receipts.sweep() == (0 if stop in ("begun", "committed") else 2 if stop == "drafted" else 1)
    assert receipts.read("a").count() == 7


def test_receipts_order_batches(spark, tmp_path):
    receipts = Receipts(spark, str(tmp_path))
    assert receipts.status("2024-01-02", "x") == "new"
    receipts.publish(1, {"t": spark.range(1)}, "2024-01-02", "x")
    assert [receipts.status(s, g) for s, g in (("2024-01-01", "y"), ("2024-01-02", "x"), ("2024-01-03", "z"))] == ["older", "duplicate", "new"]
    with pytest.raises(ValueError, match="other content"):
        receipts.status("2024-01-02", "y")
    with pytest.raises(FileNotFoundError):
        receipts.read("absent")


def test_a_stream_restarted_publishes_each_batch_once(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    receipts, crashes = Receipts(spark, str(tmp_path / "out")), [True]

    def sink(batch, n):
        receipts.sink("t")(batch, n)
        if n == 1 and crashes.pop():
            crashes.append(False)
            raise RuntimeError("after the receipt, before the stream's own commit")

    def start():
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        return stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    with pytest.raises(Exception, match="after the receipt"):
        start().awaitTermination(120)
    start().awaitTermination(120)
    assert sorted(r.id for r in receipts.read("t").collect()) == list(range(30))


RECORD = "id string, n long"


def line(i, n):
    return json.dumps({"id": i, "n": n})


def test_torn_tails_are_dropped_and_broken_middles_raise(spark, tmp_path):
    whole = [line(f"k{i % 7}", i) for i in range(500)]
    (tmp_path / "1.jsonl").write_text("\n".join(whole) + "\n")
    (tmp_path / "2.jsonl").write_text("\n".join([line("k1", 900), line("k9", 901)]) + "\n" + line("k2", 902)[:9])
    (tmp_path / "3.jsonl").write_text(line("k3", 903))  # complete, but for the line feed: it will be written again
    (tmp_path / "4.jsonl").write_bytes(line("k4", 904).encode() + b"\n" + '{"id": "é'.encode()[:-1])
    (tmp_path / "5.jsonl").write_text("")
    got = {r.id: r.n for r in journal.replayed(journal.replayable(spark, str(tmp_path), RECORD), "id").collect()}
    expected = {f"k{i % 7}": i for i in range(500)} | {"k1": 900, "k9": 901, "k4": 904}
    assert got == expected
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")  # several blocks a file
    try:
        assert {r.id: r.n for r in journal.replayed(journal.replayable(spark, str(tmp_path), RECORD), "id").collect()} == expected
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for broken in ('{"id": "k', "[1]", "", '{"id": 1, "n": "x"}'):
        (tmp_path / "6.jsonl").write_text("\n".join([line("k1", 1), broken, line("k2", 2)]) + "\n")
        with pytest.raises(Exception, match="broken journal line"):
            journal.replayable(spark, str(tmp_path), RECORD).collect()
    (tmp_path / "6.jsonl").write_text(line("k1", 1) + "\n" + '{"id":' + "\n")  # the last line, but a complete one
    with pytest.raises(Exception, match="broken journal line"):
        journal.replayable(spark, str(tmp_path), RECORD).collect()


def test_snapshot_choice(spark):
    told = {
        "one": {(1, "a"): "xy", (2, "b"): "x"}, "superset": {(3, "a"): "x", (3, "b"): "xyz", (3, "c"): "yz"}, "tied": {(3, "a"): "xy", (3, "b"): "yz"},
        "three": {(3, "a"): "xy", (3, "b"): "yz", (3, "c"): "xz"}, "twin": {(3, "a"): "xy", (3, "b"): "yx"}, "old": {(2, "a"): "xyz", (3, "b"): "x"},
    }
    rows = [(g, stamp, s, item) for g, v in told.items() for (stamp, s), items in v.items() for item in items * 2]
    frame = spark.createDataFrame(rows, "g string, stamp int, s string, item string")
    args = ("g", "stamp", "s", F.col("item"))
    got = {r.g: (r.s, r.n_items, r.ties, r.problem) for r in snapshots.choice(frame, *args).collect()}
    assert got == {"one": ("b", 1, 1, None), "superset": ("b", 3, 3, None), "tied": (None, 3, 2, "tied"), "three": (None, 3, 3, "tied"), "twin": (None, 2, 2, "twin"), "old": ("b", 1, 1, None)}
    assert snapshots.chosen(frame.where("g IN ('one', 'superset', 'old')"), *args).count() == 3
    with pytest.raises(Exception, match="several snapshots"):
        snapshots.chosen(frame, *args).collect()
    assert snapshots.choice(frame.limit(0), *args).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_history_is_the_newest_whatever_the_order(spark, seed):
    rng = random.Random(seed)
    reports = [(k, s, f"{k}-{s}") for k in ("a", "b", None) for s in range(60 if k == "a" else 20)]
    arrivals = reports + rng.choices(reports, k=40)
    rng.shuffle(arrivals)
    held = spark.createDataFrame([], "k string, stamp int, digest string")
    for at in range(0, len(arrivals), 70):
        held = snapshots.received(held, spark.createDataFrame(arrivals[at : at + 70], held.schema), "k", "stamp", "digest")
    assert sorted(map(str, (tuple(r) for r in held.collect()))) == sorted(str(r) for r in reports if r[0] != "a" or r[1] >= 20)
    with pytest.raises(Exception, match="other content"):
        snapshots.received(held, spark.createDataFrame([("a", 59, "changed")], held.schema), "k", "stamp", "digest").collect()


FORMAL = [(f"f{i}", f"http://f/{i}") for i in range(3)]
MANIFEST = [(f"c{i}", f"http://c/{i}", 9 - i) for i in range(6)]
LIMITS = Policy(daily_candidates=4, daily_amount=5 * 64 * 1024 * 1024)


class Loop:
    """The same steps, one at a time on plain dictionaries."""

    def __init__(self):
        self.queue, self.tested, self.leases, self.results, self.slots = {}, {}, [], {}, set()
        self.cycle, self.day, self.spent, self.candidates, self.out, self.version = "", "", 0, 0, None, 0

    def step(self, now, formal, manifest, told):
        local = now + timedelta(hours=8)
        name = next((n for a, b, n in ((2, 11, "morning"), (13, 16, "noon"), (20, 23, "peak")) if a <= local.hour < b), None)
        slot, before = name and f"{local:%Y%m%d}-{name}", self.cycle
        if slot:
            self.cycle = (slot, tuple(sorted(formal)))
        for batch, task, url, verdict, at in sorted(told, key=lambda o: (o[4], o[0])):
            role = next((role for c, b, t, role, u, _ in self.leases if (c, b, t, u) == (before, batch, task, url)), None)
            if role and (before, task) not in self.results:
                self.results[before, task] = verdict
                if role == "candidate":
                    self.tested[task] = verdict
        self.queue |= {c: (p, u) for c, u, p in manifest}
        self.queue = {c: v for c, v in self.queue.items() if c not in self.tested}
        if self.day != f"{local:%Y%m%d}":
            self.day, self.spent, self.candidates = f"{local:%Y%m%d}", 0, 0
        if self.cycle != before:
            self.out = None
        self.version += 1
        if slot is None:
            return "WAITING_WINDOW"
        if slot in self.slots:
            return "SLOT_COMPLETE"
        if self.out:
            if any(b == self.out and e > now and (self.cycle, t) not in self.results for _, b, t, _, _, e in self.leases):
                return "OUTSTANDING"
            self.out = None
        unseen = sorted((p, c, u) for c, (p, u) in self.queue.items())[: max(0, LIMITS.daily_candidates - self.candidates)]
        tasks = [(k, u, "current") for k, u in sorted(formal)] + [(c, u, "candidate") for _, c, u in unseen]
        tasks = [t for t in tasks if (self.cycle, t[0]) not in self.results][:2]
        if not tasks:
            self.slots.add(slot)
            return "SLOT_COMPLETE"
        if self.spent + 64 * 1024 * 1024 > LIMITS.daily_amount:
            return "WAITING_BUDGET"
        self.spent += 64 * 1024 * 1024
        self.candidates += sum(t[2] == "candidate" for t in tasks)
        self.out = self.version
        self.leases += [(self.cycle, self.version, k, role, u, now + timedelta(seconds=LIMITS.leased_s)) for k, u, role in tasks]
        return "LEASED"


def test_a_day_of_steps_is_the_loop(spark, tmp_path):
    receipts, loop, rng = Receipts(spark, str(tmp_path)), Loop(), random.Random(4)
    production.begin(receipts, spark)
    now, formal, said = datetime(2024, 1, 1, 18, 30, tzinfo=UTC), FORMAL, []
    plan = [(0, []), (20, ["f0"]), (10, ["f1", "f0"]), (15, []), (40, ["f2"]), (10, ["c5"]), (60, ["c4", "c5"]), (300, ["c3"]), (10, []), (60, ["f0"]), (300, [])]
    names = {}
    for version, (minutes, tasks) in enumerate(plan):
        now += timedelta(minutes=minutes)
        if version == 9:
            formal = [*FORMAL[:2], ("f2", "http://f/new")]  # another cycle: old results no longer count
        rows = []
        for c, b, t, role, u, _ in loop.leases:
            if t in tasks:
                rows.append((b, t, u, rng.choice(["GOOD", "BAD"]), now - timedelta(minutes=1)))
        rows += [(99, "f0", "http://f/0", "GOOD", now - timedelta(minutes=2)), (1, "f0", "http://other", "BAD", now - timedelta(minutes=3))]  # unknown batch, wrong route
        told = spark.createDataFrame([(names.get(b, "none"), t, u, v, at) for b, t, u, v, at in rows], "batch string, task string, url string, verdict string, at timestamp")
        inputs = production.Inputs(now, spark.createDataFrame(formal, "key string, url string"), spark.createDataFrame(MANIFEST, "candidate string, url string, priority long"), told, batch_tasks=2)
        said.append(loop.step(now, formal, MANIFEST, rows))
        state = production.advance(receipts, version, inputs, LIMITS)
        clock = state["clock"].first()
        assert clock.said == said[-1], version
        assert (clock.spent, clock.candidates) == (loop.spent, loop.candidates)
        if clock.said == "LEASED":
            names[loop.version] = clock.outstanding
        assert sorted((r.task, r.verdict) for r in state["results"].collect()) == sorted((t, v) for (_, t), v in loop.results.items())
        assert {r.candidate: r.verdict for r in state["tested"].collect()} == loop.tested
        assert {r.candidate for r in state["queue"].collect()} == set(loop.queue)
        assert sorted(r.task for r in state["leases"].collect()) == sorted(x[2] for x in loop.leases)
        again = production.advance(receipts, version, inputs, LIMITS)  # run again: the version is there
        assert again["clock"].first() == clock
    assert {"LEASED", "OUTSTANDING", "WAITING_WINDOW"} <= set(said)
    assert production.history(receipts).count() == len(plan) + 1
