"""One production step as a transition between versions of a few tables, and its replay.

A version is the tables that one receipt names: ``queue`` (candidates waiting), ``tested``,
``leases`` (tasks handed out), ``results`` (first result of a task in a cycle), ``slots`` (done) and
``clock`` (one row: cycle, ledger, what the step decided). A step reads one version and its own
inputs, and publishes the next; a step that is run again finds its receipt and changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions import times
from lanewise.plans.policy import DEFAULT, Policy
from lanewise.session import cut
from lanewise.sources.receipts import Receipts

TABLES = {
    "queue": "candidate string, url string, priority long",
    "tested": "candidate string, verdict string, at timestamp",
    "leases": "cycle string, batch string, task string, role string, url string, expires timestamp",
    "results": "cycle string, task string, batch string, url string, verdict string, at timestamp",
    "slots": "slot string",
    "clock": "version long, at timestamp, cycle string, day string, spent long, spent_seconds long, candidates long, outstanding string, said string",
}


@dataclass(frozen=True)
class Inputs:
    """What a step sees: ``formal(key, url)``, ``manifest(candidate, url, priority)``, ``observations(batch,
    task, url, verdict, at)``; and how many tasks a batch holds, with the amount and seconds it reserves."""

    now: datetime
    formal: DataFrame
    manifest: DataFrame
    observations: DataFrame
    batch_tasks: int = 4
    batch_amount: int = 64 * 1024 * 1024
    batch_seconds: int = 240


def begin(receipts: Receipts, spark: SparkSession) -> None:
    """Version 0: empty tables."""
    empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
    empty["clock"] = spark.createDataFrame([(0, None, "", "", 0, 0, 0, None, "NEW")], TABLES["clock"])
    receipts.publish(0, empty)


def _ingested(state: dict[str, DataFrame], seen: DataFrame, cycle: str) -> tuple[DataFrame, DataFrame]:
    """New results of the cycle and newly tested candidates. A result counts if its batch was leased
    for that task and route; of several the first stands, and an earlier step's stands always."""
    leased = state["leases"].where(F.col("cycle") == cycle)
    known = seen.join(leased.select("cycle", "batch", "task", "role", "url"), ["batch", "task", "url"])
    first = known.groupBy("cycle", "task").agg(F.min_by(F.struct("batch", "url", "verdict", "at", "role"), F.struct("at", "batch")).alias("r"))
    fresh = first.join(state["results"].select("cycle", "task"), ["cycle", "task"], "left_anti")
    results = fresh.select("cycle", "task", "r.batch", "r.url", "r.verdict", "r.at")
    return results, fresh.where("r.role = 'candidate'").select(F.col("task").alias("candidate"), "r.verdict", "r.at")


def _digest(spark: SparkSession, formal: DataFrame, slot: str) -> str:
    """The cycle's identity: its slot and the formal routes, in any order."""
    routes = formal.select(F.xxhash64("key", "url").alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h") % 1_000_003)).first()
    return spark.range(1).select(F.sha2(F.lit(f"{slot}|{tuple(routes)}"), 256)).first()[0]


def step(state: dict[str, DataFrame], inputs: Inputs, policy: Policy = DEFAULT) -> dict[str, DataFrame]:
    """The next version of all tables. What it counts on the driver is one row a table."""
    spark = inputs.formal.sparkSession
    clock = state["clock"].first()
    at = spark.range(1).select(times.slot(F.lit(inputs.now)).alias("slot"), F.date_format(F.lit(inputs.now) + F.expr("INTERVAL 8 HOURS"), "yyyyMMdd").alias("day")).first()
    cycle = _digest(spark, inputs.formal, at.slot) if at.slot else clock.cycle
    new_cycle = cycle != clock.cycle

    results, tested = _ingested(state, inputs.observations, clock.cycle)
    results, tested = cut(state["results"].unionByName(results)), cut(state["tested"].unionByName(tested))
    waiting = state["queue"].join(inputs.manifest, "candidate", "left_anti").unionByName(inputs.manifest)
    queue = cut(waiting.join(tested, "candidate", "left_anti"))
    next_state = state | {"results": results, "tested": tested, "queue": queue}
    spent, seconds, candidates = (clock.spent, clock.spent_seconds, clock.candidates) if clock.day == at.day else (0, 0, 0)
    outstanding = None if new_cycle else clock.outstanding

    def end(said: str, **changed: DataFrame) -> dict[str, DataFrame]:
        row = (clock.version + 1, inputs.now, cycle, at.day, spent, seconds, candidates, outstanding, said)
        return next_state | changed | {"clock": spark.createDataFrame([row], TABLES["clock"])}

    if at.slot is None:
        return end("WAITING_WINDOW")
    if state["slots"].where(F.col("slot") == at.slot).limit(1).count():
        return end("SLOT_COMPLETE")
    mine = results.where(F.col("cycle") == cycle).select("task")
    if outstanding:
        open_tasks = state["leases"].where((F.col("batch") == outstanding) & (F.col("expires") > F.lit(inputs.now))).join(mine, "task", "left_anti")
        if open_tasks.limit(1).count():
            return end("OUTSTANDING")
        outstanding = None
    current = inputs.formal.select(F.col("key").alias("task"), "url", F.lit("current").alias("role"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("priority"))
    room = max(0, policy.daily_candidates - candidates)
    unseen = queue.select(F.col("candidate").alias("task"), "url", F.lit("candidate").alias("role"), F.lit(1).alias("part"), "priority").orderBy("priority", "task").limit(room)
    tasks = current.unionByName(unseen).join(mine, "task", "left_anti").orderBy("part", "priority", "task").limit(inputs.batch_tasks)
    tasks = cut(tasks)
    taken = tasks.agg(F.count("*").alias("n"), F.count_if(F.col("role") == "candidate").alias("c")).first()
    if not taken.n:
        return end("SLOT_COMPLETE", slots=state["slots"].unionByName(spark.createDataFrame([(at.slot,)], TABLES["slots"])))
    if spent + inputs.batch_amount > policy.daily_amount or seconds + inputs.batch_seconds > policy.daily_seconds:
        return end("WAITING_BUDGET")
    spent, seconds, candidates = spent + inputs.batch_amount, seconds + inputs.batch_seconds, candidates + taken.c
    outstanding = f"{cycle[:12]}-{clock.version + 1}"
    expires = inputs.now + timedelta(seconds=policy.leased_s)
    leased = tasks.select(F.lit(cycle).alias("cycle"), F.lit(outstanding).alias("batch"), "task", "role", "url", F.lit(expires).alias("expires"))
    return end("LEASED", leases=state["leases"].unionByName(leased))


def advance(receipts: Receipts, version: int, inputs: Inputs, policy: Policy = DEFAULT) -> dict[str, DataFrame]:
    """Publish version ``version`` + 1 from ``version`` unless it is there, and return it."""
    if not receipts.committed(version + 1):
        state = {name: receipts.read(name, version) for name in TABLES}
        receipts.publish(version + 1, step(state, inputs, policy))
    return {name: receipts.read(name, version + 1) for name in TABLES}


def history(receipts: Receipts) -> DataFrame:
    """What every step decided, a row a version."""
    return receipts.read("clock")
