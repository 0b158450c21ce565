"""Streaming forms: keyed health state by run number, first-wins evidence, batches skipped by receipt."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lanewise.plans.policy import DEFAULT, Policy

HEALTH_OUT = "name string, run long, status string, streak int, effective string"
HEALTH_STATE = "url string, streak int, began double, dead boolean, last long"


IDLE_MS = 30 * 24 * 3600 * 1000


def health_stream(observations: DataFrame, policy: Policy = DEFAULT, idle_ms: int = IDLE_MS) -> DataFrame:
    """The DEAD state machine over a stream ``(name, run, at double, url, status, circuit boolean)``.

    Each micro-batch's rows of a name are put in run order; a row not after the last one seen is
    late and ignored (first wins). The state is one small row a name, which leaves once nothing has
    come for it for ``idle_ms`` of processing time. ``keyed.stream`` with ``rules.health`` is the
    form by event time.
    """

    def step(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        url, streak, began, dead, last = state.get if state.exists else (None, 0, None, False, -(1 << 62))
        out = []
        rows = pd.concat(list(frames)).sort_values("run")
        for r in rows.itertuples():
            if r.run <= last:
                continue
            last = int(r.run)
            if r.url != url or r.status != "UNKNOWN":
                streak, began, dead = 0, None, False
            url = r.url
            if r.status == "UNKNOWN" and not r.circuit:
                streak += 1
                began = float(r.at) if began is None or pd.isna(began) else began
                dead = dead or (streak >= policy.dead_after_runs and r.at - began >= policy.dead_min_age_hours * 3600)
            effective = r.status if r.status != "UNKNOWN" else "DEAD" if dead else "UNKNOWN"
            out.append((key[0], int(r.run), r.status, streak, effective))
        state.update((url, streak, began, dead, last))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["name", "run", "status", "streak", "effective"])

    return observations.groupBy("name").applyInPandasWithState(step, HEALTH_OUT, HEALTH_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def first_evidence(events: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """First event of each key within the watermark; repeats and late ones are dropped."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def slot_counts(events: DataFrame, at: str, width: str, delay: str) -> DataFrame:
    """Events by tumbling window and type, closed by the watermark."""
    return events.withWatermark(at, delay).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n"))


def once(write: Callable[[DataFrame, int], None], receipts: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that skips a batch id whose receipt is there. A stop between the
    write and the receipt repeats the write; ``receipts.Receipts.sink`` does not."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.json(receipts).where(F.col("batch_id") == batch_id).limit(1).count()
        except Exception as e:  # no receipt yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = 0
        if not done:
            write(batch, batch_id)
            spark.createDataFrame([(batch_id,)], "batch_id long").write.mode("append").json(receipts)

    return run
