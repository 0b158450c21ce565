"""State machines that no window can say: rules folded over each key's events in order.

A rule is a start state and a step from (state, event) to (new state, outputs, events to come). In
batch, rows are dealt by key and sorted inside the partitions, and a task steps through them with
the state of one key at a time, so a key of any size needs no more memory. In a stream the same
rules run on keyed state (``lanewise.streaming.keyed``).
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Event = dict[str, Any]
State = dict[str, Any]


ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "boolean": pa.bool_(), "double": pa.float64(), "date": pa.date32(),
    "timestamp": pa.timestamp("us", "UTC"), "timestamp_ntz": pa.timestamp("us"),
}


@dataclass(frozen=True)
class Stepped:
    state: State | None  # None: as if the key had never been seen
    out: list[Event]
    later: list[Event]  # events that the rule itself brings about, at their own time


@dataclass(frozen=True)
class Rule:
    """``order`` are the event fields by which a key's events are taken, the first its time."""

    step: Callable[[State | None, Event], Stepped]
    order: tuple[str, ...]
    events: str  # schema of an event, without the key
    state: str
    out: str  # schema of an output, without the key

    def rank(self, event: Event) -> tuple[Any, ...]:
        return tuple((event[f] is not None, event[f]) for f in self.order)


def drain(rule: Rule, state: State | None, pending: list[Event], upto: datetime | None) -> tuple[State | None, list[Event], list[Event]]:
    """Take pending events up to a time, with those they bring about, in order; ``(state, out, left)``."""
    heap = [(rule.rank(e), n, e) for n, e in enumerate(pending)]
    heapq.heapify(heap)
    out, count = [], len(heap)
    while heap and (upto is None or heap[0][2][rule.order[0]] <= upto):
        _, _, event = heapq.heappop(heap)
        done = rule.step(state, event)
        state = done.state
        out += done.out
        for e in done.later:
            count += 1
            heapq.heappush(heap, (rule.rank(e), count, e))
    return state, out, [e for _, _, e in sorted(heap, key=lambda x: x[:2])]


def folded(events: DataFrame, keys: Sequence[str], rule: Rule) -> DataFrame:
    """Outputs of ``rule`` over each key's events, with the key columns in front.

    Late arrivals do not matter: the whole table is there, so order is by the event. Events without
    a time are left out; a null key is a key. One key's events are stepped through by one task.
    """
    fields = [f.name for f in StructType.fromDDL(rule.events).fields]
    schema = StructType([events.schema[k] for k in keys] + StructType.fromDDL(rule.out).fields)
    arrow = pa.schema([(f.name, ARROW[f.dataType.simpleString()]) for f in schema.fields])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Any, ...] | None = None
        state: State | None = None
        ahead: list[Event] = []
        rows: list[dict[str, Any]] = []

        def emit(out: list[Event]) -> None:
            rows.extend(dict(zip(keys, held, strict=True)) | e for e in out)

        def made() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(rows, schema=arrow)
            rows.clear()
            return batch

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                key, event = values[:width], dict(zip(fields, values[width:], strict=True))
                if key != held:
                    if held is not None:
                        emit(drain(rule, state, ahead, None)[1])
                    held, state, ahead = key, None, []
                rank = rule.rank(event)
                while ahead and rule.rank(ahead[0]) < rank:  # what earlier events brought about comes first
                    done = rule.step(state, ahead.pop(0))
                    state = done.state
                    emit(done.out)
                    ahead = sorted(ahead + done.later, key=rule.rank)
                done = rule.step(state, event)
                state = done.state
                emit(done.out)
                if done.later:
                    ahead = sorted(ahead + done.later, key=rule.rank)
            if rows:
                yield made()
        if held is not None:
            emit(drain(rule, state, ahead, None)[1])
        if rows:
            yield made()

    dealt = events.where(F.col(rule.order[0]).isNotNull()).select(*keys, *fields).repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *rule.order)
    return dealt.mapInArrow(run, schema)
