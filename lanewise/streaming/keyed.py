"""The rules of ``lanewise.operators.rules`` on a stream, in event-time order.

Rows wait in keyed state until the watermark has passed them, so the order of arrival within the
watermark's delay does not matter and results equal those of the batch fold. Timers wake a key at
its rows' times, at the times of events that the rule itself brings about (a lease that expires),
and once it has been idle for long enough, when its state is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lanewise.operators.folds import Rule, drain

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _ms(at: datetime) -> int:
    return -(-(at - EPOCH) // timedelta(milliseconds=1))


def _zoned(value: Any) -> Any:
    """Times from state come without a zone, in the worker's, and those of rows with one: all in UTC."""
    if isinstance(value, datetime):
        return value.astimezone(UTC)
    return {k: _zoned(v) for k, v in value.items()} if isinstance(value, dict) else value


class Folding(StatefulProcessor):
    def __init__(self, rule: Rule, keys: list[str], idle: timedelta | None) -> None:
        self.rule, self.keys, self.idle = rule, keys, idle
        self.fields = StructType.fromDDL(rule.events).names
        self.parts = StructType.fromDDL(rule.state).names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.rule.state)
        self.pending = handle.getListState("pending", self.rule.events)
        self.last = handle.getValueState("last", "at timestamp")

    def _load(self) -> dict[str, Any] | None:
        return _zoned(dict(zip(self.parts, self.state.get(), strict=True))) if self.state.exists() else None

    def _last(self) -> datetime | None:
        return _zoned(self.last.get()[0]) if self.last.exists() else None

    def _wait(self, event: dict[str, Any]) -> None:
        self.pending.appendValue(tuple(event[f] for f in self.fields))
        self.handle.registerTimer(_ms(event[self.rule.order[0]]))

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest = self._last()
        for row in rows:
            event = _zoned({f: row[f] for f in self.fields})
            self._wait(event)
            latest = max(filter(None, (latest, event[self.rule.order[0]])))
        self.last.update((latest,))
        if self.idle:
            self.handle.registerTimer(_ms(latest + self.idle))
        return iter(())

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = EPOCH + timedelta(milliseconds=expiredTimerInfo.getExpiryTimeInMs())
        events = [_zoned(dict(zip(self.fields, e, strict=True))) for e in self.pending.get()] if self.pending.exists() else []
        due = [e for e in events if e[self.rule.order[0]] <= now]
        if due:
            state, out, ahead = drain(self.rule, self._load(), due, now)
            self.pending.clear()
            for e in events:
                if e[self.rule.order[0]] > now:
                    self.pending.appendValue(tuple(e[f] for f in self.fields))
            for e in ahead:
                self._wait(e)
            if state is None:
                self.state.clear()
            else:
                self.state.update(tuple(state[p] for p in self.parts))
            for o in out:
                yield Row(**dict(zip(self.keys, key, strict=True)), **o)
        latest = self._last()
        if self.idle and latest and latest + self.idle <= now and not self.pending.exists():
            self.state.clear()
            self.last.clear()

    def close(self) -> None:
        pass


def stream(events: DataFrame, keys: list[str], rule: Rule, delay: str, idle: timedelta | None = None) -> DataFrame:
    """Outputs of ``rule`` over a stream of events, each once the watermark has passed it.

    Rows that arrive after the watermark are ignored: first wins. With ``idle`` a key without an
    event for that long leaves the state; if it comes back it starts anew. The session's state
    store must be RocksDB (``PROVIDER``).
    """
    schema = StructType([events.schema[k] for k in keys] + StructType.fromDDL(rule.out).fields)
    waiting = events.where(F.col(rule.order[0]).isNotNull()).withWatermark(rule.order[0], delay).select(*keys, *StructType.fromDDL(rule.events).names)
    return waiting.groupBy(*keys).transformWithState(Folding(rule, keys, idle), schema, "append", "eventTime")
