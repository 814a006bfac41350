"""Stateful processors: folds over rows in event-time order, with typed state, timers and expiry.

A key's rows wait until the watermark has passed them; then they go through the same steps as in
batch, in order, whatever batches they came in. What a step leaves to be done at a time becomes a
timer. Keys with nothing left have no state.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import gate, idempotency

#: Timers and typed states need this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A key's rows wait by slots of so much time, of which one is in memory at a time, and are taken in so many at a time.
SLOT_MS, TOGETHER = 3_600_000, 200_000


def use_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


class InOrder(StatefulProcessor):
    """A fold over each key's rows in the order of ``order``, of which the first is the time in milliseconds.

    Subclasses give ``outputs`` (names), ``load`` and ``dump`` between a state and its row, ``step``, and
    ``ends``: what happens up to a time without any row. ``due`` tells when that is next.
    """

    outputs: Sequence[str] = ()
    state_schema = ""

    def __init__(self, waiting_schema: str, order: Sequence[str], key_names: Sequence[str]):
        self.waiting_schema, self.order, self.key_names = waiting_schema, list(order), list(key_names)
        fields = [c.split() for c in waiting_schema.split(", ")]
        self.columns = [c.strip("`") for c, _ in fields]
        self.whole = [kind in ("long", "bigint", "int", "integer", "short", "smallint", "byte", "tinyint") for _, kind in fields]

    def load(self, row: tuple | None) -> Any:
        raise NotImplementedError

    def dump(self, state: Any) -> tuple | None:
        """None if nothing is left."""
        raise NotImplementedError

    def step(self, state: Any, row: tuple) -> Iterator[tuple]:
        raise NotImplementedError

    def ends(self, state: Any, until_ms: int) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self, state: Any) -> int | None:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, n long", "rows binary")
        self.held = handle.getValueState("held", self.state_schema)
        self.armed = handle.getValueState("armed", "at_ms long, n long")

    def _arm(self, times: list[int], n: int) -> None:
        """A key has one timer: for the first row that waits, or what ends before. ``n``: how often rows have been put by."""
        if not times:
            return
        before = self.armed.get()[0] if self.armed.exists() else None
        if before is None or min(times) < before:
            self.handle.registerTimer(min(times))
            before = min(times)
        self.armed.update((before, n))

    def _rows(self, part: pd.DataFrame) -> Iterator[tuple]:
        columns = []
        for c, whole in zip(self.columns, self.whole, strict=True):
            values, gone = part[c].tolist(), part[c].isna()
            if gone.any():
                values = [None if n else int(x) if whole else x for x, n in zip(values, gone, strict=True)]
            columns.append(values)
        return zip(*columns, strict=True)

    def _wait(self, rows: list[tuple]) -> None:
        """Rows are put by as one value for each slot that they are of."""
        n, at = self.armed.get()[1] if self.armed.exists() else 0, self.columns.index(self.order[0])
        rows.sort(key=itemgetter(at))
        for slot, own in groupby(rows, lambda r: r[at] // SLOT_MS):
            self.waiting.updateValue((slot, n), (pickle.dumps(list(own), protocol=5),))
        self._arm([rows[0][at] + 1], n + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = []
        for part in rows:
            held += self._rows(part)
            if len(held) >= TOGETHER:
                self._wait(held)
                held = []
        if held:
            self._wait(held)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        at, order = self.columns.index(self.order[0]), itemgetter(*(self.columns.index(c) for c in self.order))
        state, times = self.load(tuple(self.held.get()) if self.held.exists() else None), []

        def table(out: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame([(*key, *x) for x in out], columns=[*self.key_names, *self.outputs])

        for slot, places in groupby(sorted(tuple(k) for k in self.waiting.keys()), itemgetter(0)):
            places = list(places)
            waiting = sorted((r for p in places for r in pickle.loads(self.waiting.getValue(p)[0])), key=order)
            later = [r for r in waiting if r[at] >= now]
            ready = waiting[: len(waiting) - len(later)]
            if ready:
                for p in places:
                    self.waiting.removeKey(p)
                if later:
                    self.waiting.updateValue(places[0], (pickle.dumps(later, protocol=5),))
                out = [x for r in ready for x in self.step(state, r)]
                if out:
                    yield table(out)
            if later:
                times = [later[0][at] + 1]
                break
        out = list(self.ends(state, now))
        kept = self.dump(state)
        if kept is None:
            self.held.clear()
        else:
            self.held.update(kept)
            times.append(max(self.due(state), now + 1))
        n = self.armed.get()[1] if self.armed.exists() else 0
        self.armed.clear()
        self._arm(times, n)
        if out:
            yield table(out)

    def close(self) -> None:
        pass


class Gate(InOrder):
    """``operators.gate`` on a stream."""

    outputs = gate.OUTPUTS

    def __init__(self, captures: DataFrame, limits: gate.Limits):
        kinds = dict(captures.dtypes)
        fields = [f"{c} {kinds[c]}" for c in gate.COLUMNS]
        super().__init__(", ".join(fields), ["received_ms", "utterance_id"], ["room"])
        self.limits = limits
        self.state_schema = f"pending array<struct<{','.join(f.replace(' ', ':') for f in fields)}>>"

    def load(self, row):
        return [gate.Capture(*x) for x in row[0]] if row else []

    def dump(self, state):
        return ([tuple(x) for x in state],) if state else None

    def step(self, state, row):
        return gate.arrived(state, gate.Capture(*row), self.limits)

    def ends(self, state, until_ms):
        return gate.due(state, until_ms, self.limits)

    def due(self, state):
        return state[0].received_ms + self.limits.hold_ms + 1


class Requests(InOrder):
    """``operators.idempotency.Key`` on a stream."""

    outputs = idempotency.RESOLVED
    state_schema = idempotency.STATE

    def __init__(self, ttl_ms: int, lease_ms: int):
        super().__init__("at_ms long, seq long, kind string, request_id string, fingerprint string, ok boolean", ["at_ms", "seq"], ["key"])
        self.ttl_ms, self.lease_ms = ttl_ms, lease_ms

    def load(self, row):
        return idempotency.Key(*row[:3], list(row[3]), *row[4:]) if row else idempotency.Key()

    def dump(self, state):
        return None if state.idle() else (state.fingerprint, state.leader, state.since_ms, state.waiters, state.answered_by, state.until_ms)

    def step(self, state, row):
        at_ms, _, kind, request, fingerprint, ok = row
        return state.take(kind, request, fingerprint, at_ms, ok, self.ttl_ms, self.lease_ms)

    def ends(self, state, until_ms):
        # A row of this very time may still come: it is looked at before what ends then.
        return state.elapse(until_ms - 1, self.lease_ms)

    def due(self, state):
        return state.next_ms(self.lease_ms) + 1


def gate_stream(captures: DataFrame, limits: gate.Limits = gate.LIMITS) -> DataFrame:
    """``gate.gated`` on a stream of captures (room, gate.COLUMNS and a timestamp with a watermark): room and gate.OUTPUTS.

    A group leaves when the watermark has passed the end of its hold. Captures behind the watermark take
    no part; ``late.split`` keeps them apart before.
    """
    use_store(captures.sparkSession)
    kind = dict(captures.dtypes)["room"]
    return captures.groupBy("room").transformWithStateInPandas(Gate(captures, limits), f"room {kind}, {gate.kinds(captures)}", "Append", "EventTime")


def resolved_stream(events: DataFrame, ttl_ms: int = idempotency.TTL_MS, lease_ms: int = idempotency.LEASE_MS) -> DataFrame:
    """``idempotency.resolved`` on a stream of events with a timestamp and a watermark. Answers expire with event time, and their state goes."""
    use_store(events.sparkSession)
    kind = dict(events.dtypes)["key"]
    return events.groupBy("key").transformWithStateInPandas(Requests(ttl_ms, lease_ms), f"key {kind}, {idempotency.RESOLVED_KINDS}", "Append", "EventTime")
