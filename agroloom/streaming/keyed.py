"""Keyed state in event-time order: one step function serves a stream and a batch alike.

A step takes (row, state) and returns (output, state after it); rows and states are plain dictionaries, a new key's state
is None. The stream holds rows back until the watermark has passed them and then takes them in order of time, so what
arrives shuffled is answered as if it had come in order. Rows later than the watermark allows are dropped, as everywhere in
Structured Streaming. A key that was silent for ``forget_ms`` starts anew, in the batch as in the stream, where a timer
removes what is held of it. Rows without a time are left out by both.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

Step = Callable[[dict, dict | None], tuple[dict, dict]]


def unpacked(frame: pd.DataFrame) -> Iterator[tuple[dict, int, int, str]]:
    """(row, milliseconds, place among equal times, row as it is kept) of packed rows; a missing value has no entry."""
    for at, ord_, row in zip(frame["at_ms"], frame["ord_no"], frame["packed"], strict=True):
        yield json.loads(row), int(at), int(ord_), row


def stepped(step: Step, row: dict, at: int, ord_: int, state: dict | None, last: int | None, forget_ms: int | None) -> tuple[dict, dict]:
    """One step, from nothing where the key was silent for too long; the step finds time and place among equal times as
    ``at_ms`` and ``ord_no``."""
    row["at_ms"], row["ord_no"] = at, ord_
    return step(row, None if forget_ms is not None and last is not None and at - last >= forget_ms else state)


class InOrder(StatefulProcessor):
    """Rows wait, keyed by time and place in the input, until the watermark passes; one timer a key is set at a time: for
    the earliest waiting row, else for the moment of forgetting."""

    def __init__(self, step: Step, names: list[str], forget_ms: int | None):
        self.step, self.names, self.forget_ms = step, names, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, ord long, copy long", "row string")
        self.held = handle.getValueState("held", "state string, last long")
        self.timer = handle.getValueState("timer", "at long")

    def wake_at(self, moment: int | None) -> None:
        now = self.timer.get()[0] if self.timer.exists() else None
        if now == moment:
            return
        if now is not None:
            self.handle.deleteTimer(now)
            self.timer.clear()
        if moment is not None:
            self.handle.registerTimer(moment)
            self.timer.update((moment,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, mark = None, timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            for _, at, ord_, row in unpacked(frame):
                if at < mark:  # what lies there was answered: the engine's own filter is one batch behind
                    continue
                copy = 0
                while self.waiting.containsKey((at, ord_, copy)):
                    copy += 1
                self.waiting.updateValue((at, ord_, copy), (row,))
                first = at if first is None else min(first, at)
        pending = self.timer.get()[0] if self.timer.exists() else None
        last = self.held.get()[1] if self.held.exists() else None
        forgetting = pending is not None and self.forget_ms is not None and last is not None and pending == last + self.forget_ms
        if first is not None:
            self.wake_at(first if pending is None or forgetting else min(first, pending))
        yield pd.DataFrame(columns=self.names, dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        state, last = (json.loads(self.held.get()[0]), self.held.get()[1]) if self.held.exists() else (None, None)
        places = sorted(tuple(k) for k in self.waiting.keys())
        out = []
        for place in (p for p in places if p[0] < mark):
            row = json.loads(self.waiting.getValue(place)[0])
            answer, state = stepped(self.step, row, place[0], place[1], state, last, self.forget_ms)
            last = place[0]
            out.append(answer)
            self.waiting.removeKey(place)
        later = [p[0] for p in places if p[0] >= mark]
        if later:
            self.wake_at(later[0])
        elif self.forget_ms is not None and last is not None and last + self.forget_ms < mark:
            self.held.clear()
            state = None
        elif self.forget_ms is not None and last is not None:
            self.wake_at(last + self.forget_ms)
        if state is not None:
            self.held.update((json.dumps(state), last))
        yield pd.DataFrame(out, columns=self.names, dtype=object)

    def close(self) -> None:
        pass


def packed(rows: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """(key, ts, at_ms, ord_no, packed): whole rows as JSON, so that integers and nulls reach the steps as they are. A time
    without a zone counts as it is written, whatever the session's zone: a clock that is put on or back changes no distance."""
    at = F.concat(F.col(ts).cast("string"), F.lit("Z")) if rows.schema[ts].dataType == TimestampNTZType() else F.col(ts)
    rest = F.to_json(F.struct(*(F.col(c) for c in rows.columns if c != ts)))
    return rows.select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_millis(at.cast("timestamp")).alias("at_ms"), F.coalesce(F.col(order).cast("long"), F.lit(0)).alias("ord_no"), rest.alias("packed"))


def names_of(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def in_stream(rows: DataFrame, key: str, ts: str, order: str, step: Step, schema: str, late: str = "10 minutes", forget_ms: int | None = None) -> DataFrame:
    """The step over every key of a stream, in order of ``ts`` and then ``order``. Needs the RocksDB state store."""
    kept = packed(rows.withWatermark(ts, late), key, ts, order).filter("at_ms IS NOT NULL")
    return kept.groupBy("key").transformWithStateInPandas(InOrder(step, names_of(schema), forget_ms), schema, "append", "EventTime")


def in_batch(rows: DataFrame, key: str, ts: str, order: str, step: Step, schema: str, forget_ms: int | None = None) -> DataFrame:
    """The same over a table. Rows come sorted from the shuffle, a batch at a time, and only the state of the current key
    is held: a key with a third of all rows takes one task's time, as steps follow each other, but not its memory."""
    names = names_of(schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current = state = last = None
        started = False
        for frame in frames:
            out = []
            for (row, at, ord_, _), key_now in zip(unpacked(frame), frame["key"], strict=True):
                if not started or key_now != current:
                    current, state, last, started = key_now, None, None, True
                answer, state = stepped(step, row, at, ord_, state, last, forget_ms)
                last = at
                out.append(answer)
            yield pd.DataFrame(out, columns=names, dtype=object)

    kept = packed(rows, key, ts, order).select(F.to_json(F.struct("key")).alias("key"), "at_ms", "ord_no", "packed").filter("at_ms IS NOT NULL")
    return kept.repartition("key").sortWithinPartitions("key", "at_ms", "ord_no", "packed").mapInPandas(run, schema)


def breaker(key: str, keep: tuple[str, ...] = ("id",), open_ms: int = 600_000) -> Step:
    """Calls of a source: after a call that failed, calls are skipped for ``open_ms``; a skipped call can't fail. Rows that
    repeat time and place of the failed call are copies of it and not skipped; calls without a source never are."""

    def step(r: dict, state: dict | None) -> tuple[dict, dict]:
        state = state or {"failed": None}
        skipped = state["failed"] is not None and r["at_ms"] < state["failed"] + open_ms
        if r.get(key) is None or (r["at_ms"], r["ord_no"]) == (state["failed"], state.get("ord")):
            skipped = False
        if not skipped and r.get("ok") is False:
            state = {"failed": r["at_ms"], "ord": r["ord_no"]}
        return {key: r.get(key), **{c: r.get(c) for c in keep}, "skipped": skipped}, state

    return step


def cache(key: str, keep: tuple[str, ...] = ("id",), ttl_ms: int = 86_400_000) -> Step:
    """Requests for a key: served from the entry while it is younger than ``ttl_ms``, else fetched (``fresh``) and held."""

    def step(r: dict, state: dict | None) -> tuple[dict, dict]:
        fetch = state is None or r["at_ms"] - state["at"] >= ttl_ms
        state = {"at": r["at_ms"], "value": r.get("fresh")} if fetch else state
        return {key: r.get(key), **{c: r.get(c) for c in keep}, "fetched": fetch, "value": state["value"]}, state

    return step


def dialogue(chapters: bool = False) -> Step:
    """The turns of a conversation, by the same rules as ``operators.dialog.resolved``."""
    from agroloom.operators import dialog

    def step(r: dict, state: dict | None) -> tuple[dict, dict]:
        turn = {c: r.get(c) for c in ("conv_id", "turn", *dialog.TURN, *dialog.MARKS, *dialog.TOLD)}
        out, state = dialog.step(turn, state, chapters)
        return {"conv_id": turn["conv_id"], "turn": turn["turn"], **out}, state

    return step
