"""Replay of an append log of events into the state of each candidate, as a batch and as a stream.

An `api_response` opens a call of a turn. A `retrieval_observation` answers the call with its id; where there is none, the only open call of its turn;
else it is an orphan. What is kept of a candidate are its open calls and four numbers, never its log.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "candidate_id string, matched long, sole long, orphans long, pending long"
CALL, ANSWER = "api_response", "retrieval_observation"


def answered(pending: set[tuple], turn: int, call: str) -> tuple[str, tuple | None]:
    """What an observation is (matched, sole, orphans) and the open call that it closes."""
    if (turn, call) in pending:
        return "matched", (turn, call)
    of_turn = [k for k in pending if k[0] == turn]
    return ("sole", of_turn[0]) if len(of_turn) == 1 else ("orphans", None)


def step(counts: dict, pending: set[tuple], kind: str, turn: int, call: str) -> None:
    if kind == CALL:
        pending.add((turn, call))
    else:
        what, closed = answered(pending, turn, call)
        counts[what] += 1
        pending.discard(closed)


def fold(events: list[dict]) -> dict:
    """State after events in order."""
    counts, pending = dict.fromkeys(("matched", "sole", "orphans"), 0), set()
    for e in events:
        step(counts, pending, e["event_type"], e["turn_index"], e["tool_call_id"])
    return {**counts, "pending": len(pending)}


def replay(log: DataFrame) -> DataFrame:
    """(candidate_id, matched, sole, orphans, pending) of a log with row_idx: each candidate's events pass through one task in order."""
    columns = ["candidate_id", "event_type", "turn_index", "tool_call_id"]
    ordered = log.repartition("candidate_id").sortWithinPartitions("candidate_id", "row_idx").select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts, pending = None, {}, set()
        done: list[tuple] = []
        for b in batches:
            for who, kind, turn, call in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if current is None or who != current[0]:
                    if current:
                        done.append((*current, *counts.values(), len(pending)))
                    current, counts, pending = (who,), dict.fromkeys(("matched", "sole", "orphans"), 0), set()
                step(counts, pending, kind, turn, call)
            if done:
                yield rows(done)
                done = []
        if current:
            yield rows([(*current, *counts.values(), len(pending))])

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in found], pa.string()), *(pa.array([r[i] for r in found], pa.int64()) for i in range(1, 5))], names=["candidate_id", "matched", "sole", "orphans", "pending"])

    return ordered.mapInArrow(run, STATE)


class Replay(StatefulProcessor):
    """State of a candidate: a map of open calls and the counts. A call that stays open for `patience` milliseconds is given up by a timer and
    reported in `expired`; an answer that comes later is an orphan."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "turn int, call string", "since long")
        self.counts = handle.getValueState("counts", "matched long, sole long, orphans long, expired long")

    def _row(self, key, counts: list[int], pending: int) -> pd.DataFrame:
        self.counts.update(tuple(counts))
        return pd.DataFrame({"candidate_id": [key[0]], "matched": [counts[0]], "sole": [counts[1]], "orphans": [counts[2]], "pending": [pending], "expired": [counts[3]]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts = [int(x) for x in self.counts.get()] if self.counts.exists() else [0, 0, 0, 0]
        pending = {(int(k[0]), k[1]) for k in self.open.keys()}
        now = timerValues.getCurrentProcessingTimeInMs()
        tally = dict(zip(("matched", "sole", "orphans"), counts, strict=False))
        events = pd.concat(list(rows)).sort_values("row_idx")
        for kind, turn, call in zip(events["event_type"], events["turn_index"], events["tool_call_id"], strict=True):
            before = set(pending)
            step(tally, pending, kind, int(turn), call)
            for k in pending - before:
                self.open.updateValue(k, (now,))
                if self.patience:
                    self.handle.registerTimer(now + self.patience)
            for k in before - pending:
                self.open.removeKey(k)
        yield self._row(key, [*tally.values(), counts[3]], len(pending))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        late = [k for k, since in list(self.open.iterator()) if int(since[0]) + self.patience <= now]
        if late:
            counts = [int(x) for x in self.counts.get()]
            for k in late:
                self.open.removeKey(k)
            yield self._row(key, [*counts[:3], counts[3] + len(late)], sum(1 for _ in self.open.keys()))

    def close(self) -> None:
        pass


def follow(log: DataFrame, patience_ms: int = 0) -> DataFrame:
    """replay() of a stream: the state of each candidate that a micro-batch touched (output mode update). Events of a micro-batch are taken by
    row_idx, and micro-batches are taken to come in order. Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass)."""
    columns = log.select("candidate_id", "row_idx", "event_type", "turn_index", "tool_call_id")
    return columns.groupBy("candidate_id").transformWithStateInPandas(Replay(patience_ms), outputStructType=STATE + ", expired long", outputMode="Update", timeMode="ProcessingTime")
