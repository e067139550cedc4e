"""Progress as it is shown: at most one message a gap, a percentage that never falls, and the time that is left.

Events of a file are its work done so far, in the order in which they come. The same step serves a batch, whose files pass
through tasks in order, and a stream, which keeps one small state a file: what a stream says after any number of restarts is
what the batch says of the same events.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GAP, WEIGHT, MOST, SURE = 0.1, 0.3, 99.0, 5
#: Columns of events besides the file: when (seconds), work done, whether it must be shown.
EVENT = ("at", "done", "force")
_OUT = "at double, percent int, ema double, remaining double"
_STATE = "started double, last double, percent int, ema double"


class State(NamedTuple):
    """What is kept of a file: when it started, when something was shown last, the percentage and the seconds a unit."""

    started: float
    last: float
    percent: int
    ema: float | None


def shown(state: State | None, at: float, done: float, force: bool, total: float, gap: float) -> tuple[State, tuple | None]:
    """The state after an event, and its message (at, percent, ema, remaining) if it is shown. The time that is left is told from
    SURE percent on."""
    if state is not None and not force and at - state.last < gap:
        return state, None
    started = at if state is None else state.started
    percent = max(int(min(MOST, done / total * 100.0)) if total > 0 else 0, 0 if state is None else state.percent)
    ema = None if state is None else state.ema
    if done > 0 and total > 0:
        each = (at - started) / done
        ema = each if ema is None else WEIGHT * each + (1 - WEIGHT) * ema
    left = (total - done) * ema if ema is not None and done > 0 and percent >= SURE else None
    return State(started, at, percent, ema), (at, percent, ema, left)


def _frame(rows: list[tuple], key: str, ids: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["at", "percent", "ema", "remaining"]).astype({"at": float, "percent": "int32", "ema": float, "remaining": float})
    out.insert(0, key, ids)
    return out


def emissions(events: DataFrame, key: str, order: list[str], total: float, gap: float = GAP) -> DataFrame:
    """(key, at, percent, ema, remaining): the messages of a table of events. order: what events of a file are ordered by after
    `at`. Events without a time, and files without a name, give nothing; work that is null counts as none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for f in frames:
            rows, ids = [], []
            for name, at, done, force in zip(f[key], f["at"], f["done"], f["force"]):
                if name != now:
                    now, state = name, None
                state, said = shown(state, at, done, force, total, gap)
                if said:
                    rows.append(said)
                    ids.append(name)
            yield _frame(rows, key, ids)

    d = events.where(F.col(key).isNotNull() & F.col("at").isNotNull())
    d = d.select(key, F.col("at").cast("double").alias("at"), F.coalesce(F.col("done").cast("double"), F.lit(0.0)).alias("done"), F.coalesce("force", F.lit(False)).alias("force"), *(F.col(x).alias(f"_o{i}") for i, x in enumerate(order)))
    d = d.repartition(key).sortWithinPartitions(key, "at", *(f"_o{i}" for i in range(len(order)))).select(key, *EVENT)
    return d.mapInPandas(run, f"{key} {events.schema[key].dataType.simpleString()}, {_OUT}")


class Emitter(StatefulProcessor):
    """Keeps a file's state; a file that has been still for `idle_ms` is told as it stands, once, and forgotten."""

    def __init__(self, key: str, total: float, gap: float, idle_ms: int) -> None:
        self.key, self.total, self.gap, self.idle_ms = key, total, gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        f = pd.concat(list(rows)).sort_values(["at", "done"], kind="stable")  # of one file and one trigger
        state, out = State(*self.state.get()) if self.state.exists() else None, []
        for at, done, force in zip(f["at"], f["done"], f["force"]):
            state, said = shown(state, at, done, bool(force), self.total, self.gap)
            if said:
                out.append(said)
        if state is not None:
            self.state.update(tuple(state))
        if self.idle_ms:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(out, self.key, [key[0]] * len(out))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = State(*self.state.get())
        self.state.clear()
        yield _frame([(state.last, state.percent, state.ema, None)], self.key, [key[0]])

    def close(self) -> None:
        pass


def emission_stream(events: DataFrame, key: str, total: float, gap: float = GAP, idle_ms: int = 0) -> DataFrame:
    """The messages of a stream of events. Events of a file come in the order of `at` from trigger to trigger, within one in any;
    needs a state store with column families (RocksDB). idle_ms: after how long a file that gives no events is forgotten; 0: never."""
    d = events.where(F.col(key).isNotNull() & F.col("at").isNotNull())
    d = d.select(key, F.col("at").cast("double").alias("at"), F.coalesce(F.col("done").cast("double"), F.lit(0.0)).alias("done"), F.coalesce("force", F.lit(False)).alias("force"))
    kind = f"{key} {events.schema[key].dataType.simpleString()}, {_OUT}"
    return d.groupBy(key).transformWithStateInPandas(Emitter(key, total, gap, idle_ms), kind, "Append", "ProcessingTime" if idle_ms else "None")
