"""Replay of recorded crawls with the state that an agent keeps: budgets, what it has visited, its latch and its time.

A run takes its goals one after another. The rules are one class, `Run`, that takes a step after the other; it runs over a
table, sorted by run and time, and over a stream, where Spark keeps it as the state of each run. A stream's rows wait in the
state until the watermark has passed them, so that rows which come late, but not too late, take their places, and both ways
give the same rows. A timer drops what a run has visited once its time is over; a few numbers stay, so that later rows of the
run are refused rather than taken for a new run.

Columns of steps: run, goal, at (timestamp), seq (long, order within a time), path, element_id, role, name (strings),
outage (boolean: the model didn't answer). Null texts are empty texts, a null outage is none, rows without a run or time are
left out. Each row comes back as (run, goal, at, seq, element_id, taken, reason, fallback, in_flow, in_run).
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import base_name

#: Most actions of a flow and of a run, and a run's seconds.
PER_FLOW, PER_RUN, SECONDS = 15, 80, 900.0
STEP = "run string, goal string, at timestamp, seq long, path string, element_id string, role string, name string, outage boolean"
REPLAYED = "run string, goal string, at timestamp, seq long, element_id string, taken boolean, reason string, fallback boolean, in_flow int, in_run int"
EPOCH = datetime.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Budget:
    per_flow: int = PER_FLOW
    per_run: int = PER_RUN
    seconds: float = SECONDS


@dataclass
class Run:
    """What a run has done so far. Times are microseconds."""

    started: int | None = None
    in_run: int = 0
    goal: str | None = None
    in_flow: int = 0
    fallback: bool = False
    over: bool = False
    elements: list[list[str]] = field(default_factory=list)
    names: list[list[str]] = field(default_factory=list)

    def take(self, goal: str, at: int, path: str, element: str, role: str, name: str, outage: bool, budget: Budget) -> str | None:
        """Take a step, or say why not. A goal resets what was visited, its count and the latch; nothing resets the run's."""
        if self.started is None:
            self.started = at
        if self.over or at - self.started > budget.seconds * 1_000_000:
            self.close()
            return "time"
        if goal != self.goal:
            self.goal, self.in_flow, self.fallback, self.elements, self.names = goal, 0, False, [], []
        if self.in_flow >= budget.per_flow:
            return "flow-budget"
        if self.in_run >= budget.per_run:
            return "run-budget"
        self.fallback = self.fallback or outage
        if [path, element] in self.elements or [path, role, name] in self.names:
            return "already-executed"
        self.elements.append([path, element])
        self.names.append([path, role, name])
        self.in_flow, self.in_run = self.in_flow + 1, self.in_run + 1
        return None

    def close(self) -> None:
        self.over, self.elements, self.names = True, [], []


def prepared(steps: DataFrame) -> DataFrame:
    """Steps with the columns of STEP: names without their numbers, no nulls but in `run` and `at`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    s = steps.where("run is not null and at is not null").select(F.col("run").cast("string").alias("run"), text("goal"), "at", F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), text("path"), text("element_id"), text("role"), base_name(F.coalesce("name", F.lit(""))).alias("name"), F.coalesce("outage", F.lit(False)).alias("outage"))
    return s


def _row(run: Run, step: tuple, budget: Budget) -> tuple:
    """A step's row of REPLAYED. step: the values of STEP with the time in microseconds."""
    name, goal, at, seq, path, element, role, label, outage = step
    reason = run.take(goal, at, path, element, role, label, bool(outage), budget)
    return name, goal, at, seq, element, reason is None, reason, run.fallback, run.in_flow, run.in_run


def replay(steps: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """Replay a table of steps. A run's steps are in one task, one at a time: memory holds what the run has visited, no more."""
    fields = [f.name for f in T._parse_datatype_string(REPLAYED).fields]
    order = ["run", "at", "seq", "element_id", "goal", "path", "role", "name", "outage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, Run()
        for batch in batches:
            columns = [batch.column(i).cast(pa.timestamp("us")).cast(pa.int64()) if i == 2 else batch.column(i) for i in range(9)]
            out = []
            for step in zip(*(c.to_pylist() for c in columns), strict=True):
                if step[0] != name:
                    name, state = step[0], Run()
                out.append(_row(state, step, budget))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.bool_(), pa.int32(), pa.int32()]
            got = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            got[2] = got[2].cast(pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays(got, fields)

    return prepared(steps).repartition("run").sortWithinPartitions(*order).mapInArrow(run, REPLAYED)


class _Replay(StatefulProcessor):
    """State of a run: what `Run` holds as JSON, and the steps that the watermark hasn't passed."""

    def __init__(self, budget: Budget):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("run", "state string")
        self.waiting = handle.getListState("waiting", "at long, seq long, element_id string, goal string, path string, role string, name string, outage boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        latest = set()
        for batch in rows:
            at = (batch["at"] - EPOCH) // pd.Timedelta(microseconds=1)
            columns = [at, *(batch[c] for c in ("seq", "element_id", "goal", "path", "role", "name", "outage"))]
            steps = [(int(a), int(s), *map(str, rest[:5]), bool(rest[5])) for a, s, *rest in zip(*columns, strict=True)]
            if steps:
                self.waiting.appendList(steps)
                latest |= {max(steps)[0] // 1000 + 1, min(steps)[0] // 1000 + 1}
        for at in latest:
            self.handle.registerTimer(at)
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        run = Run(**json.loads(self.state.get()[0])) if self.state.exists() else Run()
        steps = sorted(self.waiting.get())
        ready = [s for s in steps if s[0] < now]
        first = run.started is None and bool(ready)
        out = [_row(run, (key[0], goal, at, seq, path, element, role, name, outage), self.budget) for at, seq, element, goal, path, role, name, outage in ready]
        rest = [tuple(s) for s in steps[len(ready) :]]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if run.started is not None:
            end = run.started + int(self.budget.seconds * 1_000_000)
            if now > end:
                run.close()
            elif first:
                self.handle.registerTimer(end // 1000 + 2)
            self.state.update((json.dumps(asdict(run)),))
        if out:
            frame = pd.DataFrame(out, columns=["run", "goal", "at", "seq", "element_id", "taken", "reason", "fallback", "in_flow", "in_run"])
            frame["at"] = pd.to_datetime(frame["at"], unit="us")
            yield frame

    def close(self) -> None:
        pass


def replay_stream(steps: DataFrame, budget: Budget = Budget(), late: str = "10 minutes") -> DataFrame:
    """Replay a stream of steps: a step's row comes out once the watermark, `late` behind the latest step, has passed it.

    The state needs the RocksDB provider (spark.sql.streaming.stateStore.providerClass) and a session in UTC.
    """
    s = prepared(steps).withWatermark("at", late)
    return s.groupBy("run").transformWithStateInPandas(_Replay(budget), outputStructType=REPLAYED, outputMode="append", timeMode="eventTime")
