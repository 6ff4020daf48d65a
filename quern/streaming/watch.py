"""When to reconcile a worktree: a state machine over its events, by event time.

A hint makes a worktree dirty; it is reconciled after a quiet time, and at the latest ``latency`` after the first hint however
many follow. An overflow (hints were lost) counts as a hint. An exhausted watch turns to polling; a safety net reconciles
now and then without any event; a root that has gone ends it all. The state (what is due when) is Spark's, so it outlives
executors and restarts. Timers fire when the watermark has passed them; events that come later than another one's due time
first let the due one happen, so the requests don't depend on how events are cut into batches.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "worktree string, kind string, ts timestamp"
REQUESTS = "worktree string, at long, reason string, hints long, overflows long"
_STATE = "first long, quiet long, safety long, poll long, last long, hints long, overflows long, gone boolean"


@dataclasses.dataclass(frozen=True)
class Times:
    """In milliseconds: quiet time after the last hint, most time after the first one, of polls and of the safety net."""

    quiet: int = 1_000
    latency: int = 10_000
    poll: int = 300_000
    safety: int = 3_600_000


class Machine:
    """One worktree. Times are milliseconds; -1 is none. ``first`` is the first open hint, ``quiet`` when it will have been quiet."""

    fields = [f.split()[0] for f in _STATE.split(", ")]

    def __init__(self, times: Times, state: tuple | None = None) -> None:
        self.times = times
        values = state or (-1, -1, -1, -1, -1, 0, 0, False)
        for k, v in zip(self.fields, values, strict=True):
            setattr(self, k, bool(v) if k == "gone" else int(v))

    def state(self) -> tuple:
        return tuple(getattr(self, k) for k in self.fields)

    def due(self) -> tuple[int, str] | None:
        """The next time something happens, and why."""
        if self.gone:
            return None
        out = [(self.safety, "safety")] if self.safety >= 0 else []
        if self.poll >= 0:
            out.append((self.poll, "poll"))
        if self.first >= 0:
            out += [(self.quiet, "quiet"), (self.first + self.times.latency, "latency")]
        return min(out) if out else None

    def advance(self, now: int) -> Iterator[tuple[int, str, int, int]]:
        """All requests that are due by then."""
        while (next_ := self.due()) is not None and next_[0] <= now:
            at, why = next_
            yield at, why, self.hints, self.overflows
            self.first = self.quiet = -1
            self.hints = self.overflows = 0
            if why == "safety":
                self.safety = at + self.times.safety
            if why == "poll":
                self.poll = at + self.times.poll

    def take(self, kind: str, at: int) -> None:
        if self.gone:
            return
        if self.safety < 0:
            self.safety = at + self.times.safety
        if kind == "root_gone":
            self.gone, self.first = True, -1
        elif kind == "exhausted":
            self.poll = at + self.times.poll
        elif self.poll < 0:  # one that polls has no hints
            self.first = at if self.first < 0 else self.first
            self.quiet = at + self.times.quiet
            self.hints += kind != "overflow"
            self.overflows += kind == "overflow"


def run(machine: Machine, events: list[tuple[int, str]]) -> Iterator[tuple[int, str, int, int]]:
    """Requests until the last of some events (time, kind); one that comes late counts as of the latest time."""
    for at, kind in sorted(events):
        at = max(at, machine.last)
        yield from machine.advance(at)
        machine.take(kind, at)
        machine.last = at


def _frame(key: str, found: list) -> pd.DataFrame:
    return pd.DataFrame([(key, *r) for r in found], columns=["worktree", "at", "reason", "hints", "overflows"])


class _Watch(StatefulProcessor):
    def __init__(self, times: Times) -> None:
        self.times = times

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("machine", _STATE)

    def _load(self) -> Machine:
        return Machine(self.times, tuple(self.kept.get()) if self.kept.exists() else None)

    def _store(self, machine: Machine) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.kept.update(machine.state())
        if (due := machine.due()) is not None:
            self.handle.registerTimer(due[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        machine = self._load()
        events = [(t.value // 1_000_000, k) for part in rows for t, k in zip(part["ts"], part["kind"], strict=True)]
        found = list(run(machine, events))
        self._store(machine)
        if found:
            yield _frame(key[0], found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._load()
        found = list(machine.advance(timerValues.getCurrentWatermarkInMs()))
        self._store(machine)
        if found:
            yield _frame(key[0], found)

    def close(self) -> None:
        pass


def requests(events: DataFrame, times: Times = Times(), delay: str = "1 second") -> DataFrame:
    """A stream of events (worktree, kind, ts) to requests (worktree, at in milliseconds, reason, hints, overflows).

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    x = events.select("worktree", "kind", "ts").withWatermark("ts", delay)
    return x.groupBy("worktree").transformWithStateInPandas(statefulProcessor=_Watch(times), outputStructType=REQUESTS, outputMode="append", timeMode="eventtime")


def requests_of(events: DataFrame, times: Times = Times(), until: int | None = None) -> DataFrame:
    """The requests of a table of events, up to a time if given (else the last event of each worktree).

    A worktree's events pass by in order, one batch at a time; only the machine is kept between them.
    """

    def each(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for part in it:
            for worktree, rows in part.groupby("worktree", sort=False):
                if worktree != key:
                    if machine is not None and until is not None:
                        yield _frame(key, list(machine.advance(until)))
                    key, machine = worktree, Machine(times)
                yield _frame(key, list(run(machine, [(t.value // 1_000_000, k) for t, k in zip(rows["ts"], rows["kind"], strict=True)])))
        if machine is not None and until is not None:
            yield _frame(key, list(machine.advance(until)))

    x = events.select("worktree", "kind", F.col("ts").cast("timestamp").alias("ts")).where("worktree IS NOT NULL AND ts IS NOT NULL")
    return x.repartition("worktree").sortWithinPartitions("worktree", "ts", "kind").mapInPandas(each, REQUESTS)
