"""Streams whose state ends: answers and bursts, kept by key until an event-time timer closes them.

Processors keep what has come in typed state, and a timer for when nothing more
counts. When it fires the result goes out and the state goes away, so what a
stream holds follows the keys that are live, not those that ever were. Frames
and events carry ``at``, the instant by which the watermark moves.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from evalloom.sources.session import python_ready
from evalloom.streaming.sessions import ENDS

# A processor also starts in a Python process beside the driver, which need not have this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Answers(StatefulProcessor):
    """Deltas in a list, appended to and never rewritten; the end, when it has come; a timer for silence and, after the end, for forgetting."""

    def __init__(self, idle_ms: int, linger_ms: int):
        self.idle, self.linger = idle_ms, linger_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.deltas = handle.getListState("deltas", "seq int, data string")
        self.ended = handle.getValueState("ended", "status string")

    def _timer(self, at_ms: int) -> None:
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer(at_ms)

    def _told(self, key, status: str) -> pd.DataFrame:
        said = sorted((r[0], r[1]) for r in self.deltas.get()) if self.deltas.exists() else []
        return pd.DataFrame({"key": [key[0]], "status": [status], "answer": ["".join(d for _, d in said)], "n_deltas": pd.array([len(said)], "int32")})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = pd.concat(list(rows)).sort_values("seq", kind="stable")
        last = int(frames["at"].max().timestamp() * 1000)
        if self.ended.exists():  # frames after the end do not count
            return
        frames = frames.reset_index(drop=True)
        ends = frames.index[frames["event"].isin(ENDS)]
        own = frames.iloc[: ends[0]] if len(ends) else frames
        new = [(int(s), d or "") for s, e, d in zip(own["seq"], own["event"], own["data"], strict=True) if e == "delta"]
        if new:
            self.deltas.appendList(new)
        if len(ends):
            status = str(frames["event"][ends[0]])
            yield self._told(key, status)
            self.deltas.clear()
            self.ended.update((status,))
            self._timer(last + self.linger)
        else:
            self._timer(last + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.ended.exists():
            yield self._told(key, "expired")
        self.deltas.clear()
        self.ended.clear()

    def close(self) -> None:
        pass


def answer_stream(frames: DataFrame, delay: str = "10 seconds", idle_s: float = 900, linger_s: float = 900) -> DataFrame:
    """(key, status, answer, n_deltas): one row for each answer of frames (key long, seq, event, data, at), when it ends.

    What counts is as in :func:`evalloom.streaming.sessions.answers`, frames of a
    key coming in order of seq from batch to batch. A stream without a frame for
    ``idle_s`` of event time ends as "expired" with what it has said; one that
    has ended is remembered for ``linger_s``, so that late frames do not begin it
    anew, and then forgotten.
    """
    python_ready(frames.sparkSession)
    rows = frames.select("key", F.col("seq").cast("int").alias("seq"), "event", "data", F.col("at").cast("timestamp").alias("at")).withWatermark("at", delay)
    processor = Answers(int(idle_s * 1000), int(linger_s * 1000))
    return rows.groupBy("key").transformWithStateInPandas(processor, "key long, status string, answer string, n_deltas int", "append", "eventTime")


class Bursts(StatefulProcessor):
    """The burst that is open: its first event and how many joined it."""

    def __init__(self, step_us: int):
        self.step = step_us

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long, n int")

    def _run(self, key, started: int, n: int) -> tuple:
        return (key[0], pd.Timestamp(started, unit="us"), pd.Timestamp(started + self.step, unit="us"), n)

    @staticmethod
    def _frame(runs: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(runs, columns=["key", "started", "runs_at", "n"]).astype({"n": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(int(t.value // 1000) for b in rows for t in b["at"])
        started, n = self.open.get() if self.open.exists() else (None, 0)
        runs = []
        for t in times:
            if started is None or t > started + self.step:
                if started is not None:
                    runs.append(self._run(key, started, n))
                started, n = t, 0
            n += 1
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.open.update((started, n))
        self.handle.registerTimer((started + self.step) // 1000 + 1)
        if runs:
            yield self._frame(runs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        started, n = self.open.get()
        self.open.clear()
        yield self._frame([self._run(key, started, n)])

    def close(self) -> None:
        pass


def debounced_stream(events: DataFrame, seconds: float = 20, delay: str = "0 seconds") -> DataFrame:
    """(key, started, runs_at, n): the runs of :func:`evalloom.streaming.sessions.debounced` over a stream of (key long, at), each when it is due.

    A run goes out once an event after it, of its key or, by the watermark, of any,
    has come. An event that comes after later ones of its key joins the open burst.
    """
    python_ready(events.sparkSession)
    rows = events.select("key", F.col("at").cast("timestamp").alias("at")).filter(F.col("at").isNotNull()).withWatermark("at", delay)
    out = rows.groupBy("key").transformWithStateInPandas(Bursts(int(seconds * 1_000_000)), "key long, started timestamp_ntz, runs_at timestamp_ntz, n int", "append", "eventTime")
    return out
