"""Recognition sessions as a stream (O-113, O-114, O-117, O-118): votes and commits that begin anew with every mode.

State is typed: a value (mode, session number, latch, how far the key is), the vote's window and the rows
that wait. A row waits until its key has seen one that is ``lateness_ms`` younger, so rows that come out of order by less are
put in order, over batches too. One that comes after its place was passed is late: it changes nothing and goes to the side
table. An event-time timer ends a key that is silent for ``idle_ms``: what waits is worked off, and its state goes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from curatrix.streaming import machines

OUT = "event_id long, user_id long, kind string, session int, stable_label string, stable_confidence double, committed string"
_WAITING = "event_id:long,ms:long,mode:string,label:string,confidence:double"
#: Rows, those of the window among them, that are voted on one by one; arrays pay beyond.
FEW = 64
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sessions(StatefulProcessor):
    """Rows of a key (event_id, ms, mode, label, confidence) to votes, commits and late rows.

    A row whose mode is another than that of the row before it, null included, begins a session: the window is empty and the latch open.
    """

    def __init__(self, window_ms: int = 420, least: int = 5, ratio: float = 0.64, release_ms: int = 300, lateness_ms: int = 1000, idle_ms: int = 86_400_000) -> None:
        self.vote = machines.majority(window_ms, least, ratio)
        self.latch = machines.latch(release_ms)
        self.lateness, self.idle = lateness_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "mode string, session int, locked string, since long, newest long, passed long")
        # values that hold arrays: a list state costs a call and an Arrow stream for each look at it
        self.window = handle.getValueState("window", "rows array<struct<ms:long,label:string,confidence:double>>")
        self.waiting = handle.getValueState("waiting", f"rows array<struct<{_WAITING}>>")

    def _state(self) -> dict[str, Any]:
        names = ("mode", "session", "locked", "since", "newest", "passed")
        return dict(zip(names, self.at.get() or (None, 0, None, None, None, None), strict=True))

    @staticmethod
    def _held(state: Any) -> list[tuple]:
        found = state.get()
        return [tuple(r) for r in found[0]] if found else []

    def _worked(self, key: tuple, state: dict[str, Any], rows: list[tuple]) -> list[tuple]:
        """Results of rows in order of time; the state moves on."""
        out, k = [], 0
        if not rows:
            return out
        before = window = tuple(self._held(self.window))
        while k < len(rows):
            mode, end = rows[k][2], k
            if not state["session"] or mode != state["mode"]:
                state |= {"mode": mode, "session": state["session"] + 1, "locked": None, "since": None}
                window = ()
            while end < len(rows) and rows[end][2] == mode:
                end += 1
            part = rows[k:end]
            k = end
            if len(window) + len(part) <= FEW:
                found = {"stable_label": [], "stable_confidence": []}
                for r in part:
                    window, vote = self.vote.step(window, {"ms": r[1], "label": r[3], "confidence": r[4]})
                    for name, value in vote.items():
                        found[name].append(value)
            else:
                window, found = self._folded(window, part)
            for r, label, sure in zip(part, found["stable_label"], found["stable_confidence"], strict=True):
                (state["locked"], state["since"]), commit = self.latch.step((state["locked"], state["since"]), {"ms": r[1], "stable_label": label})
                out.append((r[0], key[0], "vote", state["session"], label, sure, commit["commit"] if commit else None))
        if window or before:
            self._put(self.window, [(int(t), label, float(c)) for t, label, c in window])
        return out

    def _folded(self, window: tuple, part: list[tuple]) -> tuple[tuple, dict[str, list]]:
        columns = {"ms": np.array([r[1] for r in part], dtype=np.int64), "label": np.array([r[3] for r in part] + [None], dtype=object)[:-1], "confidence": np.array([np.nan if r[4] is None else r[4] for r in part], dtype=np.float64)}
        window, _, found = self.vote.run(window, columns)
        return window, {name: values.tolist() for name, values in found.items()}

    @staticmethod
    def _put(held: Any, rows: list[tuple]) -> None:
        if rows:
            held.update((rows,))
        else:
            held.clear()

    def _kept(self, state: dict[str, Any], waiting: list[tuple], before: list[tuple]) -> None:
        self.at.update(tuple(state[n] for n in ("mode", "session", "locked", "since", "newest", "passed")))
        if waiting != before:
            self._put(self.waiting, waiting)

    @staticmethod
    def _rows(frame: pd.DataFrame) -> list[tuple]:
        missing = lambda v: None if v is None or v != v else v
        return [(int(e), int(t), missing(m), missing(x), missing(c)) for e, t, m, x, c in zip(*(frame[n].tolist() for n in ("event_id", "ms", "mode", "label", "confidence")), strict=True)]

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, given = self._state(), [r for part in rows for r in self._rows(part)]
        late = [r for r in given if state["passed"] is not None and r[1] <= state["passed"]]
        before, timer = self._held(self.waiting), None if state["newest"] is None else state["newest"] + self.idle
        waiting = sorted([*before, *(r for r in given if state["passed"] is None or r[1] > state["passed"])], key=lambda r: (r[1], r[0]))
        newest = max([state["newest"] or given[0][1], *(r[1] for r in given)])
        state["newest"], state["passed"] = newest, max(newest - self.lateness, newest - self.lateness if state["passed"] is None else state["passed"])
        ready = [r for r in waiting if r[1] <= state["passed"]]
        out = self._worked(key, state, ready) + [(r[0], key[0], "late", None, None, None, None) for r in late]
        self._kept(state, waiting[len(ready) :], before)
        if timer != newest + self.idle:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(newest + self.idle)
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        out = self._worked(key, self._state(), self._held(self.waiting))
        for held in (self.at, self.window, self.waiting):
            held.clear()
        yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (np.int64, np.int64, object, None, object, np.float64, object)
        names = [part.split()[0] for part in OUT.split(", ")]
        return pd.DataFrame({n: pd.array(c, "Int32") if k is None else np.array(c, dtype=k) for n, c, k in zip(names, columns, kinds, strict=True)})

    def close(self) -> None:
        pass


def run_sessions(stream: DataFrame, time: str, processor: Sessions, lateness: str) -> DataFrame:
    """Votes, commits and late rows of a stream (event_id, user_id, ms, mode, label, confidence and the event time ``time``); ``lateness`` is the
    watermark's, which drops what is older before it comes here: longer than the processor's, so that late rows are seen and counted."""
    spark = stream.sparkSession
    spark.conf.set(*_STORE)
    return stream.withWatermark(time, lateness).groupBy("user_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUT, outputMode="append", timeMode="EventTime")


def votes(found: DataFrame) -> DataFrame:
    return found.where("kind = 'vote'").drop("kind")


def late_rows(found: DataFrame) -> DataFrame:
    """The side table: rows that came after their place was passed, by key."""
    return found.where("kind = 'late'").groupBy("user_id").count().withColumnRenamed("count", "late")


def replayed(spark: SparkSession, batches: list[DataFrame], at: str, processor: Sessions, time: str, lateness: str, end: DataFrame) -> DataFrame:
    """The written results of batches that come as files, one after the other, and of an ``end`` row that lets the watermark pass all timers.

    Each batch's files, as many as it has partitions, are taken at once by a query of their own that goes on from the stored state of the one before.
    """
    from curatrix.streaming.stateful import read_frames, run_available

    for rows in [*batches, end]:
        rows.write.mode("append").parquet(f"{at}/in")
        run_available(run_sessions(read_frames(spark, f"{at}/in", rows.schema), time, processor, lateness), f"{at}/out", f"{at}/state")
    return spark.read.schema(OUT).parquet(f"{at}/out")
