"""Step machines: (state, row) -> (state, result or None). States are plain tuples, so they can be stored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np

Columns = dict[str, np.ndarray]


@dataclass(frozen=True)
class Machine:
    """``step`` takes one row; ``fold`` a run of rows as arrays, and gives the places of those with a result."""

    start: Callable[[], Any]
    step: Callable[[Any, dict], tuple[Any, dict | None]]
    fold: Callable[[Any, Columns], tuple[Any, np.ndarray, Columns]] | None = None

    def run(self, state: Any, columns: Columns) -> tuple[Any, np.ndarray, Columns]:
        if self.fold is not None:
            return self.fold(state, columns)
        at, out = [], []
        for k, row in enumerate(zip(*(c.tolist() for c in columns.values()), strict=True)):
            state, result = self.step(state, dict(zip(columns, row, strict=True)))
            if result is not None:
                at.append(k)
                out.append(result)
        return state, np.array(at, dtype=np.int64), {name: np.array([r[name] for r in out]) for name in (out[0] if out else ())}


def throttle(gap: int, ms: str = "ms", last: int = 0) -> Machine:
    """O-111: lets a row pass when ``gap`` has gone by since the last one that passed."""

    def step(state: int, row: dict) -> tuple[int, dict | None]:
        return (state, None) if row[ms] - state < gap else (row[ms], {})

    def fold(state: int, columns: Columns) -> tuple[int, np.ndarray, Columns]:
        t, at = columns[ms], []
        k = int(np.searchsorted(t, state + gap))
        while k < len(t):  # one turn for each row that passes
            at.append(k)
            state = int(t[k])
            k = int(np.searchsorted(t, state + gap))
        return state, np.array(at, dtype=np.int64), {}

    return Machine(lambda: last, step, fold)


def clock(ms: str = "ms") -> Machine:
    """O-104: strictly growing whole numbers."""

    def step(state: int | None, row: dict) -> tuple[int, dict]:
        up = -int(-row[ms] // 1)
        now = up if state is None else max(up, state + 1)
        return now, {"clock": now}

    return Machine(lambda: None, step)


def _sure(value: float | None) -> float:
    """A confidence; null and NaN count as 0."""
    return 0.0 if value is None or value != value else float(value)


def _named(value: str | None) -> str | None:
    """A label; null, in whatever form a column brings it, is None."""
    return None if value is None or value != value else value


def window_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Sums of ``values[begin:end]``, put together from sums over powers of two: nothing is subtracted, so a
    value outside a window, however large, leaves no trace in its sum."""
    out, at, left = np.zeros(len(begin)), begin.copy(), end - begin
    level, width = values.astype(np.float64), 1
    while len(level) and (left >= width).any():
        rows = np.flatnonzero(left & width)
        out[rows] += level[at[rows]]
        at[rows] += width
        level, width = level[:-width] + level[width:], width * 2
    return out


def majority(window: int = 420, least: int = 5, ratio: float = 0.64, ms: str = "ms", label: str = "label", confidence: str = "confidence") -> Machine:
    """O-113: sliding-window majority vote. A missing confidence counts as 0; a missing label is a label of its own, and stays null where it wins."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        now = row[ms]
        kept = tuple(s for s in (*state, (now, _named(row[label]), _sure(row[confidence]))) if now - s[0] <= window)
        if len(kept) < least:
            return kept, {"stable_label": "UNKNOWN", "stable_confidence": 0.0}
        votes: dict[str | None, list[float]] = {}
        for _, name, c in kept:
            votes.setdefault(name, []).append(c)
        winner = max(votes, key=lambda name: len(votes[name]))  # the first seen of equals
        mean = sum(votes[winner]) / len(votes[winner])
        stable = winner != "UNKNOWN" and len(votes[winner]) / len(kept) >= ratio
        return kept, {"stable_label": winner if stable else "UNKNOWN", "stable_confidence": mean}

    def fold(state: tuple, columns: Columns) -> tuple[tuple, np.ndarray, Columns]:
        old = len(state)
        t = np.concatenate([np.array([s[0] for s in state], dtype=columns[ms].dtype), columns[ms]])
        number: dict[str | None, int] = {}
        code = np.array([number.setdefault(_named(v), len(number)) for v in (*(s[1] for s in state), *columns[label].tolist())], dtype=np.int64)
        names = np.array([*number, None], dtype=object)[:-1]
        c = np.nan_to_num(np.concatenate([np.array([s[2] for s in state], dtype=np.float64), columns[confidence].astype(np.float64)]), nan=0.0, posinf=np.inf, neginf=-np.inf)
        begin, end = np.searchsorted(t, t - window), np.arange(1, len(t) + 1)
        best, most, first, mean = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64), np.full(len(t), len(t)), np.zeros(len(t))
        every = [np.flatnonzero(code == k) for k in range(len(names))]
        for k, places in enumerate(every):
            low, high = np.searchsorted(places, begin), np.searchsorted(places, end)
            n, since = high - low, np.append(places, len(t))[low]
            win = (n > most) | ((n == most) & (n > 0) & (since < first))
            best, most, first = np.where(win, k, best), np.where(win, n, most), np.where(win, since, first)
        for k, places in enumerate(every):
            rows = np.flatnonzero(best == k)
            mean[rows] = window_sums(c[places], np.searchsorted(places, begin[rows]), np.searchsorted(places, end[rows])) / np.maximum(most[rows], 1)
        size = end - begin
        stable = (size >= least) & (names[best] != "UNKNOWN") & (most / size >= ratio) if len(t) else np.empty(0, dtype=bool)
        out = {"stable_label": np.where(stable, names[best], "UNKNOWN")[old:] if len(t) else np.empty(0, dtype=object), "stable_confidence": np.where(size < least, 0.0, mean)[old:]}
        kept = t >= (t[-1] - window if len(t) else 0)
        return tuple(zip(t[kept].tolist(), names[code[kept]].tolist(), c[kept].tolist(), strict=True)), np.arange(len(columns[ms])), out

    return Machine(tuple, step, fold)


def latch(release: int = 300, ms: str = "ms", label: str = "stable_label") -> Machine:
    """O-114: gives a label when it is not the locked one; UNKNOWN for ``release`` unlocks."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict | None]:
        locked, since = state
        if row[label] == "UNKNOWN":
            since = row[ms] if since is None else since
            return (None if row[ms] - since >= release else locked, since), None
        if row[label] == locked:
            return (locked, None), None
        return (row[label], None), {"commit": row[label]}

    return Machine(lambda: (None, None), step)


def hold(target: str, gain: int = 10, loss: int = 25, least: float = 0.7, full: int = 100, label: str = "label", confidence: str = "confidence") -> Machine:
    """O-116: progress of holding a target; only changes of (label, confidence) count. Completing starts anew."""

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        progress, done, seen = state
        now = (row[label], row[confidence])
        if now != seen:
            if row[label] == target and row[confidence] >= least:
                progress = min(full, progress + gain)
            elif row[label] != target:
                progress = max(0, progress - loss)
        shown = progress
        if progress >= full:
            progress, done = 0, done + 1
        return (progress, done, now), {"progress": shown, "completed": done}

    def fold(state: tuple, columns: Columns) -> tuple[tuple, np.ndarray, Columns]:
        progress, done, seen = state
        name, sure = columns[label], columns[confidence]
        n = len(name)
        if not n:
            return state, np.empty(0, dtype=np.int64), {}
        changed = np.ones(n, dtype=bool)
        changed[1:] = (name[1:] != name[:-1]) | (sure[1:] != sure[:-1])
        changed[0] = seen is None or (name[0], float(sure[0])) != tuple(seen)
        moved = np.where(name == target, np.where(sure >= least, gain, 0), -loss) * changed
        shown, ends = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        at, before = np.flatnonzero(moved), 0
        for k, by in zip(at.tolist(), moved[at].tolist(), strict=True):  # one turn for each row that moves it
            shown[before:k], ends[before:k] = progress, done
            progress = min(full, max(0, progress + by))
            shown[k] = progress
            if progress >= full:
                progress, done = 0, done + 1
            ends[k], before = done, k + 1
        shown[before:], ends[before:] = progress, done
        return (progress, done, (name[-1], float(sure[-1]))), np.arange(n), {"progress": shown, "completed": ends}

    return Machine(lambda: (0, 0, None), step, fold)


def meter(span: int = 1000, ms: str = "ms") -> Machine:
    """O-110: a rate that is taken anew whenever ``span`` has gone by since the frame that closed the last window; the first window begins with the first frame.

    Frames of a window over its length, in frames a second; 0 before the first window closes. ``closed`` says that the row closes one.
    """

    def step(state: tuple, row: dict) -> tuple[tuple, dict]:
        since, frames, fps = state
        since, frames = row[ms] if since is None else since, frames + 1
        elapsed = row[ms] - since
        if elapsed < span:
            return (since, frames, fps), {"fps": fps, "frames": 0, "closed": False}
        return (row[ms], 0, frames * 1000 / elapsed), {"fps": frames * 1000 / elapsed, "frames": frames, "closed": True}

    def fold(state: tuple, columns: Columns) -> tuple[tuple, np.ndarray, Columns]:
        since, frames, rate = state
        t = columns[ms]
        n = len(t)
        fps, count, closed = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        if n and since is None:
            since = int(t[0])
        begin = 0
        while begin < n:  # one turn for each window
            k = max(begin, int(np.searchsorted(t, since + span)))
            fps[begin:k] = rate
            if k >= n:
                frames += n - begin
                break
            frames += k - begin + 1
            rate = frames * 1000 / int(t[k] - since)
            fps[k], count[k], closed[k] = rate, frames, True
            since, frames, begin = int(t[k]), 0, k + 1
        return (since, frames, rate), np.arange(n), {"fps": fps, "frames": count, "closed": closed}

    return Machine(lambda: (None, 0, 0.0), step, fold)
