"""The session processor on its own, with states held in memory; the stream itself is the query stream_sessions."""

import random

import pandas as pd

from curatrix.streaming import machines, sessions


class Held:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def put(self, rows):
        assert rows
        self.value = list(rows)

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *_):
        return Held()

    getListState = getValueState

    def listTimers(self):
        return sorted(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


def processor(**settings):
    made, handle = sessions.Sessions(420, 2, 0.5, 300, **settings), Handle()
    made.init(handle)
    return made, handle


def fed(made, batches):
    """Votes by id and the ids of late rows."""
    found = [pd.concat(made.handleInputRows((5,), iter([pd.DataFrame(b, columns=["event_id", "ms", "mode", "label", "confidence"])]), None)) for b in batches]
    found.append(pd.concat(made.handleExpiredTimer((5,), None, None)))
    rows = [tuple(None if x is None or x is pd.NA or x != x else x for x in r) for f in found for r in f.itertuples(index=False)]
    return {r[0]: r[3:] for r in rows if r[2] == "vote"}, [r[0] for r in rows if r[2] == "late"]


def plain(rows):
    """Votes of rows in order: machines that begin anew with every mode."""
    out, mode, session = {}, object(), 0
    for event, t, m, label, sure in sorted(rows, key=lambda r: (r[1], r[0])):
        if m != mode or not session:
            mode, session = m, session + 1
            vote, latch = machines.majority(420, 2, 0.5), machines.latch(300)
            window, held = vote.start(), latch.start()
        window, found = vote.step(window, {"ms": t, "label": label, "confidence": sure})
        held, commit = latch.step(held, {"ms": t, "stable_label": found["stable_label"]})
        out[event] = (session, found["stable_label"], found["stable_confidence"], commit["commit"] if commit else None)
    return out


def test_rows_out_of_order_and_modes_that_come_back():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 60)
        at = sorted(rng.sample(range(6000), n))
        modes = [("a", "b", None)[(t // 900) % 3] for t in at]
        rows = [(k, t, m, rng.choice(["x", "y", "UNKNOWN", None]), rng.choice([0.25, 0.5, None])) for k, (t, m) in enumerate(zip(at, modes, strict=True))]
        shuffled = sorted(rows, key=lambda r: r[1] + rng.randint(0, 500))
        cuts = sorted(rng.sample(range(1, n), min(3, n - 1)))
        batches = [shuffled[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]
        made, _ = processor(lateness_ms=600)
        votes, late = fed(made, batches)
        want = plain(rows)
        assert not late and {k: v[:2] + v[3:] for k, v in votes.items()} == {k: v[:2] + v[3:] for k, v in want.items()}
        assert all(abs(votes[k][2] - want[k][2]) < 1e-12 for k in want)


def test_late_rows_change_nothing():
    rows = [(k, 100 * k, "a", "x", 0.5) for k in range(30)]
    made, handle = processor(lateness_ms=200, idle_ms=1000)
    votes, late = fed(made, [rows[:10], rows[12:], [rows[10], rows[11]], [(30, 2900, "a", "x", 0.5)]])
    assert late == [10, 11] and votes == plain([*rows[:10], *rows[12:], (30, 2900, "a", "x", 0.5)])
    assert handle.timers == {2900 + 1000}
    assert not made.at.exists() and not made.window.exists() and not made.waiting.exists()
