"""One key over many tasks: the rules over ranges against the rules over whole keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.operators import segments, temporal
from curatrix.streaming import machines


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    out = []
    for user, n in (("busy", 3000), ("calm", 5), (None, 40), ("mute", 30)):
        at = np.sort(rng.choice(400 * n, n, replace=False))
        label = np.repeat(rng.choice(["a", "b", "UNKNOWN", "UNKNOWN"], n), rng.integers(1, 60, n))[:n] if user != "mute" else ["UNKNOWN"] * n
        out += [(user, int(t), str(x), None if rng.random() < 0.05 else float(rng.random())) for t, x in zip(at, label, strict=True)]
    return out


def stepped(machine, rows):
    out, states = [], {}
    for user, t, label, sure in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        states[user], found = machine.step(states.get(user, machine.start()), {"ms": t, "label": label, "confidence": sure})
        if found is not None:
            out.append((str(user), t, *found.values()))
    return sorted(out)


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_ranges_change_nothing(spark, rows, ranges):
    df = spark.createDataFrame(rows, "user string, ms long, label string, confidence double")
    name = F.coalesce("user", F.lit("None")).alias("u")
    clock = temporal.monotone_clock(df, "user", F.col("ms") / 700.0, ["ms"], ranges=ranges)
    want = []
    last = {}
    for user, t, *_ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        last[user] = max(-(-t // 700), last.get(user, -(10**9)) + 1)
        want.append((str(user), t, last[user]))
    assert sorted(tuple(r) for r in clock.select(name, "ms", "clock").collect()) == sorted(want)
    latch = temporal.commit_latch(df, "user", F.col("ms"), F.col("label"), 900, ranges=ranges)
    assert sorted(tuple(r) for r in latch.select(name, "ms", "label").collect()) == stepped(machines.latch(900, "ms", "label"), rows)
    vote = temporal.sliding_majority(df, "user", F.col("ms"), F.col("label"), F.col("confidence"), 2500, 4, 0.5, ranges=ranges)
    got = sorted(tuple(r) for r in vote.select(name, "ms", "stable_label", "stable_confidence").collect())
    assert vote.columns == [*df.columns, "stable_label", "stable_confidence"]
    want = stepped(machines.majority(2500, 4, 0.5), rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want])


def test_a_busy_key_uses_many_ranges(spark):
    df = spark.range(200_000).select(F.lit("u").alias("user"), (F.col("id") * 10).alias("ms"))
    assert segments.ranges_for(df, "user", 10_000) == 20 and segments.ranges_for(df, "user") is None and segments.ranges_for(df.limit(0), "user") is None
    sizes = [r["count"] for r in segments.cut(df, "user", ["ms"], 8).groupBy("_range").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 60_000
    lead = segments.with_lead_in(df, "user", F.col("ms"), 100, 8)
    assert lead.where("_own").count() == 200_000 and lead.where("not _own").count() <= 7 * 11
