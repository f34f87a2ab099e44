"""Unit vectors of the operators, and step machines against the window forms."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curatrix.functions import bits, geometry, pose, text
from curatrix.operators import curation, detection, metrics, scoring, similarity, temporal
from curatrix.plans import provenance, training
from curatrix.sources import files
from curatrix.streaming import machines, stateful

HAND = "array<struct<points:array<struct<x:double,y:double,z:double>>,handedness:string,score:double>>"


def hand(ox=0.0, oy=0.0, s=1.0):
    points = [(ox + s * (i % 5) * 0.1, oy + s * (i // 5) * 0.12, s * i * 0.01) for i in range(21)]
    points[9] = (ox + s, oy, 0.0)
    return points


def features(spark, rows):
    df = spark.createDataFrame(rows, f"id int, hands {HAND}, expected int")
    return {r["id"]: r["feature"] for r in pose.add_features(df).collect()}


def test_features_of_hands(spark):
    one, moved, left = (hand(), "Right", 0.9), (hand(4.0, -2.0, 3.5), "Right", 0.9), (hand(0.2), "Left", 0.8)
    far = (hand(0.8), "Right", 0.9)
    bad = ([(0.0, 0.0, 0.0)] * 21, "Right", 1.0)
    nan = ([(float("nan"), 0.0, 0.0), *hand()[1:]], "Right", 1.0)
    got = features(spark, [(0, [one], 1), (1, [moved], 1), (2, [far, left], 2), (3, [one], 2), (4, [], 1), (5, [], 0), (6, [one], 0), (7, [bad], 1), (8, [nan], 1)])
    assert len(got[0]["features"]) == len(pose.feature_names()) == 132
    assert np.allclose(got[0]["features"], got[1]["features"], atol=1e-6)
    assert got[2]["features"][126:128] == [1, 1] and got[2]["handedness"] == [-1, 1] and got[2]["reason"] == "ok"
    assert got[3]["reason"] == "partial_hands" and got[3]["usable"]
    assert [got[k]["reason"] for k in (4, 5, 6)] == ["no_hands_detected", "no_hands_expected", "hard_negative"]
    assert not got[4]["usable"] and got[6]["usable"]
    assert got[7]["reason"] == "invalid_geometry:scale" and got[8]["reason"] == "invalid_geometry:non_finite"


def test_mirror(spark):
    two = [1.0, 2.0, 3.0] + [0.0] * 60 + [4.0, 5.0, 6.0] + [0.0] * 60 + [1.0, 1.0, 7.0, 8.0, 9.0, 10.0]
    one = [1.0, 2.0, 3.0] + [0.0] * 123 + [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]
    rows = spark.createDataFrame([(0, two), (1, one)], "id int, f array<double>").select("id", pose.mirror(F.col("f")).alias("m"), pose.mirror(pose.mirror(F.col("f"))).alias("mm"))
    got = {r["id"]: r for r in rows.collect()}
    assert got[0]["m"][:3] == [-4, 5, 6] and got[0]["m"][63:66] == [-1, 2, 3] and got[0]["m"][126:] == [1, 1, 7, -8, 9, -10]
    assert got[1]["m"][:3] == [-1, 2, 3] and not any(got[1]["m"][63:126])
    assert got[0]["mm"] == two and got[1]["mm"] == one


def test_ranges_and_blocks(spark):
    want = {1: "train", 2000: "train", 2001: None, 2100: None, 2101: "val", 2500: "val", 2501: None, 2601: "test", 3000: "test", 3001: None}
    rows = spark.createDataFrame([(n,) for n in want], "n int").select("n", text.range_split(F.col("n")).alias("s"), text.block_id("b", F.col("n")).alias("b")).collect()
    assert {r["n"]: r["s"] for r in rows} == want
    assert {r["n"]: r["b"] for r in rows}[1] == "b:000" and {r["n"]: r["b"] for r in rows}[2000] == "b:039"


def test_errors(spark):
    rows = spark.createDataFrame([("a/b.jpg",)], "p string")
    with pytest.raises(Exception, match="unknown label strategy"):
        rows.select(text.label_for(F.col("p"), F.lit("none"))).collect()
    with pytest.raises(Exception, match="no trailing number"):
        rows.select(text.trailing_number(text.stem(F.col("p")))).collect()
    with pytest.raises(ValueError, match="total 1"):
        curation.group_split(rows, "p", [("a", 0.5)], "s")
    assert rows.select(text.extension(F.lit("x/.hidden")), text.extension(F.lit("A.JPG"))).first()[:] == ("[none]", ".jpg")


def test_group_split_is_literal(spark):
    random.seed(3)
    sizes = {f"g{k}": random.randint(1, 9) for k in range(60)}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = {r["g"]: r["split"] for r in curation.group_split(df, "g", [("a", 0.5), ("b", 0.3), ("c", 0.2)], "seed").collect()}
    import hashlib

    used, total, want = 0, sum(sizes.values()), {}
    for g in sorted(sizes, key=lambda g: hashlib.sha256(f"seed:{g}".encode()).hexdigest()):
        mid = (used + sizes[g] / 2) / total
        want[g] = "a" if mid < 0.5 else "b" if mid < 0.5 + 0.3 else "c"
        used += sizes[g]
    assert got == want


def test_hamming_join_is_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40)
    hashes = sorted({int(b) ^ (1 << int(k)) ^ (1 << int(j)) for b in base for k, j in rng.integers(0, 62, (5, 2))} | {int(b) for b in base})
    df = spark.createDataFrame([("x", h) for h in hashes], "label string, h long")
    got = {(r["h1"], r["h2"]) for r in similarity.hamming_join(df, df, "label", 3).collect()}
    assert got == {(a, b) for a in hashes for b in hashes if (a ^ b).bit_count() <= 3}
    assert spark.range(1).select(bits.hamming(F.lit(-1), F.lit(0))).first()[0] == 64


def test_gate_and_arbitration(spark):
    rows = spark.createDataFrame([(0, 1, [0.49, 0.51]), (1, 2, [0.9, 0.1]), (2, 1, [0.9, 0.1])], "f int, feature_hands int, probabilities array<double>")
    name, conf = scoring.arg_max(F.col("probabilities"), ["A", "UNKNOWN"])
    said = rows.select("f", scoring.gate(name, conf, F.col("feature_hands"), {"A": 1, "UNKNOWN": 0}, 0.48).alias("l")).collect()
    assert {r["f"]: r["l"] for r in said} == {0: "UNKNOWN", 1: "UNKNOWN", 2: "A"}
    frames = spark.createDataFrame([(0,), (1,), (2,), (3,)], "f int")
    got = {r["f"]: (r["label"], r["confidence"], r["feature_hands"]) for r in scoring.arbitrate(rows, "f", ["A", "UNKNOWN"], {"A": 1, "UNKNOWN": 0}, 0.48, frames).collect()}
    assert got == {0: ("UNKNOWN", 0.51, 1), 1: ("UNKNOWN", 0.1, 2), 2: ("A", 0.9, 1), 3: ("UNKNOWN", 1.0, 0)}


def test_calibration_without_unknown_rows(spark):
    rows = spark.createDataFrame([("A", "A", 0.9, True)], "label string, pred string, conf double, routed boolean")
    classes = spark.createDataFrame([("A",), ("UNKNOWN",)], "label string")
    assert metrics.calibrate(rows, classes).first()[:] == (1.0, 0.0, 0.0)


def test_recovery_of_nothing(spark):
    rows = spark.createDataFrame([], "b int, s int, e int")
    got = metrics.recovery(rows, F.col("b"), F.col("s"), F.col("e")).first()
    assert got["recovery_rate"] == 0 and got["regression_rate"] == 0 and got["zero_hand_false_detection_rate"] is None


def test_machines():
    m = machines.majority(500, 5, 0.6)
    state, out = m.start(), []
    for ms, c in ((0, 0.9), (50, 0.9), (100, 0.9), (150, 0.9), (200, 0.95)):
        state, r = m.step(state, {"ms": ms, "label": "A", "confidence": c})
        out.append(r)
    assert [r["stable_label"] for r in out] == ["UNKNOWN"] * 4 + ["A"] and math.isclose(out[-1]["stable_confidence"], 0.91)
    m = machines.latch(300)
    state, out = m.start(), []
    for ms, label in ((0, "A"), (100, "A"), (150, "UNKNOWN"), (450, "UNKNOWN"), (500, "A")):
        state, r = m.step(state, {"ms": ms, "stable_label": label})
        out.append(r and r["commit"])
    assert out == ["A", None, None, None, "A"]
    m, state = machines.clock(), None
    for t, want in ((8225849.0012, 8225850), (8225849.0013, 8225851), (8225865.2, 8225866)):
        state, r = m.step(state, {"ms": t})
        assert r["clock"] == want


def test_windows_equal_machines(spark):
    random.seed(5)
    rows = []
    for s in range(8):
        t = 0
        for _ in range(80):
            t += random.randint(20, 200)
            rows.append((s, t, random.choice(["A", "A", "B", "UNKNOWN"]), round(random.random(), 3)))
    df = spark.createDataFrame(rows, "s int, ms long, label string, confidence double")
    stable = temporal.sliding_majority(df, "s", F.col("ms"), F.col("label"), F.col("confidence"), 420, 3, 0.6)
    got = {(r["s"], r["ms"]): (r["stable_label"], round(r["stable_confidence"], 9)) for r in stable.collect()}
    commits = {(r["s"], r["ms"]) for r in temporal.commit_latch(stable, "s", F.col("ms"), F.col("stable_label"), 300).collect()}
    want, wanted = {}, set()
    for s in range(8):
        major, lock = machines.majority(420, 3, 0.6), machines.latch(300)
        a, b = major.start(), lock.start()
        for _, ms, label, c in [r for r in rows if r[0] == s]:
            a, r = major.step(a, {"ms": ms, "label": label, "confidence": c})
            want[s, ms] = (r["stable_label"], round(r["stable_confidence"], 9))
            b, r = lock.step(b, {"ms": ms, "stable_label": r["stable_label"]})
            if r:
                wanted.add((s, ms))
    assert got == want and commits == wanted


def test_cascade_and_crops(spark):
    df = spark.createDataFrame([([], [1], [2, 3], 2), ([1], None, None, 1)], "a array<int>, b array<int>, c array<int>, e int")
    name, hands = detection.cascade([("full", F.col("a")), ("low", F.col("b")), ("pad", F.col("c"))])
    got = df.select(name, hands, detection.crop_override(F.col("a"), F.col("c"), F.col("e"))).collect()
    assert [tuple(r) for r in got] == [("low", [1], True), ("full", [1], False)]
    crop = geometry.annotation_crop(F.lit(10.0), F.lit(10.0), F.lit(20.0), F.lit(20.0), F.lit(100), F.lit(100), 0.2)
    assert spark.range(1).select(crop).first()[0] is None


def test_detectors_degrade(spark):
    def open_detectors():
        def broken(data):
            raise RuntimeError("no")

        return [("a", broken), ("b", lambda data: [len(data)] if data else None)]

    df = spark.createDataFrame([(1, bytearray(b"xy")), (2, bytearray(b""))], "id int, content binary")
    got = {r["id"]: (r["strategy"], r["hands"]) for r in detection.detect(df, open_detectors, "content", "id int, content binary, strategy string, hands array<int>").collect()}
    assert got[1][0] == "b" and list(got[1][1]) == [2] and got[2] == ("b", None)


def test_files(spark, tmp_path):
    (tmp_path / "in/x").mkdir(parents=True)
    png = files.render_png(np.full((2, 3, 3), 200, dtype=np.uint8), 3)
    (tmp_path / "in/x/cut.png").write_bytes(png[:-12])
    (tmp_path / "in/x/a.PNG").write_bytes(png)
    (tmp_path / "in/x/b.jpg").write_bytes(b"junk")
    (tmp_path / "in/readme").write_bytes(b"x")
    found = files.scan(spark, str(tmp_path / "in"), content=True)
    assert {r["extension"] for r in found.collect()} == {".png", ".jpg", "[none]"}
    seen = {r["path"].rsplit("/", 1)[1]: r for r in files.inspect_images(found.where("is_image")).collect()}
    assert seen["a.PNG"]["dimensions"] == "3x3" and seen["a.PNG"]["sha256"] and seen["b.jpg"]["sha256"] is None and seen["b.jpg"]["error"]
    assert seen["cut.png"]["sha256"] is None and seen["cut.png"]["error"] == "ValueError: truncated file"
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        files.scan(spark, str(tmp_path / "none")).collect()
    files.write_json_atomic({"b": 1}, str(tmp_path / "s.json"))
    assert (tmp_path / "s.json").read_text().endswith("}\n")
    assert files.load_model(spark, str(tmp_path / "s.json")) == {"b": 1}
    row = spark.range(1).selectExpr("'a' sample_id", "array_repeat(0f, 132) features", "true usable", "'ok' reason", "1 detected_hands", "array(0f, 0f) handedness", "array(0f, 0f) handedness_scores", "'full_frame' strategy", "0 chunk_index", "'k' generation_key")
    files.write_store(row, str(tmp_path / "store"))
    at = str(tmp_path / "store")
    assert files.valid_chunk(spark, at, 0, "k", 1) and not files.valid_chunk(spark, at, 0, "other", 1) and not files.valid_chunk(spark, at, 1, "k", 1) and not files.valid_chunk(spark, at + "x", 0, "k", 1)
    order = spark.createDataFrame([("a", 0)], "sample_id string, feature_row int")
    assert provenance.consolidate(files.read_store(spark, at), order, {0: "k"}).count() == 1
    with pytest.raises(ValueError, match="stale"):
        provenance.consolidate(files.read_store(spark, at), order, {0: "new"})


def test_csv_round_trip(spark, tmp_path):
    from curatrix import schemas

    values = {f.name: "x" if f.dataType.simpleString() == "string" else 1 for f in schemas.MANIFEST}
    df = spark.createDataFrame([tuple(values.values())], schemas.MANIFEST).withColumn("extra", F.lit(1))
    files.write_csv(df, str(tmp_path / "m"))
    assert files.read_csv(spark, str(tmp_path / "m")).collect() == df.drop("extra").collect()


def test_provenance():
    key = provenance.generation_key(b=1, a=[1, 2])
    assert key == provenance.generation_key(a=[1, 2], b=1) != provenance.generation_key(a=[2, 1], b=1)
    assert provenance.canonical({"b": 1, "a": {"d": 1, "c": 2}}) == '{"a":{"c":2,"d":1},"b":1}'
    good = dict(feature_version="v", feature_count=1, manifest_sha256="m", model_sha256="d", key="k")
    state = {"status": "complete", "feature_version": "v", "feature_count": 1, "generation_key": "k"}
    store = {"generation_key": "k", "manifest_sha256": "m", "model_sha256": "d", "feature_version": "v"}
    assert provenance.stale(state, {"generation_key": "k"}, store, **good) is None
    assert "stale" in provenance.stale(state | {"generation_key": "old"}, {"generation_key": "k"}, store, **good)
    assert provenance.stale(None, None, None, **good) == "missing extraction state"


def test_model_contract_and_training(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, 4)) + y[:, None] * 2
    model, scores = training.train(x, y, np.ones(300), x[:100], y[:100], ["A", "UNKNOWN"], (8,), epochs=60, patience=20, rate=0.02)
    again, _ = training.train(x, y, np.ones(300), x[:100], y[:100], ["A", "UNKNOWN"], (8,), epochs=60, patience=20, rate=0.02)
    assert json.dumps(model) == json.dumps(again) and max(scores) > 0.9
    full = model | {"schemaVersion": 1, "mode": "m", "featureVersion": "v", "featureCount": 4, "confidenceThreshold": 0.5, "expectedHands": {"A": 1, "UNKNOWN": 0}}
    ask = dict(mode="m", feature_version="v", feature_count=4)
    assert provenance.model_problem(full, **ask) is None
    assert provenance.model_problem(full | {"confidenceThreshold": 2}, **ask) == "threshold"
    assert provenance.model_problem(full | {"expectedHands": {"A": 1, "UNKNOWN": 1}}, **ask) == "routes"
    assert provenance.model_problem(full | {"layers": full["layers"][:1]}, **ask) == "layers"
    fixture = training.parity_fixture(model, x[0])
    assert abs(sum(fixture["probabilities"]) - 1) < 1e-12
    df = spark.createDataFrame([(0, x[0].tolist()), (1, None)], "id int, v array<double>")
    got = {r["id"]: r["probabilities"] for r in scoring.mlp_score(df, "v", model).collect()}
    assert np.allclose(got[0], fixture["probabilities"], atol=1e-12) and got[1] is None


def test_violations_raise(spark):
    df = spark.createDataFrame([("1", "A", "g", "train", "h"), ("1", "A", "g", "val", "h")], "sample_id string, label string, group_id string, split string, content_sha256 string")
    labels = spark.createDataFrame([("A",)], "label string")
    assert {r["rule"] for r in curation.violations(df, labels).collect()} == {"duplicate_sample_id", "group_leakage", "hash_leakage"}
    with pytest.raises(ValueError, match="duplicate_sample_id"):
        curation.require_valid(df, labels)
    assert [r["rule"] for r in curation.violations(df.limit(0), labels).collect()] == ["empty", "label_missing"]


def test_stream_resumes(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10_000_000 + k * 1000, k) for k in range(6)], "user_id long, ms long, event_id long").withColumn("ts", F.timestamp_millis("ms"))
    at = lambda name: str(tmp_path / name)

    def run():
        stream = stateful.read_frames(spark, at("in"), rows.schema)
        stateful.run_available(stateful.run_machine(stream, ["user_id"], "ts", machines.throttle(2000, last=-10_000), "event_id long, user_id long"), at("out"), at("state"))
        return sorted(r["event_id"] for r in spark.read.parquet(at("out")).collect())

    rows.where("event_id < 3").write.mode("append").parquet(at("in"))
    assert run() == [0, 2]
    rows.where("event_id >= 3").write.mode("append").parquet(at("in"))
    assert run() == [0, 2, 4]
    assert run() == [0, 2, 4]


def test_feature_builder_refuses_bad_input(spark):
    point = "array_repeat(named_struct('x', 0D, 'y', 0D, 'z', 0D), 21)"
    rows = spark.range(1).selectExpr(f"array({point}) p", "array('Right', 'Left') h", "array(0.9D) s", f"array(named_struct('points', {point}, 'handedness', 'Right', 'score', 0.9D)) hands", "3 expected")
    with pytest.raises(Exception, match="differ in length"):
        rows.select(pose.hands_of(F.col("p"), F.col("h"), F.col("s"))).collect()
    with pytest.raises(Exception, match="have to be 0, 1 or 2, not 3"):
        pose.add_features(rows).collect()
    with pytest.raises(Exception, match="not null"):
        pose.add_features(rows.withColumn("expected", F.lit(None).cast("int"))).collect()


def test_folds_are_their_steps():
    """The array form of every machine against its step form, in one run and cut into pieces."""
    rng = random.Random(5)
    rows, t = [], 0
    for _ in range(400):
        t += rng.choice([1, 5, 40, 41, 42, 200])
        rows.append({"ms": t, "label": rng.choice(["A", "B", "UNKNOWN"]), "confidence": rng.choice([0.2, 0.7, 0.9])})
    for machine in (machines.throttle(42), machines.majority(420, 3, 0.6), machines.hold("A")):
        state, want = machine.start(), []
        for k, row in enumerate(rows):
            state, out = machine.step(state, row)
            if out is not None:
                want.append((k, tuple(out.values())))
        for cuts in ([0, 400], [0, 1, 7, 200, 200, 399, 400]):
            state, got = machine.start(), []
            for a, b in zip(cuts, cuts[1:]):
                columns = {c: np.array([r[c] for r in rows[a:b]], dtype=object if c == "label" else None) for c in rows[0]}
                state, at, out = machine.run(state, columns)
                got += [(int(k) + a, tuple(v[i] for v in out.values())) for i, k in enumerate(at)]
            assert [k for k, _ in got] == [k for k, _ in want]
            for (_, x), (_, y) in zip(got, want):
                assert all(u == v if isinstance(v, str) else abs(u - v) < 1e-9 for u, v in zip(x, y))


def test_first_seen_without_a_key(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "doc long, h string")
    kept, out = curation.first_seen(df, "h", [F.col("doc")])
    assert sorted(r["doc"] for r in kept.collect()) == [1, 3, 4, 5] and [r["doc"] for r in out.collect()] == [2]


def test_folds_and_steps_agree_on_missing_and_extreme_values():
    """Nulls leave no trace in later windows, large values neither; the rows may be folded in any pieces."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        n = int(rng.integers(0, 60))
        t = np.sort(rng.choice(3000, n, replace=False)).astype(np.int64)
        label = np.array([rng.choice(["a", "b", "UNKNOWN", None]) for _ in range(n)], dtype=object)
        sure = rng.choice([0.1, 0.5, 1e15, np.nan, 0.25], n)
        machine = machines.majority(420, 3, 0.5, "ms", "label", "confidence")
        state, want = machine.start(), []
        for row in zip(t.tolist(), label.tolist(), sure.tolist(), strict=True):
            state, out = machine.step(state, dict(zip(("ms", "label", "confidence"), row, strict=True)))
            want.append((out["stable_label"], out["stable_confidence"]))
        cut, got, carried = int(rng.integers(0, n + 1)), [], machine.start()
        for part in (slice(0, cut), slice(cut, n)):
            carried, at, out = machine.fold(carried, {"ms": t[part], "label": label[part], "confidence": sure[part]})
            got += list(zip(out["stable_label"].tolist(), out["stable_confidence"].tolist(), strict=True))
        assert [g[0] for g in got] == [w[0] for w in want], trial
        assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-12)
        assert carried == state


def test_window_sums_subtract_nothing():
    values = np.array([1e300, 0.1, 0.2, -1e300, 0.3, np.inf, 0.4])
    begin, end = np.array([1, 1, 4, 0, 6, 2, 3]), np.array([3, 2, 5, 0, 7, 2, 6])
    assert machines.window_sums(values, begin, end).tolist() == [0.1 + 0.2, 0.1, 0.3, 0.0, 0.4, 0.0, np.inf]


def test_generation_key_is_that_of_escaped_json():
    import hashlib

    assert provenance.generation_key(a="données", b=None) == hashlib.sha256(b'{"a":"donn\\u00e9es","b":null}').hexdigest()


def test_meter_folds_as_it_steps():
    rng = np.random.default_rng(4)
    for _ in range(50):
        t = np.sort(rng.integers(0, 9000, rng.integers(0, 60))).astype(np.int64)
        machine = machines.meter(1000)
        state, want = machine.start(), []
        for x in t.tolist():
            state, out = machine.step(state, {"ms": x})
            want.append((out["fps"], out["frames"], out["closed"]))
        cut, got, carried = int(rng.integers(0, len(t) + 1)), [], machine.start()
        for part in (t[:cut], t[cut:]):
            carried, _, out = machine.fold(carried, {"ms": part})
            got += list(zip(out["fps"].tolist(), out["frames"].tolist(), out["closed"].tolist(), strict=True))
        assert got == want and carried == state


def test_frames_and_latency_are_observed(spark):
    from pyspark.sql import Observation

    seen = Observation("meter")
    df = spark.createDataFrame([(1, 5.0), (2, 9.0)], "ms long, latency double")
    assert temporal.observed(df, "latency", seen).count() == 2
    assert seen.get == {"frames": 2, "latency_ms": 7.0, "worst_ms": 9.0}


def test_constraints_of_odd_manifests(spark):
    labels = spark.createDataFrame([("A",), ("B",)], "label string")
    schema = "sample_id string, group_id string, content_sha256 string, label string, split string"
    rules = lambda rows: sorted((r["rule"], r["subject"]) for r in curation.violations(spark.createDataFrame(rows, schema), labels).collect())
    assert rules([]) == [("empty", "manifest"), ("label_missing", "A"), ("label_missing", "B")]
    good = [("1", "g", "h", "A", "train"), ("2", "g", "i", "B", "train")]
    assert rules(good) == []
    assert rules([*good, ("2", "k", "h", "C", "val"), (None, "g", None, "A", "val")]) == [("duplicate_sample_id", "2"), ("group_leakage", "g"), ("hash_leakage", "h"), ("label_unexpected", "C"), ("split_lacks_label", "val:B")]
