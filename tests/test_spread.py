"""Work that comes from few or small files: it reaches every core, and results stay those of the whole."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.operators import detection
from curatrix.plans import stored
from curatrix.session import tasks_for
from curatrix.sources import pictures


def one_file(spark, tmp_path, n=2000):
    """A folder whose table of items is one small file, as the driver's are."""
    spark.range(n).select(F.col("id").alias("p_partkey"), F.concat(F.lit("t"), F.col("id") % 3).alias("p_type")).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def busiest(df):
    """(tasks with rows, the largest share of rows that one has)."""
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return len(sizes), max(sizes) / sum(sizes)


def test_strategies_reach_every_core(spark, tmp_path):
    tasks, share = busiest(stored.strategy_evaluation(spark, one_file(spark, tmp_path)))
    assert tasks == tasks_for(spark) and share < 2 / tasks


def test_strategies_of_odd_rows(spark):
    """Columns that clash, nulls, broken pictures and failing detectors."""
    good = pictures.encode_png(np.full((4, 4, 3), 200, dtype=np.uint8))
    rows = [(1, bytearray(good), [0, 0, 2, 2], 7), (1, bytearray(good), None, 8), (2, None, None, 9), (3, bytearray(good[:30]), [1, 1, 1, 1], None), (4, bytearray(good), [1, 1, 1, 1], None)]
    df = spark.createDataFrame(rows, "c0 long, content binary, box array<int>, found int")

    def open_detector(threshold):
        def detector(pixels):
            if threshold > 0.8:
                raise OSError("lost")
            return pixels.shape[0] * pixels.shape[1]

        return detector

    plan = [detection.Strategy("full", 0.5), detection.Strategy("cut", 0.5, True), detection.Strategy("wide", 0.5, True, 0.5), detection.Strategy("lost", 0.9)]
    out = detection.evaluate_strategies(df, plan, open_detector)
    assert out.columns == ["c0", "content", "box", "found", "strategy", "hands", "error"]
    got = {(r["c0"], r["found"], r["strategy"], r["hands"], r["error"]) for r in out.collect()}
    lost = "OSError: lost"
    assert {g for g in got if g[0] == 1} == {(1, 7, "full", 16, None), (1, 7, "cut", 4, None), (1, 7, "wide", 16, None), (1, 7, "lost", None, lost), (1, 8, "full", 16, None), (1, 8, "cut", None, None), (1, 8, "wide", None, None), (1, 8, "lost", None, lost)}
    assert {g[1:] for g in got if g[0] == 2} == {(9, s.name, None, "ValueError: empty file") for s in plan}
    assert {g[3] for g in got if g[0] == 3} == {None} and {(g[2], g[3]) for g in got if g[0] == 4} == {("full", 16), ("cut", None), ("wide", None), ("lost", None)}
    assert detection.evaluate_strategies(df.limit(0), plan, open_detector).count() == 0


def test_pictures_are_not_a_file_each(spark, tmp_path, monkeypatch):
    """The files that are written and listed do not grow with the items, and hashes come from every core."""
    at = tmp_path / "pictures"
    monkeypatch.setattr(stored, "_folder", lambda spark: str(at))
    found = stored.picture_hashes(spark, one_file(spark, tmp_path / "tables"))
    tasks, share = busiest(found)
    assert tasks == tasks_for(spark) and share < 2 / tasks
    assert found.count() == 2000 and len([p for p in at.rglob("*") if p.is_file() and not p.name.startswith((".", "_"))]) <= tasks_for(spark)


def events(spark, tmp_path, n=2000):
    """A table of events in one small file."""
    k = F.col("id")
    rows = spark.range(n).select(k.alias("event_id"), F.timestamp_seconds(1_700_000_000 + k * 977).alias("ts"), (k % 97).alias("user_id"), F.when(k % 3 == 0, "view").otherwise("click").alias("event_type"), (k % 500).cast("double").alias("value"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def files_of_streams(monkeypatch):
    """The numbers of files that a folder of stream input has got, call by call."""
    from pathlib import Path

    from curatrix.streaming import stateful

    seen, read = [], stateful.read_frames

    def read_frames(spark, path, *rest, **more):
        seen.append(len(list(Path(path.removeprefix("file:")).glob("*.parquet"))))
        return read(spark, path, *rest, **more)

    monkeypatch.setattr(stateful, "read_frames", read_frames)
    return seen


def test_session_batches_come_in_many_files(spark, tmp_path, monkeypatch):
    from curatrix.plans import queries

    seen = files_of_streams(monkeypatch)
    assert queries.stream_sessions(spark, events(spark, tmp_path)).count() == 2000
    assert len(seen) == 4 and seen[0] >= 4 and seen[2] >= seen[1] + 4


def test_machine_batches_come_in_many_files(spark, tmp_path, monkeypatch):
    from curatrix.plans import queries

    seen, folder = files_of_streams(monkeypatch), events(spark, tmp_path)
    out = queries.stream_majority(spark, folder)
    assert len(seen) == 3 and seen[0] >= 4 and seen[2] >= seen[0] + 8
    assert out.exceptAll(queries.sliding_majority(spark, folder)).count() == 0 and out.count() == 2000
    assert sorted(queries.stream_latch(spark, folder).collect()) == sorted(queries.commit_latch(spark, folder).collect())


def test_sheets_reach_every_core(spark, tmp_path):
    """Few types, of which one is null: places come without a task for each type, and pages from many tasks."""
    at = one_file(spark, tmp_path)
    tasks, _ = busiest(stored.contact_sheets(spark, at))
    assert tasks >= tasks_for(spark) // 2
    rows = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "x").alias("kind"), F.col("id").alias("n"))
    from curatrix.operators import segments

    placed = segments.numbered(rows, "kind", ["n"], "k")
    assert placed.columns == ["kind", "n", "k"]
    got = sorted((r["kind"] is None, r["n"], r["k"]) for r in placed.collect())
    want = [(False, n, k) for k, n in enumerate(n for n in range(1000) if n % 3)] + [(True, n, n // 3) for n in range(0, 1000, 3)]
    assert got == want


def test_fingerprints_in_bounded_memory(spark, monkeypatch):
    """Few words are kept at a time and texts come in slices; fingerprints are the same."""
    import pyarrow as pa

    from curatrix.plans import queries
    from curatrix.session import slices

    at = "/root/testdata/sf0.001"
    whole = sorted(queries.difference_hashes(spark, at).collect())
    assert queries.KNOWN_WORDS <= 50_000
    monkeypatch.setattr(queries, "KNOWN_WORDS", 3)
    assert sorted(queries.difference_hashes(spark, at).collect()) == whole
    batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 1000] * 50)], names=["k", "text"])
    parts = list(slices(iter([batch, batch.slice(0, 0)]), 1, 10_000))
    assert sum(p.num_rows for p in parts) == 50 and max(p.num_rows for p in parts) <= 10
