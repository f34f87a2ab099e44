"""The frame source: options that a device refuses, stop and resume, replay of a batch that failed."""

import json

import pytest

from curatrix.streaming import frames


def recorder(path, log):
    """Opens a recorder that keeps its frames in a file of JSON lines, and refuses any wish but its own size."""

    def open_device(options):
        with open(log, "a") as out:
            out.write(json.dumps(dict(options)) + "\n")
        if options.get("width", 640) != 640:
            raise ValueError("unsupported size")

        class Recorder:
            def frames(self, begin, most):
                with open(path) as lines:
                    rows = [json.loads(line) for line in lines][begin : begin + most]
                return [(r["ms"], 640, 480, r["data"].encode()) for r in rows]

        return Recorder()

    return open_device


def record(path, begin, end):
    with open(path, "a") as out:
        for k in range(begin, end):
            out.write(json.dumps({"ms": 40 * k, "data": f"f{k}"}) + "\n")


def test_options_are_relaxed_once(tmp_path):
    device = frames.opened(recorder(tmp_path / "r", tmp_path / "log"))
    record(tmp_path / "r", 0, 2)
    assert device.frames(1, 5) == [(40, 640, 480, b"f1")]
    assert (tmp_path / "log").read_text() == '{"width": 1280, "height": 720}\n{}\n'

    def never(options):
        raise OSError("no device")

    with pytest.raises(OSError, match="no device"):
        frames.opened(never)


def test_a_batch_is_read_again_or_is_an_error(tmp_path):
    record(tmp_path / "r", 0, 10)
    reader = frames.frame_source(recorder(tmp_path / "r", tmp_path / "log"), most=4)({}).simpleStreamReader(None)
    rows, end = reader.read(reader.initialOffset())
    rows = list(rows)
    assert end == {"frame": 4} and [r[0] for r in rows] == [0, 1, 2, 3]
    assert list(reader.readBetweenOffsets({"frame": 0}, end)) == rows
    assert list(reader.read({"frame": 10})[0]) == [] and reader.read({"frame": 10})[1] == {"frame": 10}
    with pytest.raises(OSError, match="frames 10 to 12 are gone"):
        reader.readBetweenOffsets({"frame": 8}, {"frame": 12})


def test_stop_resume_and_replay(spark, tmp_path):
    record(tmp_path / "r", 0, 30)

    def run(fail_at=None):
        stream = frames.read_device(spark, recorder(str(tmp_path / "r"), str(tmp_path / "log")), most=7)
        seen = []

        def take(df, batch):
            if batch == fail_at:
                raise RuntimeError("stopped here")
            df.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={batch}")
            seen.append(df.count())

        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return seen

    with pytest.raises(Exception, match="stopped here"):
        run(fail_at=2)
    run()  # the batch that failed comes again
    record(tmp_path / "r", 30, 45)
    run()
    rows = spark.read.parquet(f"{tmp_path}/out").orderBy("frame").collect()
    assert [(r["frame"], r["ms"], bytes(r["content"])) for r in rows] == [(k, 40 * k, b"f%d" % k) for k in range(45)]
