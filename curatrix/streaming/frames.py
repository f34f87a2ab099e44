"""Frames as a stream with offsets (O-17): a Python data source over anything that numbers its frames.

A device is asked for its frames by number, so a batch can be read again after a failure: a recorder's log, a
camera's ring buffer, a message queue. Opening asks for the ideal options first and, if the device refuses, for none of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

IDEAL = {"width": 1280, "height": 720}
SCHEMA = "frame long, ms long, width int, height int, content binary"


class Device(Protocol):
    """Frames from number ``begin`` on, at most ``most``, as (ms, width, height, content); fewer where there are no more yet. Asking again gives the same."""

    def frames(self, begin: int, most: int) -> list[tuple[int, int, int, bytes]]: ...


def opened(open_device: Callable[[Mapping[str, Any]], Device], ideal: Mapping[str, Any] = IDEAL) -> Device:
    """The device with the ideal options, or with none where it cannot meet them; a second refusal is the caller's error."""
    try:
        return open_device(ideal)
    except (ValueError, OSError):
        return open_device({})


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, open_device: Callable[[Mapping[str, Any]], Device], ideal: Mapping[str, Any], most: int) -> None:
        self.open_device, self.ideal, self.most, self.device = open_device, ideal, most, None

    def _frames(self, begin: int, most: int) -> list[tuple]:
        if self.device is None:
            self.device = opened(self.open_device, self.ideal)
        return [(begin + k, *f) for k, f in enumerate(self.device.frames(begin, most))]

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows = self._frames(start["frame"], self.most)
        return iter(rows), {"frame": start["frame"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = self._frames(start["frame"], end["frame"] - start["frame"])
        if len(rows) != end["frame"] - start["frame"]:
            raise OSError(f"frames {start['frame'] + len(rows)} to {end['frame']} are gone")
        return iter(rows)

    def commit(self, end: dict) -> None:
        """Nothing to give back: frames stay numbered."""


def frame_source(open_device: Callable[[Mapping[str, Any]], Device], ideal: Mapping[str, Any] = IDEAL, most: int = 1000, name: str = "frames") -> type[DataSource]:
    """A data source class for ``spark.dataSource.register``; ``most`` frames come in a micro-batch."""

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def simpleStreamReader(self, schema: Any) -> SimpleDataSourceStreamReader:
            return _Reader(open_device, ideal, most)

    return Frames


def read_device(spark: SparkSession, open_device: Callable[[Mapping[str, Any]], Device], **settings: Any) -> DataFrame:
    """O-17: the device's frames as a stream."""
    source = frame_source(open_device, **settings)
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).load()
