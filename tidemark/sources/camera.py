"""A camera as a streaming source: a URL or a device number, read by an injected capture.

``capture(source)``, importable and named ``module:function``, gives an object whose ``read()`` returns
(width, height, bytes), or None at the end. Frames that come less than ``interval`` seconds after the
last one that was passed on are dropped as they are read, by the clock, before any model sees them. A
frame's time is the time it was read. Frames stay until their batch is committed, so that a batch that is
run again has the same ones. After a failed read no more frames come.
"""
from __future__ import annotations

import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tidemark.sources.video import resolve

FRAMES = "source string, ts double, width int, height int, content binary"


def device(source: str) -> int | str:
    """A number for a source of digits only, else the URL."""
    return int(source) if source.isdigit() else source


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        lower = {k.lower(): v for k, v in options.items()}
        self.source, self.capture = lower["source"], lower["capture"]
        self.interval, self.most = float(lower.get("interval", 1.0)), int(lower.get("maxframes", 64))
        self.wait = float(lower.get("batchseconds", 1.0))
        self.camera = self.last = None
        self.ended = False
        self.held: dict[int, tuple] = {}

    def initialOffset(self) -> dict:
        return {"frame": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.camera is None:
            self.camera = resolve(self.capture)(device(self.source))
        at, began = start["frame"], time.monotonic()
        while not self.ended and at - start["frame"] < self.most and time.monotonic() - began < self.wait:
            frame = self.camera.read()
            if frame is None:
                self.ended = True
                break
            now = time.monotonic()
            if self.last is not None and now - self.last < self.interval:
                continue
            self.last = now
            self.held[at] = (self.source, time.time(), int(frame[0]), int(frame[1]), bytes(frame[2]))
            at += 1
        return self.readBetweenOffsets(start, {"frame": at}), {"frame": at}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([self.held[i] for i in range(start["frame"], end["frame"]) if i in self.held])

    def commit(self, end: dict) -> None:
        self.held = {i: f for i, f in self.held.items() if i >= end["frame"]}


class Camera(DataSource):
    """``spark.readStream.format("camera").option("source", "0").option("capture", "mod:f")``"""

    @classmethod
    def name(cls) -> str:
        return "camera"

    def schema(self) -> str:
        return FRAMES

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(dict(self.options))
