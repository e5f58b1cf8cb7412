"""Videos as a Spark data source: sampled, downscaled frames in batches, from an injected decoder.

No codec ships with the engine. A decoder is a callable ``decode(path, sample_seconds, max_side,
max_seconds)`` that yields (timestamp_seconds, width, height, bytes), importable on executors and
named ``module:function``; a prober ``probe(path)`` gives duration, fps, width and height or None.
"""
from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAMES = "video_name string, timestamp_seconds double, width int, height int, content binary"
PROBED = "path string, duration_seconds double, fps double, width int, height int"


def read_exact(stream, size: int) -> bytes | None:
    """``size`` bytes of a pipe; None at its end; an error where it ends within a frame."""
    parts, left = [], size
    while left:
        part = stream.read(left)
        if not part:
            if left == size:
                return None
            raise EOFError(f"stream ended {left} bytes before a frame's end")
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def resolve(name: str) -> Callable:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Video(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("paths", "").split("\n") if p]
        self.decoder = options["decoder"]
        self.sample, self.side = float(options.get("sampleseconds", options.get("sampleSeconds", 5.0))), int(options.get("maxside", options.get("maxSide", 512)))
        limit = options.get("maxseconds", options.get("maxSeconds"))
        self.limit = float(limit) if limit else None

    def partitions(self) -> list[_Video]:
        return [_Video(p) for p in self.paths]

    def read(self, partition: _Video) -> Iterator[tuple]:
        name = partition.path.rsplit("/", 1)[-1]
        for ts, width, height, content in resolve(self.decoder)(partition.path, self.sample, self.side, self.limit):
            yield name, float(ts), int(width), int(height), bytes(content)


class SampledFrames(DataSource):
    """``spark.read.format("sampled_frames").option("paths", "a\\nb").option("decoder", "mod:f")``:
    one partition a video; sampling, scaling and duration are pushed into the decoder."""

    @classmethod
    def name(cls) -> str:
        return "sampled_frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def probe(files: DataFrame, prober: str) -> tuple[DataFrame, DataFrame]:
    """Probed videos, and the paths that could not be probed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = resolve(prober)
        for batch in batches:
            rows = [(p, *(f(p) or (None,) * 4)) for p in batch["path"]]
            yield pd.DataFrame(rows, columns=["path", "duration_seconds", "fps", "width", "height"]).astype({"width": "Int32", "height": "Int32"})

    out = files.select("path").mapInPandas(run, PROBED)
    return out.filter(F.col("duration_seconds").isNotNull()), out.filter(F.col("duration_seconds").isNull()).select("path")


def frames_from(stream, seconds: float) -> Iterator[tuple]:
    """Frames (pts, width, height, bytes) of an open ``stream`` from the key frame before ``seconds`` on.
    ``stream.seek(seconds)`` may refuse with an OSError: then it goes to the beginning, and where it
    refuses that too, frames come from where the stream stands."""
    for target in (max(0.0, seconds), 0.0):
        try:
            stream.seek(target)
            break
        except OSError:
            continue
    return (f for f in stream.frames() if f[0] is not None)


def frame_at(stream, seconds: float) -> tuple | None:
    """The first frame at ``seconds`` or after it, decoding forwards; None behind the last."""
    return next((f for f in frames_from(stream, seconds) if f[0] + 1e-6 >= seconds), None)


def recorder(url: str, folder: str, seconds: int = 600) -> list[str]:
    """The command that records a camera into files of ``seconds``, named by their time."""
    return ["ffmpeg", "-rtsp_transport", "tcp", "-i", url, "-c", "copy", "-f", "segment", "-segment_time", str(seconds), "-segment_format", "mkv", "-strftime", "1", f"{folder.rstrip('/')}/%Y-%m-%d_%H-%M-%S.mkv"]
