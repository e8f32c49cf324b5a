"""A stream of gray frames from packed files that may grow while they are read."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.store import listed, located

#: A file begins with these and its frames' height and width; each frame is a time in milliseconds and its pixels.
MAGIC = b"TMFR"
HEAD = struct.Struct("<4sII")


def packed(frames: Sequence[tuple[int, np.ndarray]], shape: tuple[int, int]) -> bytes:
    """A packed file of frames (time in milliseconds, bytes of that shape)."""
    return HEAD.pack(MAGIC, *shape) + b"".join(struct.pack("<q", t) + np.ascontiguousarray(v, np.uint8).tobytes() for t, v in frames)


def counted(path: str) -> tuple[int, int, int]:
    """Height, width and whole frames that a file has now; a frame that is only partly written does not count, nor does a file that is not there yet."""
    store, at = located(path)
    info = store.get_file_info(at)
    if not info.is_file or info.size < HEAD.size:
        return 0, 0, 0
    with store.open_input_file(at) as f:
        magic, h, w = HEAD.unpack(f.read_at(HEAD.size, 0))
    if magic != MAGIC:
        raise ValueError(f"{path} is not a file of frames")
    return h, w, (info.size - HEAD.size) // (8 + h * w)


@dataclass
class Frames(InputPartition):
    """Frames first to last (exclusive) of a file."""

    path: str
    first: int
    last: int


def _read(part: Frames, every: int) -> Iterator[pa.RecordBatch]:
    if part.first >= part.last:
        return
    path = part.path
    h, w, _ = counted(path)
    size = 8 + h * w
    store, at = located(path)
    with store.open_input_file(at) as f:
        for k in range(-(-part.first // every) * every, part.last, every):
            raw = f.read_at(size, HEAD.size + k * size)
            yield pa.RecordBatch.from_arrays(
                [pa.array([path]), pa.array([k]), pa.array([struct.unpack("<q", raw[:8])[0] * 1000], pa.timestamp("us", tz="UTC")), pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([raw[8:]], pa.binary())],
                names=["path", "frame", "time", "height", "width", "pixels"],
            )


def _cut(first: dict[str, int], last: dict[str, int], run: int) -> list[Frames]:
    return [Frames(path, k, min(n, k + run)) for path, n in sorted(last.items()) for k in range(first.get(path, 0), n, run)]


def _there(path: str) -> dict[str, int]:
    """Whole frames of each file that has any."""
    return {p: n for p in listed(path, "*.frames") if (n := counted(p)[2])}


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.run, self.every = options["path"], int(options.get("runframes", 64)), int(options.get("every", 1))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return _there(self.path)

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        return _cut(start, end, self.run)

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.every)

    def commit(self, end: dict) -> None:
        """Frames stay in their file."""


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.run, self.every = options["path"], int(options.get("runframes", 64)), int(options.get("every", 1))

    def partitions(self) -> list[Frames]:
        return _cut({}, _there(self.path), self.run) or [Frames("", 0, 0)]

    def read(self, partition: Frames) -> Iterator[pa.RecordBatch]:
        return _read(partition, self.every)


class FrameSource(DataSource):
    """Frames of a packed file, as a table or a stream. Options: path, every (the nth frames only), runframes."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_frames"

    def schema(self) -> str:
        return "path string, frame long, time timestamp, height int, width int, pixels binary"

    def reader(self, schema) -> _Batch:
        return _Batch(self.options)

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options)


def frames(spark: SparkSession, path: str, *, stream: bool = True, every: int = 1, run_frames: int = 64) -> DataFrame:
    """path, frame (from 0), time, height, width, pixels of a packed file, or of a folder's *.frames: a stream that goes on as files grow and come, or a table of what is there.

    A stream's offset is the number of whole frames of each file; a query that starts again from its checkpoint goes on with the next one. A partition is a run of frames, each
    read by its place. every takes the frames whose numbers it divides.
    """
    spark.dataSource.register(FrameSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("tidemark_frames").options(path=path, every=every, runframes=run_frames).load()
