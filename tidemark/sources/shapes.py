"""Shapefiles: polygons, lines and points in a box, read by the index file, and written."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.store import listed, located, registered

#: Shape types by number; those with heights or measures have the same plane coordinates in front. Fixed values.
KINDS = {1: "point", 3: "line", 5: "polygon", 11: "point", 13: "line", 15: "polygon", 21: "point", 23: "line", 25: "polygon"}


@dataclass
class Records(InputPartition):
    """Records of one file from the number `first` on: their places and sizes in bytes, without headers."""

    path: str
    first: int
    places: list[tuple[int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.bounds = tuple(map(float, options["bounds"].split(","))) if "bounds" in options else None
        self.run_bytes = int(options.get("runbytes", 4 << 20))

    def partitions(self) -> list[Records]:
        """Runs of records by the places in the index files; files whose own box lies outside the bounds are in none."""
        out = []
        for path in listed(self.path, "*.shp"):
            store, _ = located(path)
            with store.open_input_file(path) as f:
                head = f.read_at(100, 0)
            if len(head) < 100 or struct.unpack(">i", head[:4])[0] != 9994:
                raise ValueError(f"{path} is not a shapefile")
            if not self._meets(struct.unpack("<4d", head[36:68])):
                continue
            with store.open_input_file(f"{path[:-4]}.shx") as f:
                index = np.frombuffer(f.read()[100:], ">i4").reshape(-1, 2).astype(np.int64) * 2
            run: list[tuple[int, int]] = []
            for k, (at, n) in enumerate(index.tolist()):
                run.append((at + 8, n))
                if at + n - run[0][0] >= self.run_bytes or k == len(index) - 1:
                    out.append(Records(path, k - len(run) + 1, run))
                    run = []
        return out or [Records("", 0, [])]

    def _meets(self, box: Sequence[float]) -> bool:
        b = self.bounds
        return b is None or (box[0] <= b[2] and b[0] <= box[2] and box[1] <= b[3] and b[1] <= box[3])

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        if not partition.places:
            return
        first, last = partition.places[0][0], sum(partition.places[-1])
        store, at = located(partition.path)
        with store.open_input_file(at) as f:
            raw = f.read_at(last - first, first)
        rows = []
        for k, (at, n) in enumerate(partition.places, partition.first):
            kind, box, parts = _decoded(raw[at - first : at - first + n], self._meets)
            if kind is not None:
                rows.append((partition.path, k, kind, parts, *box))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.list_(pa.float64()))), *[pa.float64()] * 4]
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["path", "record", "kind", "rings", "xmin", "ymin", "xmax", "ymax"])


def _decoded(raw: bytes, meets) -> tuple[str | None, tuple[float, ...], list]:
    """Kind, box and parts of a record's content; None for null shapes, and for those whose box does not meet, whose points are not looked at."""
    kind = KINDS.get(struct.unpack("<i", raw[:4])[0])
    if kind is None:
        return None, (), []
    if kind == "point":
        x, y = struct.unpack("<2d", raw[4:20])
        return (kind, (x, y, x, y), [[[x, y]]]) if meets((x, y, x, y)) else (None, (), [])
    box = struct.unpack("<4d", raw[4:36])
    if not meets(box):
        return None, (), []
    parts, points = struct.unpack("<2i", raw[36:44])
    begins = [*struct.unpack(f"<{parts}i", raw[44 : 44 + 4 * parts]), points]
    xy = np.frombuffer(raw, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()
    return kind, box, [xy[a:b] for a, b in zip(begins, begins[1:])]


class ShapeSource(DataSource):
    """Shapes of shapefiles. Options: path, bounds, runbytes."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_shapes"

    def schema(self) -> str:
        return "path string, record long, kind string, rings array<array<array<double>>>, xmin double, ymin double, xmax double, ymax double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_shapes(spark: SparkSession, path: str, *, bounds: tuple[float, float, float, float] | None = None, run_bytes: int | None = None) -> DataFrame:
    """path, record (from 0), kind, rings (parts of [x, y]), xmin, ymin, xmax, ymax of the shapes of a shapefile, or of a folder's, whose box meets the bounds.

    A partition is a run of records, found by the index file; a record's box is tested before its points are decoded, and a file's before its index is read. Null shapes are left out.
    """
    return registered(spark, ShapeSource, path=path, bounds=None if bounds is None else ",".join(map(repr, bounds)), runbytes=run_bytes).load()


def encoded(shapes: Sequence[Sequence[Sequence[Sequence[float]]] | None], kind: str = "polygon") -> tuple[bytes, bytes]:
    """The .shp and .shx files of shapes as lists of parts of [x, y], or None for a null shape; polygons' first rings turn clockwise and the others counter-clockwise, and are closed."""
    number = next(k for k, v in KINDS.items() if v == kind)
    records, index, at, boxes = b"", b"", 50, []
    for n, parts in enumerate(shapes, 1):
        if not parts:
            content = struct.pack("<i", 0)
        else:
            parts = [_turned(p, k == 0) if kind == "polygon" else p for k, p in enumerate(parts)]
            xy = np.array([q for p in parts for q in p], "<f8").reshape(-1, 2)
            boxes.append([*xy.min(0), *xy.max(0)])
            begins = np.cumsum([0, *map(len, parts[:-1])])
            content = struct.pack("<i2d", number, *xy[0]) if kind == "point" else struct.pack(f"<i4d2i{len(parts)}i", number, *boxes[-1], len(parts), len(xy), *begins) + xy.tobytes()
        records += struct.pack(">2i", n, len(content) // 2) + content
        index += struct.pack(">2i", at, len(content) // 2)
        at += 4 + len(content) // 2
    box = [f([b[k] for b in boxes]) for k, f in enumerate((min, min, max, max))] if boxes else [0.0] * 4
    head = lambda body: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<2i8d", 1000, number, *box, 0, 0, 0, 0)
    return head(records) + records, head(index) + index


def _turned(ring: Sequence[Sequence[float]], clockwise: bool) -> list:
    ring = [*ring, ring[0]] if list(ring[0]) != list(ring[-1]) else list(ring)
    area = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))
    return ring if (area < 0) == clockwise else ring[::-1]
