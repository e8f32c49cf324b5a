"""GeoTIFF rasters: windows of them as rows of pixels, sampled at points, and written."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.geo import map_to_pixel
from tidemark.sources.store import listed, located, registered

#: Field types of the format by number: size and struct letter. Fixed values.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q")}
#: Tags by number. Fixed values.
TAGS = {256: "width", 257: "height", 258: "bits", 259: "compression", 273: "strip_offsets", 277: "samples", 278: "strip_rows", 279: "strip_sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height", 324: "tile_offsets", 325: "tile_sizes", 339: "kind", 33550: "scale", 33922: "tie", 34264: "matrix", 34735: "geo_keys", 42113: "no_data"}
KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass(frozen=True)
class Raster:
    """What a file's first directory says. Blocks are its tiles or strips."""

    path: str
    width: int
    height: int
    bands: int
    dtype: str
    compression: int
    predictor: int
    planar: bool
    block: tuple[int, int]  # rows, columns
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    affine: tuple[float, ...] | None
    epsg: int | None
    no_data: float | None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])

    def window(self, bounds: tuple[float, ...] | None) -> tuple[int, int, int, int]:
        """Rows and columns (ends exclusive) whose pixels meet map bounds (xmin, ymin, xmax, ymax); all of them without bounds, none where they do not meet."""
        if bounds is None:
            return 0, self.height, 0, self.width
        if self.affine is None:
            raise ValueError(f"{self.path} is not placed on a map")
        a, b, c, d, e, f = self.affine
        det = a * e - b * d
        at = [((a * (y - f) - d * (x - c)) / det, (e * (x - c) - b * (y - f)) / det) for x in bounds[::2] for y in bounds[1::2]]
        ends = lambda k, n: (max(0, min(n, int(np.floor(min(p[k] for p in at))))), max(0, min(n, int(np.floor(max(p[k] for p in at))) + 1)))
        return *ends(0, self.height), *ends(1, self.width)

    def blocks(self, window: tuple[int, int, int, int], bands: list[int]) -> list[tuple[int, int]]:
        """(block, band) of what meets the window; blocks that hold all bands come once, with band 0."""
        r0, r1, c0, c1 = window
        if r0 >= r1 or c0 >= c1:
            return []
        grid = [i * self.across + j for i in range(r0 // self.block[0], (r1 - 1) // self.block[0] + 1) for j in range(c0 // self.block[1], (c1 - 1) // self.block[1] + 1)]
        return [(k + n * self.across * self.down, n) for n in bands for k in grid] if self.planar else [(k, 0) for k in grid]

    def decoded(self, file, block: int) -> np.ndarray:
        """Rows x columns x bands (one if planar) of a block; those past the image's end are there in tiles, but not in strips."""
        n = self.sizes[block]
        raw = file.read_at(n, self.offsets[block]) if n else b""
        if self.compression in (8, 32946):
            raw = zlib.decompress(raw) if raw else b""
        elif self.compression == 50000:
            import zstandard

            raw = zstandard.decompress(raw) if raw else b""
        elif self.compression != 1:
            raise ValueError(f"{self.path}: compression {self.compression} is not read")
        rows = min(self.block[0], self.height - block % (self.across * self.down) // self.across * self.block[0]) if self.block[1] == self.width else self.block[0]
        bands, dtype = 1 if self.planar else self.bands, np.dtype(self.dtype)
        if not raw:  # a block that was never written
            return np.full((rows, self.block[1], bands), self.no_data if self.no_data is not None else 0, dtype.newbyteorder("="))
        out = np.frombuffer(raw, dtype, rows * self.block[1] * bands).reshape(rows, self.block[1], bands).astype(dtype.newbyteorder("="))
        return np.cumsum(out, axis=1, dtype=out.dtype) if self.predictor == 2 else out


def opened(path: str) -> Raster:
    """The first directory of a TIFF or BigTIFF file: its header and the tags' values are read, no pixels."""
    store, at = located(path)
    with store.open_input_file(at) as f:
        head = f.read_at(16, 0)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path} is not a TIFF file")
        big = version == 43
        first = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        n = struct.unpack(f"{order}{'Q' if big else 'H'}", f.read_at(8 if big else 2, first))[0]
        size, inline = (20, 8) if big else (12, 4)
        entries = f.read_at(n * size, first + (8 if big else 2))
        tags: dict[str, tuple] = {}
        for k in range(n):
            e = entries[k * size : (k + 1) * size]
            tag, kind = struct.unpack(f"{order}HH", e[:4])
            count = struct.unpack(f"{order}{'Q' if big else 'I'}", e[4 : size - inline])[0]
            if tag in TAGS and kind in FIELDS:
                width, letter = FIELDS[kind]
                there = e[size - inline :] if width * count <= inline else f.read_at(width * count, struct.unpack(f"{order}{'Q' if big else 'I'}", e[size - inline :])[0])
                tags[TAGS[tag]] = struct.unpack(f"{order}{count}{letter}", there[: width * count])
    one = lambda name, default: tags.get(name, (default,))[0]
    tiled = "tile_width" in tags
    block = (one("tile_height", 0), one("tile_width", 0)) if tiled else (min(one("strip_rows", 1 << 31), one("height", 0)), one("width", 0))
    affine = None
    if "matrix" in tags:
        m = tags["matrix"]
        affine = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif "scale" in tags and "tie" in tags:
        (sx, sy, *_), (i, j, _, x, y, *_) = tags["scale"], tags["tie"]
        affine = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = {tags["geo_keys"][k]: tags["geo_keys"][k + 3] for k in range(4, len(tags.get("geo_keys", ())), 4) if tags["geo_keys"][k + 1] == 0}
    empty = tags.get("no_data", (b"",))[0].rstrip(b"\0").strip()
    dtype = f"{order}{KINDS[one('kind', 1)]}{one('bits', 1) // 8}"
    return Raster(path, one("width", 0), one("height", 0), one("samples", 1), dtype, one("compression", 1), one("predictor", 1), one("planar", 1) == 2, block, tags["tile_offsets" if tiled else "strip_offsets"], tags["tile_sizes" if tiled else "strip_sizes"], affine, keys.get(3072) or keys.get(2048), float(empty) if empty else None)


@dataclass
class BlockRun(InputPartition):
    """Blocks of one partition, neighbours in their files: (raster, window, block, band)."""

    blocks: list[tuple[Raster, tuple[int, int, int, int], int, int]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern = options["path"], options.get("pattern", "*.tif*")
        self.bounds = tuple(map(float, options["bounds"].split(","))) if "bounds" in options else None
        self.bands = [int(b) for b in options["bands"].split(",")] if "bands" in options else None
        self.run_bytes = int(options.get("runbytes", 8 << 20))

    def partitions(self) -> list[BlockRun]:
        """Runs of about run_bytes of stored blocks; those that lie outside the bounds are in none. A partition carries its blocks' places only."""
        runs, held = [], 0
        for path in listed(self.path, self.pattern):
            r = opened(path)
            window = r.window(self.bounds)
            for block, band in r.blocks(window, self.bands or list(range(r.bands))):
                if not runs or held >= self.run_bytes:
                    runs.append([])
                    held = 0
                one = Raster(**{**r.__dict__, "offsets": {block: r.offsets[block]}, "sizes": {block: r.sizes[block]}})
                runs[-1].append((one, window, block, band))
                held += r.sizes[block]
        return [BlockRun(x) for x in runs] or [BlockRun([])]

    def read(self, partition: BlockRun) -> Iterator[pa.RecordBatch]:
        file, path = None, None
        for r, window, block, band in partition.blocks:
            if r.path != path:
                store, at = located(r.path)
                file, path = store.open_input_file(at), r.path
            yield from _pixels(r, file, window, block, band, self.bands)


def _pixels(r: Raster, file, window: tuple[int, int, int, int], block: int, band: int, bands: list[int] | None) -> Iterator[pa.RecordBatch]:
    values = r.decoded(file, block)
    place = block % (r.across * r.down)
    top, left = place // r.across * r.block[0], place % r.across * r.block[1]
    r0, r1, c0, c1 = (max(window[0], top) - top, min(window[1], r.height, top + len(values)) - top, max(window[2], left) - left, min(window[3], r.width, left + r.block[1]) - left)
    i, j = np.meshgrid(np.arange(top + r0, top + r1, dtype=np.int32), np.arange(left + c0, left + c1, dtype=np.int32), indexing="ij")
    for n in [0] if r.planar else (bands or range(r.bands)):
        v = values[r0:r1, c0:c1, n].astype(np.float64).ravel()
        gone = np.zeros(len(v), bool) if r.no_data is None else (v == r.no_data) | (np.isnan(v) & np.isnan(r.no_data))
        whole = lambda x, kind, n=len(v): pa.array(np.full(n, x, kind))
        yield pa.RecordBatch.from_arrays([pa.array([r.path] * len(v)), whole(band if r.planar else n, np.int32), pa.array(i.ravel()), pa.array(j.ravel()), pa.array(v, mask=gone), whole(block, np.int32), whole(r.sizes[block], np.int64)], names=["path", "band", "i", "j", "value", "block", "block_bytes"])


class TiffSource(DataSource):
    """Pixels of GeoTIFF files. Options: path, pattern, bounds, bands, runbytes."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_tiff"

    def schema(self) -> str:
        return "path string, band int, i int, j int, value double, block int, block_bytes long"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tiff(spark: SparkSession, path: str, *, bounds: tuple[float, float, float, float] | None = None, bands: list[int] | None = None, pattern: str = "*.tif*", run_bytes: int | None = None) -> DataFrame:
    """path, band (from 0), i, j, value, block, block_bytes: the pixels of a file, or of a folder's files, that meet map bounds (in each file's own projection).

    Only directories are read to plan; a partition is a run of tiles or strips, of which those outside the bounds are never read. Values that are the file's no-data value are
    null. Uncompressed, deflate and Zstandard blocks, with or without differences; whole and real numbers of 8 to 64 bits; files over 4 GB. block_bytes is what a block takes in the file.
    """
    return registered(spark, TiffSource, path=path, pattern=pattern, bounds=None if bounds is None else ",".join(map(repr, bounds)), bands=None if bands is None else ",".join(map(str, bands)), runbytes=run_bytes).load()


def described(files: DataFrame) -> DataFrame:
    """files (path) with height, width, bands, block_rows, block_cols, affine, epsg, no_data, read from each file's directory in tasks; nulls for a file that is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path in b.column(0).to_pylist():
                try:
                    r = opened(path)
                    rows.append((path, r.height, r.width, r.bands, *r.block, r.affine, r.epsg, r.no_data))
                except (ValueError, OSError, KeyError, struct.error):
                    rows.append((path, *[None] * 8))
            kinds = (pa.string(), *[pa.int32()] * 5, pa.list_(pa.float64()), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=DESCRIBED)

    return files.select("path").distinct().mapInArrow(run, "path string, height int, width int, bands int, block_rows int, block_cols int, affine array<double>, epsg int, no_data double")


DESCRIBED = ["path", "height", "width", "bands", "block_rows", "block_cols", "affine", "epsg", "no_data"]


def sampled(points: DataFrame, *, key: str, x: Column | None = None, y: Column | None = None, band: int = 0) -> DataFrame:
    """key, value of the pixel that holds each point (key, path, x, y in the file's projection): null outside the raster, on no-data, and for files that are not there.

    Points meet in the blocks that hold them, so each block is read at most once a task, and blocks without a point never.
    """
    at = points.select(key, "path", (F.col("x") if x is None else x).cast("double").alias("_x"), (F.col("y") if y is None else y).cast("double").alias("_y"))
    info = described(at.where("path is not null"))
    row, col = map_to_pixel(F.col("_x"), F.col("_y"), F.col("affine"))
    placed = at.join(info, "path", "left").withColumns({"_i": row.cast("long"), "_j": col.cast("long")})
    inside = F.coalesce(F.col("_i").between(0, F.col("height") - 1) & F.col("_j").between(0, F.col("width") - 1) & (F.col("bands") > band), F.lit(False))
    kind = dict(points.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, raster, file, block, values = None, None, None, None, None
        for b in batches:
            out = []
            for p, i, j in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if p != path:
                    raster, path, block = opened(p), p, None
                    store, place = located(p)
                    file = store.open_input_file(place)
                k = i // raster.block[0] * raster.across + j // raster.block[1] + (band * raster.across * raster.down if raster.planar else 0)
                if k != block:
                    values, block = raster.decoded(file, k), k
                v = float(values[i % raster.block[0], j % raster.block[1], 0 if raster.planar else band])
                out.append(None if raster.no_data is not None and (v == raster.no_data or v != v and raster.no_data != raster.no_data) else v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], names=[key, "value"])

    block = F.floor(F.col("_i") / F.col("block_rows")) * F.ceil(F.col("width") / F.col("block_cols")) + F.floor(F.col("_j") / F.col("block_cols"))
    hits = placed.where(inside).select(key, "path", "_i", "_j", block.alias("_block")).repartition("path", "_block").sortWithinPartitions("path", "_block")
    found = hits.mapInArrow(run, f"`{key}` {kind}, value double")
    return found.unionByName(placed.where(~inside).select(key, F.lit(None).cast("double").alias("value")))


def encoded(values: np.ndarray, *, affine: tuple[float, ...] | None = None, epsg: int | None = None, no_data: float | None = None, tile: int | None = None, strip_rows: int = 64, compress: bool = True, differences: bool = False) -> bytes:
    """A TIFF file of an array (rows x columns, or rows x columns x bands) in square tiles (a multiple of 16) or in strips, deflated or as it is."""
    values = values[:, :, None] if values.ndim == 2 else values
    h, w, bands = values.shape
    dtype = values.dtype.newbyteorder("<")
    bh, bw = (tile, tile) if tile else (min(strip_rows, h), w)
    blocks = []
    for top in range(0, h, bh):
        for left in range(0, w, bw):
            part = values[top : top + bh, left : left + bw]
            if tile:
                part = np.pad(part, ((0, bh - part.shape[0]), (0, bw - part.shape[1]), (0, 0)))
            if differences:
                part = np.diff(part, axis=1, prepend=np.zeros_like(part[:, :1]))
            raw = np.ascontiguousarray(part.astype(dtype)).tobytes()
            blocks.append(zlib.compress(raw) if compress else raw)
    offsets, at = [], 8
    for b in blocks:
        offsets.append(at)
        at += len(b) + len(b) % 2
    kind = next(k for k, v in KINDS.items() if v == values.dtype.kind)
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [8 * dtype.itemsize] * bands), (259, "H", [8 if compress else 1]), (262, "H", [1]), (277, "H", [bands]), (284, "H", [1]), (317, "H", [2 if differences else 1]), (339, "H", [kind] * bands)]
    tags += [(322, "I", [bw]), (323, "I", [bh]), (324, "I", offsets), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", offsets), (278, "I", [bh]), (279, "I", [len(b) for b in blocks])]
    if affine is not None:
        a, b, c, d, e, f = affine
        tags += [(34264, "d", [a, b, 0, c, d, e, 0, f, 0, 0, 0, 0, 0, 0, 0, 1])] if b or d else [(33550, "d", [a, -e, 0]), (33922, "d", [0, 0, 0, c, f, 0])]
    if epsg is not None:
        degrees = epsg == 4326
        tags.append((34735, "H", [1, 1, 0, 2, 1024, 0, 1, 2 if degrees else 1, 2048 if degrees else 3072, 0, 1, epsg]))
    if no_data is not None:
        tags.append((42113, "s", [repr(no_data).encode() + b"\0"]))
    number = {letter: k for k, (_, letter) in FIELDS.items()}
    body = b"".join(b + b"\0" * (len(b) % 2) for b in blocks)
    entries, extra, rest = b"", b"", 8 + len(body) + 2 + 12 * len(tags) + 4
    for tag, letter, vs in sorted(tags):
        raw = vs[0] if letter == "s" else struct.pack(f"<{len(vs)}{letter}", *vs)
        count = len(raw) if letter == "s" else len(vs)
        if len(raw) > 4:
            place = struct.pack("<I", rest + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        else:
            place = raw.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, number[letter], count) + place
    return b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + extra
