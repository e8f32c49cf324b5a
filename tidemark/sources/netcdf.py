"""NetCDF files of the classic formats (CDF-1, 2 and 5): parts of a gridded variable as rows of cells, and files written from cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.sources.grids import LAT_NAMES, LON_NAMES
from tidemark.sources.store import listed, located, registered

#: Types of the format by number. Fixed values.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}


@dataclass(frozen=True)
class Variable:
    """A variable's place in its file. shape has the number of records for the record dimension; step is from one index of the first dimension to the next, in bytes."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    begin: int
    step: int
    attributes: dict

    def rows(self, file, first: int, last: int, columns: slice | None = None) -> np.ndarray:
        """Raw values of indices first to last (exclusive) of the last dimension but one, all other dimensions but the last being single; only the columns if they are under half of a row."""
        dtype, width = np.dtype(self.dtype), self.shape[-1]
        step = width * dtype.itemsize if len(self.shape) > 2 or len(self.shape) == 1 else self.step
        columns = columns or slice(0, width)
        narrow = 2 * (columns.stop - columns.start) < width
        if narrow or step != width * dtype.itemsize:
            n = columns.stop - columns.start
            return np.array([np.frombuffer(file.read_at(n * dtype.itemsize, self.begin + k * step + columns.start * dtype.itemsize), dtype, n) for k in range(first, last)]).reshape(-1, n)
        return np.frombuffer(file.read_at((last - first) * step, self.begin + first * step), dtype, (last - first) * width).reshape(-1, width)[:, columns]

    def whole(self, file) -> np.ndarray:
        """All values of a variable of one dimension."""
        dtype = np.dtype(self.dtype)
        if self.step == dtype.itemsize:
            return np.frombuffer(file.read_at(self.shape[0] * self.step, self.begin), dtype, self.shape[0])
        return np.array([np.frombuffer(file.read_at(dtype.itemsize, self.begin + k * self.step), dtype, 1)[0] for k in range(self.shape[0])])

    def unpacked(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled values, and where they are missing: fill values, missing values and NaN."""
        gone = np.isnan(raw) if raw.dtype.kind == "f" else np.zeros(raw.shape, bool)
        for name in ("_FillValue", "missing_value"):
            if name in self.attributes:
                gone |= raw == np.asarray(self.attributes[name]).ravel()[0]
        one = lambda name, default: float(np.asarray(self.attributes.get(name, default)).ravel()[0])
        return raw.astype(np.float64) * one("scale_factor", 1.0) + one("add_offset", 0.0), gone


class _Header:
    """Reads a header from its beginning, a buffer at a time."""

    def __init__(self, file):
        self.file, self.at = file, 4

    def bytes(self, n: int) -> bytes:
        out = self.file.read_at(n, self.at)
        if len(out) < n:
            raise ValueError("the header ends too early")
        self.at += n
        return out

    def number(self, wide: bool = False) -> int:
        return struct.unpack(">Q" if wide else ">I", self.bytes(8 if wide else 4))[0]

    def padded(self, n: int) -> bytes:
        return self.bytes(-(-n // 4) * 4)[:n]


def opened(path: str) -> dict[str, Variable]:
    """The variables of a file, in order, from its header; no data are read."""
    store, at = located(path)
    with store.open_input_file(at) as file:
        magic = file.read_at(4, 0)
        if magic[:3] != b"CDF" or magic[3:] not in (b"\1", b"\2", b"\5"):
            raise ValueError(f"{path} is not a NetCDF file of a classic format")
        wide, far = magic[3] == 5, magic[3] != 1
        h = _Header(file)
        name = lambda: h.padded(h.number(wide)).decode()
        many = lambda: (h.number(), h.number(wide))[1]

        def attributes() -> dict:
            out = {}
            for _ in range(many()):
                key, kind, n = name(), TYPES[h.number()], h.number(wide)
                raw = h.padded(n * np.dtype(kind).itemsize)
                out[key] = raw.decode("utf-8", "replace") if kind == "S1" else np.frombuffer(raw, kind)
            return out

        records = h.number(wide)
        dims = [(name(), h.number(wide)) for _ in range(many())]
        attributes()
        found = []
        for _ in range(many()):
            key, ids = name(), [h.number(wide) for _ in range(h.number(wide))]
            attrs, kind, size, begin = attributes(), TYPES[h.number()], h.number(wide), h.number(far)
            found.append((key, ids, attrs, kind, size, begin))
        in_records = [x for x in found if x[1] and not dims[x[1][0]][1]]
        width = lambda x: int(np.prod([dims[d][1] for d in x[1][1:]], dtype=np.int64)) * np.dtype(x[3]).itemsize
        record = width(in_records[0]) if len(in_records) == 1 else sum(-(-width(x) // 4) * 4 for x in in_records)  # one alone is not padded
        out = {}
        for x in found:
            key, ids, attrs, kind, _, begin = x
            shape = tuple(dims[d][1] or records for d in ids)
            out[key] = Variable(key, tuple(dims[d][0] for d in ids), shape, kind, begin, record if x in in_records else width(x) if ids else np.dtype(kind).itemsize, attrs)
        return out


@dataclass(frozen=True)
class Grid:
    """The wanted variable of a file and its axes: of one dimension each, or of the variable's two."""

    path: str
    value: Variable
    lat: Variable
    lon: Variable


def gridded(path: str, variable: str | None, tokens: Sequence[str] = ()) -> Grid:
    """The variable of a file: that name, else the first that holds a token, else the first of two dimensions that is no palette; single other dimensions count for nothing."""
    found = opened(path)
    axis = lambda names: next((found[k] for c in names for k in found if k.lower() == c), None)
    lat, lon = axis(LAT_NAMES), axis(LON_NAMES)
    if lat is None or lon is None:
        raise ValueError(f"{path} has no axes of latitude and longitude")
    flat = {k: v for k, v in found.items() if len(v.shape) >= 2 and all(n == 1 for n in v.shape[:-2]) and v not in (lat, lon)}
    like = [k for k in flat if any(t.lower() in k.lower() for t in tokens)]
    chosen = variable if variable in flat else (like or [k for k in flat if "palette" not in k.lower()] or [None])[0]
    if chosen is None or (variable is not None and not tokens and chosen != variable):
        raise ValueError(f"{path} has no such variable of two dimensions")
    return Grid(path, flat[chosen], lat, lon)


@dataclass
class Slab(InputPartition):
    """Rows first to last of a grid, and the columns between the bounds."""

    grid: Grid | None
    first: int = 0
    last: int = 0
    left: int = 0
    right: int = 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.pattern, self.variable = options["path"], options.get("pattern", "*.nc"), options.get("variable")
        self.tokens = [t for t in options.get("tokens", "").split(",") if t]
        self.bounds = tuple(map(float, options["bounds"].split(","))) if "bounds" in options else None
        self.run_bytes = int(options.get("runbytes", 8 << 20))
        self.skip = options.get("skip", "true") == "true"

    def partitions(self) -> list[Slab]:
        out = []
        for path in listed(self.path, self.pattern):
            try:
                out += self._slabs(gridded(path, self.variable, self.tokens))
            except (ValueError, KeyError):
                if not self.skip:
                    raise
        return out or [Slab(None)]

    def _slabs(self, g: Grid) -> list[Slab]:
        h, w = g.value.shape[-2:]
        r0, r1, c0, c1 = 0, h, 0, w
        if self.bounds is not None and len(g.lat.shape) == len(g.lon.shape) == 1:
            store, at = located(g.path)
            with store.open_input_file(at) as file:
                west, south, east, north = self.bounds
                ends = lambda v, lo, hi: (lambda k: (int(k[0]), int(k[-1]) + 1) if len(k) else (0, 0))(np.flatnonzero((v >= lo) & (v <= hi)))
                (r0, r1), (c0, c1) = ends(g.lat.unpacked(g.lat.whole(file))[0], south, north), ends(g.lon.unpacked(g.lon.whole(file))[0], west, east)
        rows = max(1, self.run_bytes // max(1, w * np.dtype(g.value.dtype).itemsize))
        return [Slab(g, k, min(r1, k + rows), c0, c1) for k in range(r0, r1, rows)] if c0 < c1 else []

    def read(self, s: Slab) -> Iterator[pa.RecordBatch]:
        if s.grid is None:
            return
        g, columns = s.grid, slice(s.left, s.right)
        store, at = located(g.path)
        with store.open_input_file(at) as file:
            if len(g.lat.shape) == 1:
                lat, lon = np.meshgrid(g.lat.unpacked(g.lat.whole(file))[0][s.first : s.last], g.lon.unpacked(g.lon.whole(file))[0][columns], indexing="ij")
            else:
                lat, lon = (v.unpacked(v.rows(file, s.first, s.last, columns))[0] for v in (g.lat, g.lon))
            value, gone = g.value.unpacked(g.value.rows(file, s.first, s.last, columns))
        i, j = np.meshgrid(np.arange(s.first, s.last, dtype=np.int32), np.arange(s.left, s.right, dtype=np.int32), indexing="ij")
        keep = np.ones(lat.shape, bool)
        if self.bounds is not None:
            keep = (lon >= self.bounds[0]) & (lat >= self.bounds[1]) & (lon <= self.bounds[2]) & (lat <= self.bounds[3])
        n = int(keep.sum())
        yield pa.RecordBatch.from_arrays([pa.array([g.path] * n, pa.string()), pa.array([g.value.name] * n, pa.string()), pa.array(i[keep]), pa.array(j[keep]), pa.array(lat[keep]), pa.array(lon[keep]), pa.array(value[keep], mask=gone[keep])], names=["path", "variable", "i", "j", "lat", "lon", "value"])


class NetcdfSource(DataSource):
    """Cells of a gridded variable of NetCDF files. Options: path, pattern, variable, tokens, bounds, runbytes, skip."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_netcdf"

    def schema(self) -> str:
        return "path string, variable string, i int, j int, lat double, lon double, value double"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_netcdf(spark: SparkSession, path: str, *, variable: str | None = None, tokens: Sequence[str] = (), bounds: tuple[float, float, float, float] | None = None, pattern: str = "*.nc", skip: bool = True, run_bytes: int | None = None) -> DataFrame:
    """path, variable, i, j, lat, lon, value: cells of the wanted variable (as gridded() chooses it) of a file, or of a folder's files, within bounds (west, south, east, north, ends included).

    Only headers and axes are read to plan; a partition is a run of rows of one file, those outside the bounds in none, and of a row that is needed by less than half only that part is read. Values
    are scaled and offset as their attributes say, and null where they are fill or missing values. Axes may rise or fall, and may be of two dimensions. Files that are not of a classic format, or lack the
    variable or the axes, are left out, or raise without skip.
    """
    return registered(spark, NetcdfSource, path=path, pattern=pattern, variable=variable, tokens=",".join(tokens) or None, bounds=None if bounds is None else ",".join(map(repr, bounds)), runbytes=run_bytes, skip=str(skip).lower()).load()


def encoded(lats: np.ndarray, lons: np.ndarray, values: np.ndarray, *, variable: str = "chlor_a", scale: float | None = None, offset: float = 0.0, fill: int = -32767) -> bytes:
    """A CDF-2 file of a grid (lat, lon); NaN is the fill value. With a scale, values are stored as 16-bit whole numbers of it, else as doubles."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    text = lambda s: struct.pack(">I", len(s)) + pad(s.encode())
    listing = lambda tag, items: struct.pack(">II", tag if items else 0, len(items)) + b"".join(items)
    number = {v: k for k, v in TYPES.items()}
    attribute = lambda key, kind, v: text(key) + struct.pack(">II", number[kind], 1) + pad(np.array([v], kind).tobytes())
    if scale is None:
        kind, stored, attrs = ">f8", values, [attribute("_FillValue", ">f8", np.nan)]
    else:
        kind, attrs = ">i2", [attribute("scale_factor", ">f8", scale), attribute("add_offset", ">f8", offset), attribute("_FillValue", ">i2", fill)]
        stored = np.where(np.isnan(values), fill, np.floor((values - offset) / scale + 0.5))
    columns = [("lat", [0], [], ">f8", lats), ("lon", [1], [], ">f8", lons), (variable, [0, 1], attrs, kind, stored)]
    data = [pad(np.asarray(v).astype(k).tobytes()) for _, _, _, k, v in columns]

    def header(begins: Sequence[int]) -> bytes:
        dims = listing(10, [text("lat") + struct.pack(">I", len(lats)), text("lon") + struct.pack(">I", len(lons))])
        variables = [text(n) + struct.pack(f">{1 + len(d)}I", len(d), *d) + listing(12, a) + struct.pack(">IIQ", number[k], len(x), b) for (n, d, a, k, _), x, b in zip(columns, data, begins)]
        return b"CDF\2" + struct.pack(">I", 0) + dims + listing(12, []) + listing(11, variables)

    size = len(header([0] * len(data)))
    return header([size + sum(map(len, data[:k])) for k in range(len(data))]) + b"".join(data)


def contents(cells: DataFrame, *, variable: str = "chlor_a", scale: float | None = None, offset: float = 0.0) -> DataFrame:
    """name, content: a NetCDF file for each grid in cells (path, i, j, lat, lon, value) under its path's last part; store.write_files() writes them. A file is one row, as readers need it whole; cells that are not there are missing."""

    def one(pdf):
        lats, lons = (pdf.drop_duplicates(k).sort_values(k)[[k, v]].to_numpy() for k, v in (("i", "lat"), ("j", "lon")))
        grid = np.full((len(lats), len(lons)), np.nan)
        grid[np.searchsorted(lats[:, 0], pdf["i"]), np.searchsorted(lons[:, 0], pdf["j"])] = pdf["value"].astype(float)
        content = encoded(lats[:, 1], lons[:, 1], grid, variable=variable, scale=scale, offset=offset)
        return type(pdf)({"name": [pdf["path"].iloc[0]], "content": [content]})

    last = F.element_at(F.split("path", "/"), -1)
    rows = cells.select(last.alias("path"), "i", "j", "lat", "lon", F.col("value").cast("double").alias("value"))
    return rows.groupBy("path").applyInPandas(one, "name string, content binary")
