"""Gridded products and rasters: packed and long forms, discovery of variables and axes, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import clamp

LON_NAMES, LAT_NAMES = ("lon", "longitude", "x"), ("lat", "latitude", "y")


def find_variable(names: Column, wanted: str, tokens: Sequence[str] = (), not_these: Sequence[str] = ("palette",)) -> Column:
    """wanted if among the names, else the first that holds a token, else the first that holds none of not_these."""
    holds = lambda n, ts: F.forall(F.array(*map(F.lit, ts)), lambda t: ~F.contains(F.lower(n), F.lower(t)))
    exact = F.when(F.array_contains(names, F.lit(wanted)), F.lit(wanted))
    like = F.try_element_at(F.filter(names, lambda n: ~holds(n, tokens)), F.lit(1)) if tokens else F.lit(None).cast("string")
    other = F.try_element_at(F.filter(names, lambda n: holds(n, not_these)), F.lit(1))
    return F.coalesce(exact, like, other)


def find_axis(names: Column, candidates: Sequence[str]) -> Column:
    return F.coalesce(*[F.try_element_at(F.filter(names, _equals(c)), F.lit(1)) for c in candidates])


def _equals(c: str):
    return lambda n: F.lower(n) == F.lit(c)


def to_long(packed: DataFrame) -> DataFrame:
    """packed (path, lats, lons, vals: array of rows) to path, i, j, lat, lon, value."""
    rows = packed.select("path", "lats", "lons", F.posexplode("vals").alias("i", "row"))
    cells = rows.select("path", "i", F.col("lats")[F.col("i")].alias("lat"), "lons", F.posexplode("row").alias("j", "value"))
    return cells.select("path", "i", "j", "lat", F.col("lons")[F.col("j")].alias("lon"), F.col("value").cast("double").alias("value"))


def to_packed(cells: DataFrame) -> DataFrame:
    """The inverse of to_long; each grid must fit a row."""
    rows = cells.groupBy("path", "i", "lat").agg(F.array_sort(F.collect_list(F.struct("j", "lon", "value"))).alias("r"))
    line = F.struct("i", "lat", F.transform("r", lambda s: s["lon"]).alias("lons"), F.transform("r", lambda s: s["value"]).alias("v"))
    out = rows.groupBy("path").agg(F.array_sort(F.collect_list(line)).alias("g"))
    return out.select("path", F.transform("g", lambda s: s["lat"]).alias("lats"), F.col("g")[0]["lons"].alias("lons"), F.transform("g", lambda s: s["v"]).alias("vals"))


def window(bounds: Column, affine: Column, height: Column, width: Column) -> Column:
    """Struct of row0, row1, col0, col1 (ends exclusive, one pixel at least) that a raster has of bounds (xmin, ymin, xmax, ymax), clamped to it."""
    from tidemark.functions.geo import map_to_pixel

    r0, c0 = map_to_pixel(bounds["xmin"], bounds["ymax"], affine)
    r1, c1 = map_to_pixel(bounds["xmax"], bounds["ymin"], affine)
    low, high = F.least(r0, r1), F.greatest(r0, r1)
    left, right = F.least(c0, c1), F.greatest(c0, c1)
    a, b = clamp(low, 0, height - 1), clamp(left, 0, width - 1)
    return F.struct(a.alias("row0"), F.greatest(a + 1, clamp(high, 0, height)).alias("row1"), b.alias("col0"), F.greatest(b + 1, clamp(right, 0, width)).alias("col1"))


def resample(band: Column, width: Column, win: Column, out_h: int, out_w: int) -> Column:
    """Nearest pixels of a window of a flat band, out_h x out_w of them, flat."""
    h, w = win["row1"] - win["row0"], win["col1"] - win["col0"]
    cells = F.sequence(F.lit(0), F.lit(out_h * out_w - 1))
    at = lambda k: (win["row0"] + F.floor((F.floor(k / out_w) + 0.5) * h / out_h)) * width + win["col0"] + F.floor((k % out_w + 0.5) * w / out_w)
    return F.transform(cells, lambda k: F.try_element_at(band, (at(k) + 1).cast("int")))


def point_sample(x: Column, y: Column, band: Column, mask: Column, affine: Column, height: Column, width: Column) -> Column:
    """The finite, unmasked value of a flat band at a map point; null outside."""
    from tidemark.functions.geo import map_to_pixel
    from tidemark.functions.parse import finite

    r, c = map_to_pixel(x, y, affine)
    at = (r * width + c + 1).cast("int")
    inside = r.between(0, height - 1) & c.between(0, width - 1)
    v = F.when(inside, F.try_element_at(band, at)).cast("double")
    return F.when(inside & (F.try_element_at(mask, at) > 0) & finite(v), v)


def sample_any(points: DataFrame, rasters: DataFrame, cells: DataFrame, *, key: str, radius: int = 7) -> DataFrame:
    """key, value of points (key, path, lon, lat) by the suffix of their file: .tif and .tiff from rasters, .nc from gridded cells, null for others and for what is not there.

    rasters: path, band, mask (flat arrays), affine, height, width, epsg (4326 for degrees, else a UTM zone; null samples nothing). cells: path, i, j, lat, lon, value.
    """
    from tidemark.functions.geo import to_utm
    from tidemark.functions.names import suffix
    from tidemark.operators import grid

    kind = F.lower(suffix(F.col("path")))
    flat = points.where(kind.isin(".tif", ".tiff")).join(rasters, "path", "left")
    east, north = to_utm(F.col("lon"), F.col("lat"), F.col("epsg"))
    degrees = F.col("epsg") == 4326
    x, y = F.when(degrees, F.col("lon")).otherwise(east), F.when(degrees, F.col("lat")).otherwise(north)
    out = flat.select(key, point_sample(x, y, F.col("band"), F.col("mask"), F.col("affine"), F.col("height"), F.col("width")).alias("value"))
    placed = grid.place(points.where(kind == ".nc").select(key, "path", "lon", "lat"), cells)
    found = grid.sample(placed, cells, key=key, radius=radius)
    rest = points.where(~kind.isin(".tif", ".tiff")).select(key).join(found, key, "left")
    return out.unionByName(rest.select(key, "value"))
