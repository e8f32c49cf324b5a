"""Nearest cells, expanding fills and tiles of gridded values in long form (path, i, j, lat, lon, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.parse import finite
from tidemark.session import written


def nearest_index(axis: Column, q: Column) -> Column:
    """0-based index of the axis value nearest to q; ties go to the lower index; clamped at the ends; axis ascending or descending; null for an empty axis."""
    n = F.size(axis)
    rising = F.element_at(axis, 1) <= F.element_at(axis, -1)
    before = F.size(F.filter(axis, lambda v: F.when(rising, v < q).otherwise(v > q)))
    lo = F.greatest(F.lit(0), F.least(before - 1, n - 1))
    hi = F.least(before, n - 1)
    closer = F.abs(F.element_at(axis, lo + 1) - q) <= F.abs(F.element_at(axis, hi + 1) - q)
    return F.when((n > 0) & q.isNotNull(), F.when(closer, lo).otherwise(hi))


def regular_index(q: Column, first: Column, step: Column, n: Column) -> Column:
    """The same on an evenly spaced axis by arithmetic; ties go to the lower index."""
    x = (q - first) / step
    return F.greatest(F.lit(0), F.least((F.ceil(x - 0.5)).cast("int"), n - 1))


def axes(cells: DataFrame) -> DataFrame:
    """path, lats, lons: the axes of each grid in index order."""
    pick = lambda k, v: F.transform(F.array_sort(F.collect_set(F.struct(F.col(k), F.col(v)))), lambda s: s[v])
    return cells.groupBy("path").agg(pick("i", "lat").alias("lats"), pick("j", "lon").alias("lons"))


def place(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points (path, lon, lat, ...) with the indices i, j of their nearest cell on one-dimensional axes."""
    out = points.join(axes(cells), "path")
    return out.withColumn("i", nearest_index(F.col("lats"), F.col("lat"))).withColumn("j", nearest_index(F.col("lons"), F.col("lon"))).drop("lats", "lons")


def sample(points: DataFrame, cells: DataFrame, *, key: str, radius: int = 7, mode: str = "mean") -> DataFrame:
    """key, value for points (key, path, i, j): the cell's value if finite, else from the smallest square ring, up to radius, with a finite one.

    mode 'mean' averages that window, 'nearest' takes its first finite cell, rows before columns, low before high. Cells are met by equality of path, i and j. Only
    points whose own cell is not finite are spread over the window.
    """
    good = cells.where(finite(F.col("value"))).select("path", "i", "j", F.col("value").cast("double").alias("value"))
    own = points.select(key, "path", "i", "j").join(good, ["path", "i", "j"], "left")
    hit = own.where("value is not null").select(key, "value")
    miss = own.where("value is null").drop("value")
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    spread = miss.select(key, "path", F.col("i").alias("i0"), F.col("j").alias("j0"), F.explode(steps).alias("di")).select("*", F.explode(steps).alias("dj"))
    spread = spread.select(key, "path", (F.col("i0") + F.col("di")).alias("i"), (F.col("j0") + F.col("dj")).alias("j"), "di", "dj", F.greatest(F.abs("di"), F.abs("dj")).alias("r"))
    near = spread.join(good, ["path", "i", "j"])
    if mode == "mean":
        by_ring = near.groupBy(key, "r").agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
        filled = by_ring.groupBy(key).agg(F.min_by(F.col("s") / F.col("n"), "r").alias("value"))
    else:
        limits = cells.groupBy("path").agg(F.max("i").alias("top"), F.max("j").alias("end"), F.min("i").alias("low"), F.min("j").alias("start"))
        at = near.join(limits, "path")
        i0, j0 = F.col("i") - F.col("di"), F.col("j") - F.col("dj")
        a, b = F.greatest(i0 - F.col("r"), F.col("low")), F.least(i0 + F.col("r"), F.col("top"))
        edge = (F.col("i") == a) | (F.col("i") == b)
        rank = F.struct(F.col("r"), F.when(edge, 0).otherwise(1).alias("phase"), F.when(edge, F.col("j")).otherwise(F.col("i")).alias("along"), F.when(edge, F.col("i")).otherwise(F.col("j")).alias("across"))
        filled = at.groupBy(key).agg(F.min_by("value", rank).alias("value"))
    missed = miss.select(key).join(filled, key, "left")
    return hit.unionByName(missed.select(key, "value"))


def nearest_curvilinear(points: DataFrame, cells: DataFrame, *, key: str, cell_degrees: float | None = None) -> DataFrame:
    """key, value of the nearest cell (plain distance in degrees) where each cell has its own lat and lon; null only for a path without cells.

    Cells and points meet in square buckets and the eight around. Whatever lies within a bucket's side is then found, so an answer that near is final; the points
    that are left, written once a round, go on to buckets of eight times the side, up to one that holds the globe, and no further once none is left. The first side is cell_degrees, or
    else twice the spacing of the widest-spaced path's cells, were they laid out evenly over their extent.
    """
    if cell_degrees is None:
        extent = (F.max("lat") - F.min("lat")) * (F.max("lon") - F.min("lon"))
        spacing = cells.groupBy("path").agg((2 * F.sqrt(extent / F.count(F.lit(1)))).alias("s")).agg(F.max("s")).first()[0]
        cell_degrees = min(720.0, max(spacing or 0.5, 1e-3))
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    left, answers, side = points.select(key, "path", "lat", "lon"), [], cell_degrees
    d = F.hypot(F.col("clat") - F.col("lat"), F.col("clon") - F.col("lon"))
    while True:
        b = lambda c, side=side: F.floor(F.col(c) / side).cast("long")
        cs = cells.select("path", F.col("lat").alias("clat"), F.col("lon").alias("clon"), "value", "i", "j", b("lat").alias("by"), b("lon").alias("bx"))
        ps = left.select("*", F.explode(around).alias("dy")).select("*", F.explode(around).alias("dx"))
        ps = ps.select(key, "path", "lat", "lon", (b("lat") + F.col("dy")).alias("by"), (b("lon") + F.col("dx")).alias("bx"))
        nearest = F.min(F.when(F.col("clat").isNotNull(), F.struct(d.alias("d"), F.col("i"), F.col("j"), F.col("value")))).alias("_b")
        tried = written(ps.join(cs, ["path", "by", "bx"], "left").groupBy(key, "path", "lat", "lon").agg(nearest))
        final = F.lit(True) if side >= 720 else F.coalesce(F.col("_b.d") <= side, F.lit(False))
        answers.append(tried.where(final).select(key, "_b.value"))
        left = tried.where(~final).select(key, "path", "lat", "lon")
        if side >= 720 or left.isEmpty():
            found = answers[0]
            for more in answers[1:]:
                found = found.unionByName(more)
            return found
        side = min(720.0, side * 8)


def clip(cells: DataFrame, west: float, south: float, east: float, north: float) -> DataFrame:
    """Cells in a closed box, whatever the axes' directions."""
    return cells.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def tiles(cells: DataFrame, size: int, *, nan_ratio: float = 0.2, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """path, tile_row, tile_col, mean, n, missing of full tiles of size x size whose share of missing values is at most nan_ratio."""
    limits = cells.groupBy(*keys).agg((F.max("i") + 1).alias("_h"), (F.max("j") + 1).alias("_w"))
    r, c = F.floor(F.col("i") / size).cast("int"), F.floor(F.col("j") / size).cast("int")
    inside = cells.join(limits, list(keys)).where((r < F.floor(F.col("_h") / size)) & (c < F.floor(F.col("_w") / size)))
    v = F.when(finite(F.col("value")), F.col("value").cast("double"))
    out = inside.groupBy(*keys, r.alias("tile_row"), c.alias("tile_col")).agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"), F.avg(v.isNull().cast("double")).alias("missing"))
    return out.where(F.col("missing") <= nan_ratio)


def class_share(cells: DataFrame, value: str, wanted: int, least: float, *keys: str) -> DataFrame:
    """Groups in which at least `least` of the cells are of the wanted class; groups without any class pass."""
    share = F.avg((F.col(value) == wanted).cast("double"))
    out = cells.groupBy(*keys).agg(share.alias("share"))
    return out.where((F.col("share") >= least) | F.col("share").isNull())
