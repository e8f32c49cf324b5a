"""Overlay, dissolve, buffer and repair of polygons, and the join of shapes that meet. Regions are directed boundaries, as arrangement.measures() and rings() read them.

Coordinates are snapped to a precision step first (10 cm by default, in projected metres). Polygons are arrays of rings of [x, y] whose first ring is the shell; null shapes,
rings and vertices count for nothing, and shapes without area have no region.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import arrangement
from tidemark.session import written

PRECISION = 0.1


def bounds(geoms: DataFrame, *, rings: str = "rings") -> DataFrame:
    """geoms with xmin, ymin, xmax, ymax of all vertices; shapes without any are left out."""
    points = F.flatten(F.filter(rings, lambda r: r.isNotNull()))
    axis = lambda k: F.transform(points, lambda p: p[k])
    ends = {"xmin": F.array_min(axis(0)), "ymin": F.array_min(axis(1)), "xmax": F.array_max(axis(0)), "ymax": F.array_max(axis(1))}
    return geoms.withColumns(ends).where("xmin is not null and ymin is not null")


BOX = ["xmin", "ymin", "xmax", "ymax"]


def boxes_that_meet(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str) -> DataFrame:
    """left_id, right_id and the common box (xmin, ymin, xmax, ymax) of every pair whose boxes share a point, each pair once.

    A box lies on the level whose cells are no smaller than it, and so in at most four of them. A pair meets on the coarser of its levels, where the
    finer box is placed as well, in the cell of the lower left corner of what they share. So the sizes of boxes may differ as they like.
    """
    level = F.ceil(F.log2(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(2.0**-20)))).cast("int")
    sides = [df.select(F.col(i).alias(name), *BOX).withColumn("level", level) for df, i, name in ((left, left_id, "l"), (right, right_id, "r"))]
    levels = [sorted(r[0] for r in df.select("level").distinct().collect()) for df in sides]  # a level is a power of two: a few dozen rows

    def placed(df: DataFrame, coarser: list[int]) -> DataFrame:
        at = F.array_union(F.array("level"), F.filter(F.array(*map(F.lit, coarser)).cast("array<int>"), lambda m: m > F.col("level")))
        df = df.withColumn("at", F.explode(at)).withColumn("_s", F.pow(F.lit(2.0), F.col("at")))
        cells = lambda a, b: F.sequence(F.floor(F.col(a) / F.col("_s")), F.floor(F.col(b) / F.col("_s")))
        return df.withColumn("cx", F.explode(cells("xmin", "xmax"))).withColumn("cy", F.explode(cells("ymin", "ymax")))

    a, b = placed(sides[0], levels[1]), placed(sides[1], levels[0])
    b = b.select("r", "at", "cx", "cy", F.col("level").alias("_level"), *[F.col(c).alias(f"_{c}") for c in BOX])
    both = a.join(b.hint("merge"), ["at", "cx", "cy"]).where((F.col("at") == F.greatest("level", "_level")) & (F.col("xmin") <= F.col("_xmax")) & (F.col("_xmin") <= F.col("xmax")) & (F.col("ymin") <= F.col("_ymax")) & (F.col("_ymin") <= F.col("ymax")))
    shared = [F.greatest("xmin", "_xmin").alias("xmin"), F.greatest("ymin", "_ymin").alias("ymin"), F.least("xmax", "_xmax").alias("xmax"), F.least("ymax", "_ymax").alias("ymax")]
    corner = both.select(F.col("l").alias(left_id), F.col("r").alias(right_id), *shared, "cx", "cy", "_s")
    return corner.where((F.floor(F.col("xmin") / F.col("_s")) == F.col("cx")) & (F.floor(F.col("ymin") / F.col("_s")) == F.col("cy"))).select(left_id, right_id, *BOX)


def _of_pairs(geoms: DataFrame, pairs: DataFrame, ids: list[str], own: str, rings: str, precision: float, layer: str) -> DataFrame:
    """Edges of the pairs' shapes, drawn into the pairs' common boxes (a step wider), keyed by pair."""
    low, high = (lambda c: F.floor(F.col(c) / precision).cast("long") - 1), (lambda c: F.ceil(F.col(c) / precision).cast("long") + 1)
    boxes = pairs.select(*[F.col(i).alias(f"_{i}") for i in ids], low("xmin").alias("_x0"), low("ymin").alias("_y0"), high("xmax").alias("_x1"), high("ymax").alias("_y1"))
    edges = arrangement.ring_edges(geoms, F.col(own), F.col(rings), precision, layer=layer)
    met = edges.join(boxes.hint("merge"), edges["key"] == boxes[f"_{own}"]).drop("key").withColumn("key", F.struct(*[F.col(f"_{i}").alias(i) for i in ids]))
    drawn = arrangement.clamped(met.select("key", *arrangement.EDGE, "a", "b", "_x0", "_y0", "_x1", "_y1"), tuple(F.col(c) for c in ("_x0", "_y0", "_x1", "_y1")))
    return drawn.select("key", *arrangement.EDGE, "a", "b")


HOW = {"intersection": lambda a, b: (a > 0) & (b > 0), "union": lambda a, b: (a > 0) | (b > 0), "difference": lambda a, b: (a > 0) & ~(b > 0), "symmetric_difference": lambda a, b: (a > 0) != (b > 0)}


def overlay(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, left_rings: str = "rings", right_rings: str = "rings", precision: float = PRECISION) -> DataFrame:
    """key (left_id, right_id), x1, y1, x2, y2: boundaries of what each left polygon shares with each right one, for pairs that share an area.

    Any rings and holes. Pairs come from boxes_that_meet(); only what lies in a pair's common box enters its arrangement. Ids are unique on each side.
    """
    sides = [df.select(F.col(i), F.col(r).alias("rings")) for df, i, r in ((left, left_id, left_rings), (right, right_id, right_rings))]
    pairs = written(boxes_that_meet(bounds(sides[0]), bounds(sides[1]), left_id=left_id, right_id=right_id))
    ids = [left_id, right_id]
    edges = [_of_pairs(df, pairs, ids, i, "rings", precision, layer) for df, i, layer in zip(sides, ids, "ab")]
    return arrangement.boundary(edges[0].unionByName(edges[1]), HOW["intersection"])


def meeting(left: DataFrame, right: DataFrame, *, left_id: str, right_id: str, precision: float = PRECISION) -> DataFrame:
    """The left rows whose polygons (rings) share an area with any of the right ones."""
    shared = overlay(left, right, left_id=left_id, right_id=right_id, precision=precision)
    return left.join(shared.select(F.col("key")[left_id].alias(left_id)).distinct().hint("merge"), left_id, "left_semi")


def combined(left: DataFrame, right: DataFrame, how: str, *, key: Column, left_rings: str = "rings", right_rings: str = "rings", precision: float = PRECISION) -> DataFrame:
    """key, x1, y1, x2, y2: boundary, for each key, of all left polygons against all right ones of that key: intersection, union, difference or symmetric_difference."""
    edges = arrangement.ring_edges(left, key, F.col(left_rings), precision).unionByName(arrangement.ring_edges(right, key, F.col(right_rings), precision, layer="b"))
    return arrangement.boundary(edges, HOW[how])


def dissolved(geoms: DataFrame, key: Column, *, rings: str = "rings", precision: float = PRECISION) -> DataFrame:
    """key, x1, y1, x2, y2: boundary of the union of all polygons of a key. Inner edges cancel; a key may hold any share of the rows."""
    return arrangement.boundary(arrangement.ring_edges(geoms, key, F.col(rings), precision), lambda a, b: a > 0)


def valid(geoms: DataFrame, key: Column, *, rings: str = "rings", rule: str = "even_odd", precision: float = PRECISION) -> DataFrame:
    """key, x1, y1, x2, y2: the region that possibly self-crossing rings enclose: where they wind an odd number of times, or at all (rule 'nonzero')."""
    inside = {"even_odd": lambda a, b: F.pmod(a, F.lit(2)) == 1, "nonzero": lambda a, b: a != 0}[rule]
    return arrangement.boundary(arrangement.ring_edges(geoms, key, F.col(rings), precision, orient=False), inside)


def arc(distance: float, precision: float, quad_segs: int) -> list[tuple[int, int]]:
    """The vertices of a circle around the origin, in steps of the precision, counter-clockwise from the right."""
    angles = [k * math.pi / (2 * quad_segs) for k in range(4 * quad_segs)]
    whole = lambda v: math.floor(abs(v) + 0.5) * (1 if v > 0 else -1)
    return [(whole(distance / precision * math.cos(t)), whole(distance / precision * math.sin(t))) for t in angles]


def _capsules(lines: DataFrame, key: Column, line: Column, distance: float, precision: float, quad_segs: int, closed: bool) -> DataFrame:
    """Edges of the outlines of all points within distance of each segment of the lines (arrays of [x, y])."""
    snapped = F.transform(F.filter(line, lambda p: p[0].isNotNull() & p[1].isNotNull()), lambda p: F.struct(F.round(p[0] / precision).cast("long").alias("x"), F.round(p[1] / precision).cast("long").alias("y")))
    out = lines.select(key.alias("key"), snapped.alias("_l")).where(F.size("_l") > 0)
    last = F.size("_l") if closed else F.greatest(F.size("_l") - 1, F.lit(1))  # a single point is a segment without length
    out = out.select("key", "_l", F.explode(F.sequence(F.lit(1), last)).alias("_i"))
    p, q = F.element_at("_l", F.col("_i")), F.element_at("_l", (F.col("_i") % F.size("_l") + 1).cast("int"))
    out = out.select("key", F.when(p < q, p).otherwise(q).alias("p"), F.when(p < q, q).otherwise(p).alias("q")).distinct()
    d, step, n = distance / precision, math.pi / (2 * quad_segs), 4 * quad_segs
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    length = F.hypot(dx, dy)
    off = lambda v: F.when(length > 0, F.round(d * v / length)).otherwise(0).cast("long")
    out = out.withColumns({"_nx": F.when(length > 0, off(dy)).otherwise(0), "_ny": F.when(length > 0, off(-dx)).otherwise(round(-d)), "_t": F.when(length > 0, F.atan2(-dx, dy)).otherwise(-math.pi / 2)})
    circle = F.array(*[F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in arc(distance, precision, quad_segs)])
    point = lambda c, x, y: F.struct((F.col(f"{c}.x") + x).alias("x"), (F.col(f"{c}.y") + y).alias("y"))

    def half(c: str, turn: float) -> Column:
        """Vertices strictly between the normal turned so far and half a circle on."""
        first, last = F.floor((F.col("_t") + turn) / step + 1e-9) + 1, F.ceil((F.col("_t") + turn + math.pi) / step - 1e-9) - 1
        return F.transform(F.sequence(first, last), lambda k: point(c, F.element_at(circle, (F.pmod(k, F.lit(n)) + 1).cast("int"))["x"], F.element_at(circle, (F.pmod(k, F.lit(n)) + 1).cast("int"))["y"]))

    nx, ny = F.col("_nx"), F.col("_ny")
    ring = F.concat(F.array(point("p", nx, ny), point("q", nx, ny)), half("q", 0.0), F.array(point("q", -nx, -ny), point("p", -nx, -ny)), half("p", math.pi))
    ring = F.transform(ring, lambda v: F.array(v["x"].cast("double"), v["y"].cast("double")))
    return arrangement.ring_edges(out.select("key", F.array(ring).alias("_r")), F.col("key"), F.col("_r"), 1.0)


def buffered(geoms: DataFrame, key: Column, distance: float, *, rings: str | None = None, line: str | None = None, quad_segs: int = 16, precision: float = PRECISION) -> DataFrame:
    """key, x1, y1, x2, y2: boundary of all that lies within distance of the polygons (rings) or polylines (line: an array of [x, y]) of a key, dissolved.

    Sides are offset along their normals, ends and bends are arcs with quad_segs vertices a quarter; the outlines of all segments, and the polygons, are wound into one
    region. A line of one point gives a disc. distance must be positive.
    """
    if distance <= 0 or (rings is None) == (line is None):
        raise ValueError("give a positive distance, and either rings or a line")
    if line is not None:
        edges = _capsules(geoms, key, F.col(line), distance, precision, quad_segs, closed=False)
    else:
        own = geoms.select(key.alias("key"), F.explode(rings).alias("_ring")).where("_ring is not null")
        edges = _capsules(own, F.col("key"), F.col("_ring"), distance, precision, quad_segs, closed=True)
        edges = edges.unionByName(arrangement.ring_edges(geoms, key, F.col(rings), precision))
    return arrangement.boundary(edges, lambda a, b: a > 0)


def coastal_band(lines: DataFrame, area: DataFrame, key: Column, distance: float, *, line: str = "line", rings: str = "rings", quad_segs: int = 16, precision: float = PRECISION) -> DataFrame:
    """key, x1, y1, x2, y2: boundary of all that lies within distance of a key's lines and in its area's polygons: buffer, dissolve and intersection in one arrangement."""
    band = _capsules(lines, key, F.col(line), distance, precision, quad_segs, closed=False)
    return arrangement.boundary(band.unionByName(arrangement.ring_edges(area, key, F.col(rings), precision, layer="b")), HOW["intersection"])
