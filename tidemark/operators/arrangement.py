"""Arrangements of polygon edges: split where they meet, counted by layer, wound around, and chained into rings.

Coordinates are whole numbers of a precision step. An edge is a row (key, x1, y1, x2, y2, a, b): it goes upwards, or to the right if level, and a and b say how often
layer A and layer B run along it that way, less the runs the other way. Rows of one key form one arrangement. Every step is a join or a sum within cells of a grid
laid over each key, so no large arrangement is one task or one row; the grid's side follows the key's edges. Joins ask for a merge: tables of whole numbers are many times
smaller as files than as rows, so the planner would broadcast, by file sizes, what the driver cannot hold. Points at which edges cross each other or a cell's border are rounded,
so what comes out is right to half a step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import discard, own_run, written

EDGE = ["x1", "y1", "x2", "y2"]
GRID = ["s", "x0", "y0"]
#: Keys of so many edges or fewer are not cut into cells.
ONE_CELL = 128
MOST_ROUNDS = 40


def _whole(x: Column) -> Column:
    return F.round(x).cast("long")


def _cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def upright(edges: DataFrame) -> DataFrame:
    """Edges turned to go upwards, or to the right if level, with their counts' signs turned likewise; edges without length are left out."""
    down = (F.col("y1") > F.col("y2")) | ((F.col("y1") == F.col("y2")) & (F.col("x1") > F.col("x2")))
    turned = {c: F.when(down, F.col(o)).otherwise(F.col(c)) for c, o in zip(EDGE, ("x2", "y2", "x1", "y1"))}
    signed = {c: F.when(down, -F.col(c)).otherwise(F.col(c)) for c in ("a", "b")}
    return edges.where("x1 != x2 or y1 != y2").withColumns(turned | signed)


def ring_edges(geoms: DataFrame, key: Column, rings: Column, precision: float, *, layer: str = "a", orient: bool = True) -> DataFrame:
    """Edges of polygons given as arrays of rings of [x, y], the first ring of a row being its shell and the others holes; closed or not.

    With orient, shells run counter-clockwise and holes clockwise by their signed areas, so the interior is to the left. Rows, rings and vertices that are null give no edges.
    """
    snap = lambda ring: F.transform(F.filter(ring, lambda p: p[0].isNotNull() & p[1].isNotNull()), lambda p: F.struct(_whole(p[0] / precision).alias("x"), _whole(p[1] / precision).alias("y")))
    out = geoms.select(key.alias("key"), F.posexplode(rings).alias("_at", "_ring")).where("_ring is not null").select("key", "_at", snap(F.col("_ring")).alias("_ring"))
    out = out.where(F.size("_ring") > 1)
    nxt = lambda i: F.element_at("_ring", (i % F.size("_ring") + 1).cast("int"))
    doubled = F.aggregate(F.sequence(F.lit(1), F.size("_ring")), F.lit(0).cast("long"), lambda s, i: s + (F.element_at("_ring", i)["x"] - nxt(i)["x"]) * (F.element_at("_ring", i)["y"] + nxt(i)["y"]))
    sign = F.when((doubled > 0) != (F.col("_at") == 0), -1).otherwise(1) if orient else F.lit(1)
    out = out.withColumn("_sign", sign).select("key", "_sign", "_ring", F.explode(F.sequence(F.lit(1), F.size("_ring"))).alias("_i"))
    p, q = F.element_at("_ring", F.col("_i")), nxt(F.col("_i"))
    count = {c: (F.col("_sign") if c == layer else F.lit(0)).cast("long").alias(c) for c in ("a", "b")}
    return upright(out.select("key", p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2"), *count.values()))


def merged(edges: DataFrame, *more: str) -> DataFrame:
    """One row an edge, counts added up; an edge whose runs cancel in both layers is no boundary and goes."""
    return edges.groupBy("key", *more, *EDGE).agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a != 0 or b != 0")


def cut(edges: DataFrame, axis: str, lines: Column) -> DataFrame:
    """Edges cut where they cross the given lines (coordinates on the axis; those not strictly between an edge's ends do nothing), at points rounded to whole numbers."""
    c1, c2, o1, o2 = (F.col(c) for c in (("x1", "x2", "y1", "y2") if axis == "x" else ("y1", "y2", "x1", "x2")))
    lines = F.array_sort(F.filter(lines, lambda v: (v > F.least(c1, c2)) & (v < F.greatest(c1, c2))))
    lines = F.when(c1 <= c2, lines).otherwise(F.reverse(lines))
    point = lambda c, o: F.struct(*((c.alias("x"), o.alias("y")) if axis == "x" else (o.alias("x"), c.alias("y"))))
    across = lambda v: point(v, o1 + _whole((v - c1).cast("double") * (o2 - o1) / (c2 - c1)))
    points = F.concat(F.array(point(c1, o1)), F.transform(lines, across), F.array(point(c2, o2)))
    return _pieces(edges, points)


def _pieces(edges: DataFrame, points: Column) -> DataFrame:
    """Each edge as the pieces between consecutive points."""
    rest = [c for c in edges.columns if c not in EDGE]
    out = edges.select(*rest, points.alias("_p")).select(*rest, "_p", F.explode(F.sequence(F.lit(1), F.size("_p") - 1)).alias("_i"))
    p, q = F.element_at("_p", F.col("_i")), F.element_at("_p", F.col("_i") + 1)
    return upright(out.select(*rest, p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def clamped(edges: DataFrame, box: tuple[Column, Column, Column, Column]) -> DataFrame:
    """Edges drawn into a box (xmin, ymin, xmax, ymax, whole numbers): what is outside moves to the nearest point of the border. Windings within the box stay,
    and what folds onto itself on the border cancels in merged()."""
    out = cut(edges, "x", F.array(box[0], box[2]))
    out = cut(out, "y", F.array(box[1], box[3]))
    into = lambda c, lo, hi: F.least(F.greatest(F.col(c), lo), hi)
    return upright(out.withColumns({"x1": into("x1", box[0], box[2]), "x2": into("x2", box[0], box[2]), "y1": into("y1", box[1], box[3]), "y2": into("y2", box[1], box[3])}))


def _gridded(edges: DataFrame) -> DataFrame:
    """Edges relative to their key's lower left corner (x0, y0), with the side s of the key's cells, cut at the cells' borders.

    A key of few edges is one cell, and none of them is cut. Else s is a power of two over the edges' mean extent and over the side that holds four edges when evenly spread, or twice that extent if less:
    edges seldom fill their key's box, and cells that grow with the box would hold ever more of them. Cells without edges cost nothing, and pieces stay within a few times the edges.
    """
    far = F.greatest(F.abs(F.col("x2") - F.col("x1")), F.col("y2") - F.col("y1"))
    x0, y0, n = F.min(F.least("x1", "x2")), F.min("y1"), F.count(F.lit(1))
    w, h = F.max(F.greatest("x1", "x2")) - x0, F.max("y2") - y0
    side = F.when(n <= ONE_CELL, F.greatest(w, h) + 1.0).otherwise(F.greatest(F.avg(far), F.least(F.sqrt(4.0 * w * h / n), 2 * F.avg(far)), F.lit(4.0)))
    sides = edges.groupBy("key").agg(F.pow(F.lit(2.0), F.ceil(F.log2(side))).cast("long").alias("s"), x0.alias("x0"), y0.alias("y0"))
    out = edges.join(sides.hint("merge"), "key").withColumns({c: F.col(c) - F.col(f"{c[0]}0") for c in EDGE})
    for axis, lo, hi in (("x", F.least("x1", "x2"), F.greatest("x1", "x2")), ("y", F.col("y1"), F.col("y2"))):
        first, last = F.floor(lo / F.col("s")) + 1, F.ceil(hi / F.col("s")) - 1
        out = cut(out, axis, F.when(first <= last, F.transform(F.sequence(first, last), lambda k: k * F.col("s"))).otherwise(F.array().cast("array<bigint>")))
    return merged(out, *GRID)


def _cell(edges: DataFrame) -> DataFrame:
    """Edges with their cell (ci, cj): upright ones on a border belong to the cell on its left, level ones to the cell above."""
    on_border = (F.col("x1") == F.col("x2")) & (F.col("x1") % F.col("s") == 0)
    return edges.withColumn("ci", F.floor(F.least("x1", "x2") / F.col("s")) - on_border.cast("long")).withColumn("cj", F.floor(F.col("y1") / F.col("s")))


@own_run
def noded(edges: DataFrame) -> DataFrame:
    """Edges on their key's grid that meet only at their ends: cut at crossings and at ends of others that lie on them.

    Crossings are rounded, which can make new ones: rounds go on, over pairs with a changed edge only, until none is found. Pairs meet in the cells of the grid.
    """
    spark = edges.sparkSession
    out = written(_gridded(edges).withColumn("fresh", F.lit(True)))
    for _ in range(MOST_ROUNDS):
        own = _cell(out)
        on_x = (F.col("x1") == F.col("x2")) & (F.col("x1") % F.col("s") == 0)
        on_y = (F.col("y1") == F.col("y2")) & (F.col("y1") % F.col("s") == 0)
        beside = F.when(on_x, F.array(F.struct("ci", "cj"), F.struct((F.col("ci") + 1).alias("ci"), F.col("cj")))).when(on_y, F.array(F.struct("ci", "cj"), F.struct(F.col("ci"), (F.col("cj") - 1).alias("cj")))).otherwise(F.array(F.struct("ci", "cj")))
        placed = own.select("key", *EDGE, "fresh", F.explode(beside).alias("_c")).select("key", "_c.ci", "_c.cj", F.struct(*EDGE).alias("e"), "fresh")
        left, right = placed.alias("l"), placed.withColumnsRenamed({"e": "f", "fresh": "fresh_f"}).alias("r")
        e, f = F.col("e"), F.col("f")
        meet = (F.least(e["x1"], e["x2"]) <= F.greatest(f["x1"], f["x2"])) & (F.least(f["x1"], f["x2"]) <= F.greatest(e["x1"], e["x2"])) & (e["y1"] <= f["y2"]) & (f["y1"] <= e["y2"])
        pairs = left.join(right.hint("merge"), ["key", "ci", "cj"]).where((e < f) & (F.col("fresh") | F.col("fresh_f")) & meet)
        cuts = pairs.select("key", F.explode(_cuts(e, f)).alias("_c")).groupBy("key", "_c.e").agg(F.collect_set("_c.p").alias("p"))
        cuts = written(cuts.select("key", *[F.col("e")[c].alias(c) for c in EDGE], "p"))
        if cuts.isEmpty():
            discard(spark, keep=[out])
            return out.drop("fresh")
        dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
        along = F.array_sort(F.transform("p", lambda p: F.struct(((p["x"] - F.col("x1")) * dx + (p["y"] - F.col("y1")) * dy).alias("t"), p["x"].alias("x"), p["y"].alias("y"))))
        ends = lambda x, y: F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
        points = F.concat(ends("x1", "y1"), F.coalesce(F.transform(along, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))), F.array().cast("array<struct<x:bigint,y:bigint>>")), ends("x2", "y2"))
        split = _pieces(out.join(cuts.hint("merge"), ["key", *EDGE], "left").withColumn("fresh", F.col("p").isNotNull()), points).drop("p")
        out = written(split.groupBy("key", *GRID, *EDGE).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("fresh").alias("fresh")).where("a != 0 or b != 0"))
        discard(spark, keep=[out])
    raise RuntimeError(f"edges still cross after {MOST_ROUNDS} rounds")


def _cuts(e: Column, f: Column) -> Column:
    """Array of (e, p): the points at which two edges cut each other."""
    side = lambda g, x, y: F.signum(_cross(g["x2"] - g["x1"], g["y2"] - g["y1"], x - g["x1"], y - g["y1"]))

    def on(g: Column, x: Column, y: Column) -> Column:
        t = (x - g["x1"]) * (g["x2"] - g["x1"]) + (y - g["y1"]) * (g["y2"] - g["y1"])
        whole = (g["x2"] - g["x1"]) * (g["x2"] - g["x1"]) + (g["y2"] - g["y1"]) * (g["y2"] - g["y1"])
        return (side(g, x, y) == 0) & (t > 0) & (t < whole)

    def touch(g: Column, h: Column, x: str, y: str) -> Column:
        return F.when(on(g, h[x], h[y]), F.struct(g.alias("e"), F.struct(h[x].alias("x"), h[y].alias("y")).alias("p")))

    crossing = (side(e, f["x1"], f["y1"]) * side(e, f["x2"], f["y2"]) < 0) & (side(f, e["x1"], e["y1"]) * side(f, e["x2"], e["y2"]) < 0)
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    t = _cross(f["x1"] - e["x1"], f["y1"] - e["y1"], f["x2"] - f["x1"], f["y2"] - f["y1"]).cast("double") / _cross(dx, dy, f["x2"] - f["x1"], f["y2"] - f["y1"])
    p = F.struct((e["x1"] + _whole(t * dx)).alias("x"), (e["y1"] + _whole(t * dy)).alias("y"))
    other = lambda g: crossing & ~((p["x"] == g["x1"]) & (p["y"] == g["y1"])) & ~((p["x"] == g["x2"]) & (p["y"] == g["y2"]))
    crossed = [F.when(other(g), F.struct(g.alias("e"), p.alias("p"))) for g in (e, f)]
    found = F.array(touch(e, f, "x1", "y1"), touch(e, f, "x2", "y2"), touch(f, e, "x1", "y1"), touch(f, e, "x2", "y2"), *crossed)
    return F.filter(found, lambda c: c.isNotNull())


def wound(nodes: DataFrame) -> DataFrame:
    """noded edges with wa and wb, how often each layer winds around what lies just to their left; to their right it is wa - a and wb - b.

    A cell's corner is wound as the edges that rise from the cell's bottom line left of it say: running sums along a row of cells. From the corner the way goes up
    the cell's left side, over edges that begin there, and then level to the middle of the edge, over edges in between; all of these are in the cell.
    """
    e = _cell(nodes).withColumn("xl", F.col("ci") * F.col("s")).withColumn("yb", F.col("cj") * F.col("s"))
    rises = (F.col("y1") == F.col("yb")) & (F.col("y2") > F.col("y1"))
    cells = e.groupBy("key", "ci", "cj").agg(*[F.sum(F.when(rises, -F.col(c)).otherwise(0)).alias(c) for c in ("a", "b")])
    before = Window.partitionBy("key", "cj").orderBy("ci").rowsBetween(Window.unboundedPreceding, -1)
    corners = cells.select("key", "ci", "cj", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"w{c}") for c in ("a", "b")])
    others = e.select("key", "ci", "cj", *[F.col(c).alias(f"o{c}") for c in (*EDGE, "a", "b")])
    mx, my = F.col("x1") + F.col("x2"), F.col("y1") + F.col("y2")  # twice the middle
    rightward = F.col("ox1") < F.col("ox2")
    start = F.when(rightward, F.col("oy1")).otherwise(F.col("oy2"))
    begins = (F.least("ox1", "ox2") == F.col("xl")) & (F.col("ox1") != F.col("ox2")) & (start > F.col("yb")) & (2 * start <= my)
    spans = (2 * F.col("oy1") <= my) & (my < 2 * F.col("oy2"))
    passed = spans & (_cross(F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1"), mx - 2 * F.col("ox1"), my - 2 * F.col("oy1")) < 0)
    met = e.join(others.hint("merge"), ["key", "ci", "cj"])
    step = lambda c: F.sum(F.when(begins, F.when(rightward, F.col(c)).otherwise(-F.col(c))).otherwise(0) - F.when(passed, F.col(c)).otherwise(0))
    local = met.groupBy("key", "x0", "y0", "ci", "cj", *EDGE, "a", "b").agg(step("oa").alias("la"), step("ob").alias("lb"))
    out = local.join(corners.hint("merge"), ["key", "ci", "cj"])
    return out.select("key", *[(F.col(c) + F.col(f"{c[0]}0")).alias(c) for c in EDGE], "a", "b", (F.col("wa") + F.col("la")).alias("wa"), (F.col("wb") + F.col("lb")).alias("wb"))


def boundary(edges: DataFrame, inside: Callable[[Column, Column], Column]) -> DataFrame:
    """key, x1, y1, x2, y2: directed edges with the region to their left, where inside(winding of A, winding of B) says what belongs to the region."""
    w = wound(noded(edges))
    left, right = inside(F.col("wa"), F.col("wb")), inside(F.col("wa") - F.col("a"), F.col("wb") - F.col("b"))
    out = w.where(left != right).withColumn("_l", left)
    return out.select("key", *[F.when(F.col("_l"), F.col(c)).otherwise(F.col(o)).alias(c) for c, o in zip(EDGE, ("x2", "y2", "x1", "y1"))])


def measures(edges: DataFrame, precision: float) -> DataFrame:
    """key, area, perimeter of regions given by their directed boundary. Areas add up in whole numbers."""
    doubled = F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2")))
    around = F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    return edges.groupBy("key").agg((doubled / 2.0 * precision * precision).alias("area"), (around * precision).alias("perimeter"))


@own_run
def rings(edges: DataFrame, precision: float) -> DataFrame:
    """key, ring_id, ring, area of regions given by their directed boundary: shells counter-clockwise with positive areas, holes clockwise with negative ones.

    An edge goes on with the leftmost one at its end, so regions that touch at a point are rings of their own. Rings form by doubling: in each round an edge looks twice as far ahead for the
    smallest number on its ring, which takes as many rounds as the longest ring's length has bits. Vertices on a straight line are left out, and equal ones joined.
    """
    spark = edges.sparkSession
    e = written(edges.withColumn("id", F.monotonically_increasing_id()))
    turn = F.pmod(F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")) - F.atan2(F.col("_y") - F.col("y2"), F.col("_x") - F.col("x2")), F.lit(6.283185307179586))
    ahead = e.select("key", F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("_x"), F.col("y2").alias("_y"), F.col("id").alias("_next"))
    nxt = e.join(ahead.hint("merge"), ["key", "x2", "y2"]).groupBy("id").agg(F.min_by("_next", F.when(turn <= 0, 7.0).otherwise(turn)).alias("ptr"))
    at = written(nxt.select("id", "ptr", F.when(F.col("ptr") < F.col("id"), F.col("ptr")).otherwise(F.col("id")).alias("least"), F.when(F.col("ptr") < F.col("id"), 1).otherwise(0).cast("long").alias("steps"), F.lit(True).alias("moved")))
    ahead_of = lambda df: df.select(F.col("id").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("least").alias("_least"), F.col("steps").alias("_steps"))
    reach = 1
    while not at.where("moved").isEmpty():
        nearer = F.col("_least") < F.col("least")
        at = written(at.join(ahead_of(at).hint("merge"), "ptr").select("id", F.col("_ptr").alias("ptr"), F.least("least", "_least").alias("least"), F.when(nearer, F.col("_steps") + reach).otherwise(F.col("steps")).alias("steps"), nearer.alias("moved")))
        reach *= 2
        discard(spark, keep=[e, at])
    points = F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("t"), F.col("x1").alias("x"), F.col("y1").alias("y"))))
    whole = e.join(at.select("id", "least", "steps").hint("merge"), "id").groupBy("key", F.col("least").alias("ring_id")).agg(points.alias("_p"), (F.sum((F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2"))) / 2.0 * precision * precision).alias("area"))
    n = F.size("_p")
    near = lambda i, k: F.element_at("_p", F.pmod(i + k, n).cast("int") + 1)
    bends = lambda p, i: _cross(p["x"] - near(i, -1)["x"], p["y"] - near(i, -1)["y"], near(i, 1)["x"] - p["x"], near(i, 1)["y"] - p["y"]) != 0
    ring = F.transform(F.filter("_p", bends), lambda p: F.array(p["x"] * F.lit(precision), p["y"] * F.lit(precision)))
    return whole.select("key", "ring_id", ring.alias("ring"), "area")
