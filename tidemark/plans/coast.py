"""Queries of polygons: overlay, spatial join, dissolve, buffer and repair.

Shapes are squares turned by 45 degrees, so all edges are slanted: boxes in u = x + y and v = x - y, whose areas SQL gives by ranges or by counting unit cells (half a unit of area each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import arrangement, polygons
from tidemark.plans.base import query, table
from tidemark.session import written


def _turned(u0: Column, v0: Column, u1: Column, v1: Column) -> Column:
    """The ring of a box in u and v."""
    return F.array(*[F.array((u + v) / 2, (u - v) / 2) for u, v in ((u0, v0), (u1, v0), (u1, v1), (u0, v1))])


def _box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


#: Customers as turned squares with a hole and suppliers as larger ones, in fields of 150 and 10 that lie apart.
FIELDS = """c AS (SELECT c_custkey, c_nationkey, c_custkey // 150 * 1000 + c_custkey * 37 % 128 AS u0, c_custkey * 53 % 128 AS v0, 6 + c_custkey % 5 AS side FROM customer),
 s AS (SELECT s_suppkey, s_suppkey // 10 * 1000 + s_suppkey * 29 % 100 AS u0, s_suppkey * 71 % 100 AS v0, 20 + s_suppkey % 11 AS side FROM supplier)"""


def _customers(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    out = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.floor(k / 150) * 1000 + k * 37 % 128).alias("u0"), (k * 53 % 128).alias("v0"), (6 + k % 5).alias("side"))
    hole = _turned(F.col("u0") + 2, F.col("v0") + 2, F.col("u0") + 4, F.col("v0") + 5)
    return out.withColumn("rings", F.array(_turned(F.col("u0"), F.col("v0"), F.col("u0") + F.col("side"), F.col("v0") + F.col("side")), hole))


def _suppliers(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    out = table(spark, sf, "supplier").select("s_suppkey", (F.floor(k / 10) * 1000 + k * 29 % 100).alias("u0"), (k * 71 % 100).alias("v0"), (20 + k % 11).alias("side"))
    return out.withColumn("rings", F.array(_turned(F.col("u0"), F.col("v0"), F.col("u0") + F.col("side"), F.col("v0") + F.col("side"))))


SHARED = "greatest(0, least(c.u0 + {1}, s.u0 + s.side) - greatest(c.u0 + {0}, s.u0)) * greatest(0, least(c.v0 + {3}, s.v0 + s.side) - greatest(c.v0 + {2}, s.v0))"
WHOLE, HOLE = SHARED.format(0, "c.side", 0, "c.side"), SHARED.format(2, 4, 2, 5)


@query(f"WITH {FIELDS} SELECT * FROM (SELECT c_custkey, s_suppkey, ({WHOLE} - {HOLE}) / 2.0::double AS area FROM c, s) WHERE area > 0")
def q_overlay(spark, sf):
    """What every customer's square with a hole shares with every supplier's square."""
    edges = polygons.overlay(_customers(spark, sf), _suppliers(spark, sf), left_id="c_custkey", right_id="s_suppkey", precision=0.5)
    return arrangement.measures(edges, 0.5).select("key.c_custkey", "key.s_suppkey", "area")


@query(f"WITH {FIELDS} SELECT c_custkey, side FROM c WHERE EXISTS (SELECT 1 FROM s WHERE ({WHOLE} - {HOLE}) > 0)")
def q_footprints(spark, sf):
    """Scenes whose footprint, a square with a hole, shares an area with any of the areas of interest."""
    return polygons.meeting(_customers(spark, sf), _suppliers(spark, sf), left_id="c_custkey", right_id="s_suppkey", precision=0.5).select("c_custkey", "side")


@query("""WITH c AS (SELECT c_custkey, c_custkey // 150 * 1000 + c_custkey * 37 % 128 AS x0, c_custkey * 53 % 128 AS y0, CASE WHEN c_custkey % 50 = 0 THEN 90 ELSE c_custkey % 7 END AS side FROM customer),
 s AS (SELECT s_suppkey, s_suppkey // 10 * 1000 + s_suppkey * 29 % 100 AS x0, s_suppkey * 71 % 100 AS y0, CASE WHEN s_suppkey % 5 = 0 THEN 60 ELSE s_suppkey % 3 END AS side FROM supplier)
 SELECT c_custkey, s_suppkey, greatest(c.x0, s.x0)::double AS xmin, greatest(c.y0, s.y0)::double AS ymin, least(c.x0 + c.side, s.x0 + s.side)::double AS xmax, least(c.y0 + c.side, s.y0 + s.side)::double AS ymax
 FROM c, s WHERE c.x0 <= s.x0 + s.side AND s.x0 <= c.x0 + c.side AND c.y0 <= s.y0 + s.side AND s.y0 <= c.y0 + c.side""")
def q_spatial_join(spark, sf):
    """Pairs of boxes that meet, once each: points, small boxes and boxes of half a field on both sides."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    side = {"c": F.when(c % 50 == 0, 90).otherwise(c % 7), "s": F.when(s % 5 == 0, 60).otherwise(s % 3)}
    left = table(spark, sf, "customer").select("c_custkey", (F.floor(c / 150) * 1000 + c * 37 % 128).alias("x"), (c * 53 % 128).alias("y"), side["c"].alias("side"))
    right = table(spark, sf, "supplier").select("s_suppkey", (F.floor(s / 10) * 1000 + s * 29 % 100).alias("x"), (s * 71 % 100).alias("y"), side["s"].alias("side"))
    ring = F.array(_box(F.col("x"), F.col("y"), F.col("x") + F.col("side"), F.col("y") + F.col("side")))
    boxes = [polygons.bounds(df.withColumn("rings", ring)) for df in (left, right)]
    return polygons.boxes_that_meet(*boxes, left_id="c_custkey", right_id="s_suppkey")


#: The unit cells of the union of all squares of a nation, holes of single squares left out.
CELLS = f"""WITH {FIELDS}, k AS (SELECT c_nationkey, u, v, c_custkey FROM (SELECT *, unnest(range(u0::bigint, (u0 + side)::bigint)) AS u FROM c) t, range(200) AS r(v)
 WHERE v >= v0 AND v < v0 + side AND NOT (u >= u0 + 2 AND u < u0 + 4 AND v >= v0 + 2 AND v < v0 + 5)), d AS (SELECT DISTINCT c_nationkey, u, v FROM k)"""


@query(f"""{CELLS}, b AS (SELECT c_nationkey, u + du AS u, v + dv AS v FROM d, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) AS t(du, dv)),
 p AS (SELECT c_nationkey, count(*) AS sides FROM b ANTI JOIN d USING (c_nationkey, u, v) GROUP BY c_nationkey)
 SELECT c_nationkey, count(*) / 2.0::double AS area, round(any_value(sides) * sqrt(0.5), 4) AS perimeter FROM d JOIN p USING (c_nationkey) GROUP BY c_nationkey""")
def q_dissolve(spark, sf):
    """The union of all customers' squares of each nation."""
    edges = polygons.dissolved(_customers(spark, sf), F.col("c_nationkey"), precision=0.5)
    return arrangement.measures(edges, 0.5).select(F.col("key").alias("c_nationkey"), "area", F.round("perimeter", 4).alias("perimeter"))


@query(f"""{CELLS}, p AS (SELECT DISTINCT c_nationkey, u + du AS u, v + dv AS v FROM d, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) AS t(du, dv)),
 e AS (SELECT DISTINCT c_nationkey, u, v, 'u' AS way FROM (SELECT c_nationkey, u, v FROM d UNION ALL SELECT c_nationkey, u, v + 1 FROM d) UNION ALL SELECT DISTINCT c_nationkey, u, v, 'v' FROM (SELECT c_nationkey, u, v FROM d UNION ALL SELECT c_nationkey, u + 1, v FROM d))
 SELECT c_nationkey, n_cells / 2.0::double AS area, n_points - n_edges + n_cells AS shells_less_holes FROM (SELECT c_nationkey, count(*) AS n_cells FROM d GROUP BY 1) JOIN (SELECT c_nationkey, count(*) AS n_points FROM p GROUP BY 1) USING (c_nationkey) JOIN (SELECT c_nationkey, count(*) AS n_edges FROM e GROUP BY 1) USING (c_nationkey)""")
def q_dissolve_rings(spark, sf):
    """Rings of those unions. Where regions touch at a point only, the cells count as joined there, and so do rings once for each such point."""
    edges = written(polygons.dissolved(_customers(spark, sf), F.col("c_nationkey"), precision=0.5))
    found = arrangement.rings(edges, 0.5).groupBy("key").agg(F.sum("area").alias("area"), F.sum(F.when(F.col("area") > 0, 1).otherwise(-1)).alias("n"))
    touching = edges.groupBy("key", "x1", "y1").count().where("count > 1").groupBy("key").agg(F.sum(F.col("count") - 1).alias("touching"))
    return found.join(touching, "key", "left").select(F.col("key").alias("c_nationkey"), "area", (F.col("n") - F.coalesce("touching", F.lit(0))).alias("shells_less_holes"))


#: The circle that ends and bends are drawn with, in hundredths, and its area with the two ends of a normal among its vertices.
ARC = """arc AS (SELECT round(300 * cos(k * pi() / 8))::bigint AS x, round(300 * sin(k * pi() / 8))::bigint AS y FROM range(16) AS t(k)),
 g AS (SELECT s_suppkey, s_suppkey % 5 AS way, 1 + s_suppkey % 13 AS n FROM supplier),
 v AS (SELECT DISTINCT s_suppkey, x, y FROM g, arc UNION SELECT s_suppkey, CASE way WHEN 2 THEN 240 ELSE 180 END * sign, CASE way WHEN 2 THEN -180 ELSE 240 END * sign FROM g, (VALUES (1), (-1)) AS t(sign) WHERE way IN (2, 3)),
 o AS (SELECT s_suppkey, x, y, lead(x) OVER w AS nx, lead(y) OVER w AS ny, first(x) OVER w AS fx, first(y) OVER w AS fy FROM v WINDOW w AS (PARTITION BY s_suppkey ORDER BY atan2(y, x))),
 d AS (SELECT s_suppkey, sum(x * coalesce(ny, fy) - y * coalesce(nx, fx)) / 20000.0::double AS disc FROM o GROUP BY s_suppkey)"""


@query(f"WITH {ARC} SELECT s_suppkey, disc + CASE way WHEN 4 THEN 2 * n * n + 2 * 3 * (3 * n) WHEN 0 THEN 2 * 3 * n WHEN 1 THEN 2 * 3 * n ELSE 2 * 3 * 5 * n END AS area FROM g JOIN d USING (s_suppkey)")
def q_buffer(spark, sf):
    """All within 3 of suppliers' segments (level, upright, and two slanted 3 to 4) and boxes."""
    k = F.col("s_suppkey")
    g = table(spark, sf, "supplier").select("s_suppkey", (k % 5).alias("way"), (1 + k % 13).cast("double").alias("n"), (k * 7.0).alias("x"), (k % 11 * 3.0).alias("y"))
    n, way = F.col("n"), F.col("way")
    dx = F.when(way == 0, n).when(way == 1, 0.0).when(way == 2, 3 * n).otherwise(-4 * n)
    dy = F.when(way == 0, 0.0).when(way == 1, n).when(way == 2, 4 * n).otherwise(3 * n)
    lines = g.where("way < 4").withColumn("line", F.array(F.array("x", "y"), F.array(F.col("x") + dx, F.col("y") + dy)))
    shapes = g.where("way = 4").withColumn("rings", F.array(_box(F.col("x"), F.col("y"), F.col("x") + 2 * n, F.col("y") + n)))
    edges = polygons.buffered(lines, k, 3.0, line="line", quad_segs=4, precision=0.01).unionByName(polygons.buffered(shapes, k, 3.0, rings="rings", quad_segs=4, precision=0.01))
    return arrangement.measures(edges, 0.01).select(F.col("key").alias("s_suppkey"), "area")


@query("SELECT c_custkey, rule, CASE rule WHEN 'even_odd' THEN w * h / 2.0::double + 2.0 ELSE w * h / 2.0::double + 4.0 END AS area FROM (SELECT c_custkey, 2 * (2 + c_custkey % 9) AS w, 2 * (2 + c_custkey % 4) AS h FROM customer), (VALUES ('even_odd'), ('nonzero')) AS r(rule)")
def q_make_valid(spark, sf):
    """Rings that cross themselves in the middle, and a ring that goes twice round one of two squares side by side, by both rules."""
    k = F.col("c_custkey")
    g = table(spark, sf, "customer").select("c_custkey", (2.0 * (2 + k % 9)).alias("w"), (2.0 * (2 + k % 4)).alias("h"), (k % 100 * 50.0).alias("x"), (F.floor(k / 100) * 50.0).alias("y"))
    x, y, w, h = (F.col(c) for c in "xywh")
    at = lambda *ps: F.array(*[F.array((x + a).cast("double"), (y + b).cast("double")) for a, b in ps])
    eight = at((0, 0), (w, h), (w, 0), (0, h))
    twice = at((30, 20), (32, 20), (32, 21), (30, 21), (30, 20), (34, 20), (34, 21), (30, 21))
    rings = g.withColumn("rings", F.array(eight, twice))
    out = [arrangement.measures(polygons.valid(rings, k, rule=r, precision=0.5), 0.5).select(F.col("key").alias("c_custkey"), F.lit(r).alias("rule"), "area") for r in ("even_odd", "nonzero")]
    return out[0].unionByName(out[1])
