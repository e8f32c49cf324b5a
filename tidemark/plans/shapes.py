"""Queries of boxes, rings, affines, chips and samples, and of small functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import boxes, geo, names, numeric, parse
from tidemark.operators import calendars, chipping, detection, grid, metrics, quality, raster
from tidemark.plans.base import query, table
from tidemark.plans.values import BOX, CELLS, _cells, _corner, _dets, _yolo, _yolo_images
from tidemark.sources import catalogue, grids
from tidemark.sources.labels import pixel_variants

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x1 + 25) / 640, 8) AS cx, round((y1 + 20) / 480, 8) AS cy, round(50 / 640.0, 8) AS w, round(40 / 480.0, 8) AS h FROM (SELECT *, {BOX} FROM lineitem)")
def q_to_centre(spark, sf):
    x, y, w, h = boxes.sides(*[F.col(c) for c in ("x1", "y1", "x2", "y2")])
    out = boxes.to_centre(x, y, w, h, F.lit(640.0), F.lit(480.0))
    return _corner(table(spark, sf, "lineitem")).select(*KEY, *[F.round(v, 8).alias(n) for n, v in zip(("cx", "cy", "w", "h"), out)])


YOLO_TEXT = "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS stem, round(l_quantity / 100, 4) AS w, round(l_discount * 3, 4) AS h FROM lineitem"


@query(f"SELECT 'unclamped' AS variant, stem, 1 AS category_id, round(w * 640 * h * 480, 2) AS area FROM ({YOLO_TEXT}) UNION ALL SELECT 'single_class', stem, 1, round(greatest(1, w * 640) * greatest(1, h * 480), 2) FROM ({YOLO_TEXT})")
def q_yolo_variants(spark, sf):
    both = pixel_variants(_yolo(spark, sf), _yolo_images(spark, sf), ["unclamped", "single_class"], how="inner")
    return both.select("variant", "stem", "category_id", F.round("area", 2).alias("area"))


@query(f"SELECT l_orderkey, round(sum(x1 * w / 640), 4) AS x1, round(sum(y2 * h / 640), 4) AS y2 FROM (SELECT *, {BOX}, 300 + l_orderkey % 7 AS w, 200 + l_orderkey % 5 AS h FROM lineitem) GROUP BY l_orderkey")
def q_rescaled(spark, sf):
    dets = _dets(spark, sf)
    images = dets.select("image_id").distinct().select("image_id", (F.lit(300) + F.col("image_id") % 7).alias("width"), (F.lit(200) + F.col("image_id") % 5).alias("height"))
    return detection.rescaled(dets, images, 640).groupBy(F.col("image_id").alias("l_orderkey")).agg(F.round(F.sum("x1"), 4).alias("x1"), F.round(F.sum("y2"), 4).alias("y2"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30 AND l_tax * 100 > 4)")
def q_has_target(spark, sf):
    boxes_ = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity") - 29, F.col("l_tax") * 100 - 3).alias("bbox"))
    return detection.with_targets(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), boxes_).select(F.col("id").alias("o_orderkey"))


@query("SELECT p_partkey AS id, file_name, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (ORDER BY file_name) AS p_partkey FROM (SELECT 'f' || lpad(p_partkey::varchar, 9, '0') AS file_name, p_partkey AS k FROM part)) JOIN (SELECT l_partkey AS k, l_orderkey, l_linenumber FROM lineitem) USING (k)")
def q_to_coco(spark, sf):
    name = lambda c: F.concat(F.lit("f"), F.lpad(F.col(c).cast("string"), 9, "0"))
    images = table(spark, sf, "part").select(name("p_partkey").alias("file_name"))
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    rows = table(spark, sf, "lineitem").select(name("l_partkey").alias("file_name"), line.alias("line"), F.lit(1).alias("category_id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), line.cast("double").alias("w"), F.lit(1.0).alias("h"), F.lit(1.0).alias("area"))
    ims, anns = detection.to_coco(images, rows)
    back = anns.select(F.col("image_id").alias("id"), F.col("bbox")[2].cast("long").alias("line")).join(ims, "id")
    return back.select("id", "file_name", F.floor(F.col("line") / 10).alias("l_orderkey"), (F.col("line") % 10).cast("int").alias("l_linenumber"))


@query(f"""WITH c AS ({CELLS}), q AS (SELECT DISTINCT path, 10.3 - (path::bigint * 7 % 30) AS lat, 49.2 + (path::bigint * 3 % 20) AS lon FROM c), g AS (SELECT path, i, j, v, 10.0 - i + 0.01 * j AS clat, 50.0 + j + 0.02 * i AS clon FROM c),
 d AS (SELECT q.path, v, row_number() OVER (PARTITION BY q.path ORDER BY sqrt(pow(clat - lat, 2) + pow(clon - lon, 2)), i, j) AS r FROM q JOIN g USING (path)) SELECT path, v AS value FROM d WHERE r = 1""")
def q_curvilinear(spark, sf):
    cells = _cells(spark, sf).select("path", "i", "j", (F.lit(10.0) - F.col("i") + 0.01 * F.col("j")).alias("lat"), (F.lit(50.0) + F.col("j") + 0.02 * F.col("i")).alias("lon"), "value")
    k = F.col("vec_id")
    points = table(spark, sf, "embeddings").select(k.cast("string").alias("path"), k.cast("string").alias("id"), (F.lit(10.3) - k * 7 % 30).alias("lat"), (F.lit(49.2) + k * 3 % 20).alias("lon"))
    return grid.nearest_curvilinear(points, cells, key="id").select(F.col("id").alias("path"), "value")


@query(f"""WITH c AS ({CELLS}), g AS (SELECT * FROM c WHERE v > 0.15), q AS (SELECT DISTINCT path, (path::bigint % 8)::int AS qi, (path::bigint * 3 % 8)::int AS qj FROM c),
 d AS (SELECT q.path, v, i, j, greatest(abs(i - qi), abs(j - qj)) AS r, greatest(qi - greatest(abs(i - qi), abs(j - qj)), 0) AS lo, least(qi + greatest(abs(i - qi), abs(j - qj)), 7) AS hi FROM q JOIN g USING (path)),
 o AS (SELECT path, v, row_number() OVER (PARTITION BY path ORDER BY r, CASE WHEN i IN (lo, hi) THEN 0 ELSE 1 END, CASE WHEN i IN (lo, hi) THEN j ELSE i END, CASE WHEN i IN (lo, hi) THEN i ELSE j END) AS k FROM d WHERE r <= 3)
 SELECT q.path, o.v AS value FROM q LEFT JOIN o ON q.path = o.path AND k = 1""")
def q_grid_fill_nearest(spark, sf):
    k = F.col("vec_id")
    points = table(spark, sf, "embeddings").select(k.cast("string").alias("path"), k.alias("id"), (k % 8).cast("int").alias("i"), (k * 3 % 8).cast("int").alias("j"))
    return grid.sample(points, _cells(spark, sf, 0.15), key="id", radius=3, mode="nearest").select(F.col("id").cast("string").alias("path"), "value")


@query("""SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN (CASE WHEN embedding[(vec_id % 8) * 8 + vec_id * 3 % 8 + 1] > -0.1 THEN embedding[(vec_id % 8) * 8 + vec_id * 3 % 8 + 1]::double END)
 WHEN 1 THEN embedding[(vec_id % 8) * 8 + vec_id * 3 % 8 + 1]::double END AS value FROM embeddings""")
def q_sample_any(spark, sf):
    """A third of the files are rasters, a third grids, and a third of a kind that nothing reads."""
    k, e = F.col("vec_id"), F.col("embedding")
    path = F.concat(k.cast("string"), F.element_at(F.array(F.lit(".TIF"), F.lit(".nc"), F.lit(".txt")), (k % 3 + 1).cast("int")))
    files = table(spark, sf, "embeddings").withColumn("path", path)
    points = files.select("path", k.alias("id"), (F.lit(10.0) - k % 8).alias("lat"), (F.lit(50.0) + k * 3 % 8).alias("lon"))
    affine = F.array(*[F.lit(v) for v in (1.0, 0.0, 49.5, 0.0, -1.0, 10.5)])
    rasters = files.where("vec_id % 3 = 0").select("path", e.alias("band"), F.transform(e, lambda v: (v > F.lit(-0.1)).cast("int")).alias("mask"), affine.alias("affine"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(4326).alias("epsg"))
    cells = files.where("vec_id % 3 = 1").select("path", F.posexplode("embedding").alias("n", "v"))
    i, j = F.floor(F.col("n") / 8).cast("int"), (F.col("n") % 8).cast("int")
    cells = cells.select("path", i.alias("i"), j.alias("j"), (F.lit(10.0) - i).alias("lat"), (F.lit(50.0) + j).alias("lon"), F.col("v").cast("double").alias("value"))
    return grids.sample_any(points, rasters, cells, key="id").select(F.col("id").alias("vec_id"), "value")


MOVED = "least(8 - side, greatest(0, {b} + ('0x' || substr(md5('42:' || vec_id || ':' || br || ':' || bc || ':' || side || ':base_{n}'), 1, 8))::bigint % 3 - 1))::int"


@query(f"""WITH w AS (SELECT vec_id, br, bc, side FROM embeddings, (SELECT unnest([0, 2, 4]) AS br) a, (SELECT unnest([0, 2, 4]) AS bc) b, (SELECT unnest([4, 2]) AS side) s),
 m AS (SELECT vec_id, br, bc, side, {MOVED.format(b="br", n="row")} AS r, {MOVED.format(b="bc", n="col")} AS c FROM w), v AS (SELECT * FROM m WHERE r <= 6 AND r + side >= 2 AND c <= 6 AND c + side >= 3),
 p AS ({CELLS}), s AS (SELECT vec_id, br, bc, r, c, side, avg((v.v > 0.05)::int) AS share, max(v.v) AS top FROM (SELECT v.*, p.v FROM v JOIN p ON p.path = v.vec_id::varchar AND p.i >= r AND p.i < r + side AND p.j >= c AND p.j < c + side) v GROUP BY ALL HAVING avg((v.v > 0.05)::int) >= 0.7 AND max(v.v) > 0),
 f AS (SELECT vec_id, CASE side WHEN 4 THEN 2 ELSE 3 END AS r, CASE side WHEN 4 THEN 2 ELSE 3 END AS c, side FROM embeddings, (SELECT unnest([4, 2]) AS side) s WHERE vec_id NOT IN (SELECT vec_id FROM s)),
 g AS (SELECT f.vec_id, r, c, side, avg((p.v > 0.05)::int) AS share, max(p.v) AS top FROM f JOIN p ON p.path = f.vec_id::varchar AND p.i >= r AND p.i < r + side AND p.j >= c AND p.j < c + side GROUP BY ALL HAVING avg((p.v > 0.05)::int) >= 0.7 AND max(p.v) > 0)
 SELECT vec_id, r AS "row", c AS col, side, round(share, 6) AS share, false AS forced FROM s UNION ALL SELECT vec_id, r, c, side, round(share, 6), true FROM g""")
def q_chips(spark, sf):
    e = table(spark, sf, "embeddings")
    images = e.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(2).alias("row0"), F.lit(6).alias("row1"), F.lit(3).alias("col0"), F.lit(6).alias("col1"))
    cells = _cells(spark, sf).select(F.col("path").cast("long").alias("image_id"), "i", "j", (F.col("value") > 0.05).cast("int").alias("cls"), "value")
    out = chipping.chips(images, cells, size=4, stride=2, scales=(1.0, 0.5), jitter=1, wanted=1, least=0.7)
    return out.select(F.col("image_id").alias("vec_id"), "row", "col", "side", F.round("share", 6).alias("share"), "forced")


@query(f"""WITH e AS (SELECT vec_id FROM embeddings), w AS (SELECT vec_id, br, bc, side FROM e, range(0, greatest(0, least(7, 6 + 4) - 4 + 1) + 1, 2) AS a(br), range(0, greatest(0, least(7, 6 + 4) - 4 + 1) + 1, 2) AS b(bc), (SELECT unnest([4, 3]) AS side) s),
 m AS (SELECT vec_id, br, bc, side, {MOVED.format(b="br", n="row").replace("8 - side", "7 - side")} AS r, {MOVED.format(b="bc", n="col").replace("8 - side", "7 - side")} AS c FROM w), v AS (SELECT * FROM m WHERE r <= 6 AND r + side >= 2 AND c <= 6 AND c + side >= 3),
 p AS (SELECT path::bigint AS vec_id, i, j, v, CASE WHEN path::bigint % 3 > 0 THEN (v > 0.05)::int END AS cls FROM ({CELLS}) WHERE i < 7 AND j < 7),
 s AS (SELECT v.vec_id, br, bc, r, c, side, avg(cls) AS share FROM v JOIN p ON p.vec_id = v.vec_id AND p.i >= r AND p.i < r + side AND p.j >= c AND p.j < c + side GROUP BY ALL HAVING coalesce(avg(cls) >= 0.6, true) AND max(v) > 0),
 f AS (SELECT vec_id, CASE side WHEN 4 THEN 2 ELSE 3 END AS r, CASE side WHEN 4 THEN 2 ELSE 3 END AS c, side FROM e, (SELECT unnest([4, 3]) AS side) s WHERE vec_id NOT IN (SELECT vec_id FROM s)),
 g AS (SELECT f.vec_id, r, c, side, avg(cls) AS share FROM f JOIN p ON p.vec_id = f.vec_id AND p.i >= r AND p.i < r + side AND p.j >= c AND p.j < c + side GROUP BY ALL HAVING coalesce(avg(cls) >= 0.6, true) AND max(v) > 0)
 SELECT vec_id, r AS "row", c AS col, side, round(share, 6) AS share, false AS forced FROM s UNION ALL SELECT vec_id, r, c, side, round(share, 6), true FROM g""")
def q_chips_odd(spark, sf):
    """Images of odd sides, whose last base lies past the last whole window, every third without a class band."""
    e = table(spark, sf, "embeddings")
    images = e.select(F.col("vec_id").alias("image_id"), F.lit(7).alias("height"), F.lit(7).alias("width"), F.lit(2).alias("row0"), F.lit(6).alias("row1"), F.lit(3).alias("col0"), F.lit(6).alias("col1"))
    k = F.col("path").cast("long")
    cells = _cells(spark, sf).where("i < 7 and j < 7").select(k.alias("image_id"), "i", "j", F.when(k % 3 > 0, (F.col("value") > 0.05).cast("int")).alias("cls"), "value")
    out = chipping.chips(images, cells, size=4, stride=2, scales=(1.0, 0.75), jitter=1, wanted=1, least=0.6)
    return out.select(F.col("image_id").alias("vec_id"), "row", "col", "side", F.round("share", 6).alias("share"), "forced")


@query("""WITH i AS (SELECT s_suppkey, 200 + s_suppkey % 40 AS h, 320 - s_suppkey % 70 AS w FROM supplier), z AS (SELECT * FROM i, (VALUES (1.0::double, 64), (0.8::double, 51)) AS t(scale, side)), r AS (SELECT *, unnest(range(0, h - side + 1, 32)) AS row FROM z)
 SELECT s_suppkey, scale, row::int AS row, unnest(range(0, w - side + 1, 32))::int AS col, side FROM r""")
def q_chip_grid(spark, sf):
    """A grid of chips over images of different sizes, at two scales."""
    k = F.col("s_suppkey")
    images = table(spark, sf, "supplier").select("s_suppkey", (200 + k % 40).cast("int").alias("height"), (320 - k % 70).cast("int").alias("width"))
    return calendars.grid_starts(images, 64, 32, (1.0, 0.8)).select("s_suppkey", "scale", "row", "col", "side")


@query("""SELECT o_orderkey, round(greatest(0, least(x + 10, 30) - greatest(x, 5)) * greatest(0, least(y + 8, 20) - greatest(y, 4)), 6) AS area, x + 5.0 AS cx, least(30, x + 10) >= greatest(5, x) AND least(20, y + 8) >= greatest(4, y) AS meets
 FROM (SELECT o_orderkey, (o_orderkey % 41)::double AS x, (o_orderkey % 29)::double AS y FROM orders)""")
def q_ring_clip(spark, sf):
    x, y = (F.col("o_orderkey") % 41).cast("double"), (F.col("o_orderkey") % 29).cast("double")
    ring = F.array(*[F.array(a, b) for a, b in ((x, y), (x + 10, y), (x + 10, y + 8), (x, y + 8), (x, y))])
    box = tuple(F.lit(v) for v in (5.0, 4.0, 30.0, 20.0))
    area = geo.bound(geo.ring_in_box(ring, box), lambda r: F.when(geo.ring_in_use(r), geo.ring_area(r)).otherwise(0.0))
    return table(spark, sf, "orders").select("o_orderkey", F.round(area, 6).alias("area"), geo.centre(x, y, x + 10, y + 8)[0].alias("cx"), geo.boxes_meet((x, y, x + 10, y + 8), box).alias("meets"))


@query("SELECT min(x) AS xmin, min(y) AS ymin, max(x) + 2 AS xmax, max(y) + 1 AS ymax FROM (SELECT (l_partkey % 97)::double AS x, (l_suppkey % 53)::double AS y FROM lineitem)")
def q_extent(spark, sf):
    x, y = (F.col("l_partkey") % 97).cast("double"), (F.col("l_suppkey") % 53).cast("double")
    ring = F.array(F.array(x, y), F.array(x + 2, y), F.array(x + 2, y + 1), F.array(x, y + 1))
    return catalogue.extent(table(spark, sf, "lineitem").select(ring.alias("ring")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, floor((y0 - y) / 10)::bigint AS "row", floor((x - 600000) / 20)::bigint AS col, round(600000 + 20 * floor((x - 600000) / 20), 4) AS left_, 40.0 AS scaled
 FROM (SELECT *, 600000 + l_quantity * 37.25 AS x, 2700000 - l_discount * 12345.5 AS y, 2700000 AS y0 FROM lineitem)""")
def q_affine(spark, sf):
    aff = F.array(*[F.lit(float(v)) for v in (20, 0, 600000, 0, -10, 2700000)])
    r, c = geo.map_to_pixel(F.lit(600000) + F.col("l_quantity") * 37.25, F.lit(2700000) - F.col("l_discount") * 12345.5, aff)
    return table(spark, sf, "lineitem").select(*KEY, r.alias("row"), c.alias("col"), F.round(geo.pixel_to_map(r, c, aff)[0], 4).alias("left_"), geo.scaled_affine(aff, 2.0, 2.0)[0].alias("scaled"))


@query("SELECT o_orderkey, CASE WHEN q < 0 THEN q + 360 ELSE q END AS east, CASE WHEN q > 180 THEN q - 360 ELSE q END AS west FROM (SELECT o_orderkey, (o_orderkey % 540 - 180)::double AS q FROM orders)")
def q_longitude(spark, sf):
    q = (F.col("o_orderkey") % 540 - 180).cast("double")
    return table(spark, sf, "orders").select("o_orderkey", geo.match_longitude(q, F.lit(0.0), F.lit(359.0)).alias("east"), geo.match_longitude(q, F.lit(-180.0), F.lit(179.0)).alias("west"))


@query("SELECT o_orderkey, CASE WHEN x = floor(x) THEN x WHEN x - floor(x) < 0.5 THEN floor(x) WHEN x - floor(x) > 0.5 THEN floor(x) + 1 WHEN floor(x) % 2 = 0 THEN floor(x) ELSE floor(x) + 1 END::int AS even, round(-(y * ln(p) + (1 - y) * ln(1 - p)), 8) AS loss, round(1 / (1 + exp(-x / 10)), 8) AS sigmoid FROM (SELECT o_orderkey, (o_orderkey % 200) / 4.0 AS x, (o_orderkey % 2)::double AS y, greatest(1e-7, least(1 - 1e-7, (o_orderkey % 101) / 100.0)) AS p FROM orders)")
def q_rounding_and_loss(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", numeric.half_even((k % 200) / 4.0).alias("even"), F.round(numeric.cross_entropy((k % 101) / 100.0, (k % 2).cast("double")), 8).alias("loss"), F.round(numeric.sigmoid((k % 200) / 40.0), 8).alias("sigmoid"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H') AS wall, 'http://h/g?' || url_encode('chl[(' || strftime(o_orderdate, '%Y-%m-%d') || ')][(15):(26)][(' || CASE WHEN w < 0 THEN w + 360 ELSE w END || '):(60)]') AS url FROM (SELECT *, (o_orderkey % 100 - 50)::int AS w FROM orders)")
def q_times_and_urls(spark, sf):
    t = F.col("o_orderdate")
    text = F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+04:00"))
    url = names.query_url(F.lit("http://h/g"), F.lit("chl"), F.date_format(t, "yyyy-MM-dd"), F.lit(15), F.lit(26), (F.col("o_orderkey") % 100 - 50).cast("int"), F.lit(60), east_360=True)
    return table(spark, sf, "orders").select("o_orderkey", F.date_format(parse.wall_time(text), "yyyy-MM-dd HH").alias("wall"), url.alias("url"))


@query("SELECT CASE WHEN floor(l_quantity * 40) < 1024 THEN 'low_valid_px' WHEN l_discount > 0.06 AND l_tax > 0.05 THEN 'no_l3' END AS reason, count(*) AS n FROM lineitem WHERE floor(l_quantity * 40) < 1024 OR (l_discount > 0.06 AND l_tax > 0.05) GROUP BY 1")
def q_any_present(spark, sf):
    cell = lambda c, limit: F.when(F.col(c) > limit, F.lit("nan")).otherwise(F.col(c).cast("string"))
    chips = table(spark, sf, "lineitem").select(F.floor(F.col("l_quantity") * 40).cast("string").alias("valid_px"), cell("l_discount", 0.06).alias("chlor_a"), cell("l_tax", 0.05).alias("flh"))
    return quality.reason_counts(quality.with_reason(chips, quality.chip_gates(chips, require_l3=True)))


@query("SELECT vec_id FROM embeddings WHERE list_max(list_transform(embedding, lambda x: trunc(greatest(0, least(1, (x::double - 0.25) / 0.5)) * 255))) > 0")
def q_zero_reject(spark, sf):
    """Images whose bytes are all zero are left out."""
    px = F.transform("embedding", lambda v: numeric.to_byte(v.cast("double"), 0.25, 0.75))
    return table(spark, sf, "embeddings").where(F.array_max(px) > 0).select("vec_id")


@query("""WITH p AS (SELECT (x * sqrt(3) / 3 - y / 3) / 0.1 AS q, y * 2 / 3 / 0.1 AS r FROM (SELECT log10(l_discount) AS x, log10(l_tax) AS y FROM lineitem WHERE l_discount > 0 AND l_tax > 0)), c AS (SELECT q, r, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM p),
 d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - (-q - r)) AS ds FROM c) SELECT (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::bigint AS q, (CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END)::bigint AS r, count(*) AS n FROM d GROUP BY 1, 2""")
def q_hexbin_log(spark, sf):
    return metrics.hex_bins(table(spark, sf, "lineitem").select("l_discount", "l_tax"), "l_discount", "l_tax", 0.1, log=True)


#: Weights of four places over eight, in whole numbers of 2**-22: a triangle of two pixels on either side, cut at the ends.
HALF = ", ".join(f"({k}, {x}, {int(0.5 + w * 2**22)})" for k, row in enumerate([{0: 3 / 7, 1: 3 / 7, 2: 1 / 7}, {1: 1 / 8, 2: 3 / 8, 3: 3 / 8, 4: 1 / 8}, {3: 1 / 8, 4: 3 / 8, 5: 3 / 8, 6: 1 / 8}, {5: 1 / 7, 6: 3 / 7, 7: 3 / 7}]) for x, w in row.items())


@query(f"""WITH w(o, s, w) AS (VALUES {HALF}), c AS (SELECT path, i, j, greatest(0, least(255, floor((v + 0.6) * 200)))::bigint AS px FROM ({CELLS})),
 h AS (SELECT path, i, o AS b, (2097152 + sum(w * px)::bigint) >> 22 AS px FROM c JOIN w ON s = j GROUP BY ALL), g AS (SELECT path, o * 4 + b AS k, (2097152 + sum(w * px)::bigint) >> 22 AS value FROM h JOIN w ON s = i GROUP BY path, o, b)
 SELECT path::bigint AS vec_id, (channel * 16 + k)::int AS k, round((value / 255.0 - 0.5) / 0.5, 9)::double AS value FROM g, range(0, 3) t(channel)""")
def q_resize_bilinear(spark, sf):
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.6) * 200))).cast("int"))
    small = raster.model_input(raster.resized_bilinear(gray, 8, 8, 4, 4))
    return table(spark, sf, "embeddings").select("vec_id", F.posexplode(small).alias("k", "value")).select("vec_id", "k", F.round("value", 9).alias("value"))
