"""Queries of labels, rasters, grids, metrics, detections, models and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import boxes, numeric
from tidemark.operators import components, detection, grid, labels, metrics, ml, ranking, raster
from tidemark.plans.base import ORACLES, QUERIES, query, table
from tidemark.session import folder
from tidemark.sources.labels import parse_boxes, pixel_boxes
from tidemark.sources.tables import summary_lines

CHIPS = """SELECT o_orderkey, o_orderdate AS datetime, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 100000 END AS flh, (o_orderkey % 97) / 10.0 AS chlor_a,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE (o_orderkey % 50) / 100.0 END AS kd490 FROM orders"""
SEASON = "['winter', 'spring', 'summer', 'autumn'][(month(datetime) % 12) // 3 + 1]"


def _chips(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k, F.col("o_orderdate").alias("datetime"), F.when(k % 3 != 0, F.col("o_totalprice") / 100000).alias("flh"), ((k % 97) / 10.0).alias("chlor_a"), F.when(k % 4 != 0, (k % 50) / 100.0).alias("kd490"))
    return labels.time_fields(rows)


def _label_sql(keys: str) -> str:
    at = "[" + ", ".join(map(repr, labels.levels())) + "]"
    n = len(labels.levels())
    hit = "((coalesce({f} AND flh >= tf[{i}], false) OR coalesce(chlor_a >= tc[{i}], false)) AND ok)".replace("{f} AND ", "")
    hits = ", ".join(f"{hit.format(i=i + 1)} AS h{i}" for i in range(n))
    tops = ", ".join(f"max(h{i}::int) OVER (PARTITION BY g) AS m{i}" for i in range(n))
    case = " ".join(f"WHEN m{i} = 1 THEN h{i}::int" for i in range(n))
    return f"""WITH c AS ({CHIPS}), k AS (SELECT *, {keys} AS g FROM c), s AS (SELECT g, quantile_cont(flh, {at}) AS tf, quantile_cont(chlor_a, {at}) AS tc, count(kd490) AS nk FROM k GROUP BY g),
 r AS (SELECT k.*, tf, tc, nk = 0 OR coalesce(kd490 >= 0.12, false) AS ok FROM k JOIN s USING (g)), h AS (SELECT *, {hits} FROM r), m AS (SELECT *, {tops} FROM h)
 SELECT o_orderkey, CASE {case} ELSE ((coalesce(flh >= 0.002, false) OR coalesce(chlor_a >= 3.0, false)) AND ok)::int END AS hab_label FROM m"""


for _group, _keys in {"none": "''", "season": SEASON, "year": "year(datetime)::varchar", "year_season": f"year(datetime) || {SEASON}"}.items():

    def _run(spark, sf, group=_group):
        return labels.quantile_labels(_chips(spark, sf), group=group).select("o_orderkey", "hab_label")

    QUERIES[f"q_label_{_group}"], ORACLES[f"q_label_{_group}"] = _run, _label_sql(_keys)


INDICES = """SELECT l_orderkey, round(avg((g - n) / (g + n + 1e-6)), 8) AS ndwi_mean, round(stddev_pop((g - n) / (g + n + 1e-6)), 8) AS ndwi_std, round(avg(r - (g + (n - g) * (105.0 / 300.0))), 8) AS fai_mean, round(avg(r / (n + 1e-6)), 6) AS rednir_mean, count(*)::int AS valid_px
 FROM (SELECT l_orderkey, l_quantity * 100 / 10000 AS g, l_discount * 10000 / 10000 AS r, l_tax * 10000 / 10000 + 0.01 AS n FROM lineitem) GROUP BY l_orderkey"""


def _rounded(out):
    return out.select("l_orderkey", *[F.round(c, 6 if c.startswith("red") else 8).alias(c) for c in ("ndwi_mean", "ndwi_std", "fai_mean", "rednir_mean")], "valid_px")


@query(INDICES)
def q_chip_indices(spark, sf):
    px = table(spark, sf, "lineitem")
    return _rounded(raster.pixel_indices(px, "l_orderkey", green=F.col("l_quantity") * 100, red=F.col("l_discount") * 10000, nir=F.col("l_tax") * 10000 + 100))


@query(INDICES)
def q_chip_indices_packed(spark, sf):
    px = F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") * 100).alias("g"), (F.col("l_discount") * 10000).alias("r"), (F.col("l_tax") * 10000 + 100).alias("n"))
    chips = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(px)).alias("px"))
    chips = chips.select("l_orderkey", *[F.transform("px", _field(c)).alias(b) for c, b in (("g", "b03"), ("r", "b04"), ("n", "b08"))])
    return _rounded(raster.chip_indices(chips, classes=None))


def _field(name):
    return lambda s: s[name]


@query("""SELECT vec_id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*)::int AS n FROM (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings) WHERE v > 0 GROUP BY vec_id""")
def q_array_stats(spark, sf):
    e = F.col("embedding")
    s = raster.robust(e, F.transform(e, lambda x: (x > 0).cast("int")))
    return table(spark, sf, "embeddings").select("vec_id", s.alias("s")).where("s.n > 0").select("vec_id", F.round("s.mean", 6).alias("mean"), F.round("s.std", 6).alias("std"), "s.n")


@query("""WITH q AS (SELECT vec_id, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings) GROUP BY vec_id)
 SELECT vec_id, sum(trunc(greatest(0, least(1, (v - a) / (greatest(b, a + 1e-6) - a))) * 255)::int)::bigint AS total FROM (SELECT vec_id, unnest(embedding)::double AS v FROM embeddings) JOIN q USING (vec_id) GROUP BY vec_id""")
def q_stretch_uint8(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.aggregate(raster.stretched(F.col("embedding")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


def _cells(spark, sf, missing=None):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.posexplode("embedding").alias("k", "v"))
    v = F.col("v").cast("double")
    value = v if missing is None else F.when(v > missing, v)
    i, j = F.floor(F.col("k") / 8).cast("int"), (F.col("k") % 8).cast("int")
    return rows.select("path", i.alias("i"), j.alias("j"), (10.0 - i).alias("lat"), (50.0 + j).alias("lon"), value.alias("value"))


CELLS = "SELECT vec_id::varchar AS path, ((k - 1) // 8)::int AS i, ((k - 1) % 8)::int AS j, embedding[k]::double AS v FROM embeddings, range(1, 65) t(k)"


@query(f"""SELECT path, (i // 4)::int AS tile_row, (j // 4)::int AS tile_col, round(avg(CASE WHEN v > -0.1 THEN v END), 8) AS mean, count(*) AS n, round(avg(CASE WHEN v > -0.1 THEN 0.0 ELSE 1.0 END), 6) AS missing FROM ({CELLS}) GROUP BY 1, 2, 3 HAVING avg(CASE WHEN v > -0.1 THEN 0.0 ELSE 1.0 END) <= 0.2""")
def q_tiling(spark, sf):
    return grid.tiles(_cells(spark, sf, -0.1), 4).select("path", "tile_row", "tile_col", F.round("mean", 8).alias("mean"), "n", F.round("missing", 6).alias("missing"))


@query("SELECT l_orderkey, avg((l_returnflag = 'R')::int) AS share FROM lineitem GROUP BY 1 HAVING avg((l_returnflag = 'R')::int) >= 0.5")
def q_class_fraction(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("is_r", (F.col("l_returnflag") == "R").cast("int"))
    return grid.class_share(rows, "is_r", 1, 0.5, "l_orderkey")


@query("""SELECT event_id, (CASE WHEN value <= 1 THEN 0 ELSE (SELECT min(k) FROM range(0, 8) t(k) WHERE abs(pow(3, k) - value) = (SELECT min(abs(pow(3, m) - value)) FROM range(0, 8) u(m))) END)::int AS idx FROM events""")
def q_grid_nearest_1d(spark, sf):
    axis = F.array(*[F.lit(float(3**k)) for k in range(8)])
    return table(spark, sf, "events").select("event_id", grid.nearest_index(axis, F.col("value")).alias("idx"))


@query(f"""WITH c AS ({CELLS}), g AS (SELECT * FROM c WHERE v > 0.15), q AS (SELECT DISTINCT path, (path::bigint % 8)::int AS qi, (path::bigint * 3 % 8)::int AS qj FROM c),
 d AS (SELECT q.path, greatest(abs(i - qi), abs(j - qj)) AS r, v FROM q JOIN g USING (path)), m AS (SELECT path, min(r) AS r FROM d WHERE r <= 3 GROUP BY path)
 SELECT q.path, round(avg(d.v), 8) AS value FROM q LEFT JOIN m USING (path) LEFT JOIN d ON d.path = q.path AND d.r = m.r GROUP BY q.path""")
def q_grid_fill(spark, sf):
    cells = _cells(spark, sf, 0.15)
    pts = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.col("vec_id").alias("id"), (F.col("vec_id") % 8).cast("int").alias("i"), (F.col("vec_id") * 3 % 8).cast("int").alias("j"))
    out = grid.sample(pts, cells, key="id", radius=3)
    return out.select(F.col("id").cast("string").alias("path"), F.round("value", 8).alias("value"))


@query(f"""WITH c AS ({CELLS}) SELECT path, v AS value FROM c WHERE i = (path::bigint % 8) AND j = (path::bigint * 3 % 8)""")
def q_grid_place(spark, sf):
    cells = _cells(spark, sf)
    pts = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), (10.2 - F.col("vec_id") % 8).alias("lat"), (49.9 + F.col("vec_id") * 3 % 8).alias("lon"))
    return grid.place(pts, cells).join(cells.select("path", "i", "j", "value"), ["path", "i", "j"]).select("path", "value")


@query(f"SELECT path, count(*) AS n FROM ({CELLS}) WHERE 10 - i BETWEEN 4 AND 8 AND 50 + j BETWEEN 51 AND 53 GROUP BY path")
def q_grid_clip(spark, sf):
    return grid.clip(_cells(spark, sf), 51, 4, 53, 8).groupBy("path").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT count(*) AS n, round(sqrt(avg(pow(p - t, 2))), 4) AS rmse, round(avg(abs(p - t)), 4) AS mae, round(1 - sum(pow(p - t, 2)) / (var_pop(t) * count(*) + count(*) * 1e-12), 6) AS r2, round(avg(pow(p - t, 2)) / 1e6, 3) AS mse
 FROM (SELECT o_orderkey, o_totalprice AS t FROM orders) JOIN (SELECT l_orderkey AS o_orderkey, sum(l_quantity) * 1500 AS p FROM lineitem GROUP BY 1) USING (o_orderkey)""")
def q_pred_truth_metrics(spark, sf):
    """Truths joined with predictions by their key; those without the other are left out."""
    truth = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("t"))
    pred = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_quantity") * 1500).alias("p"))
    out = metrics.regression(truth.join(pred, "o_orderkey"), "t", "p")
    return out.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), F.round(F.col("mse") / 1e6, 3).alias("mse"))


@query("""WITH s AS (SELECT avg(ln(1 + o_totalprice)) AS mu, stddev_pop(ln(1 + o_totalprice)) + 1e-8 AS sigma FROM orders) SELECT o_orderkey, round((ln(1 + o_totalprice) - mu) / sigma, 6) AS z, round(o_totalprice, 2) AS back FROM orders, s""")
def q_standardise(spark, sf):
    o = table(spark, sf, "orders")
    z = numeric.standardise(F.col("o_totalprice"), F.col("mu"), F.col("sigma"))
    rows = o.crossJoin(F.broadcast(metrics.target_stats(o, "o_totalprice"))).withColumn("z", z)
    return rows.select("o_orderkey", F.round("z", 6).alias("z"), F.round(numeric.destandardise(F.col("z"), F.col("mu"), F.col("sigma")), 2).alias("back"))


@query("SELECT round(avg(s), 4) AS mean_loss FROM (SELECT sum(l_quantity) AS s FROM lineitem GROUP BY l_orderkey)")
def q_mean_of_batches(spark, sf):
    return metrics.mean_of_batches(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity").select(F.round("mean_loss", 4).alias("mean_loss"))


@query("""WITH l AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem), h AS (SELECT least(29, floor((l_extendedprice - a) / ((b - a) / 30)))::int AS bin FROM lineitem, l) SELECT bin, count(*) AS n FROM h GROUP BY bin""")
def q_histogram(spark, sf):
    return metrics.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 30).select("bin", "n")


@query("""WITH p AS (SELECT (x * sqrt(3) / 3 - y / 3) / 5 AS q, y * 2 / 3 / 5 AS r FROM (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)), c AS (SELECT q, r, floor(q + 0.5) AS rq, floor(r + 0.5) AS rr, floor(-q - r + 0.5) AS rs FROM p),
 d AS (SELECT *, abs(rq - q) AS dq, abs(rr - r) AS dr, abs(rs - (-q - r)) AS ds FROM c) SELECT (CASE WHEN dq > dr AND dq > ds THEN -rr - rs ELSE rq END)::bigint AS q, (CASE WHEN dq > dr AND dq > ds THEN rr WHEN dr > ds THEN -rq - rs ELSE rr END)::bigint AS r, count(*) AS n FROM d GROUP BY 1, 2 HAVING count(*) >= 5""")
def q_hexbin(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
    return metrics.hex_bins(rows, "x", "y", 5.0, min_count=5)


@query("""SELECT d, v, min(v) OVER (ORDER BY d) AS best, coalesce(v < min(v) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_new FROM (SELECT strftime(ts, '%Y-%m-%d') AS d, max(value) AS v FROM events GROUP BY 1)""")
def q_running_best(spark, sf):
    days = table(spark, sf, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("d")).agg(F.max("value").alias("v"))
    return metrics.running_best(days, "d", "v")


@query("""SELECT event_type, arg_max(event_id, value * 1e9 - event_id) AS event_id FROM events GROUP BY event_type""")
def q_argmax_fallback(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", "value", F.lit(None).cast("double").alias("other"))
    return metrics.best_row(rows, ["other", "value"], "event_id", "event_type").select("event_type", "event_id")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus = 'O') AS skip, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS err FROM orders")
def q_status_counts(spark, sf):
    return metrics.status_counts(table(spark, sf, "orders"), "o_orderstatus", {"ok": ["F"], "skip": ["O"], "err": ["P"]})


@query("""SELECT round(avg((i + 1e-6) / (p + t - i + 1e-6)), 8) AS mean_iou, round(avg((2 * i + 1e-6) / (p + t + 1e-6)), 8) AS mean_dice FROM (SELECT sum(l_discount * l_tax) AS i, sum(l_discount) AS p, sum(l_tax) AS t FROM lineitem GROUP BY l_orderkey, l_returnflag)""")
def q_overlap(spark, sf):
    out = metrics.overlap(table(spark, sf, "lineitem"), "l_discount", "l_tax", "l_orderkey", "l_returnflag")
    return out.select(F.round("mean_iou", 8).alias("mean_iou"), F.round("mean_dice", 8).alias("mean_dice"))


AUC = """WITH s AS (SELECT n_chars AS s, toxic AS y FROM documents JOIN labels USING (doc_id)), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM s GROUP BY s),
 c AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM g) SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 8) AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 8) AS auprc FROM c"""


@query(AUC)
def q_auc(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return metrics.auc(rows, "n_chars", "toxic").select(F.round("auroc", 8).alias("auroc"), F.round("auprc", 8).alias("auprc"))


@query("""WITH r AS (SELECT toxic AS t, quality AS p FROM labels), s AS (SELECT t AS label, count(*) AS support, count(*) FILTER (t = p) AS tp FROM r GROUP BY t), q AS (SELECT p AS label, count(*) AS said FROM r GROUP BY p)
 SELECT label, round(CASE WHEN coalesce(said, 0) > 0 THEN tp / said ELSE 0 END, 8) AS precision, round(tp / support, 8) AS recall, support FROM s LEFT JOIN q USING (label)""")
def q_class_report(spark, sf):
    return metrics.class_report(table(spark, sf, "labels"), "toxic", "quality").select("label", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), "support")


YOLO_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _yolo(spark, sf):
    li = table(spark, sf, "lineitem")
    line = F.format_string("0 %.4f %.4f %.4f %.4f", F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity") / 100, F.col("l_discount") * 3)
    return parse_boxes(li.select(F.concat_ws("-", *YOLO_KEY).alias("stem"), F.lit(0).alias("line"), line.alias("value")))


def _yolo_images(spark, sf):
    """The images of all lines, whether or not these parse."""
    stems = table(spark, sf, "lineitem").select(F.concat_ws("-", *YOLO_KEY).alias("stem")).distinct()
    return stems.select("stem", F.concat("stem", F.lit(".png")).alias("file_name"), F.lit(640.0).alias("width"), F.lit(480.0).alias("height"))


YOLO = "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS stem, round(l_discount * 5, 4) AS cx, round(l_tax * 5, 4) AS cy, round(l_quantity / 100, 4) AS w, round(l_discount * 3, 4) AS h FROM lineitem"


@query(f"""SELECT stem, round(greatest(0, cx * 640 - w * 640 / 2), 4) AS x, round(greatest(0, cy * 480 - h * 480 / 2), 4) AS y, round(greatest(1, w * 640), 4) AS w, round(greatest(1, h * 480), 4) AS h, round(greatest(1, w * 640) * greatest(1, h * 480), 2) AS area FROM ({YOLO})""")
def q_yolo_coco(spark, sf):
    return pixel_boxes(_yolo(spark, sf), _yolo_images(spark, sf)).select("stem", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("bw", 4).alias("w"), F.round("bh", 4).alias("h"), F.round("area", 2).alias("area"))


BOX = "l_quantity * 10 AS x1, l_discount * 1000 AS y1, l_quantity * 10 + 50 AS x2, l_discount * 1000 + 40 AS y2"


def _corner(df):
    return df.select("*", (F.col("l_quantity") * 10).alias("x1"), (F.col("l_discount") * 1000).alias("y1"), (F.col("l_quantity") * 10 + 50).alias("x2"), (F.col("l_discount") * 1000 + 40).alias("y2"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, greatest(0, least(319, x1)) AS x1, greatest(0, least(199, y1)) AS y1, greatest(0, least(319, x2)) AS x2, greatest(0, least(199, y2)) AS y2 FROM (SELECT *, {BOX} FROM lineitem)")
def q_coco_clip(spark, sf):
    rows = _corner(table(spark, sf, "lineitem"))
    c = boxes.clipped(*[F.col(k) for k in ("x1", "y1", "x2", "y2")], F.lit(320.0), F.lit(200.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[v.alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), c)])


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, round(x1 * 0.5, 4) AS x1, round(y1 * 2, 4) AS y1, round(x2 * 0.5, 4) AS x2, round(y2 * 2, 4) AS y2 FROM (SELECT *, {BOX} FROM lineitem)")
def q_resize(spark, sf):
    rows = _corner(table(spark, sf, "lineitem"))
    c = boxes.resized(*[F.col(k) for k in ("x1", "y1", "x2", "y2")], F.lit(0.5), F.lit(2.0))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.round(v, 4).alias(k) for k, v in zip(("x1", "y1", "x2", "y2"), c)])


@query(f"""WITH b AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, {BOX} FROM lineitem), j AS (SELECT a.o, a.p AS pa, b.p AS pb, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS i
 FROM b a JOIN b ON a.o = b.o AND (a.n < b.n OR (a.n = b.n AND a.p < b.p))) SELECT o, pa, pb, round(i / (4000 - i), 6) AS iou FROM j WHERE i > 0""")
def q_iou_pairs(spark, sf):
    b = _corner(table(spark, sf, "lineitem")).select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), "x1", "y1", "x2", "y2")
    c = b.select("o", *[F.col(k).alias("r" + k) for k in ("n", "p", "x1", "y1", "x2", "y2")])
    j = b.join(c, "o").where((F.col("n") < F.col("rn")) | ((F.col("n") == F.col("rn")) & (F.col("p") < F.col("rp"))))
    v = boxes.iou(tuple(F.col(k) for k in ("x1", "y1", "x2", "y2")), tuple(F.col("r" + k) for k in ("x1", "y1", "x2", "y2")))
    return j.withColumn("v", v).where("v > 0").select("o", F.col("p").alias("pa"), F.col("rp").alias("pb"), F.round("v", 6).alias("iou"))


def _dets(spark, sf):
    rows = _corner(table(spark, sf, "lineitem"))
    return rows.select(F.col("l_orderkey").alias("image_id"), F.lit(1).alias("category_id"), "x1", "y1", "x2", "y2", (F.col("l_extendedprice") / 100000).alias("score"))


@query("""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x1, y1) AS k FROM (SELECT l_orderkey AS image_id, l_extendedprice / 100000 AS score, l_quantity * 10 AS x1, l_discount * 1000 AS y1 FROM lineitem) WHERE score >= 0.30),
 s AS (SELECT DISTINCT image_id, 0::bigint AS k, []::STRUCT(x1 DOUBLE, y1 DOUBLE, score DOUBLE)[] AS kept FROM b UNION ALL SELECT b.image_id, b.k, CASE WHEN len(kept) >= 20 OR
 len(list_filter(kept, lambda t: greatest(0, 50 - abs(t.x1 - b.x1)) * greatest(0, 40 - abs(t.y1 - b.y1)) / (4000 - greatest(0, 50 - abs(t.x1 - b.x1)) * greatest(0, 40 - abs(t.y1 - b.y1))) > 0.50)) > 0 THEN kept ELSE list_append(kept, {'x1': b.x1, 'y1': b.y1, 'score': b.score}) END FROM s JOIN b ON b.image_id = s.image_id AND b.k = s.k + 1),
 l AS (SELECT image_id, arg_max(kept, k) AS kept FROM s GROUP BY image_id) SELECT image_id, i::int AS rank, kept[i].score AS score, kept[i].x1 AS x1, kept[i].y1 AS y1, kept[i].x1 + 50 AS x2, kept[i].y1 + 40 AS y2 FROM l, range(1, 21) t(i) WHERE i <= len(kept)""")
def q_nms(spark, sf):
    return detection.suppressed(_dets(spark, sf), ["image_id"])


OVER = "greatest(0, 50 - abs(t.x1 - {0}.x1)) * greatest(0, 40 - abs(t.y1 - {0}.y1)) / (4000 - greatest(0, 50 - abs(t.x1 - {0}.x1)) * greatest(0, 40 - abs(t.y1 - {0}.y1)))"


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x1, y1) AS k FROM (SELECT l_suppkey AS image_id, l_extendedprice / 100000 AS score, l_quantity * 10 AS x1, l_discount * 1000 AS y1 FROM lineitem) WHERE score >= 0.30),
 s AS (SELECT DISTINCT image_id, 0::bigint AS k, []::STRUCT(x1 DOUBLE, y1 DOUBLE, score DOUBLE)[] AS kept FROM b UNION ALL SELECT b.image_id, b.k, CASE WHEN len(list_filter(kept, lambda t: {OVER.format('b')} > 0.50)) > 0 THEN kept ELSE list_append(kept, {{'x1': b.x1, 'y1': b.y1, 'score': b.score}}) END FROM s JOIN b ON b.image_id = s.image_id AND b.k = s.k + 1),
 l AS (SELECT image_id, arg_max(kept, k) AS kept FROM s GROUP BY image_id) SELECT image_id, i::int AS rank, kept[i].score AS score, kept[i].x1 AS x1, kept[i].y1 AS y1 FROM (SELECT image_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM l)""")
def q_nms_rounds(spark, sf):
    """Suppression in images of hundreds of boxes, by rounds over cells."""
    rows = _corner(table(spark, sf, "lineitem")).select(F.col("l_suppkey").alias("image_id"), "x1", "y1", "x2", "y2", (F.col("l_extendedprice") / 100000).alias("score"))
    return detection.suppressed_in_rounds(rows, ["image_id"], top=None).select("image_id", "rank", "score", "x1", "y1")


@query(f"""WITH RECURSIVE b AS (SELECT l_orderkey AS image_id, l_extendedprice / 100000 AS score, l_quantity * 10 AS x1, l_discount * 1000 AS y1 FROM lineitem), d AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, x1, y1) AS k FROM b),
 g AS (SELECT image_id, list({{'x1': x1 + 4, 'y1': y1}} ORDER BY x1, y1) AS ts FROM b GROUP BY image_id), v AS (SELECT round(0.5 + 0.05 * n, 2)::double AS iou FROM range(10) t(n)),
 s AS (SELECT image_id, iou, 0::bigint AS k, 0::double AS score, 0 AS tp, []::bigint[] AS used FROM g, v UNION ALL
 SELECT image_id, iou, k, score, CASE WHEN best IS NULL THEN 0 ELSE 1 END, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.i) END FROM (SELECT s.image_id, s.iou, d.k, d.score, used,
 list_max(list_filter(list_transform(ts, lambda t, i: {{'o': round({OVER.format('d')}, 12), 'i': i}}), lambda c: c.o >= s.iou AND NOT list_contains(used, c.i))) AS best FROM s JOIN d ON d.image_id = s.image_id AND d.k = s.k + 1 JOIN g ON g.image_id = s.image_id)),
 c AS (SELECT iou, score, sum(tp) AS t, count(*) AS n FROM s WHERE k > 0 GROUP BY iou, score), w AS (SELECT iou, sum(t) OVER o AS tp, sum(n) OVER o AS seen FROM c WINDOW o AS (PARTITION BY iou ORDER BY score DESC)),
 p AS (SELECT iou, floor(tp / (SELECT count(*) FROM lineitem) * 100 + 1e-9) AS k, max(tp / seen) AS p FROM w GROUP BY 1, 2), r AS (SELECT v.iou, r, max(p) AS p FROM v, range(101) t(r) LEFT JOIN p ON p.iou = v.iou AND p.k >= r GROUP BY v.iou, r)
 SELECT 1 AS category_id, iou, sum(coalesce(p, 0)) / 101 AS ap FROM r GROUP BY iou""")
def q_ap(spark, sf):
    d = _dets(spark, sf)
    truths = _corner(table(spark, sf, "lineitem")).select(F.col("l_orderkey").alias("image_id"), F.lit(1).alias("category_id"), (F.col("x1") + 4).alias("x1"), "y1", (F.col("x2") + 4).alias("x2"), "y2")
    return detection.average_precision(d, truths)


def _component_sql(pixels: str, least: int) -> str:
    """Boxes of the components of p (key, i, j) by reaching pixels from each other; the ground is reached from a frame around them."""
    steps = "(SELECT unnest([-1, 0, 1]) AS di) AS x, (SELECT unnest([-1, 0, 1]) AS dj) AS y"
    return f"""WITH RECURSIVE {pixels},
 r AS (SELECT key, i, j, i AS ri, j AS rj FROM p UNION SELECT r.key, p.i, p.j, ri, rj FROM r, {steps}, p WHERE p.key = r.key AND p.i = r.i + di AND p.j = r.j + dj),
 c AS (SELECT key, i, j, min((ri, rj)) AS root FROM r GROUP BY key, i, j),
 f AS (SELECT key, min(i) - 1 AS i0, max(i) + 1 AS i1, min(j) - 1 AS j0, max(j) + 1 AS j1 FROM p GROUP BY key),
 q AS (SELECT f.key, a.i, b.j FROM f, (SELECT unnest(range(-1, (SELECT max(i1) + 1 FROM f)))::int AS i) a, (SELECT unnest(range(-1, (SELECT max(j1) + 1 FROM f)))::int AS j) b ANTI JOIN p ON p.key = f.key AND p.i = a.i AND p.j = b.j WHERE a.i BETWEEN i0 AND i1 AND b.j BETWEEN j0 AND j1),
 g AS (SELECT key, i0 AS i, j0 AS j FROM f UNION SELECT g.key, q.i, q.j FROM g, {steps}, q WHERE abs(di) + abs(dj) = 1 AND q.key = g.key AND q.i = g.i + di AND q.j = g.j + dj),
 o AS (SELECT DISTINCT c.key, c.root FROM c, {steps}, g WHERE abs(di) + abs(dj) = 1 AND g.key = c.key AND g.i = c.i + di AND g.j = c.j + dj),
 z AS (SELECT key, min(j) AS x, min(i) AS y, max(j) - min(j) + 1 AS box_w, max(i) - min(i) + 1 AS box_h, count(*) AS pixels FROM c SEMI JOIN o USING (key, root) GROUP BY key, root HAVING (max(j) - min(j) + 1) * (max(i) - min(i) + 1) >= {least})"""


TILE_PIXELS = """b AS MATERIALIZED (SELECT vec_id AS key, ((k - 1) // 8)::int AS i, ((k - 1) % 8)::int AS j, floor(greatest(0, least(1, (embedding[k]::double + 0.3) / 0.6)) * 255) > 180 AS bright FROM embeddings, range(1, 65) t(k)),
 p AS MATERIALIZED (SELECT DISTINCT key, i + di AS i, j + dj AS j FROM b, (SELECT unnest([-1, 0, 1]) AS di) a, (SELECT unnest([-1, 0, 1]) AS dj) c WHERE bright AND i + di BETWEEN 0 AND 7 AND j + dj BETWEEN 0 AND 7)"""


@query(_component_sql(TILE_PIXELS, 9) + " SELECT key AS vec_id, x, y, box_w, box_h FROM z")
def q_components(spark, sf):
    tiles = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: numeric.to_byte(v.cast("double"), -0.3, 0.3)).alias("px"), F.lit(8).alias("w"))
    return components.component_boxes(tiles, key="vec_id", values="px", threshold=180, min_area=9)


MOSAIC_PIXELS = "p AS MATERIALIZED (SELECT DISTINCT 0 AS key, (vec_id // 25 * 8 + (k - 1) // 8)::int AS i, (vec_id % 25 * 8 + (k - 1) % 8)::int AS j FROM embeddings, range(1, 65) t(k) WHERE embedding[k]::double > 0.1)"


@query(_component_sql(MOSAIC_PIXELS, 4) + " SELECT x, y, box_w, box_h, pixels FROM z")
def q_components_large(spark, sf):
    """Components of one raster, 25 tiles wide, that all vectors make up; they reach over the tiles' borders."""
    k = F.col("vec_id")
    on = components.bright_pixels(table(spark, sf, "embeddings"), key=F.lit(0), row=F.floor(k / 25) * 8, col=k % 25 * 8, values=F.transform("embedding", lambda v: v.cast("double")), width=F.lit(8), threshold=0.1, dilate=False)
    return components.boxes(on, min_area=4).drop("key")


@query("SELECT DISTINCT vec_id, i + di AS i, j + dj AS j FROM (SELECT vec_id, ((k - 1) // 8)::int AS i, ((k - 1) % 8)::int AS j FROM embeddings, range(1, 65) t(k) WHERE embedding[k] > 0.2) p, (SELECT unnest([-1, 0, 1]) AS di) a, (SELECT unnest([-1, 0, 1]) AS dj) b")
def q_dilate(spark, sf):
    px = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("k", "v")).where("v > cast(0.2 as double)")
    return raster.dilated(px.select("vec_id", F.floor(F.col("k") / 8).cast("int").alias("i"), (F.col("k") % 8).cast("int").alias("j")), "vec_id")


@query("SELECT doc_id AS image_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def q_sanitize(spark, sf):
    images = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("file_name"))
    listing = table(spark, sf, "documents").select(F.concat(F.when(F.col("lang") == "en", "").otherwise("other-"), F.col("doc_id")).alias("file_name"))
    return detection.sanitised(images, table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"), "quality"), listing)[1].select("image_id", "quality")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id)) AS r, count(*) OVER () AS n FROM documents) SELECT doc_id AS image_id, toxic, CASE WHEN r <= floor(n * .8) THEN 'train' WHEN r <= floor(n * .8) + floor(n * .1) THEN 'val' ELSE 'test' END AS split FROM labels JOIN r USING (doc_id)""")
def q_split_coco(spark, sf):
    images = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return detection.split_documents(images, table(spark, sf, "labels").select(F.col("doc_id").alias("image_id"), "toxic"))[1].select("image_id", "toxic", "split")


@query("SELECT 'lo' AS key, 'lo,' || format('{:.3f}', min(value)) AS line FROM events UNION ALL SELECT 'hi', 'hi,' || format('{:.3f}', max(value)) FROM events")
def q_summary_lines(spark, sf):
    return summary_lines(table(spark, sf, "events").agg(F.min("value").alias("lo"), F.max("value").alias("hi")))


def _classifier_sql() -> str:
    """Newton steps on the balanced, penalised likelihood of two standardised features; the steps are sums over the training rows and a solution of three equations."""
    h = ["h00", "h01", "h02", "h11", "h12", "h22"]
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    d0 = f"(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / {det}"
    d1 = f"(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / {det}"
    d2 = f"(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / {det}"
    sums = ", ".join(f"sum(w * p * (1 - p) * {e}) + {r} AS {n}" for n, e, r in zip(h, ("1", "a", "b", "a * a", "a * b", "b * b"), (0, 0, 0, 1, 0, 1)))
    return f"""WITH RECURSIVE x AS MATERIALIZED (SELECT doc_id, n_chars::double AS size, length(regexp_replace(text, '[^A-Z]', '', 'g'))::double / greatest(1, length(text)) AS upper, quality::double AS label FROM documents JOIN labels USING (doc_id)),
 s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id)) <= floor(count(*) OVER (PARTITION BY label) * 0.75) AS train FROM x),
 m AS MATERIALIZED (SELECT avg(size) AS ms, stddev_pop(size) AS ss, avg(upper) AS mu, stddev_pop(upper) AS su, count(*) AS n, sum(label) AS ones FROM s WHERE train),
 z AS MATERIALIZED (SELECT doc_id, label, train, (size - ms) / ss AS a, (upper - mu) / su AS b, n / (2 * CASE label WHEN 1 THEN ones ELSE n - ones END) AS w FROM s, m),
 c AS (SELECT 0 AS k, 0::double AS b0, 0::double AS b1, 0::double AS b2 UNION ALL SELECT k + 1, b0 - {d0}, b1 - {d1}, b2 - {d2} FROM (SELECT k, b0, b1, b2, sum(w * (p - label)) AS g0, sum(w * (p - label) * a) + b1 AS g1, sum(w * (p - label) * b) + b2 AS g2, {sums}
 FROM (SELECT c.*, z.*, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p FROM c, z WHERE train AND k < 30) GROUP BY k, b0, b1, b2))
 SELECT doc_id, label, round(1 / (1 + exp(-(b0 + b1 * a + b2 * b))), 6) AS probability, (1 / (1 + exp(-(b0 + b1 * a + b2 * b))) > 0.5)::int AS predicted FROM z, c WHERE NOT train AND k = 30"""


@query(_classifier_sql())
def q_classifier(spark, sf):
    """A classifier fitted on three quarters of the labelled rows, saved, loaded and applied to the others."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("size"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.lit(1), F.length("text"))).alias("upper"), F.col("quality").cast("double").alias("label"))
    named = ranking.stratified(rows, "label", F.col("doc_id"))
    path = folder(spark, "model")
    ml.save_classifier(ml.fit_classifier(named.where("split = 'train'"), ["size", "upper"], "label"), path)
    return ml.classify(ml.load_classifier(path), named.where("split = 'test'")).select("doc_id", "label", F.round("probability", 6).alias("probability"), "predicted")


@query("SELECT event_id, value AS pred, value >= 200.0 AS alert FROM events")
def q_stream_alert(spark, sf):
    """The alert rule run as a stream over the events file; the result table is what the stream wrote."""
    from tidemark.streaming.jobs import alerts

    out = folder(spark, "alerts")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    q = alerts(stream, F.col("value"), 200.0).select("event_id", "pred", "alert").writeStream.format("parquet").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start(f"{out}/rows")
    q.awaitTermination()
    return spark.read.parquet(f"{out}/rows")
