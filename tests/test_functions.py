"""Functions and operators against values worked out by hand, brute force and the goldens of the data model."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import boxes, geo, names, numeric, parse
from tidemark.operators import asof, calendars, detection, grid, labels, metrics, ml, quality, ranking, raster
from tidemark.sources import catalogue, fetch, grids, tables
from tidemark.sources import labels as label_files
from tidemark.streaming.jobs import alerts, enrich_arrivals


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_parse(spark):
    df = spark.createDataFrame([("1e-3",), (" 1.5 ",), ("nan",), ("",), ("x",), (None,), ("1024.0",)], "c string")
    got = [tuple(r) for r in df.select(parse.number(F.col("c")), parse.whole(F.col("c")), parse.present(F.col("c"))).collect()]
    assert got == [(0.001, 0, True), (1.5, 1, True), (None, None, False), (None, None, False), (None, None, True), (None, None, False), (1024.0, 1024, True)]
    t = spark.createDataFrame([("2017-09-09T06:56:19Z",), ("2017-09-09 06:56:19+04:00",), ("2017-09-09junk",), ("x",)], "c string").select(F.date_format(parse.timestamp(F.col("c")), "yyyy-MM-dd HH")).collect()
    assert [r[0] for r in t] == ["2017-09-09 06", "2017-09-09 02", "2017-09-09 00", None]
    kv = one(spark, parse.key_values(F.lit("a=1, b = 2=3")))[0]
    assert kv == {"a": "1", "b": "2=3"}


def test_names(spark):
    n = F.lit("/x/8d/AQUA_MODIS.20190218_20190225.L3m.8D.CHL.chlor_a.4km.nc")
    assert one(spark, F.date_format(names.middle(n), "yyyy-MM-dd HH"))[0] == "2019-02-21 12"
    assert one(spark, names.utm_epsg(F.lit("none"), F.lit("S2B_T39QXG")), names.utm_epsg(F.lit("t20HAB")))[:] == (32639, 32720)
    assert one(spark, names.stem(n), names.suffix(n), names.parent(n))[:] == ("AQUA_MODIS.20190218_20190225.L3m.8D.CHL.chlor_a.4km", ".nc", "/x/8d")
    listing = spark.createDataFrame([("/8d/A.20190101_20190131.L3m.MO.CHL.chlor_a.nc",), ("/m/A.20190101_20190108.L3m.8D.CHL.chlor_a.nc",)], "path string")
    got = catalogue.product_files(listing).collect()
    assert [(r["product"], str(r["mid"])) for r in got] == [("chlor_a", "2019-01-04 12:00:00")]


def test_calendars(spark):
    bins = calendars.eight_day_bins(spark, 2019, 2024)
    assert bins.count() == 6 * 46
    last = bins.where("year = 2019 and bin = 45").first()
    assert (str(last["d0"]), str(last["d1"])) == ("2019-12-27", "2019-12-31")
    names_ = calendars.file_names(calendars.months(spark, 2017, 2024), {"chlor_a": ("CHL", "chlor_a")}, "MO")
    assert names_.count() == 96


def test_geo_round_trip_and_known_point(spark):
    e, n = geo.to_utm(F.lit(51.0), F.lit(0.0), F.lit(32639))
    assert one(spark, F.round(e, 3), F.round(n, 3))[:] == (500000.0, 0.0)
    e, n = geo.to_utm(F.lit(58.5), F.lit(23.6), F.lit(32640))
    a, b = geo.from_utm(e, n, F.lit(32640))
    assert one(spark, F.round(a, 8), F.round(b, 8))[:] == (58.5, 23.6)
    aff = F.array(*[F.lit(float(v)) for v in (10, 0, 600000, 0, -10, 2700000)])
    x, y = geo.pixel_to_map(F.lit(3), F.lit(5), aff)
    assert one(spark, *geo.map_to_pixel(x + 1, y - 1, aff))[:] == (3, 5)
    assert one(spark, geo.match_longitude(F.lit(-10.0), F.lit(0.0), F.lit(359.0)), geo.match_longitude(F.lit(190.0), F.lit(-180.0), F.lit(179.0)))[:] == (350.0, -170.0)


def test_numeric(spark):
    assert one(spark, numeric.to_byte(F.lit(float("nan")), 0, 10), numeric.to_byte(F.lit(5.0), 0, 10), numeric.to_byte(F.lit(20.0), 0, 10))[:] == (0, 127, 255)
    assert [one(spark, numeric.season(F.lit(m)))[0] for m in (12, 3, 6, 11)] == ["winter", "spring", "summer", "autumn"]
    assert one(spark, numeric.half_even(F.lit(2.5)))[0] == 2


def test_gates_and_dedupe(spark):
    rows = [("a", "", "0.1"), ("b", "1023", "0.1"), ("c", "1024", "nan"), ("d", "2000", "0.2500001"), ("e", "16384.0", "")]
    df = spark.createDataFrame(rows, "tile string, valid_px string, ndwi_mean string")
    got = {r["tile"]: r["reason"] for r in quality.with_reason(df, quality.chip_gates(df)).collect()}
    assert got == {"a": "low_valid_px", "b": "low_valid_px", "c": None, "d": "high_ndwi", "e": None}
    assert quality.drop_empty_columns(spark.createDataFrame([("x", "nan"), ("", None)], "a string, b string")).columns == ["a"]
    with pytest.raises(ValueError):
        quality.best_of(df, "missing", "valid_px", ["tile"])


def test_asof_against_brute_force(spark):
    random.seed(4)
    left = [(k, f"2020-{random.randrange(1, 13):02d}-{random.randrange(1, 29):02d}") for k in range(300)] + [(999, None)]
    right = [(f"2020-{random.randrange(1, 13):02d}-{random.randrange(1, 29):02d}", f"p{k:02d}") for k in range(12)]
    a = spark.createDataFrame(left, "k int, t string").withColumn("t", F.col("t").cast("date"))
    b = spark.createDataFrame(right, "r string, path string").withColumn("r", F.col("r").cast("date"))
    got = {r["k"]: (r["path"], r["gap_days"]) for r in asof.nearest_day(a, b, left_time="t", right_time="r", value="path", max_days=9).collect()}
    for k, t in left:
        want = min(((abs((pd.Timestamp(t) - pd.Timestamp(r)).days), p) for r, p in right), default=None) if t else None
        assert got[k] == ((want[1], want[0]) if want and want[0] <= 9 else (None, None))


def brute_fill(g, i, j, radius, mode):
    h, w = g.shape
    if np.isfinite(g[i, j]):
        return g[i, j]
    for r in range(1, radius + 1):
        a, b, c, d = max(0, i - r), min(h - 1, i + r), max(0, j - r), min(w - 1, j + r)
        win = g[a : b + 1, c : d + 1]
        if not np.isfinite(win).any():
            continue
        if mode == "mean":
            return float(np.nanmean(win))
        for jj in range(c, d + 1):
            for ii in (a, b):
                if np.isfinite(g[ii, jj]):
                    return g[ii, jj]
        for ii in range(a, b + 1):
            for jj in (c, d):
                if np.isfinite(g[ii, jj]):
                    return g[ii, jj]
    return None


@pytest.mark.parametrize("mode", ["mean", "nearest"])
def test_fill_against_brute_force(spark, mode):
    rng = np.random.default_rng(5)
    g = np.where(rng.random((9, 11)) < 0.12, rng.random((9, 11)).round(3), np.nan)
    cells = spark.createDataFrame([("g", i, j, float(g[i, j])) for i in range(9) for j in range(11)], "path string, i int, j int, value double")
    points = spark.createDataFrame([(i * 11 + j, "g", i, j) for i in range(9) for j in range(11)], "id int, path string, i int, j int")
    got = {r["id"]: r["value"] for r in grid.sample(points, cells, key="id", radius=2, mode=mode).collect()}
    for i in range(9):
        for j in range(11):
            want = brute_fill(g, i, j, 2, mode)
            assert (got[i * 11 + j] is None) == (want is None) and (want is None or abs(got[i * 11 + j] - want) < 1e-12)


def test_nearest_index(spark):
    for axis in ([1.0, 2.0, 4.0], [4.0, 2.0, 1.0], [3.0]):
        for q in (-5.0, 1.4, 1.5, 3.0, 3.1, 9.0):
            want = min(range(len(axis)), key=lambda k: (abs(axis[k] - q), k))
            assert one(spark, grid.nearest_index(F.array(*map(F.lit, axis)), F.lit(q)))[0] == want


def test_quantile_sweep_against_pandas(spark):
    assert len(labels.levels()) == 8 and labels.levels()[-1] == 0.8099999999999998
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"id": range(200), "season": rng.choice(["a", "b", "c", None], 200), "flh": rng.random(200).round(3), "chlor_a": rng.random(200).round(3) * 5, "kd490": rng.random(200).round(3) * 0.3})
    pdf.loc[pdf["season"] == "b", "kd490"] = np.nan
    pdf.loc[rng.random(200) < 0.3, "flh"] = np.nan
    pdf.loc[pdf["season"] == "c", "kd490"] = 0.01
    got = {r["id"]: r["hab_label"] for r in labels.quantile_labels(spark.createDataFrame(pdf), group="season").collect()}
    for season, part in pdf.groupby("season"):
        ok = (part["kd490"] >= 0.12) if part["kd490"].notna().any() else pd.Series(True, part.index)
        for q in labels.levels():
            hit = ((part["flh"] >= part["flh"].quantile(q)) | (part["chlor_a"] >= part["chlor_a"].quantile(q))) & ok
            if hit.any():
                break
        else:
            hit = ((part["flh"] >= 0.002) | (part["chlor_a"] >= 3.0)) & ok
        assert [got[i] for i in part["id"]] == hit.astype(int).tolist()
    assert all(got[i] is None for i in pdf.loc[pdf["season"].isna(), "id"])


def test_suppression_against_loop(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), float(rng.random()), *map(float, (x, y, x + 30, y + 30))) for i, x, y in zip(rng.integers(0, 5, 80), rng.integers(0, 90, 80), rng.integers(0, 90, 80))]
    df = spark.createDataFrame(rows, "im int, score double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["im"], r["score"]) for r in detection.suppressed(df, ["im"], top=None).collect()}

    def overlap(a, b):
        w, h = max(0, min(a[4], b[4]) - max(a[2], b[2])), max(0, min(a[5], b[5]) - max(a[3], b[3]))
        return w * h / (1800 - w * h)

    want = set()
    for im in range(5):
        kept = []
        for r in sorted((r for r in rows if r[0] == im and r[1] >= 0.3), key=lambda r: -r[1]):
            if all(overlap(r, k) <= 0.5 for k in kept):
                kept.append(r)
        want |= {(r[0], r[1]) for r in kept}
    assert got == want


def test_average_precision_by_hand(spark):
    t = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (2, 1, 0.0, 0.0, 10.0, 10.0)], "image_id int, category_id int, x1 double, y1 double, x2 double, y2 double")
    d = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 50.0, 50.0, 60.0, 60.0, 0.8), (2, 1, 0.0, 0.0, 10.0, 10.0, 0.7)], "image_id int, category_id int, x1 double, y1 double, x2 double, y2 double, score double")
    ap = {r["iou"]: r["ap"] for r in detection.average_precision(d, t).collect()}
    assert abs(ap[0.5] - (51 * 1.0 + 50 * 2 / 3) / 101) < 1e-9 and len(ap) == 10
    assert detection.summary(detection.average_precision(t.withColumn("score", F.lit(0.5)), t)).first()["map50"] == 1.0


def test_box_conversions(spark):
    x, y, w, h, area = boxes.from_centre(F.lit(0.0), F.lit(0.5), F.lit(0.2), F.lit(0.001), F.lit(100.0), F.lit(100.0), clamped_area=False)
    assert [round(v, 6) for v in one(spark, x, y, w, h, area)] == [0.0, 49.95, 20.0, 1.0, 2.0]
    lines = spark.createDataFrame([("a", 0, "0 .1 .1 .1 .1 9"), ("a", 1, "0 .1 .1"), ("a", 2, "x .1 .1 .1 .1"), ("a", 3, "0 .1 .1 .1 .1")], "stem string, line int, value string")
    assert [r["line"] for r in label_files.parse_boxes(lines).collect()] == [0, 3]
    assert [r["line"] for r in label_files.parse_boxes(lines, strict=True).collect()] == [3]


def test_label_files_and_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 0.5 0.5 0.2 0.2\n0 0.1 0.1 0.1 0.1")
    (tmp_path / "b.txt").write_text("")
    got = label_files.read_boxes(spark, str(tmp_path))
    assert got.count() == 2
    images = spark.createDataFrame([("a", "a.png", 100.0, 100.0), ("b", "b.png", 100.0, 100.0)], "stem string, file_name string, width double, height double")
    px = label_files.pixel_boxes(got, images)
    assert px.count() == 3
    ims, anns = detection.to_coco(images, px.where("x is not null").select("file_name", "line", "category_id", "x", "y", F.col("bw").alias("w"), F.col("bh").alias("h"), "area"))
    assert [r["id"] for r in anns.orderBy("id").collect()] == [1, 2]
    cats = spark.createDataFrame([(1, "bloom")], "id int, name string")
    label_files.write_document(ims.select("id", "file_name", "width", "height"), anns, cats, str(tmp_path / "doc"))
    back = label_files.read_document(spark, str(tmp_path / "doc"))
    assert (back["images"].count(), back["annotations"].count(), back["categories"].first()["name"]) == (2, 2, "bloom")
    assert {r["stem"]: r["value"] for r in label_files.box_lines(got, images).collect()}["b"] == ""


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("tile,ndwi\nx,1\n")
    (tmp_path / "b.csv").write_text("ndwi,tile,flh\n2,y,\n")
    got = tables.read_csv_glob(spark, str(tmp_path / "*.csv")).orderBy("tile").collect()
    assert [(r["tile"], r["ndwi"], r["flh"]) for r in got] == [("x", "1", None), ("y", "2", "")]
    (tmp_path / "log.csv").write_text("epoch, loss\n1, 0.5\nepoch, loss\n2, 0.4\n")
    assert [r["loss"] for r in tables.read_log(spark, str(tmp_path / "log.csv")).collect()] == ["0.5", "0.4"]
    assert tables.find_column(["  epoch", "metrics/mAP50(B)"], "mAP50", contains=("map50",)) == "metrics/mAP50(B)"
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    tables.rewrite(spark.read.parquet(path).where("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "m.txt").write_text("$ROOT/a.nc  \n\n")
    assert tables.read_lines(spark, str(tmp_path / "m.txt"), {"ROOT": "/d"}).first()["name"] == "/d/a.nc"
    typed = tables.read_typed_csv(spark, str(tmp_path / "a.csv"), "tile string, ndwi double, other int").first()
    assert tuple(typed) == ("x", 1.0, None)


def test_grids_and_rasters(spark):
    packed = spark.createDataFrame([("g", [1.0, 2.0], [5.0, 6.0, 7.0], [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]])], "path string, lats array<double>, lons array<double>, vals array<array<double>>")
    assert grids.to_packed(grids.to_long(packed)).first() == packed.first()
    aff = F.array(*[F.lit(float(v)) for v in (10, 0, 0, 0, -10, 100)])
    bounds = F.struct(F.lit(-50.0).alias("xmin"), F.lit(60.0).alias("ymin"), F.lit(25.0).alias("xmax"), F.lit(200.0).alias("ymax"))
    w = one(spark, grids.window(bounds, aff, F.lit(10), F.lit(10)))[0]
    assert tuple(w) == (0, 4, 0, 2)
    near = grid.nearest_curvilinear(spark.createDataFrame([(1, "g", 1.1, 5.2), (2, "g", 50.0, 5.0)], "id int, path string, lat double, lon double"), grids.to_long(packed), key="id")
    assert {r["id"]: r["value"] for r in near.collect()} == {1: 1.0, 2: 4.0}  # however far, the nearest cell answers


def test_masks_fall_back(spark):
    rows = [("water", [6, 4], [1, 1]), ("clear", [4, 8], [1, 1]), ("data", [8, 9], [1, 0]), ("finite", [8, 8], [0, 0])]
    df = spark.createDataFrame(rows, "k string, c array<int>, d array<int>").withColumn("v", F.array(F.lit(1.0), F.lit(float("nan"))))
    got = {r["k"]: r["m"] for r in df.select("k", raster.usable_pixels(F.col("c"), F.col("d"), F.col("v")).alias("m")).collect()}
    assert got == {"water": [1, 0], "clear": [1, 0], "data": [1, 0], "finite": [1, 0]}


def test_ranking_and_curves(spark):
    df = spark.range(100)
    n = {r["split"]: r["count"] for r in ranking.split_by_rank(df, F.col("id")).groupBy("split").count().collect()}
    assert n == {"train": 70, "val": 15, "test": 15}
    assert sorted(r["k"] for r in ranking.numbered(df, ["id"], "k").collect()) == list(range(1, 101))
    curve = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 0.9, 0.95, 0.95, 0.95, 0.95, 0.8])], "epoch int, loss double")
    out = metrics.plateau(curve, "epoch", "loss").first()["curve"]
    assert [r["lr_scale"] for r in out] == [1, 1, 1, 1, 1, 0.5, 0.5]


def test_compare_keeps_failures(spark):
    got = {r["model"]: r["error"] for r in ml.compare(spark, {"a": lambda: {"x": 1}, "b": lambda: 1 / 0}).collect()}
    assert got["a"] is None and got["b"].startswith("ZeroDivisionError")


def test_needed_files(spark):
    remote = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 2)], "name string, modified int")
    local = spark.createDataFrame([("a", 1, 5), ("b", 3, 5), ("c", 3, 0)], "name string, modified int, length int")
    assert sorted(r["name"] for r in fetch.needed(remote, local).collect()) == ["a", "c", "d"]


def test_area_and_search(spark, tmp_path):
    ring = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]]
    rings = spark.createDataFrame([(ring,)], "ring array<array<double>>")
    tables.write_lines(catalogue.area_text(rings, {"km": 10.0}), "value", str(tmp_path / "aoi"))
    back = catalogue.read_area(spark, str(tmp_path / "aoi"))
    assert tuple(catalogue.extent(back).first()) == (0.0, 0.0, 4.0, 4.0)
    pts = spark.createDataFrame([(1.0, 1.0), (5.0, 1.0)], "x double, y double").crossJoin(back.select("ring"))
    assert [r[0] for r in pts.select(geo.inside_ring(F.col("x"), F.col("y"), F.col("ring"))).collect()] == [True, False]
    items = spark.createDataFrame([("a", "2020-01-01", "s2", {"eo:cloud_cover": "5"}, (1.0, 1.0, 2.0, 2.0)), ("b", "2020-01-02", "s2", {}, (1.0, 1.0, 2.0, 2.0)), ("c", "2020-01-02", "s2", {"eo:cloud_cover": "1"}, (9.0, 9.0, 10.0, 10.0))], "id string, datetime string, collection string, properties map<string,string>, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>")
    items = items.withColumn("datetime", F.col("datetime").cast("timestamp"))
    assert [r["id"] for r in catalogue.search(items, collection="s2", start="2020-01-01", end="2020-01-02", area=(0, 0, 4, 4), max_items=5).collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 1.0), (2, 3.0)], "id int, v double").write.parquet(src)
    stream = spark.readStream.schema("id int, v double").parquet(src)
    q = enrich_arrivals(stream, lambda b: alerts(b, F.col("v")), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert {r["id"]: r["alert"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: False, 2: True}


def test_last_of_ties_and_nulls(spark):
    rows = [(1, 2, "b", 5), (1, 2, "c", 1), (1, 1, "z", 9), (2, None, "n", 1), (2, 0, "m", None), (3, None, "p", 1), (3, None, "q", None)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "k int, pos int, v string, w int").repartition(3)
        assert sorted(tuple(r) for r in asof.last_of(df, "k", "pos").collect()) == [(1, "c", 1), (2, "m", None), (3, "q", None)]


def test_bilinear_against_loops(spark):
    rng = np.random.default_rng(3)
    for h, w, a, b in ((8, 8, 4, 4), (6, 9, 5, 3), (4, 4, 7, 9), (1, 5, 2, 2)):
        x = rng.integers(0, 256, size=(h, w))

        def along(m, out):
            n, rows = m.shape[0], []
            for k in range(out):
                centre, reach = (k + 0.5) * n / out, max(1.0, n / out)
                weights = np.array([max(0.0, 1 - abs((i + 0.5 - centre) / reach)) for i in range(n)])
                lo, hi = max(0, int(centre - reach + 0.5)), min(n, int(centre + reach + 0.5))
                weights[:lo] = weights[hi:] = 0
                whole = np.floor(0.5 + weights / weights.sum() * 2**22).astype(int)
                rows.append(np.clip((2**21 + whole @ m) >> 22, 0, 255))
            return np.array(rows)

        want = along(along(x.T, b).T, a)
        df = spark.createDataFrame([(x.ravel().tolist(),)], "v array<int>")
        got = df.select(raster.resized_bilinear(F.col("v"), h, w, a, b)).first()[0]
        assert np.array(got).reshape(a, b).tolist() == want.tolist()
    assert one(spark, raster.model_input(F.array(F.lit(0), F.lit(255)), 2))[0] == [-1.0, 1.0, -1.0, 1.0]


def test_rings(spark):
    ring = lambda pts: F.array(*[F.array(F.lit(float(x)), F.lit(float(y))) for x, y in pts])
    box = tuple(F.lit(v) for v in (0.0, 0.0, 2.0, 2.0))
    triangle, far, around = ring([(1, 1), (3, 1), (1, 3)]), ring([(5, 5), (6, 5), (6, 6)]), ring([(-9, -9), (9, -9), (9, 9), (-9, 9), (-9, -9)])
    got = one(spark, *[geo.ring_area(geo.ring_in_box(r, box)) for r in (triangle, far, around)], geo.ring_area(triangle), geo.ring_in_use(far), geo.ring_in_use(geo.ring_in_box(far, box)))
    assert np.allclose(got[:4], [1.0, 0.0, 4.0, 2.0]) and got[4:] == (True, False)


def test_areas_of_both_kinds(spark, tmp_path):
    square = "[[[0,0],[1,0],[1,1],[0,0]]]"
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":%s}},{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[%s,%s]}},{"type":"Feature","geometry":{"type":"Point","coordinates":[1,2]}}]}' % (square, square, square)
    (tmp_path / "a.geojson").write_text(text)
    got = catalogue.read_area(spark, str(tmp_path / "a.geojson")).collect()
    assert len(got) == 3 and len({r["feature"] for r in got}) == 2 and got[0]["ring"][1] == [1.0, 0.0]


def test_stats_and_headers(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "target_stats.json").write_text('{"mu": 0.5, "sigma": 2.0}')
    assert tables.read_stats(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).first()[:] == (0.5, 2.0, 1)
    assert tables.read_stats(spark, [str(tmp_path / "a")]).count() == 0
    for k in range(6):
        (tmp_path / f"{k}.csv").write_text(f"a,b\n{k},x\n" if k % 2 else f"b,c\ny,{k}\n")
    got = tables.read_csv_glob(spark, str(tmp_path / "*.csv"))
    assert sorted(got.columns) == ["a", "b", "c", "source_file"]
    assert sorted((r["a"] or "", r["b"], r["c"] or "") for r in got.collect()) == sorted([("1", "x", ""), ("3", "x", ""), ("5", "x", ""), ("", "y", "0"), ("", "y", "2"), ("", "y", "4")])


def test_written_tables_are_discarded(spark):
    from tidemark.session import discard, mark, written

    at = mark()
    a, b = written(spark.range(5)), written(spark.range(7))
    discard(spark, at, keep=[b])
    assert b.count() == 7
    with pytest.raises(Exception):
        a.count()
    discard(spark, at)


def test_numbers_of_ties_and_skew(spark):
    rows = [(k % 3 if k % 2 else 0, k) for k in range(2000)] + [(0, 7)] * 500
    got = ranking.numbered(spark.createDataFrame(rows, "a int, b int").repartition(7), ["a"]).collect()
    assert sorted(r["id"] for r in got) == list(range(1, 2501))
    by = sorted((r["id"], r["a"]) for r in got)
    assert [a for _, a in by] == sorted(a for _, a in by)


def test_linear_model_file(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([0.0, -1.0],)], "v array<double>")
    got = ml.score_onnx(df, ml.linear_onnx([0.5, 0.25], 1.0), "v").collect()
    assert [round(r["pred"], 6) for r in got] == [2.0, 0.75]


def test_far_points_of_curved_grids(spark):
    rng = np.random.default_rng(1)
    cells = [("p", i, j, float(i + rng.random()), float(j + rng.random()), float(i * 9 + j)) for i in range(6) for j in range(6)]
    points = [(k, "p", float(rng.uniform(-60, 60)), float(rng.uniform(-170, 170))) for k in range(60)] + [(99, "q", 0.0, 0.0)]
    got = {r["k"]: r["value"] for r in grid.nearest_curvilinear(spark.createDataFrame(points, "k int, path string, lat double, lon double"), spark.createDataFrame(cells, "path string, i int, j int, lat double, lon double, value double"), key="k").collect()}
    assert got[99] is None
    for k, _, lat, lon in points[:-1]:
        assert got[k] == min(cells, key=lambda c: (np.hypot(c[3] - lat, c[4] - lon), c[1], c[2]))[5]
