"""File formats against arrays and against files put together by hand; pushdown; one file a row; streams of frames."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.sources import fetch, netcdf, pages, shapes, store, tiff
from tidemark.streaming import frames


def pixels(df, h, w, bands=1):
    out = np.full((h, w, bands), np.nan)
    rows = df.collect()
    for r in rows:
        out[r["i"], r["j"], r["band"]] = np.nan if r["value"] is None else r["value"]
    return out, rows


@pytest.mark.parametrize(("kind", "bands", "options"), [("f4", 1, {"tile": 16}), ("u1", 3, {"strip_rows": 7, "differences": True}), ("i2", 2, {"compress": False, "tile": 32}), ("u2", 1, {"tile": 16, "differences": True}), ("f8", 1, {"compress": False, "strip_rows": 1000})])
def test_tiff(spark, tmp_path, kind, bands, options):
    rng = np.random.default_rng(1)
    values = (rng.normal(size=(53, 41, bands)) * 50 + 100).clip(0, 250).astype(kind)
    values[5, 7] = 0
    (tmp_path / "a.tif").write_bytes(tiff.encoded(values, affine=(2.0, 0.0, 100.0, 0.0, -2.0, 500.0), epsg=32640, no_data=0.0, **options))
    r = tiff.opened(str(tmp_path / "a.tif"))
    assert (r.height, r.width, r.bands, r.epsg, r.no_data, r.affine) == (53, 41, bands, 32640, 0.0, (2.0, 0.0, 100.0, 0.0, -2.0, 500.0))
    got, _ = pixels(tiff.read_tiff(spark, str(tmp_path), run_bytes=500), 53, 41, bands)
    want = values.astype(float)
    want[want == 0] = np.nan
    assert np.array_equal(got, want, equal_nan=True)
    inside = tiff.read_tiff(spark, str(tmp_path), bounds=(110.5, 450.0, 139.0, 489.0), bands=[bands - 1])
    got, rows = pixels(inside, 53, 41, bands)
    assert {(x["i"], x["j"]) for x in rows} == {(i, j) for i in range(5, 26) for j in range(5, 20)}
    assert np.array_equal(got[5:26, 5:20, -1], want[5:26, 5:20, -1], equal_nan=True)
    whole = sum(r.sizes)
    read = sum({x["block"]: x["block_bytes"] for x in rows}.values())
    assert read < whole or len(r.sizes) == 1
    assert tiff.read_tiff(spark, str(tmp_path), bounds=(0.0, 0.0, 1.0, 1.0)).collect() == []


def test_tiff_by_hand(spark, tmp_path):
    """A big-endian file with one band a plane, and a file of the large format whose second strip was never written."""
    planes = [(np.arange(12).reshape(3, 4) * s).astype(">i4") for s in (1, -5)]
    raw = [zlib.compress(p.tobytes()) for p in planes]
    tags = [(256, 3, [4]), (257, 3, [3]), (258, 3, [32, 32]), (259, 3, [8]), (273, 4, [8, 8 + len(raw[0])]), (277, 3, [2]), (278, 3, [3]), (279, 4, [len(x) for x in raw]), (284, 3, [2]), (339, 3, [2, 2])]
    at = 8 + sum(map(len, raw))
    entries, extra, rest = b"", b"", at + 2 + 12 * len(tags) + 4
    for tag, kind, vs in tags:
        v = struct.pack(f">{len(vs)}{'H' if kind == 3 else 'I'}", *vs)
        entries += struct.pack(">HHI", tag, kind, len(vs)) + (v.ljust(4, b"\0") if len(v) <= 4 else struct.pack(">I", rest + len(extra)))
        extra += v if len(v) > 4 else b""
    (tmp_path / "planes.tif").write_bytes(b"MM\0*" + struct.pack(">I", at) + b"".join(raw) + struct.pack(">H", len(tags)) + entries + b"\0" * 4 + extra)
    got, _ = pixels(tiff.read_tiff(spark, str(tmp_path / "planes.tif")), 3, 4, 2)
    assert np.array_equal(got, np.stack(planes, 2))
    first = np.arange(8, dtype="<f4")
    tags = [(256, 4, [4]), (257, 4, [3]), (258, 3, [32]), (259, 3, [1]), (273, 16, [16, 0]), (278, 3, [2]), (279, 16, [32, 0]), (339, 3, [3])]
    entries, extra, rest = b"", b"", 48 + 8 + 20 * len(tags) + 8
    for tag, kind, vs in tags:
        v = struct.pack(f"<{len(vs)}{ {3: 'H', 4: 'I', 16: 'Q'}[kind]}", *vs)
        entries += struct.pack("<HHQ", tag, kind, len(vs)) + (v.ljust(8, b"\0") if len(v) <= 8 else struct.pack("<Q", rest + len(extra)))
        extra += v if len(v) > 8 else b""
    (tmp_path / "big.tif").write_bytes(b"II" + struct.pack("<HHHQ", 43, 8, 0, 48) + first.tobytes() + struct.pack("<Q", len(tags)) + entries + b"\0" * 8 + extra)
    got, _ = pixels(tiff.read_tiff(spark, str(tmp_path / "big.tif")), 3, 4)
    assert np.array_equal(got[:, :, 0], [[0, 1, 2, 3], [4, 5, 6, 7], [0, 0, 0, 0]])
    (tmp_path / "none.tif").write_bytes(b"nothing")
    with pytest.raises(Exception, match="not a TIFF"):
        tiff.read_tiff(spark, str(tmp_path / "none.tif")).collect()


def test_tiff_points(spark, tmp_path):
    values = np.arange(40 * 30, dtype="i4").reshape(40, 30)
    (tmp_path / "a.tif").write_bytes(tiff.encoded(values, affine=(1.0, 0.0, 0.0, 0.0, -1.0, 40.0), tile=16, no_data=65.0))
    (tmp_path / "junk.tif").write_bytes(b"junk")
    a, junk = str(tmp_path / "a.tif"), str(tmp_path / "junk.tif")
    rows = [(1, a, 0.5, 39.5), (2, a, 29.9, 0.1), (3, a, 5.5, 37.5), (4, a, -0.1, 5.0), (5, a, 5.0, 41.0), (6, junk, 1.0, 1.0), (7, None, 1.0, 1.0), (8, a, None, 1.0), (9, str(tmp_path / "gone.tif"), 1.0, 1.0), (1, a, 0.5, 39.5)]
    got = tiff.sampled(spark.createDataFrame(rows, "k int, path string, x double, y double"), key="k").collect()
    assert sorted((r["k"], r["value"]) for r in got) == [(1, 0.0), (1, 0.0), (2, 1199.0), *[(k, None) for k in range(3, 10)]]


def test_netcdf(spark, tmp_path):
    lats, lons = np.linspace(30, 10, 21), np.linspace(50, 69, 39)
    values = np.add.outer(lats, lons)
    values[3, 4] = np.nan
    (tmp_path / "p.nc").write_bytes(netcdf.encoded(lats, lons, values, scale=0.01, offset=70.0))
    (tmp_path / "q.nc").write_bytes(netcdf.encoded(lats[::-1], lons, values[::-1]))
    (tmp_path / "bad.nc").write_bytes(b"\x89HDF not a classic file")
    got = netcdf.read_netcdf(spark, str(tmp_path), variable="chlor_a", run_bytes=200).collect()
    assert len(got) == 2 * 21 * 39
    for r in got:
        want = None if (r["lat"], r["lon"]) == (lats[3], lons[4]) else r["lat"] + r["lon"]
        assert r["value"] is None if want is None else r["value"] == pytest.approx(want, abs=0.0051)
        assert lats[r["i"] if r["path"].endswith("p.nc") else 20 - r["i"]] == r["lat"] and lons[r["j"]] == r["lon"]
    for bounds in ((52.0, 12.0, 53.0, 20.5), (51.0, 10.0, 68.0, 30.0), (0.0, 0.0, 1.0, 1.0)):
        clipped = netcdf.read_netcdf(spark, str(tmp_path), tokens=["CHLOR"], bounds=bounds).collect()
        inside = {(lat, lon) for lat in lats for lon in lons if bounds[0] <= lon <= bounds[2] and bounds[1] <= lat <= bounds[3]}
        assert {(r["lat"], r["lon"]) for r in clipped} == inside and len(clipped) == 2 * len(inside)
    with pytest.raises(Exception, match="classic"):
        netcdf.read_netcdf(spark, str(tmp_path), skip=False).collect()
    assert netcdf.read_netcdf(spark, str(tmp_path), variable="sst").collect() == []
    names = {r["name"]: bytes(r["content"]) for r in netcdf.contents(netcdf.read_netcdf(spark, str(tmp_path), variable="chlor_a")).collect()}
    (tmp_path / "again").mkdir()
    for k, v in names.items():
        (tmp_path / "again" / k).write_bytes(v)
    again = netcdf.read_netcdf(spark, str(tmp_path / "again"), variable="chlor_a")
    key = lambda r: (r["path"].rsplit("/", 1)[-1], r["i"], r["j"])
    assert {key(r): (r["lat"], r["lon"], r["value"]) for r in again.collect()} == {key(r): (r["lat"], r["lon"], r["value"]) for r in got}


def test_netcdf_by_hand(spark, tmp_path):
    """A CDF-1 file with records: a time, a palette, axes of two dimensions, and a variable of (time, y, x) with one record."""
    text = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    dims = struct.pack(">II", 10, 4) + b"".join(text(n) + struct.pack(">I", k) for n, k in (("time", 0), ("y", 2), ("x", 3), ("rgb", 4)))
    none, gap = struct.pack(">II", 0, 0), struct.pack(">II", 12, 1) + text("missing_value") + struct.pack(">IIf", 5, 1, -1.0)
    lat, lon, value = np.array([[1, 2, 3], [4, 5, 6]], ">f8"), np.array([[7, 8, 9], [1, 2, 3]], ">f8"), np.array([[0.5, -1, 2.5], [3, 4, np.nan]], ">f4")
    parts = [("palette", (1, 3), none, 1, np.zeros((2, 4), "i1").tobytes()), ("lat", (1, 2), none, 6, lat.tobytes()), ("lon", (1, 2), none, 6, lon.tobytes()), ("time", (0,), none, 6, np.array([5.0], ">f8").tobytes()), ("flh", (0, 1, 2), gap, 5, value.tobytes())]

    def header(begins):
        out = b"CDF\1" + struct.pack(">I", 1) + dims + none + struct.pack(">II", 11, len(parts))
        for (n, ids, attrs, kind, data), b in zip(parts, begins):
            out += text(n) + struct.pack(f">{1 + len(ids)}I", len(ids), *ids) + attrs + struct.pack(">III", kind, len(data), b)
        return out

    size = len(header([0] * 5))
    begins = [size + sum(len(p[4]) for p in parts[:k]) for k in range(5)]
    (tmp_path / "r.nc").write_bytes(header(begins) + b"".join(p[4] for p in parts))
    got = {(r["i"], r["j"]): (r["lat"], r["lon"], r["value"]) for r in netcdf.read_netcdf(spark, str(tmp_path), tokens=["fl"]).collect()}
    assert got == {(0, 0): (1, 7, 0.5), (0, 1): (2, 8, None), (0, 2): (3, 9, 2.5), (1, 0): (4, 1, 3.0), (1, 1): (5, 2, 4.0), (1, 2): (6, 3, None)}
    assert {(r["i"], r["j"]) for r in netcdf.read_netcdf(spark, str(tmp_path), bounds=(2.0, 2.0, 8.0, 5.0)).collect()} == {(0, 1), (1, 1)}


def test_shapes(spark, tmp_path):
    some = [[[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0]]], None, [[[10.0, 10.0], [11.0, 10.0], [11.0, 12.0]]]]
    lines = [[[[0.0, 0.0], [5.0, 5.0]], [[6.0, 6.0], [7.0, 7.0], [8.0, 6.0]]]]
    for name, shp, kind in (("a", some, "polygon"), ("b", lines, "line"), ("c", [[[[3.0, 3.0]]], [[[30.0, 30.0]]]], "point"), ("d", [], "polygon")):
        for suffix, content in zip(("shp", "shx"), shapes.encoded(shp, kind)):
            (tmp_path / f"{name}.{suffix}").write_bytes(content)
    got = {(r["path"][-5], r["record"]): (r["kind"], r["rings"]) for r in shapes.read_shapes(spark, str(tmp_path), run_bytes=50).collect()}
    assert set(got) == {("a", 0), ("a", 2), ("b", 0), ("c", 0), ("c", 1)}
    assert got["a", 0] == ("polygon", [[[0.0, 0.0], [0.0, 4.0], [4.0, 4.0], [4.0, 0.0], [0.0, 0.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 1.0]]])
    assert got["b", 0] == ("line", lines[0]) and got["c", 0] == ("point", [[[3.0, 3.0]]])
    near = {(r["path"][-5], r["record"]) for r in shapes.read_shapes(spark, str(tmp_path), bounds=(3.0, 3.0, 9.0, 9.0)).collect()}
    assert near == {("a", 0), ("b", 0), ("c", 0)}


def test_pages_are_skipped(spark, tmp_path):
    k = F.col("id")
    items = spark.range(5000).select(k.cast("string").alias("id"), F.when(k % 100 > 0, F.timestamp_seconds(k * 3600)).alias("datetime"), F.when(k % 2 == 0, "s2").otherwise("l8").alias("collection"), (k % 97).cast("double").alias("cloudcov"), (k % 360.0 - 180).alias("xmin"), F.lit(0.0).alias("ymin"), (k % 360.0 - 179).alias("xmax"), F.lit(1.0).alias("ymax"), F.lit(None).cast("string").alias("href"))
    pages.write_pages(items, str(tmp_path / "p"), page_items=50, partitions=4)
    every = pages.read_pages(spark, str(tmp_path / "p"))
    assert every.count() == 5000 and every.select("page").distinct().count() >= 100
    assert every.where("datetime is null").count() == 50
    reader = pages._Reader({"path": str(tmp_path / "p")})
    assert len(reader.needed()) == every.select("page").distinct().count()
    from datetime import datetime

    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    asked = [EqualTo(("collection",), "s2"), GreaterThanOrEqual(("datetime",), datetime(1970, 2, 1)), LessThan(("datetime",), datetime(1970, 2, 11))]
    assert list(reader.pushFilters(asked)) == asked
    assert 1 <= len(reader.needed()) <= 5
    found = every.where("collection = 's2' and datetime >= timestamp'1970-02-01' and datetime < timestamp'1970-02-11'")
    want = items.where("collection = 's2' and datetime >= timestamp'1970-02-01' and datetime < timestamp'1970-02-11'")
    assert sorted(r["id"] for r in found.collect()) == sorted(r["id"] for r in want.collect())
    assert found.rdd.getNumPartitions() == 1 < every.rdd.getNumPartitions() or len(reader.needed()) <= 5


def test_pushed_filters_choose_partitions(spark, tmp_path):
    """The plan's partitions follow the filters: with a page a partition, only pages that can match are tasks."""
    items = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") * 60).alias("datetime"), F.lit("c").alias("collection"), F.col("id").cast("double").alias("cloudcov"), *[F.lit(0.0).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")], F.lit("h").alias("href"))
    pages.write_pages(items, str(tmp_path / "p"), page_items=10, partitions=2)
    every = pages.read_pages(spark, str(tmp_path / "p"), run_items=1)
    assert every.rdd.getNumPartitions() >= 100
    few = every.where("cloudcov >= 500 and cloudcov < 530")
    assert few.rdd.getNumPartitions() <= 5 and few.count() == 30


def test_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"f{k}", bytes([k] * k)) for k in range(40)] + [("empty", None)], "name string, content binary").repartition(5)
    fails = rows.withColumn("content", F.when(F.col("name") == "f37", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        store.write_files(fails, path)
    assert list((tmp_path / "out").rglob("*")) == []  # no file of a failed job is there, pending or not
    store.write_files(rows, path)
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {f"f{k}": bytes([k] * k) for k in range(40)} | {"empty": b""}
    with pytest.raises(Exception, match="one file name"):
        store.write_files(rows.unionByName(rows.limit(1)), str(tmp_path / "twice"))
    assert list((tmp_path / "twice").iterdir()) == []
    with pytest.raises(Exception, match="not a file name"):
        store.write_files(rows.limit(1).withColumn("name", F.lit("../up")), path)
    store.write_files(spark.createDataFrame([("x.gz", b"as it is")], "name string, content binary"), str(tmp_path / "gz"))
    assert (tmp_path / "gz" / "x.gz").read_bytes() == b"as it is"
    assert len(store.listed(path)) == 41 and store.listed(path, "f1*")[0].endswith("/f1") and store.listed(str(tmp_path / "nowhere")) == []


def test_frames_restart(spark, tmp_path):
    rng = np.random.default_rng(2)
    shots = [(1000 * k, rng.integers(0, 256, (4, 6), dtype=np.uint8)) for k in range(10)]
    (tmp_path / "in").mkdir()
    target = tmp_path / "in" / "a.frames"
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def go():
        stream = frames.frames(spark, str(tmp_path / "in"), run_frames=3)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["path"][-8], r["frame"], bytes(r["pixels"])) for r in spark.read.parquet(out).collect())

    raw = lambda k: shots[k][1].tobytes()
    target.write_bytes(frames.packed(shots[:4], (4, 6)) + b"\0" * 20)  # the fifth is being written
    assert go() == [("a", k, raw(k)) for k in range(4)]
    target.write_bytes(frames.packed(shots, (4, 6)))
    (tmp_path / "in" / "b.frames").write_bytes(frames.packed(shots[:2], (4, 6)))
    assert go() == [("a", k, raw(k)) for k in range(10)] + [("b", k, raw(k)) for k in range(2)]
    assert len(go()) == 12
    batch = frames.frames(spark, str(target), stream=False, every=4).collect()
    assert sorted((r["frame"], r["time"].timestamp(), r["height"], r["width"]) for r in batch) == [(0, 0.0, 4, 6), (4, 4.0, 4, 6), (8, 8.0, 4, 6)]


def test_unpacked(spark):
    import bz2
    import gzip

    rows = [("a/x.nc.gz", gzip.compress(b"grid")), ("b.bz2", bz2.compress(b"two")), ("plain.gz", b"not packed"), ("broken.gz", b"\x1f\x8b??"), ("none", None), ("empty", b"")]
    got = fetch.unpacked(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert [(r["path"], None if r["content"] is None else bytes(r["content"]), r["packed"]) for r in got] == [("a/x.nc", b"grid", "gz"), ("b", b"two", "bz2"), ("plain.gz", b"not packed", None), ("broken", None, "gz"), ("none", None, None), ("empty", b"", None)]
