"""Queries of file formats: rasters and grids written from given tables, and read back by windows, points and boxes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geo import ring_area
from tidemark.plans.base import query, table
from tidemark.session import folder
from tidemark.sources import netcdf, pages, shapes, tiff
from tidemark.sources.store import read_files, write_files

#: 400 vectors of 64 make up a raster of 160 x 160, 20 by 20 squares of 8 x 8.
MOSAIC = """m AS (SELECT vec_id // 400 AS k, (vec_id % 400 // 20 * 8 + (n - 1) // 8)::int AS i, (vec_id % 20 * 8 + (n - 1) % 8)::int AS j, embedding[n]::double AS v FROM embeddings, range(1, 65) t(n))"""


def _mosaics(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v"))
    return e.select(F.floor(F.col("vec_id") / 400).alias("k"), (F.col("vec_id") % 400).cast("int").alias("at"), "v")


def _grid(pdf: pd.DataFrame) -> np.ndarray:
    """160 x 160 values of a mosaic; NaN where a vector is not there."""
    out = np.full((20, 20, 8, 8), np.nan, np.float32)
    for at, v in zip(pdf["at"], pdf["v"]):
        out[at // 20, at % 20] = np.asarray(v, np.float32).reshape(8, 8)
    return out.transpose(0, 2, 1, 3).reshape(160, 160)


def _tiffs(spark, sf) -> str:
    """A folder with the mosaics as tiled GeoTIFF files of quarter degrees, k % 7 degrees to the east of 50 and down from 20."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["k"].iloc[0])
        values = np.nan_to_num(_grid(pdf), nan=-9999.0)
        content = tiff.encoded(values, affine=(0.25, 0.0, 50.0 + k % 7, 0.0, -0.25, 20.0), epsg=4326, no_data=-9999.0, tile=16 if k % 2 else None, strip_rows=10)
        return pd.DataFrame({"name": [f"m{k}.tif"], "content": [content]})

    path = folder(spark, "tiff")
    write_files(_mosaics(spark, sf).groupBy("k").applyInPandas(one, "name string, content binary"), path)
    return path


def _number(path):
    return F.regexp_extract(path, r"m([0-9]+)\.\w+$", 1).cast("bigint")


@query(f"WITH {MOSAIC} SELECT k, i, j, v AS value FROM m WHERE i BETWEEN floor((20 - 8.9) * 4) AND floor((20 + 5.3) * 4) AND j BETWEEN floor((60.1 - 50 - k % 7) * 4) AND floor((70.2 - 50 - k % 7) * 4)")
def q_tiff_window(spark, sf):
    """The pixels of all rasters, tiled or in strips, within bounds on the map."""
    px = tiff.read_tiff(spark, _tiffs(spark, sf), bounds=(60.1, -5.3, 70.2, 8.9))
    return px.where("value is not null").select(_number(F.col("path")).alias("k"), "i", "j", "value")


@query(f"""WITH {MOSAIC}, p AS (SELECT vec_id, vec_id // 400 AS k, 50.1 + vec_id * 3 % 43 AS x, 19.9 - vec_id * 7 % 41 AS y FROM embeddings)
 SELECT vec_id, v AS value FROM p LEFT JOIN m ON m.k = p.k AND m.i = floor((20 - y) * 4) AND m.j = floor((x - 50 - p.k % 7) * 4)""")
def q_tiff_points(spark, sf):
    """A point's pixel in its raster; some points lie outside."""
    path, k = _tiffs(spark, sf), F.col("vec_id")
    points = table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit(f"{path}/m"), F.floor(k / 400), F.lit(".tif")).alias("path"), (50.1 + k * 3 % 43).alias("x"), (19.9 - k * 7 % 41).alias("y"))
    return tiff.sampled(points, key="vec_id")


CLIPPED = f"""WITH {MOSAIC}, c AS (SELECT k, 30 - 0.25::double * i AS lat, 50 + 0.25::double * j AS lon, CASE WHEN v > -0.1 THEN floor((v - 0.5::double) / 0.001::double + 0.5) * 0.001::double + 0.5::double END AS v FROM m)
 SELECT k, lat, lon, round(v, 9) AS value FROM c WHERE lat BETWEEN 0.1 AND 20 AND lon BETWEEN 55 AND 70.2"""


@query(CLIPPED)
def q_netcdf_clip(spark, sf):
    """Grids written as packed NetCDF, clipped to a box by reading only that, written again as clipped files, and read."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        values = _grid(pdf).astype(np.float64)
        values[~(values > -0.1)] = np.nan
        content = netcdf.encoded(30 - 0.25 * np.arange(160), 50 + 0.25 * np.arange(160), values, scale=0.001, offset=0.5)
        return pd.DataFrame({"name": [f"m{pdf['k'].iloc[0]}.nc"], "content": [content]})

    whole, clipped = folder(spark, "netcdf"), folder(spark, "netcdf")
    write_files(_mosaics(spark, sf).groupBy("k").applyInPandas(one, "name string, content binary"), whole)
    cells = netcdf.read_netcdf(spark, whole, variable="chlor_a", bounds=(55.0, 0.1, 70.2, 20.0))
    write_files(netcdf.contents(cells, scale=0.001, offset=0.5), clipped)
    again = netcdf.read_netcdf(spark, clipped, variable="chlor_a")
    there = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 400).alias("k"), F.floor(F.col("vec_id") % 400 / 20).alias("r"), (F.col("vec_id") % 20).alias("c")).distinct()
    out = again.select(_number(F.col("path")).alias("k"), "lat", "lon", F.round("value", 9).alias("value"), F.floor((30 - F.col("lat")) / 2).alias("r"), F.floor((F.col("lon") - 50) / 2).alias("c"))
    return out.join(there, ["k", "r", "c"], "left_semi").select("k", "lat", "lon", "value")


@query("SELECT doc_id, strlen(coalesce(text, ''))::bigint AS n_bytes, md5(coalesce(text, '')) AS md5 FROM documents")
def q_files_written(spark, sf):
    """Documents as one file each, read back."""
    path = folder(spark, "files")
    d = table(spark, sf, "documents")
    write_files(d.select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content")), path, spread=True)
    back = read_files(spark, path)
    return back.select(F.regexp_extract("path", r"/(-?[0-9]+)\.txt$", 1).cast("bigint").alias("doc_id"), F.col("length").alias("n_bytes"), F.md5("content").alias("md5"))


@query("""SELECT o_orderkey, cover, x::double AS x FROM (SELECT o_orderkey, o_orderdate, o_orderkey * 7 % 101 AS cover, o_orderkey * 13 % 360 - 180 AS x, o_orderpriority FROM orders)
 WHERE o_orderpriority = '2-HIGH' AND o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1996-02-01' AND cover < 40 AND x <= 50 AND x + 8 >= -20""")
def q_catalogue_pushed(spark, sf):
    """Scenes of a paged catalogue: the search's bounds choose pages by their manifest."""
    path, k = folder(spark, "pages"), F.col("o_orderkey")
    x = k * 13 % 360 - 180
    items = table(spark, sf, "orders").select(k.cast("string").alias("id"), F.col("o_orderdate").cast("timestamp").alias("datetime"), F.col("o_orderpriority").alias("collection"), (k * 7 % 101).cast("double").alias("cloudcov"), x.cast("double").alias("xmin"), F.lit(0.0).alias("ymin"), (x + 8).cast("double").alias("xmax"), F.lit(8.0).alias("ymax"), F.lit(None).cast("string").alias("href"))
    pages.write_pages(items, path, page_items=200)
    found = pages.read_pages(spark, path).where("collection = '2-HIGH' and datetime >= timestamp'1995-03-01' and datetime < timestamp'1996-02-01' and cloudcov < 40 and xmin <= 50 and xmax >= -20")
    return found.select(F.col("id").cast("bigint").alias("o_orderkey"), F.col("cloudcov").cast("bigint").alias("cover"), F.col("xmin").alias("x"))


@query("""WITH c AS (SELECT c_custkey // 150 AS k, row_number() OVER (PARTITION BY c_custkey // 150 ORDER BY c_custkey) - 1 AS record, (c_custkey * 37 % 128)::double AS x, (c_custkey * 53 % 128)::double AS y, (6 + c_custkey % 5)::double AS side FROM customer)
 SELECT k, record, x AS xmin, y AS ymin, x + side AS xmax, y + side AS ymax, side * side - 2 AS area FROM c WHERE x <= 90 AND x + side >= 30.5 AND y <= 100 AND y + side >= 40""")
def q_shapes_in_box(spark, sf):
    """Squares with a hole in one shapefile for every 150 customers: those in a box."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        box = lambda x, y, w, h: [[x, y], [x + w, y], [x + w, y + h], [x, y + h]]
        polygons = [[box(x, y, s, s), box(x + 2, y + 2, 1.0, 2.0)] for x, y, s in pdf.sort_values("c_custkey")[["x", "y", "side"]].to_numpy()]
        k = pdf["k"].iloc[0]
        return pd.DataFrame({"name": [f"m{k}.shp", f"m{k}.shx"], "content": list(shapes.encoded(polygons))})

    path, k = folder(spark, "shapes"), F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.floor(k / 150).alias("k"), (k * 37 % 128).cast("double").alias("x"), (k * 53 % 128).cast("double").alias("y"), (6 + k % 5).cast("double").alias("side"))
    write_files(c.groupBy("k").applyInPandas(one, "name string, content binary"), path)
    found = shapes.read_shapes(spark, path, bounds=(30.5, 40.0, 90.0, 100.0))
    return found.select(_number(F.col("path")).alias("k"), "record", "xmin", "ymin", "xmax", "ymax", (ring_area(F.col("rings")[0]) - ring_area(F.col("rings")[1])).alias("area"))


@query("""WITH f AS (SELECT vec_id, vec_id // 1000 AS camera, row_number() OVER (PARTITION BY vec_id // 1000 ORDER BY vec_id) - 1 AS frame, list_sum(list_transform(embedding, lambda v: greatest(0, least(255, floor((v::double + 0.6) * 200))))) / 64 / 25.5 AS pred FROM embeddings)
 SELECT camera, frame, vec_id * 1000 AS ms, round(pred, 6) AS pred, pred >= 4.7 AS alert FROM f WHERE frame % 3 = 0""")
def q_frame_alerts(spark, sf):
    """Every third frame of growing files scored as a stream: half of each file is there at first, the rest after a restart."""
    from pyspark.sql.streaming import StreamingQuery

    from tidemark.streaming.frames import frames
    from tidemark.streaming.jobs import alerts

    path = folder(spark, "frames")
    level = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((v.cast("double") + 0.6) * 200))).cast("int"))
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 1000).alias("camera"), "vec_id", level.alias("v"))

    @F.pandas_udf("double")
    def brightness(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda b: np.frombuffer(b, np.uint8).mean() / 25.5)

    def score() -> StreamingQuery:
        stream = alerts(frames(spark, f"{path}/in", every=3), brightness("pixels"), 4.7)
        out = stream.select(_number(F.col("path")).alias("camera"), "frame", F.unix_millis("time").alias("ms"), F.round("pred", 6).alias("pred"), "alert")
        return out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()

    for share in (0.5, 1.0):
        write_files(e.groupBy("camera").applyInPandas(_frames(share), "name string, content binary"), f"{path}/in")
        score().awaitTermination()
    return spark.read.schema("camera long, frame long, ms long, pred double, alert boolean").parquet(f"{path}/out")


def _frames(share: float):
    """Packs the first share of a camera's frames, with half of the next one as if it were being written."""
    from tidemark.streaming.frames import packed

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("vec_id")
        n = int(len(rows) * share)
        content = packed([(k * 1000, np.asarray(v, np.uint8).reshape(8, 8)) for k, v in zip(rows["vec_id"][:n], rows["v"][:n])], (8, 8))
        return pd.DataFrame({"name": [f"m{pdf['camera'].iloc[0]}.frames"], "content": [content + (b"\0" * 36 if n < len(rows) else b"")]})

    return one
