"""Scene catalogues, product listings, areas of interest and images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.geo import boxes_meet
from tidemark.functions.names import middle, product
from tidemark.functions.parse import get

ITEM = "id string, datetime timestamp, collection string, properties map<string,string>, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>, assets map<string,struct<href:string>>"
#: Name tokens of the products that the enrichment knows: fixed values.
PRODUCTS = {"chlor_a": ("chl", "chlor_a"), "Kd_490": ("kd", "kd_490"), "nflh": ("flh", "nflh")}


def search(items: DataFrame, *, collection: str, start: str, end: str, area: tuple[float, float, float, float] | None = None, cloud: float | None = None, max_items: int | None = None) -> DataFrame:
    """Items of a collection in a closed time range, whose box meets the area, under a cloud cover; the least cloudy first if limited. Filters reach the scan."""
    t = F.col("datetime")
    out = items.where((F.col("collection") == collection) & (t >= F.lit(start).cast("timestamp")) & (t < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    cover = get(F.col("properties"), "eo:cloud_cover", F.lit(None).cast("string")).try_cast("double")
    out = out.withColumn("cloudcov", cover)
    if area is not None:
        out = out.where(boxes_meet(tuple(F.col(f"bbox.{k}") for k in ("xmin", "ymin", "xmax", "ymax")), tuple(F.lit(float(v)) for v in area)))
    if cloud is not None:
        out = out.where(F.col("cloudcov") < cloud)
    return out if max_items is None else out.orderBy(F.col("cloudcov").asc_nulls_last(), "id").limit(max_items)


def asset(item_assets: Column, key: str) -> Column:
    return get(item_assets, key, F.lit(None).cast("struct<href:string>"))["href"]


def product_files(listing: DataFrame, *, period: str = "8D", products: dict[str, tuple[str, ...]] = PRODUCTS) -> DataFrame:
    """path, product, mid of the listed files of a period, by their names alone (a folder's name does not count)."""
    p = product(F.col("path"), products, needs=(f".{period}.", ".l3m."))
    return listing.select("path", p.alias("product"), middle(F.element_at(F.split("path", "/"), -1)).alias("mid")).where("product is not null")


def read_area(spark: SparkSession, path: str) -> DataFrame:
    """feature, ring (array of points) of the outer rings of a GeoJSON feature or collection; a multipolygon has a row for each of its polygons."""
    geometry = "struct<type:string,coordinates:string>"  # nested differently in each type, so read as text first
    doc = spark.read.schema(f"type string, geometry {geometry}, features array<struct<type:string,geometry:{geometry}>>").option("multiLine", True).json(path)
    found = doc.select(F.explode(F.coalesce(F.transform("features", lambda f: f["geometry"]), F.array("geometry"))).alias("g")).where("g is not null")
    found = found.select(F.monotonically_increasing_id().alias("feature"), "g.type", "g.coordinates")
    one = F.when(F.col("type") == "Polygon", F.array(F.from_json("coordinates", "array<array<array<double>>>")))
    many = F.when(F.col("type") == "MultiPolygon", F.from_json("coordinates", "array<array<array<array<double>>>>"))
    return found.select("feature", F.explode(F.coalesce(one, many)).alias("polygon")).select("feature", F.col("polygon")[0].alias("ring"))


def extent(rings: DataFrame, ring: str = "ring") -> DataFrame:
    """xmin, ymin, xmax, ymax over all rings."""
    p = rings.select(F.explode(ring).alias("p"))
    return p.agg(F.min(F.col("p")[0]).alias("xmin"), F.min(F.col("p")[1]).alias("ymin"), F.max(F.col("p")[0]).alias("xmax"), F.max(F.col("p")[1]).alias("ymax"))


def area_text(rings: DataFrame, properties: dict[str, float]) -> DataFrame:
    """value: a GeoJSON collection of the rings, each with the properties."""
    props = F.struct(*[F.lit(v).alias(k) for k, v in properties.items()])
    feature = F.struct(F.lit("Feature").alias("type"), props.alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry"))
    return rings.agg(F.collect_list(feature).alias("fs")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.col("fs").alias("features"))).alias("value"))


def buffered_boxes(boxes: DataFrame, km: float) -> DataFrame:
    """Boxes in degrees widened by km on every side, east-west by the latitude farthest from the equator; they hold the exact buffers, for which geometry libraries stand."""
    dy = km / 111.32
    far = F.greatest(F.abs("ymin"), F.abs("ymax"))
    dx = F.lit(dy) / F.greatest(F.cos(F.radians(far)), F.lit(1e-6))
    return boxes.withColumns({"xmin": F.col("xmin") - dx, "xmax": F.col("xmax") + dx, "ymin": F.col("ymin") - dy, "ymax": F.col("ymax") + dy})


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, data of the images in a folder."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return i.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), "data")
