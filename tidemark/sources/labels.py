"""Detection labels: text files of normalised boxes, and nested image/annotation documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.boxes import from_centre
from tidemark.functions.names import stem

DOCUMENT = "images array<struct<id:string,file_name:string,width:double,height:double,license:int>>, annotations array<struct<id:string,image_id:string,category_id:int,bbox:array<double>,area:double,iscrowd:int>>, categories array<struct<id:int,name:string>>"


def parse_boxes(lines: DataFrame, *, strict: bool = False) -> DataFrame:
    """lines (stem, line, value) to stem, line, cls, cx, cy, w, h. Tolerant: five tokens or more; strict: five. Lines that do not parse are left out."""
    t = F.split(F.trim("value"), r"\s+")
    names = ["cls", "cx", "cy", "w", "h"]
    fits = (lambda p: F.size(p) == 5) if strict else (lambda p: F.size(p) >= 5)
    numbers = lambda p: F.struct(*[p[k].try_cast("double").alias(n) for k, n in enumerate(names)])
    # through a generator, so that a line is split and cast once: a filter on the columns would repeat it for each of them
    rows = lines.select("stem", "line", F.inline(F.transform(F.filter(F.array(t), fits), numbers))).dropna(subset=names)
    return rows.withColumn("cls", F.col("cls").cast("int"))


def read_boxes(spark: SparkSession, path: str, *, strict: bool = False) -> DataFrame:
    """Every label file below path; files are read whole, so the last line needs no end, and as bytes: the reader of whole texts sets up a job's configuration for each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    return file_boxes(files.select(F.col("_metadata.file_path").alias("path"), "content"), strict=strict)


def file_boxes(files: DataFrame, *, strict: bool = False) -> DataFrame:
    """The boxes of label files (path, content)."""
    lines = files.select(stem(F.col("path")).alias("stem"), F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "value"))
    return parse_boxes(lines, strict=strict)


def pixel_boxes(boxes: DataFrame, images: DataFrame, *, variant: str = "clamped", how: str = "left") -> DataFrame:
    """images (stem, file_name, width, height) with their boxes in pixels. variant: 'clamped' or 'unclamped' area, or 'single_class' (category 1).

    how='left' keeps images without boxes, 'inner' drops them.
    """
    return pixel_variants(boxes, images, [variant], how=how).drop("variant")


def pixel_variants(boxes: DataFrame, images: DataFrame, variants: Sequence[str], *, how: str = "left") -> DataFrame:
    """What pixel_boxes() gives for each of several variants, named in the column variant, over one join of the boxes with their images."""
    there = F.col("cx").isNotNull()

    def one(variant: str) -> Column:
        x, y, w, h, area = from_centre(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("width"), F.col("height"), clamped_area=variant != "unclamped")
        category = F.lit(1) if variant == "single_class" else F.col("cls") + 1
        named = {"category_id": category, "x": x, "y": y, "bw": w, "bh": h, "area": area}
        return F.struct(F.lit(variant).alias("variant"), *[F.when(there, v).alias(n) for n, v in named.items()])

    return images.join(boxes, "stem", how).select(*images.columns, "line", F.inline(F.array(*map(one, variants))))


def box_lines(boxes: DataFrame, images: DataFrame) -> DataFrame:
    """stem, value: the text of each image's label file, empty without boxes; six decimals."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "cx", "cy", "w", "h")
    text = boxes.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("line", line.alias("t")))).alias("ls"))
    return images.select("stem").distinct().join(text, "stem", "left").select("stem", F.coalesce(F.array_join(F.transform("ls", lambda s: s["t"]), "\n"), F.lit("")).alias("value"))


def read_document(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories of a nested document; ids are text on both sides."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    return {k: doc.select(F.explode(k).alias("r")).select("r.*") for k in ("images", "annotations", "categories")}


def document(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """value: one row of JSON with the three lists. The format is one document, so this is for document-sized tables; larger ones stay tables."""
    one = lambda df, n: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(n))
    rows = one(images, "images").crossJoin(one(annotations, "annotations")).crossJoin(one(categories, "categories"))
    return rows.select(F.to_json(F.struct("images", "annotations", "categories")).alias("value"))


def write_document(images: DataFrame, annotations: DataFrame, categories: DataFrame, path: str) -> None:
    document(images, annotations, categories).write.mode("overwrite").text(path)
