"""Text tables in and out."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.store import read_files


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; empty cells are empty text, never null."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns])


def list_files(spark: SparkSession, pattern: str, *, recursive: bool = False) -> DataFrame:
    """path, name, length and modified of the files that match a glob or lie in a folder; contents are not read.

    Recursive: of a folder, empty ones too, each folder in it listed by a task. Otherwise Spark lists them on the driver and leaves out empty ones.
    """
    if recursive:
        return read_files(spark, pattern, content=False)
    rows = spark.read.format("binaryFile").load(pattern)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def read_csv_union(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files of different headers united by column name, with source_file; a column that a file lacks is null there.

    One read of many files would bind columns by position to the first header.
    """
    if not paths:
        raise ValueError("no files")
    frames = [read_text_csv(spark, p).withColumn("source_file", F.input_file_name()) for p in sorted(paths)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv_glob(spark: SparkSession, pattern: str) -> DataFrame:
    """As read_csv_union over the files of a glob: the first line of each is found in one scan, and the files of one header are one read.

    Only paths and headers reach the driver, and the plan has a branch for each different header.
    """
    lines = spark.read.text(pattern).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"))
    first = lines.where("at = 0").groupBy("path").agg(F.min_by("value", "k").alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("header").collect()
    if not groups:
        raise ValueError("no files")
    frames = []
    for g in groups:
        raw = spark.read.option("header", True).csv(g["paths"])
        frames.append(raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns], F.input_file_name().alias("source_file")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Cells of a CSV cast to the schema's types by name; what does not parse is null, as are columns that the file lacks."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    raw = read_text_csv(spark, path)
    cell = {c.strip(): c for c in raw.columns}
    return raw.select(*[(F.trim(F.col(f"`{cell[f.name]}`")).try_cast(f.dataType) if f.name in cell else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A metric log whose header may stand again among its rows; names and cells are trimmed."""
    raw = read_text_csv(spark, path)
    rows = raw.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in raw.columns])
    first = rows.columns[0]
    return rows.where(F.coalesce(F.col(f"`{first}`") != first, F.lit(True)))


def find_column(columns: Sequence[str], *names: str, contains: Sequence[str] = ()) -> str | None:
    """The first of names among the trimmed columns, exactly or but for case, else the first column with all of contains."""
    trimmed = {c.strip(): c for c in columns}
    lower = {c.lower(): o for c, o in reversed(list(trimmed.items()))}
    for n in names:
        if n in trimmed:
            return trimmed[n]
    for n in names:
        if n.lower() in lower:
            return lower[n.lower()]
    return next((c for c in columns if contains and all(x.lower() in c.lower() for x in contains)), None)


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """A header and the given columns, in order."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def rewrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table that df itself reads: written beside it first, then moved into its place, so a failure leaves the old one whole."""
    spark = df.sparkSession
    staged, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex}"
    df.write.format(fmt).option("header", True).save(staged)
    jvm = spark.sparkContext._jvm
    place = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = place(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(place(path)) and not fs.rename(place(path), place(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(place(staged), place(path)):
        raise OSError(f"cannot move {staged}")
    fs.delete(place(old), True)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str, env: dict[str, str] | None = None) -> DataFrame:
    """name of each line without trailing blanks, $VAR and ${VAR} replaced from env."""
    name = F.rtrim("value")
    for k, v in sorted((env or {}).items(), key=lambda kv: -len(kv[0])):
        name = F.replace(F.replace(name, F.lit("${" + k + "}"), F.lit(v)), F.lit("$" + k), F.lit(v))
    return spark.read.text(path).select(name.alias("name")).where("name <> ''")


def summary_lines(row: DataFrame) -> DataFrame:
    """key, line ('key,value' with three decimals) for each column of a one-row table of numbers; a null value's line is null.

    Rounded from the double's exact value, ties to even: Java's format rounds the shortest decimal that names it, and 0.0625 up.
    """
    cols = row.columns

    @F.pandas_udf("string")
    def decimals(v: pd.Series) -> pd.Series:
        return v.map(lambda x: f"{x:.3f}")

    rows = row.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "key", "v")
    return rows.select("key", F.when(F.col("v").isNotNull(), F.concat("key", F.lit(","), decimals("v"))).alias("line"))


def markdown(df: DataFrame) -> DataFrame:
    """line of a Markdown table's body for each row; nulls are empty."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def split_manifest(files: DataFrame, root: str, *, path: str = "path", split: str = "split") -> DataFrame:
    """src, dst of copying files into a folder for each split; the copy itself is the storage's business."""
    name = F.element_at(F.split(path, "/"), -1)
    return files.select(F.col(path).alias("src"), F.concat_ws("/", F.lit(root.rstrip("/")), split, name).alias("dst"))


def read_stats(spark: SparkSession, folders: Sequence[str], name: str = "target_stats.json") -> DataFrame:
    """mu, sigma, log_target (1 where it is missing) from the first of the folders that has the file; no row where none has."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    schema = "mu double, sigma double, log_target int"
    for folder in folders:
        place = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if place.getFileSystem(conf).exists(place):
            return spark.read.schema(schema).option("multiLine", True).json(place.toString()).fillna({"log_target": 1})
    return spark.createDataFrame([], schema)
