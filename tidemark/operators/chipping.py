"""Jittered chips at several scales over images, with a centre chip where none passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(first: Column, last: Column, step: int) -> Column:
    return F.when(first <= last, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def _sides(size: int, scales: Sequence[float]) -> Column:
    return F.array(*[F.lit(round(size * s)) for s in scales])


def windows(images: DataFrame, *, size: int, stride: int, scales: Sequence[float] = (1.0, 0.8), jitter: int = 64, seed: str = "42") -> DataFrame:
    """image_id, base_row, base_col, side, row, col: a stride grid over each image's clip box (row0, row1, col0, col1 in pixels) widened by size, at every scale.

    The last base may lie one pixel past the last whole window, as its shift is cut off at the image's end. A window is moved by up to jitter pixels each way, by a hash of its place, and kept within the image (height, width).
    """
    low = lambda c: F.floor(F.greatest(F.lit(0), F.col(c) - size) / stride).cast("int") * stride
    high = lambda c, end: F.greatest(F.lit(0), F.least(F.col(end), F.col(c) + size) - size + 1).cast("int")
    out = images.select("*", F.explode(_steps(low("row0"), high("row1", "height"), stride)).alias("base_row"))
    out = out.select("*", F.explode(_steps(low("col0"), high("col1", "width"), stride)).alias("base_col"))
    out = out.select("*", F.explode(_sides(size, scales)).alias("side"))

    def moved(base: str, end: str) -> Column:
        h = F.md5(F.concat_ws(":", F.lit(seed), "image_id", "base_row", "base_col", "side", F.lit(base)))
        shift = F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % (2 * jitter + 1) - jitter
        return F.greatest(F.lit(0), F.least(F.col(end) - F.col("side"), F.col(base) + shift)).cast("int")

    return out.select("image_id", "base_row", "base_col", "side", moved("base_row", "height").alias("row"), moved("base_col", "width").alias("col"))


def measured(wins: DataFrame, cells: DataFrame, *, size: int, wanted: int, keys: Sequence[str]) -> DataFrame:
    """Windows (keys, row, col, side) with the share of their cells (image_id, i, j, cls, value) of the wanted class, and their largest value.

    Cells and windows meet by equality of image and of square buckets of `size`.
    """
    spans = lambda c: F.sequence(F.floor(F.col(c) / size), F.floor((F.col(c) + F.col("side") - 1) / size))
    placed = wins.select("*", F.explode(spans("row")).alias("bi")).select("*", F.explode(spans("col")).alias("bj"))
    buckets = cells.select("image_id", "i", "j", "cls", "value", F.floor(F.col("i") / size).alias("bi"), F.floor(F.col("j") / size).alias("bj"))
    inside = placed.join(buckets, ["image_id", "bi", "bj"])
    inside = inside.where((F.col("i") >= F.col("row")) & (F.col("i") < F.col("row") + F.col("side")) & (F.col("j") >= F.col("col")) & (F.col("j") < F.col("col") + F.col("side")))
    return inside.groupBy(*keys, "row", "col", "side").agg(F.avg((F.col("cls") == wanted).cast("double")).alias("share"), F.max("value").alias("top"))


def chips(images: DataFrame, cells: DataFrame, *, size: int, stride: int, scales: Sequence[float] = (1.0, 0.8), jitter: int = 64, seed: str = "42", wanted: int = 6, least: float = 0.01) -> DataFrame:
    """image_id, row, col, side, share, forced of the windows that meet the clip box, hold least of the wanted class and any value above zero.

    A window whose cells all lack a class passes without a share, as an image without a class band has nothing to be judged by.

    An image without such a window has centre windows of its clip box, at every scale, that hold least and any value (forced).
    """
    clip = images.select("image_id", "row0", "row1", "col0", "col1")
    wins = windows(images, size=size, stride=stride, scales=scales, jitter=jitter, seed=seed).join(clip, "image_id")
    wins = wins.where((F.col("row") <= F.col("row1")) & (F.col("row") + F.col("side") >= F.col("row0")) & (F.col("col") <= F.col("col1")) & (F.col("col") + F.col("side") >= F.col("col0")))
    fine = F.coalesce(F.col("share") >= least, F.lit(True)) & (F.col("top") > 0)
    keys = ["image_id", "base_row", "base_col"]
    found = measured(wins.select(*keys, "row", "col", "side"), cells, size=size, wanted=wanted, keys=keys).where(fine)
    found = found.select("image_id", "row", "col", "side", "share", F.lit(False).alias("forced"))
    none = images.join(found.select("image_id").distinct(), "image_id", "left_anti")
    middle = lambda a, b, end: F.greatest(F.lit(0), F.least(F.col(end) - F.col("side"), F.floor((F.col(a) + F.col(b)) / 2) - F.floor(F.col("side") / 2))).cast("int")
    forced = none.select("*", F.explode(_sides(size, scales)).alias("side"))
    forced = forced.select("image_id", middle("row0", "row1", "height").alias("row"), middle("col0", "col1", "width").alias("col"), "side")
    forced = measured(forced, cells, size=size, wanted=wanted, keys=["image_id"]).where(fine)
    return found.unionByName(forced.select("image_id", "row", "col", "side", "share", F.lit(True).alias("forced")))
