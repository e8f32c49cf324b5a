"""Connected components of links, and of the pixels of rasters of any size.

Pixels become runs along their rows, cut at every 64th column, so that a raster is never one row or one task; runs that touch are links. Those between runs of a block that
one batch holds are joined there, and rounds of stars over the links that are left join the blocks' parts.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.raster import dilated
from tidemark.session import discard, own_run, written

#: Columns a run spans at most.
SPAN = 64
#: Rows of a block, whose runs lie together while they are joined within a batch.
BLOCK = 256
MOST_ROUNDS = 100


@own_run
def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id that can be reached) for every id in links (a, b); ids without a link are not in it.

    Alternating stars: each id's larger neighbours move to the smallest id next to it, then each id and its smaller neighbours do. Every round is two sums by id, two joins and a write,
    and the links get no more; an id with very many links is a skewed key of a join, which adaptive execution splits, and never a list.
    """
    spark = links.sparkSession
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
        discard(spark, keep=[edges])
        if state == seen:
            roots = edges.select(F.col("v").alias("id")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
        seen = state
    raise RuntimeError(f"components are not settled after {MOST_ROUNDS} rounds")


def runs(pixels: DataFrame) -> DataFrame:
    """key, i, b, j0, j1: unbroken runs of the pixels (key, i, j) in row i from column j0 to j1, within a span b of columns."""
    p = pixels.select("key", "i", "j").distinct().withColumn("b", F.floor(F.col("j") / SPAN).cast("int"))
    at = F.col("j") - F.row_number().over(Window.partitionBy("key", "i", "b").orderBy("j"))  # at most SPAN rows
    return p.withColumn("_g", at).groupBy("key", "i", "b", "_g").agg(F.min("j").alias("j0"), F.max("j").alias("j1")).drop("_g")


def gaps(on: DataFrame, frame: DataFrame) -> DataFrame:
    """The runs of what is not on within frame (key, i0, i1, j0, j1, ends included), cut at the same columns."""
    rows = frame.select("key", "j0", "j1", F.explode(F.sequence("i0", "i1")).alias("i"))
    span = lambda c: F.floor(F.col(c) / SPAN).cast("int")
    rows = rows.select("key", "i", F.col("j0").alias("_lo"), F.col("j1").alias("_hi"), F.explode(F.sequence(span("j0"), span("j1"))).alias("b"))
    rows = rows.select("key", "i", "b", F.greatest("_lo", F.col("b") * SPAN).alias("_lo"), F.least("_hi", F.col("b") * SPAN + SPAN - 1).alias("_hi"))
    held = on.groupBy("key", "i", "b").agg(F.array_sort(F.collect_list(F.struct("j0", "j1"))).alias("_r"))  # at most half of SPAN
    rows = rows.join(held, ["key", "i", "b"], "left").withColumn("_r", F.coalesce("_r", F.array().cast("array<struct<j0:int,j1:int>>")))
    begins = F.concat(F.array("_lo"), F.transform("_r", lambda r: r["j1"] + 1))
    ends = F.concat(F.transform("_r", lambda r: r["j0"] - 1), F.array("_hi"))
    free = F.filter(F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("j0"), b.alias("j1"))), lambda r: r["j0"] <= r["j1"])
    return rows.select("key", "i", "b", F.explode(free).alias("_f")).select("key", "i", "b", "_f.j0", "_f.j1")


def _spread(rs: DataFrame, reach: int) -> DataFrame:
    """Runs repeated for each span that lies within reach of their columns."""
    span = lambda c: F.floor(c / SPAN).cast("int")
    return rs.withColumn("b", F.explode(F.sequence(span(F.col("j0") - reach), span(F.col("j1") + reach))))


def touching(a: DataFrame, b: DataFrame, *, below: int, diagonal: bool) -> DataFrame:
    """a.id, b.id (as a, b) where b's run lies in the row `below` a's and the columns overlap, or touch at a corner if diagonal."""
    reach = int(diagonal)
    up = _spread(a.select("key", F.col("i"), "j0", "j1", F.col("id").alias("a")), reach).withColumn("i", F.col("i") + below)
    down = b.select("key", "i", "b", F.col("j0").alias("k0"), F.col("j1").alias("k1"), F.col("id").alias("_b"))
    met = up.join(down, ["key", "i", "b"]).where((F.col("j0") <= F.col("k1") + reach) & (F.col("k0") <= F.col("j1") + reach))
    return met.select("a", F.col("_b").alias("b"))


def beside(a: DataFrame, b: DataFrame) -> DataFrame:
    """a.id, b.id (as a, b) where b's run begins right after a's ends, in the same row."""
    left = a.select("key", "i", (F.col("j1") + 1).alias("j0"), F.col("id").alias("a"))
    return left.join(b.select("key", "i", "j0", F.col("id").alias("b")), ["key", "i", "j0"]).select("a", "b")


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that it reaches over the links a[k], b[k]: larger roots hang under smaller ones until no link has two."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return root
        a, b = a[apart], b[apart]
        np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        while (root[root] != root).any():
            root = root[root]


def _links(pdf: pd.DataFrame, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the runs (k, i, j0, j1), in order of key, row and column, that touch: one row apart (at corners too, if reach is 1), or side by side."""
    k, i, j0, j1 = (pdf[c].to_numpy(np.int64) for c in ("k", "i", "j0", "j1"))
    new = np.diff(k) != 0
    y = np.concatenate([[0], np.cumsum(np.where(new | (np.diff(i) > 1), 2, np.diff(i)))])  # the next row is one more, any other at least two
    least = j0.min()
    wide = j1.max() - least + 4
    begin, end = y * wide + j0 - least + 1, y * wide + j1 - least + 1  # both in order, as runs lie apart
    lo, hi = np.searchsorted(end, begin + wide - reach), np.searchsorted(begin, end + wide + reach, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(pdf)), n)
    b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    side = np.flatnonzero(end[:-1] + 1 == begin[1:])
    return np.concatenate([a, side]), np.concatenate([b, side + 1])


def merged(rs: DataFrame, diagonal: bool) -> DataFrame:
    """Runs (with id) and part: the least id of the runs of their batch that they are connected with. Which runs share a batch is left open; links between parts are not lost, touching() finds them.

    Blocks of a raster lie together, so that few links are left; a batch is as long as Arrow's are.
    """

    def parts(frames):
        for pdf in frames:
            at = pdf.assign(k=pd.factorize(pdf["key"])[0]).sort_values(["k", "i", "j0"], ignore_index=True)
            ids = at["id"].to_numpy()
            root = joined(len(at), *_links(at, int(diagonal)))
            least = ids.copy()
            np.minimum.at(least, root, ids)
            yield at.assign(part=least[root])[[*pdf.columns, "part"]]

    block = F.floor(F.col("i") / BLOCK)
    near = rs.repartition("key", block).sortWithinPartitions("key", block, "b", "i", "j0")
    return near.mapInPandas(parts, StructType([*rs.schema, StructField("part", LongType())]))


def labelled(rs: DataFrame, diagonal: bool) -> DataFrame:
    """Runs (with id) and their component: eight-connected if diagonal, else four-connected."""
    rs = written(merged(rs, diagonal))
    parts = rs.drop("id").withColumnRenamed("part", "id")
    found = components(touching(parts, parts, below=1, diagonal=diagonal).unionByName(beside(parts, parts)).where("a != b").distinct())
    return rs.join(found.select(F.col("id").alias("part"), "component"), "part", "left").withColumn("component", F.coalesce("component", "part")).drop("part")


def boxes(pixels: DataFrame, *, min_area: int = 1, outer: bool = True) -> DataFrame:
    """key, x, y, box_w, box_h, pixels of the eight-connected components of the pixels (key, i, j), whose box has min_area pixels or more.

    With outer, components that lie in a hole of another are left out: those that touch no background (four-connected) that reaches past the key's pixels. Repeated pixels count once; null keys, rows or
    columns are left out; no pixels give no rows.
    """
    kept = pixels.select("key", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j")).where("key is not null and i is not null and j is not null")
    on = written(runs(kept).withColumn("id", F.monotonically_increasing_id()))
    named = written(labelled(on, diagonal=True))
    size = F.sum(F.col("j1") - F.col("j0") + 1).alias("pixels")
    found = named.groupBy("key", "component").agg(F.min("j0").alias("x"), F.min("i").alias("y"), (F.max("j1") - F.min("j0") + 1).alias("box_w"), (F.max("i") - F.min("i") + 1).alias("box_h"), size)
    if outer:
        frame = on.groupBy("key").agg((F.min("i") - 1).alias("i0"), (F.max("i") + 1).alias("i1"), (F.min("j0") - 1).alias("j0"), (F.max("j1") + 1).alias("j1"))
        off = written(gaps(on, frame).withColumn("id", F.monotonically_increasing_id()))
        ground = written(labelled(off, diagonal=False))
        rim = ground.join(frame.select("key", F.col("i0").alias("i")), ["key", "i"], "left_semi").select("component").distinct()  # the frame's first row is all background
        outside = written(ground.join(rim, "component", "left_semi"))
        seen = [touching(named, outside, below=d, diagonal=False).select(F.col("a").alias("id")) for d in (-1, 1)] + [beside(named, outside).select(F.col("a").alias("id")), beside(outside, named).select(F.col("b").alias("id"))]
        ids = seen[0].unionByName(seen[1]).unionByName(seen[2]).unionByName(seen[3]).distinct()
        found = found.join(named.join(ids, "id", "left_semi").select("component").distinct(), "component", "left_semi")
    return found.where(F.col("box_w") * F.col("box_h") >= min_area).select("key", "x", "y", "box_w", "box_h", "pixels")


def bright_pixels(tiles: DataFrame, *, key: Column, row: Column, col: Column, values: Column, width: Column, threshold: float, dilate: bool = True) -> DataFrame:
    """key, i, j of the pixels of a mosaic that are over the threshold, widened by a pixel each way (within the mosaic's tiles) if dilate.

    tiles hold flat arrays of width columns; row and col are the place of a tile's first pixel in the mosaic.
    """
    w = width.cast("int")
    flat = tiles.select(key.alias("key"), row.cast("int").alias("_r"), col.cast("int").alias("_c"), w.alias("_w"), F.posexplode(values).alias("_k", "_v"))
    px = flat.select("key", (F.col("_r") + F.floor(F.col("_k") / F.col("_w"))).cast("int").alias("i"), (F.col("_c") + F.col("_k") % F.col("_w")).cast("int").alias("j"), "_v")
    on = px.where(F.col("_v") > threshold).select("key", "i", "j")
    if not dilate:
        return on
    return dilated(on, "key").join(px.select("key", "i", "j"), ["key", "i", "j"], "left_semi")


def component_boxes(tiles: DataFrame, *, key: str, values: str, width: str = "w", threshold: float = 180, min_area: int = 100, dilate: bool = True) -> DataFrame:
    """key, x, y, box_w, box_h of the bright components of each tile (a flat array of values and its width), after a 3x3 dilation; those in holes of others left out."""
    on = bright_pixels(tiles, key=F.col(key), row=F.lit(0), col=F.lit(0), values=F.col(values), width=F.col(width), threshold=threshold, dilate=dilate)
    return boxes(on, min_area=min_area).select(F.col("key").alias(key), "x", "y", "box_w", "box_h")
