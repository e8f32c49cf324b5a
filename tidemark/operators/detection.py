"""Detection documents, suppression and average precision."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.boxes import iou
from tidemark.operators.metrics import running_sums
from tidemark.operators.ranking import numbered, split_by_rank
from tidemark.session import discard, own_run, written

IOUS = [round(0.5 + 0.05 * k, 2) for k in range(10)]
#: Images of so many boxes of a category or fewer are not laid out in cells.
FEW = 64


def suppressed(df: DataFrame, group: Sequence[str], *, score: str = "score", box: Sequence[str] = ("x1", "y1", "x2", "y2"), score_min: float = 0.30, iou_max: float = 0.50, top: int | None = 20) -> DataFrame:
    """Boxes that survive: score at least score_min, then greedily by falling score those that overlap no kept one by more than iou_max, then the top ones.

    group, rank (from 1), score and box columns; ties in score go by box. One group is one image's boxes.
    """
    rows = df.where(F.col(score) >= score_min)
    item = F.struct((-F.col(score)).alias("m"), *[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate(box)])
    at = lambda s: tuple(s[f"c{k}"] for k in range(4))
    full = lambda acc: F.lit(False) if top is None else F.size(acc) >= top
    kept = F.aggregate(
        F.array_sort(F.collect_list(item)),
        F.array().cast("array<struct<m:double,c0:double,c1:double,c2:double,c3:double>>"),
        lambda acc, s: F.when(full(acc) | F.exists(acc, lambda k: iou(at(k), at(s)) > iou_max), acc).otherwise(F.array_append(acc, s)),
    )
    out = rows.groupBy(*group).agg(kept.alias("_k")).select(*group, F.posexplode("_k").alias("rank", "_b"))
    out = out.select(*group, (F.col("rank") + 1).alias("rank"), (-F.col("_b.m")).alias("score"), *[F.col(f"_b.c{k}").alias(c) for k, c in enumerate(box)])
    return out if top is None else out.where(F.col("rank") <= top)


def _reach(iou_least: float) -> int:
    """Powers of two by which the sides of boxes can differ whose overlap is over iou_least."""
    return max(0, math.ceil(math.log2(1 / iou_least)))


def _wide(rows: DataFrame, corners: Sequence[str]) -> DataFrame:
    """Boxes with an extent."""
    x1, y1, x2, y2 = (F.col(c) for c in corners)
    return rows.where((x2 > x1) & (y2 > y1))


def _levels(rows: DataFrame, corners: Sequence[str]) -> tuple[list[int], list[int]]:
    """The levels of the boxes' widths and of their heights that there are: powers of two, so a few dozen."""
    x1, y1, x2, y2 = (F.col(c) for c in corners)
    own = lambda lo, hi: F.collect_set(F.floor(F.log2(hi - lo)).cast("int"))
    found = _wide(rows, corners).agg(own(x1, x2), own(y1, y2)).first()
    return sorted(found[0]), sorted(found[1])


def _placed(rows: DataFrame, corners: Sequence[str], reach: int, levels: tuple[list[int], list[int]]) -> DataFrame:
    """Boxes with an extent in the cells (_lx, _ly, _cx, _cy; _n of them a box) of the levels of their sides (_ox, _oy) and, up to `reach` above, of the given ones: boxes of like sides that overlap
    share one if each other's levels are given."""
    x1, y1, x2, y2 = (F.col(c) for c in corners)
    wide = _wide(rows, corners)

    def placed(axis: str, lo: Column, hi: Column, there: list[int]) -> Column:
        own = F.floor(F.log2(hi - lo)).cast("int")
        at = F.array_union(F.array(own), F.filter(F.array(*map(F.lit, there)).cast("array<int>"), lambda m: (m > own) & (m <= own + reach)))
        return F.flatten(F.transform(at, lambda m: F.transform(F.sequence(F.floor(lo / _side(m)), F.floor(hi / _side(m))), lambda c: F.struct(m.alias(f"_l{axis}"), c.alias(f"_c{axis}")))))

    for axis, lo, hi, there in (("x", x1, x2, levels[0]), ("y", y1, y2, levels[1])):
        wide = wide.withColumns({f"_o{axis}": F.floor(F.log2(hi - lo)).cast("int"), f"_{axis}": placed(axis, lo, hi, there)})
    wide = wide.withColumn("_n", F.size("_x") * F.size("_y"))
    wide = wide.select(*[c for c in wide.columns if c != "_x"], F.inline("_x"))
    return wide.select(*[c for c in wide.columns if c != "_y"], F.inline("_y"))


def _side(level: Column) -> Column:
    """The side of a level's cells: over that of its boxes."""
    return F.pow(F.lit(2.0), level + 1)


@own_run
def suppressed_in_rounds(df: DataFrame, group: Sequence[str], *, score: str = "score", box: Sequence[str] = ("x1", "y1", "x2", "y2"), score_min: float = 0.30, iou_max: float = 0.50, top: int | None = 20, heads_of_cell: int = 32) -> DataFrame:
    """What suppressed() gives, for images of any number of boxes: no image is one row or one task.

    Boxes that can overlap by more than iou_max have like sides, so each lies in the few cells of its sides' powers of two and of those up to 1 / iou_max as large that other boxes have. In a round each cell's best
    undecided boxes are its heads, heads_of_cell at most. A box that is a head of all its cells has all undecided boxes that could drop it beside it there, and is kept if none of the better ones overlaps it;
    what a kept box overlaps is dropped, and the others go on to the next round. Pairs are made of heads of one cell, and of kept heads with the boxes of their cells. iou_max must be
    above 0. Equal boxes of equal score are kept once. Boxes without an extent overlap nothing and are kept.
    """
    if not iou_max > 0:
        raise ValueError("iou_max must be above 0")
    spark, keys = df.sparkSession, list(group)
    c = [f"_{k}" for k in range(4)]
    rows = df.where(F.col(score) >= score_min).select(*keys, (-F.col(score)).alias("_m"), *[F.col(b).cast("double").alias(k) for b, k in zip(box, c)]).distinct()
    flat = rows.withColumn("_r", F.struct("_m", *c))
    extent = (F.col("_2") > F.col("_0")) & (F.col("_3") > F.col("_1"))
    cell = [*keys, "_lx", "_ly", "_cx", "_cy"]
    levels = _levels(df.where(F.col(score) >= score_min).select(*[F.col(b).cast("double").alias(k) for b, k in zip(box, c)]), c)
    left = written(_placed(flat, c, _reach(iou_max), levels).select(*cell, "_r", F.col("_n").alias("_cells")))
    kept = [flat.where(~extent).select(*keys, "_r")]
    at = lambda s: tuple(F.col(s)[k] for k in c)
    over = iou(at("_b"), at("_r")) > iou_max
    while not left.isEmpty():
        heads = left.withColumn("_n", F.row_number().over(Window.partitionBy(*cell).orderBy("_r"))).where(F.col("_n") <= heads_of_cell).drop("_n")
        heads = written(heads)
        whole = heads.groupBy(*keys, "_r", "_cells").agg(F.count(F.lit(1)).alias("_n")).where("_n = _cells").select(*keys, "_r")
        better = heads.select(*cell, F.col("_r").alias("_b"))
        blocked = heads.join(better, cell).where((F.col("_b") < F.col("_r")) & over).select(*keys, "_r")
        chosen = written(whole.join(blocked, [*keys, "_r"], "left_anti"))
        kept.append(chosen)
        near = left.join(heads.join(chosen, [*keys, "_r"], "left_semi").select(*cell, F.col("_r").alias("_b")), cell)
        gone = near.where((F.col("_r") == F.col("_b")) | over).select(*keys, "_r").distinct()
        left = written(left.join(gone, [*keys, "_r"], "left_anti"))
        discard(spark, keep=[left, *kept[1:]])
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("_r")))
    out = out if top is None else out.where(F.col("rank") <= top)
    return out.select(*keys, "rank", (-F.col("_r._m")).alias("score"), *[F.col("_r")[k].alias(b) for k, b in zip(c, box)])


def rescaled(dets: DataFrame, images: DataFrame, size: int, box: Sequence[str] = ("x1", "y1", "x2", "y2")) -> DataFrame:
    """Boxes from a size x size model frame to each image's own width and height."""
    out = dets.join(images.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h")), "image_id")
    for k, c in enumerate(box):
        out = out.withColumn(c, F.col(c) * (F.col("_w") if k % 2 == 0 else F.col("_h")) / size)
    return out.drop("_w", "_h")


def _candidates(d: DataFrame, t: DataFrame, keys: Sequence[str], corners: Sequence[str], least: float) -> DataFrame:
    """Pairs of a box of d and one of t (its columns with a _ in front) of one key that overlap by least or more, each once: they meet on the coarser of their levels, in the cell of their common corner."""
    reach = _reach(least)
    cell = [*keys, "_lx", "_ly", "_cx", "_cy"]
    own = ["_ox", "_oy"]
    right = _placed(t, corners, reach, _levels(d, corners)).drop("_n").withColumnsRenamed({c: f"_{c}" for c in [*t.columns, *own] if c not in keys})
    both = _placed(d, corners, reach, _levels(t, corners)).drop("_n").join(right, cell)
    x, y = corners[:2]
    once = (F.col("_lx") == F.greatest("_ox", "__ox")) & (F.col("_ly") == F.greatest("_oy", "__oy"))
    once = once & (F.floor(F.greatest(x, f"_{x}") / _side(F.col("_lx"))) == F.col("_cx")) & (F.floor(F.greatest(y, f"_{y}") / _side(F.col("_ly"))) == F.col("_cy"))
    return _overlapping(both.where(once), corners, least)


def _overlapping(both: DataFrame, corners: Sequence[str], least: float) -> DataFrame:
    over = iou(tuple(F.col(c) for c in corners), tuple(F.col(f"_{c}") for c in corners))
    return both.withColumn("over", over).where(F.col("over") >= least)


def _pairs(d: DataFrame, t: DataFrame, keys: Sequence[str], corners: Sequence[str], least: float) -> DataFrame:
    """_candidates() over cells in images of many boxes of t only; elsewhere the few boxes of an image meet all its detections, whose number is bounded."""
    slim = d.select(*keys, "det", *corners)
    named = lambda df: _wide(df, corners).select(*keys, *[F.col(c).alias(f"_{c}") for c in df.columns if c not in keys])
    many = written(t.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > FEW).select(*keys))
    cells = not many.isEmpty()
    few = t.join(many, keys, "left_anti") if cells else t
    found = _overlapping(_wide(slim, corners).join(named(few), keys), corners, least).select(*keys, "det", *[f"_{c}" for c in t.columns if c not in keys], "over")
    if not cells:
        return found
    large = [written(df.join(many, keys, "left_semi")) for df in (slim, t)]
    return found.unionByName(_candidates(*large, keys, corners, least).select(*found.columns))


def _graded(dets: DataFrame, truths: DataFrame, max_dets: int, ious: Sequence[float]) -> DataFrame:
    """category_id, score, hits (bit k: matched at the level ious[k]) and crowd (the part of it that lies in a crowd, null without crowds) for every detection: greedy matching by falling score within an image and category.

    An image's best max_dets detections of a category meet its boxes, where these are many in cells of like sides; of the boxes that one overlaps, its
    best max_dets are enough, as other detections take fewer. So what a task matches at a time is at most max_dets squared pairs, however many boxes an image has; detections without a pair never reach it.
    """
    if len(ious) > 62:
        raise ValueError("62 levels at most")
    keys, corners = ["image_id", "category_id"], ["x1", "y1", "x2", "y2"]
    place = Window.partitionBy(*keys).orderBy(F.desc("score"), *corners)
    doubles = [F.col(c).cast("double").alias(c) for c in corners]
    d = dets.select(*keys, *doubles, "score").withColumn("det", F.row_number().over(place)).where(F.col("det") <= max_dets)
    d = written(d)
    crowd = F.col("iscrowd").cast("int") if "iscrowd" in truths.columns else F.lit(0)
    t = written(truths.select(*keys, *doubles, F.coalesce(crowd, F.lit(0)).alias("crowd")).withColumn("id", F.monotonically_increasing_id()))
    # the last of equals is taken
    best = Window.partitionBy(*keys, "det").orderBy(F.desc("over"), *[F.desc(f"_{c}") for c in (*corners, "id")])
    pairs = _pairs(d, t.where("crowd = 0").drop("crowd"), keys, corners, min(ious)).withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= max_dets)
    pairs = pairs.select(*keys, "det", "nth", F.col("_id").alias("truth"), "over")
    in_crowd = None
    if "iscrowd" in truths.columns:
        # a crowd may be much larger than what lies in it: each meets the few detections of its image
        c = t.where("crowd = 1").select(*keys, *[F.col(k).alias(f"_{k}") for k in corners])
        inter = F.greatest(F.lit(0.0), F.least("x2", "_x2") - F.greatest("x1", "_x1")) * F.greatest(F.lit(0.0), F.least("y2", "_y2") - F.greatest("y1", "_y1"))
        area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
        in_crowd = d.join(c, keys).groupBy(*keys, "det").agg(F.max(F.when(area > 0, inter / area)).alias("crowd"))
    kind = dict(dets.dtypes)

    def greedy(det: np.ndarray, truth: np.ndarray, over: np.ndarray) -> list[tuple[int, int]]:
        """(detection, hits) of what is matched in one image and category; pairs by detection and falling overlap."""
        out: dict[int, int] = {}
        for bit, level in enumerate(ious):
            used: set[int] = set()
            done = -1
            for k, g, o in zip(det, truth, over):
                if k != done and o >= level and g not in used:
                    used.add(g)
                    done = k
                    out[k] = out.get(k, 0) | 1 << bit
        return list(out.items())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None

        def matched(pdf: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
            det, truth, over = pdf["det"].to_numpy(), pdf["truth"].to_numpy(), pdf["over"].to_numpy()
            image, category = pdf["image_id"].to_numpy(), pdf["category_id"].to_numpy()
            rows = [(image[p], category[p], *r) for p, q in zip(edges, edges[1:]) for r in greedy(det[p:q], truth[p:q], over[p:q])]
            return pd.DataFrame(rows, columns=[*keys, "det", "hits"])

        for pdf in frames:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            of = pdf[keys]
            edges = np.flatnonzero((of != of.shift()).any(axis=1).to_numpy())
            held = pdf.iloc[edges[-1] :].reset_index(drop=True)
            yield matched(pdf.iloc[: edges[-1]], edges)
        if held is not None:
            yield matched(held, np.array([0, len(held)]))

    # images are matched from sorted partitions: a call for each image costs more than its matching
    rows = pairs.repartition(*keys).sortWithinPartitions(*keys, "det", "nth")
    found = rows.mapInPandas(run, f"image_id {kind['image_id']}, category_id {kind['category_id']}, det int, hits long")
    out = d.join(found, [*keys, "det"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    out = out.join(in_crowd, [*keys, "det"], "left") if in_crowd is not None else out.withColumn("crowd", F.lit(None).cast("double"))
    return out.select("category_id", "score", "hits", "crowd")


def _level(k: int, iou_least: float) -> tuple[Column, Column]:
    """Whether a graded detection is matched at level k, and whether it counts there: one that matches only crowds is ignored."""
    hit = F.shiftright("hits", k).bitwiseAND(1) == 1
    return hit, hit | F.col("crowd").isNull() | (F.col("crowd") < iou_least)


def matches(dets: DataFrame, truths: DataFrame, *, max_dets: int = 100, ious: Sequence[float] = IOUS) -> DataFrame:
    """category_id, iou, score, tp for every detection: greedy matching by falling score within an image and category.

    truths may have iscrowd: a detection that matches only crowds is ignored.
    """
    at = [F.struct(F.lit(v).alias("iou"), "score", hit.cast("int").alias("tp"), counts.alias("counts")) for v, (hit, counts) in ((v, _level(k, v)) for k, v in enumerate(ious))]
    return _graded(dets, truths, max_dets, ious).select("category_id", F.inline(F.array(*at))).where("counts").drop("counts")


def average_precision(dets: DataFrame, truths: DataFrame, *, max_dets: int = 100, ious: Sequence[float] = IOUS) -> DataFrame:
    """category_id, iou, ap: precision at 101 recalls, each the best at that recall or more, averaged; 0 without a match."""
    found = _graded(dets, truths, max_dets, ious)
    real = truths.where("coalesce(iscrowd, 0) = 0") if "iscrowd" in truths.columns else truths
    n = real.groupBy("category_id").agg(F.count(F.lit(1)).alias("n"))
    # a row a score, not one for each of its levels, is shuffled
    sums = found.groupBy("category_id", "score").agg(*[F.count_if(v).alias(f"{n}{k}") for k, level in enumerate(ious) for n, v in zip("tc", _level(k, level))])
    at = [F.struct(F.lit(v).alias("iou"), "score", F.col(f"t{k}").alias("t"), F.col(f"c{k}").alias("c")) for k, v in enumerate(ious)]
    counts = sums.select("category_id", F.inline(F.array(*at))).where("c > 0")
    steps = running_sums(counts, ["category_id", "iou"], "score", ["t", "c"]).select("category_id", "iou", F.col("t_upto").alias("tp"), F.col("c_upto").alias("seen")).join(n, "category_id")
    curve = steps.select("category_id", "iou", (F.col("tp") / F.col("n")).alias("recall"), (F.col("tp") / F.col("seen")).alias("precision"))
    # each recall level from the one before this step up to it takes this step's precision if no later one is better
    level = curve.withColumn("k", F.floor(F.col("recall") * 100 + 1e-9).cast("int")).groupBy("category_id", "iou", "k").agg(F.max("precision").alias("p"))
    spread = level.select("category_id", "iou", F.explode(F.sequence(F.lit(0), "k")).alias("r"), "p").groupBy("category_id", "iou", "r").agg(F.max("p").alias("p"))
    ap = spread.groupBy("category_id", "iou").agg((F.sum("p") / 101).alias("ap"))
    all_ = n.select("category_id", F.explode(F.array(*map(F.lit, ious))).alias("iou"))
    return all_.join(ap, ["category_id", "iou"], "left").select("category_id", "iou", F.coalesce("ap", F.lit(0.0)).alias("ap"))


def summary(ap: DataFrame) -> DataFrame:
    """map over all IoUs and categories, map50."""
    return ap.agg(F.avg("ap").alias("map"), F.avg(F.when(F.col("iou") == 0.5, F.col("ap"))).alias("map50"))


def sanitised(images: DataFrame, annotations: DataFrame, listing: DataFrame, *, name: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Images whose file the listing has (by file name), and the annotations of those images."""
    names = listing.select((name if name is not None else F.col("file_name")).alias("file_name")).distinct()
    good = images.join(names, "file_name", "left_semi")
    return good, annotations.join(good.select(F.col("id").alias("image_id")), "image_id", "left_semi")


def split_documents(images: DataFrame, annotations: DataFrame, shares: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.1), ("test", 0.1))) -> tuple[DataFrame, DataFrame]:
    """Images with a split, and annotations with that of their image."""
    named = split_by_rank(images, F.col("id"), shares)
    return named, annotations.join(named.select(F.col("id").alias("image_id"), "split"), "image_id")


def with_targets(images: DataFrame, annotations: DataFrame, *, least: float = 1.0) -> DataFrame:
    """Images that have a box wider and higher than `least`."""
    good = annotations.where((F.col("bbox")[2] > least) & (F.col("bbox")[3] > least))
    return images.join(good.select(F.col("image_id").alias("id")), "id", "left_semi")


def to_coco(images: DataFrame, boxes: DataFrame, *, order: Sequence[str] = ("file_name",)) -> tuple[DataFrame, DataFrame]:
    """Images and annotations with ids from 1: images by order, annotations by image and then line. boxes: file_name, line, category_id, x, y, w, h, area."""
    ims = numbered(images, list(order), "id")
    anns = boxes.join(ims.select("file_name", F.col("id").alias("image_id")), "file_name")
    anns = numbered(anns, ["image_id", "line"], "id")
    return ims, anns.select("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "area", F.lit(0).alias("iscrowd"))
