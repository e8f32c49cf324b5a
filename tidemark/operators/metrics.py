"""Evaluation: regression, classification, segmentation, histograms and training curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.parse import finite
from tidemark.session import written


def regression(df: DataFrame, truth: str, pred: str, *keys: str) -> DataFrame:
    """n, rmse, mae, r2, mse. The r2 denominator has 1e-12 a row added, as the sum of squares does elementwise."""
    e, t = F.col(pred) - F.col(truth), F.col(truth)
    sums = df.where(F.col(truth).isNotNull() & F.col(pred).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_se"), F.sum(F.abs(e)).alias("_ae"), F.var_pop(t).alias("_v"))
    n = F.col("n")
    return sums.select(*keys, "n", F.sqrt(F.col("_se") / n).alias("rmse"), (F.col("_ae") / n).alias("mae"), (1 - F.col("_se") / (F.col("_v") * n + n * 1e-12)).alias("r2"), (F.col("_se") / n).alias("mse"))


def target_stats(df: DataFrame, target: str, *, log: bool = True, eps: float = 1e-8) -> DataFrame:
    """mu and sigma (population, plus eps) of the target or of log1p of it."""
    x = F.log1p(target) if log else F.col(target)
    return df.agg(F.avg(x).alias("mu"), (F.stddev_pop(x) + eps).alias("sigma"))


def mean_of_batches(df: DataFrame, batch: str, value: str) -> DataFrame:
    """Mean over batches of their sums, each batch weighing the same."""
    return df.groupBy(batch).agg(F.sum(value).alias("_s")).agg(F.avg("_s").alias("mean_loss"))


def histogram(df: DataFrame, value: str, bins: int = 30) -> DataFrame:
    """bin (from 0), lo, hi, n of equal-width bins over the finite values' range, the last closed; bins without rows are left out."""
    x = df.where(finite(F.col(value))).select(F.col(value).cast("double").alias("x"))
    limits = x.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(1.0)
    k = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("a")) / width)).cast("int")
    placed = x.crossJoin(F.broadcast(limits)).select(k.alias("bin"), "a", width.alias("w"))  # limits: one row
    return placed.groupBy("bin", "a", "w").agg(F.count(F.lit(1)).alias("n")).select("bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"), "n")


def hex_bins(df: DataFrame, x: str, y: str, size: float, *, min_count: int = 1, log: bool = False) -> DataFrame:
    """q, r, n of pointy-top hexagons of the given size with at least min_count points; log takes the logarithm of both, positive ones only."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(finite(F.col(x)) & finite(F.col(y)))
    if log:
        rows, a, b = rows.where((F.col(x) > 0) & (F.col(y) > 0)), F.log10(a), F.log10(b)
    q, r = (a * (3**0.5) / 3 - b / 3) / size, b * 2 / 3 / size
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return rows.select(cq.cast("long").alias("q"), cr.cast("long").alias("r")).groupBy("q", "r").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def running_best(df: DataFrame, order: str, value: str, *keys: str) -> DataFrame:
    """best so far, and whether the row is a new one (strictly smaller).

    Without keys the table is range-partitioned by order and written with its partition; each partition's rows also see the least value of the
    partitions before, one row a partition.
    """
    v, earlier = F.col(value), F.lit(None)
    rows, groups = df, list(keys)
    if not groups:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows, groups = written(df.repartitionByRange(parts, order).withColumn("_p", F.spark_partition_id())), ["_p"]
        before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
        least = rows.groupBy("_p").agg(F.min(value).alias("_l")).select("_p", F.min("_l").over(before).alias("_l"))
        rows, earlier = rows.join(F.broadcast(least), "_p"), F.col("_l")
    w = Window.partitionBy(*groups).orderBy(order)
    least_of = lambda x: F.least(x, earlier) if not keys else x
    before = least_of(F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    best = least_of(F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*df.columns, best.alias("best"), F.coalesce(v < before, v.isNotNull()).alias("is_new"))


def best_row(df: DataFrame, preferred: Sequence[str], order: str, *keys: str) -> DataFrame:
    """For each group the row of the largest first preferred column that has any value, of equals the first; else the last row."""
    row = F.struct(*df.columns)
    picks = [F.max_by(row, F.struct(F.col(c), -F.col(order))) for c in preferred]
    some = [F.max(c) for c in preferred]
    out = F.max_by(row, order)
    for pick, any_ in reversed(list(zip(picks, some))):
        out = F.when(any_.isNotNull(), pick).otherwise(out)
    rows = df.withColumns({c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c)) for c in preferred})
    return rows.groupBy(*keys).agg(out.alias("_r")).select("_r.*")


def plateau(df: DataFrame, order: str, value: str, *keys: str, patience: int = 3, factor: float = 0.5) -> DataFrame:
    """df's groups with an array of (o, v, lr_scale): the rate is multiplied by factor after more than patience rows without a new best.

    Between two new bests there is a cut at every (patience + 1)th row, so the cuts so far are sums over windows; no array is copied row by row. NaN and null are never a best.
    """
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = df.select(*keys, F.col(order).cast("double").alias("o"), F.col(value).cast("double").alias("v"), v.alias("_v"))
    w = Window.partitionBy(*keys).orderBy("o")
    before = F.min("_v").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("_v") < before, F.col("_v").isNotNull()).cast("int"))
    rows = rows.withColumn("_at", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy("o")) - F.when(F.col("_at") > 0, 1).otherwise(0)
    rows = rows.withColumn("_cut", ((since > 0) & (since % (patience + 1) == 0)).cast("int"))
    scale = F.pow(F.lit(factor), F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("lr_scale", scale).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("o", "v", "lr_scale"))).alias("curve"))


def overlap(df: DataFrame, pred: str, truth: str, sample: str, channel: str, eps: float = 1e-6) -> DataFrame:
    """mean_iou and mean_dice over samples and channels of soft masks."""
    p, t = F.col(pred), F.col(truth)
    per = df.groupBy(sample, channel).agg(F.sum(p * t).alias("_i"), F.sum(p).alias("_p"), F.sum(t).alias("_t"))
    iou = (F.col("_i") + eps) / (F.col("_p") + F.col("_t") - F.col("_i") + eps)
    dice = (2 * F.col("_i") + eps) / (F.col("_p") + F.col("_t") + eps)
    return per.agg(F.avg(iou).alias("mean_iou"), F.avg(dice).alias("mean_dice"))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str]) -> DataFrame:
    """df with the sums so far of some columns by falling order within each key, and any key may hold most rows.

    The rows are range-partitioned by key and order and written with their partition, once, so that both readers see the same ranges; a running sum within each partition and
    the totals of those before it, one row a key and partition, give the sums. Rows of a key that are equal in order must not be there twice.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = written(df.repartitionByRange(parts, *keys, F.desc(order)).withColumn("_k", F.spark_partition_id()))
    w = Window.partitionBy(*keys, "_k").orderBy(F.desc(order))
    earlier = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    totals = spread.groupBy(*keys, "_k").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    totals = totals.select(*keys, "_k", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    out = spread.withColumns({f"{c}_upto": F.sum(c).over(w) for c in sums}).join(totals, [*keys, "_k"])
    return out.select(*df.columns, *[(F.col(f"{c}_upto") + F.col(f"_{c}")).alias(f"{c}_upto") for c in sums])


def _by_score(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row a distinct score, descending, with true and false positives so far."""
    counts = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum(1 - F.col(label).cast("long")).alias("n"))
    return running_sums(counts, [], "s", ["p", "n"]).select("s", "p", "n", F.col("p_upto").alias("tp"), F.col("n_upto").alias("fp"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """auroc (ties count half) and auprc (steps: the sum of recall gains times precision)."""
    steps = _by_score(df, score, label)
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    sums = steps.agg(area.alias("a"), ap.alias("b"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return sums.select((F.col("a") / (F.col("p") * F.col("n"))).alias("auroc"), (F.col("b") / F.col("p")).alias("auprc"))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """label, precision, recall, f1, support for each class of the labels."""
    pairs = df.groupBy(F.col(label).alias("t"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    truth = pairs.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    said = pairs.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    both = truth.join(said, "label", "left").withColumn("said", F.coalesce("said", F.lit(0)))
    precision = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(0.0)
    recall = F.col("tp") / F.col("support")
    return both.select("label", precision.alias("precision"), recall.alias("recall"), F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"), "support")


def status_counts(df: DataFrame, status: str, kinds: dict[str, Sequence]) -> DataFrame:
    """One row with the number of rows whose status is of each kind."""
    return df.agg(*[F.count_if(F.col(status).isin(*v)).alias(k) for k, v in kinds.items()])
