"""Sequence numbers, splits, top-k and sampling by hash order."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


def numbered(df: DataFrame, order: Sequence[str], name: str = "id", start: int = 1) -> DataFrame:
    """Consecutive numbers over the whole table in the given order, without sorting it in one task.

    Rows are range-partitioned by the order (ties by a hash of the row, so a value that many rows share is spread), sorted there and numbered within
    their partition. That is written once: a second evaluation could draw other ranges. The counts of what was written, one row a partition, give each
    partition's first number.
    """
    tie = F.xxhash64(*df.columns)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.withColumn("_t", tie).repartitionByRange(parts, *order, "_t").sortWithinPartitions(*order, "_t").drop("_t")
    local = written(placed.withColumn("_i", F.monotonically_increasing_id()))  # the partition's number above 33 bits of place
    place = local.withColumns({"_p": F.shiftrightunsigned("_i", 33), "_n": F.col("_i").bitwiseAND((1 << 33) - 1)})
    counts = place.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    out = place.join(F.broadcast(before), "_p")  # one row a partition
    return out.select(*df.columns, (F.col("_b") + F.col("_n") + start).alias(name))


def numbered_in(df: DataFrame, group: str, order: Sequence[str], name: str = "k") -> DataFrame:
    """Numbers from 0 within each group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def share_of(n: Column, share: float) -> Column:
    """floor(share * n) with the share as it is written: in doubles, 0.7 of 90,000 is less than 63,000."""
    return F.floor(n * F.lit(Decimal(str(share))))


def split_by_rank(df: DataFrame, key: Column, shares: Sequence[tuple[str, float]] = (("train", 0.70), ("val", 0.15), ("test", 0.15)), seed: str = "42", name: str = "split") -> DataFrame:
    """Names a split for each row by its rank in hash order: floor(share * n) rows for all but the last, which takes the rest."""
    ranked = numbered(df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))), ["_h"], "_rank")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    out, used = F.lit(shares[-1][0]), F.lit(0)
    marks = []
    for label, share in shares[:-1]:
        used = used + share_of(F.col("_n"), share)
        marks.append((label, used))
    for label, mark in reversed(marks):
        out = F.when(F.col("_rank") <= mark, F.lit(label)).otherwise(out)
    return ranked.crossJoin(F.broadcast(total)).withColumn(name, out).drop("_h", "_rank", "_n")  # total: one row


def stratified(df: DataFrame, label: str, key: Column, share: float = 0.75, seed: str = "42", name: str = "split") -> DataFrame:
    """train or test, with floor(share * n) of each class in train.

    Ranks within a class are global numbers by class and hash, less those of the classes before: a class may be any part of the table.
    """
    ranked = numbered(df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.lit(":"), key.cast("string")))), [label, "_h"], "_rank")
    sizes = ranked.groupBy(F.col(label).alias("_l")).agg(F.min("_rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
    out = ranked.join(sizes, ranked[label].eqNullSafe(sizes["_l"]))
    named = F.when(F.col("_rank") - F.col("_first") < share_of(F.col("_n"), share), "train").otherwise("test")
    return out.select(*df.columns, named.alias(name))


def positional_split(df: DataFrame, order: Sequence[str], share: float = 0.8, name: str = "split") -> DataFrame:
    ranked = numbered(df, order, "_rank")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    return ranked.crossJoin(F.broadcast(total)).withColumn(name, F.when(F.col("_rank") <= share_of(F.col("_n"), share), "train").otherwise("val")).drop("_rank", "_n")


def top_k(df: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def best_worst_rest(df: DataFrame, value: str, key: str, k: int, seed: str = "42") -> DataFrame:
    """group (best, worst, random): the max(1, k // 3) rows of smallest and of largest value, and as many of the others by hash order."""
    third = max(1, k // 3)
    best = df.orderBy(value, key).limit(third)
    worst = df.orderBy(F.desc(value), key).limit(third)
    chosen = best.unionByName(worst).select(key).distinct()
    rest = df.join(chosen, key, "left_anti").orderBy(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))).limit(third)
    return best.withColumn("group", F.lit("best")).unionByName(worst.withColumn("group", F.lit("worst"))).unionByName(rest.withColumn("group", F.lit("random")))
