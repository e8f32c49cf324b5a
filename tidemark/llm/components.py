"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _with_nearest(links: DataFrame, salts: int = 16) -> DataFrame:
    """links(u, v) with m, the smallest of u and its neighbours. A node with very many links is dealt over `salts` tasks, its own row being repeated for each; nodes grow with the table, so none are broadcast."""
    nearest = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    return links.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(nearest.hint("merge"), ["u", "s"]).drop("s")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for every node of links(a, b); nodes without links are absent.

    Large-star and small-star rounds in turn: each hangs a node's neighbours under the smallest of them, so the depth of every tree
    shrinks to one in a number of rounds that grows with the logarithm of the longest path. Every round is written to the shared folder.
    """
    star = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_nearest(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v")
        star = stored(small.distinct())
        now = star.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
