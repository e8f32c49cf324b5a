"""Exact quantiles of groups of any size by selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import written


def exact_quantiles(df: DataFrame, groups: Sequence[str], values: Sequence[str], levels: Sequence[float], *, accuracy: int = 10_000) -> DataFrame:
    """groups and, under each value's name, the array of its quantiles (linear between ranks) at the levels; null where a group has no value. NaN counts as no value.

    A sketch of each group brackets every level by values about 1 / accuracy of its ranks away on either side; one more pass counts what lies below and within each bracket, exactly, and the few values
    within, equal ones as one row, give the ranks asked for. A bracket that misses its ranks is widened and counted again. So no task merges a group's values: what is ranked in one is 4 / accuracy of a group.
    """
    columns = [F.struct(F.lit(k).alias("c"), F.when(~F.isnan(F.col(v).cast("double")), F.col(v).cast("double")).alias("v")) for k, v in enumerate(values)]
    rows = df.select(*groups, F.explode(F.array(*columns)).alias("_s")).select(*groups, "_s.c", "_s.v").where("v is not null")
    key, n_levels = [*groups, "c"], len(levels)
    found, margin = None, 2.0 / accuracy
    missing = None
    while True:
        ends = [x for q in levels for x in (max(0.0, q - margin), min(1.0, q + margin))]
        sketch = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("e"))
        at = F.array(*[F.struct(F.lit(k).alias("l"), F.floor((F.col("n") - 1) * F.lit(q)).alias("k"), ((F.col("n") - 1) * F.lit(q)).alias("at"), (F.lit(None).cast("double") if q - margin <= 0 else F.col("e")[2 * k]).alias("lo"), (F.lit(None).cast("double") if q + margin >= 1 else F.col("e")[2 * k + 1]).alias("hi")) for k, q in enumerate(levels)])
        brackets = sketch.select(*key, F.explode(at).alias("_t")).select(*key, "_t.*")
        if missing is not None:
            brackets = brackets.join(missing, [*key, "l"], "left_semi")
        brackets = written(brackets)
        wide = brackets.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("l", "lo", "hi"))).alias("_b"))  # at most a row a group and value, of n_levels brackets
        met = rows.join(wide, key)
        below = met.groupBy(*key).agg(*[F.sum(F.coalesce(F.col("v") < F.get("_b", F.lit(k))["lo"], F.lit(False)).cast("long")).alias(f"_{k}") for k in range(n_levels)], F.first("_b").alias("_b"))
        below = below.select(*key, F.explode(F.arrays_zip(F.transform("_b", lambda b: b["l"]).alias("l"), F.slice(F.array(*[f"_{k}" for k in range(n_levels)]), 1, F.size("_b")).alias("below"))).alias("_z")).select(*key, "_z.l", "_z.below")
        inside = F.filter("_b", lambda b: F.coalesce(F.col("v") >= b["lo"], F.lit(True)) & F.coalesce(F.col("v") <= b["hi"], F.lit(True)))
        within = met.select(*key, "v", F.explode(inside).alias("_i")).groupBy(*key, "_i.l", "v").agg(F.count(F.lit(1)).alias("m"))
        w = Window.partitionBy(*key, "l").orderBy("v")
        ranked = within.withColumn("upto", F.sum("m").over(w)).join(below.join(brackets, [*key, "l"]), [*key, "l"])
        rank = lambda r: F.min(F.when(F.col("below") + F.col("upto") > r, F.col("v")))
        first = F.max((F.col("below") <= F.col("k")).cast("int"))
        picked = ranked.groupBy(*key, "l").agg(F.first("k").alias("k"), F.first("at").alias("at"), rank(F.col("k")).alias("a"), rank(F.ceil("at")).alias("b"), first.alias("fine"))
        picked = written(picked)
        good = picked.where("fine = 1 and a is not null and b is not null")
        level = good.select(*key, "l", F.when(F.col("k") == F.col("at"), F.col("a")).otherwise((F.ceil("at") - F.col("at")) * F.col("a") + (F.col("at") - F.col("k")) * F.col("b")).alias("q"))
        found = level if found is None else found.unionByName(level)
        missing = brackets.join(good, [*key, "l"], "left_anti").select(*key, "l")
        if missing.isEmpty():
            break
        missing, margin = written(missing), margin * 16
    by_value = found.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "q"))), lambda s: s["q"]).alias("q"))
    out = by_value.groupBy(*groups).agg(*[F.first(F.when(F.col("c") == k, F.col("q")), ignorenulls=True).alias(v) for k, v in enumerate(values)])
    return out
