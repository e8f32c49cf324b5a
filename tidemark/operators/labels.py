"""Group-adaptive quantile labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import season
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import written

GROUPS = {"none": (), "season": ("season",), "year": ("year",), "year_season": ("year", "season")}


def levels(start: float = 0.95, floor: float = 0.80, step: float = 0.02) -> list[float]:
    """Quantile levels by repeated subtraction, as floats give them: the floor itself is not reached."""
    out = []
    while start >= floor:
        out.append(start)
        start -= step
    return out


def time_fields(df: DataFrame, time: str = "datetime") -> DataFrame:
    """year, month and season of a time; null where it is null."""
    t = F.col(time).cast("timestamp")
    return df.withColumns({"year": F.year(t), "month": F.month(t)}).withColumn("season", season(F.col("month")))


def quantile_labels(df: DataFrame, *, flh: str | None = "flh", chlor: str | None = "chlor_a", kd: str | None = "kd490", group: str = "season", q: float = 0.95, q_floor: float = 0.80, kd_floor: float = 0.12, flh_absolute: float = 0.002, chlor_absolute: float = 3.0, name: str = "hab_label") -> DataFrame:
    """df with a 0/1 label: values at or over the highest quantile level that gives its group any positive, else over absolute thresholds.

    A row is positive at a level if flh or chlor reaches its group's exact quantile, and kd is at least kd_floor where the group has any kd. NaN counts as missing. Rows with
    a null group key have a null label. All levels are selected without merging a group's values, and the rows join the few groups' results, so no group is one task.
    """
    there = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) if c and c in df.columns else F.lit(None).cast("double")
    if not any(c and c in df.columns for c in (flh, chlor)):
        raise ValueError("neither flh nor chlor is there")
    keys, ls = list(GROUPS[group]), levels(q, q_floor)
    rows = df.withColumns({"_f": there(flh), "_c": there(chlor), "_k": there(kd)})
    on = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_g{i}") for i, k in enumerate(keys)] or [F.lit("").alias("_g0")]
    g = [f"_g{i}" for i in range(len(on))]
    rows = rows.select("*", *on)
    at = exact_quantiles(rows, g, ["_f", "_c"], ls).select(*g, F.col("_f").alias("_tf"), F.col("_c").alias("_tc"))
    stats = written(rows.groupBy(*g).agg(F.count("_k").alias("_nk")).join(at, g, "left"))
    rows = rows.join(F.broadcast(stats), g)  # one row a year or season
    fine = (F.col("_nk") == 0) | F.coalesce(F.col("_k") >= kd_floor, F.lit(False))

    def hit(f: Column, c: Column) -> Column:
        return (F.coalesce(F.col("_f") >= f, F.lit(False)) | F.coalesce(F.col("_c") >= c, F.lit(False))) & fine

    hits = [hit(F.col("_tf")[i], F.col("_tc")[i]) for i in range(len(ls))]
    rows = rows.withColumn("_hits", F.array(*hits)).withColumn("_absolute", hit(F.lit(flh_absolute), F.lit(chlor_absolute)))
    some = rows.groupBy(*g).agg(*[F.max(F.col("_hits")[i]).alias(f"_s{i}") for i in range(len(ls))])
    first = F.lit(None).cast("int")
    for i in reversed(range(len(ls))):
        first = F.when(F.col(f"_s{i}"), F.lit(i)).otherwise(first)
    rows = rows.join(F.broadcast(some.select(*g, first.alias("_level"))), g)
    label = F.when(F.col("_level").isNotNull(), F.col("_hits")[F.col("_level")]).otherwise(F.col("_absolute")).cast("int")
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return rows.withColumn(name, F.when(known, label)).select(*df.columns, name)
