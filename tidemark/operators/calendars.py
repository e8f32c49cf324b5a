"""Calendar generators and bin keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def months(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """d0, d1 (last day), tag (the 15th) of every month."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(f"{first_year}-01-01").cast("date"), F.lit(f"{last_year}-12-01").cast("date"), F.expr("interval 1 month"))).alias("d0"))
    return days.select("d0", F.last_day("d0").alias("d1"), F.date_add("d0", 14).alias("tag"))


def eight_day_bins(spark: SparkSession, first_year: int, last_year: int, days: int = 8) -> DataFrame:
    """year, bin, d0, d1: bins that start anew every 1 January, the last cut at 31 December (46 a year)."""
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    end = F.make_date("year", F.lit(12), F.lit(31))
    starts = years.select("year", F.posexplode(F.sequence(F.make_date("year", F.lit(1), F.lit(1)), end, F.expr(f"interval {days} day"))).alias("bin", "d0"))
    return starts.select("year", "bin", "d0", F.least(F.date_add("d0", days - 1), end).alias("d1"))


def year_bin(t: Column, days: int = 8) -> tuple[Column, Column]:
    """Year and number of the year-anchored bin of a time: a key for grouping and for streams."""
    return F.year(t), F.floor((F.dayofyear(t) - 1) / days).cast("int")


def running_windows(spark: SparkSession, start: str, end: str, days: int = 8) -> DataFrame:
    """k, d0, d1: windows from start on without a yearly restart, the last cut at end; reversed limits are swapped."""
    lo, hi = sorted([start, end])
    rows = spark.range(1).select(F.posexplode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.expr(f"interval {days} day"))).alias("k", "d0"))
    return rows.select("k", "d0", F.least(F.date_add("d0", days - 1), F.lit(hi).cast("date")).alias("d1"))


def file_names(bins: DataFrame, products: dict[str, tuple[str, str]], period: str, *, prefix: str = "AQUA_MODIS", resolution: str = "4km") -> DataFrame:
    """product, name for each bin (d0, d1) and product (suite, variable): prefix.yyyyMMdd_yyyyMMdd.L3m.period.suite.variable.resolution.nc."""
    table = bins.sparkSession.createDataFrame([(k, *v) for k, v in products.items()], "product string, suite string, variable string")
    day = lambda c: F.date_format(c, "yyyyMMdd")
    name = F.concat(F.lit(prefix + "."), day("d0"), F.lit("_"), day("d1"), F.lit(f".L3m.{period}."), "suite", F.lit("."), "variable", F.lit(f".{resolution}.nc"))
    return bins.crossJoin(F.broadcast(table)).select("product", "d0", "d1", name.alias("name"))  # products: a handful


def per_window(items: DataFrame, windows: DataFrame, *, time: str, id_col: str, cost: str, per: int = 1, limit: int | None = None) -> DataFrame:
    """The `per` cheapest items of each window (null cost last), each item in its first window only, `limit` at most in window order.

    Windows (k, d0, d1) do not overlap, so the window of an item follows from its day by an equi-join on the days of the windows.
    """
    from pyspark.sql import Window

    days = windows.select("k", F.explode(F.sequence("d0", "d1", F.expr("interval 1 day"))).alias("_day"))
    placed = items.withColumn("_day", F.to_date(time)).join(days, "_day").drop("_day")
    first = Window.partitionBy(id_col).orderBy("k")
    placed = placed.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    order = Window.partitionBy("k").orderBy(F.col(cost).asc_nulls_last(), id_col)
    out = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per)
    return out if limit is None else out.orderBy("k", "rank").limit(limit)


def grid_starts(images: DataFrame, size: int, stride: int, scales: Sequence[float] = (1.0,)) -> DataFrame:
    """images (height, width, ...) with scale, row, col, side of a chip grid over each at several scales; side is size * scale rounded half to even, and an image smaller than it has one chip at its corner."""
    out = images.select("*", F.explode(F.array(*[F.struct(F.lit(float(s)).alias("scale"), F.lit(round(size * s)).alias("side")) for s in scales])).alias("_s")).select(*images.columns, "_s.*")
    starts = lambda c: F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col(c) - F.col("side")), F.lit(stride)))
    return out.withColumn("row", starts("height")).withColumn("col", starts("width"))
