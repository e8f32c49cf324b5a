"""The named queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import asof, calendars, labels
from tidemark.plans import coast, files, flows, roundtrips, rows, shapes, values  # noqa: F401  they register their queries
from tidemark.plans.base import ORACLES, QUERIES, Query, table


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as chips: the nearest 8-day composite, and the season's quantile label, counted by season."""
    o = table(spark, sf_dir, "orders")
    bins = calendars.eight_day_bins(spark, 1995, 2001).select(F.col("d0").alias("mid"), F.date_format("d0", "yyyyMMdd").alias("path"))
    chips = asof.nearest_day(o, bins, left_time="o_orderdate", right_time="mid", value="path", max_days=30)
    chips = labels.time_fields(chips.withColumn("chlor_a", F.col("o_totalprice") / 1e5), "o_orderdate")
    labelled = labels.quantile_labels(chips, flh=None, kd=None, group="season")
    return labelled.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("hab_label").alias("positives"), F.count_distinct("path").alias("composites"))
