"""Nearest-in-time and lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nearest_day(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, value: str, max_days: int = 30, by: Sequence[str] = (), drop_misses: bool = False) -> DataFrame:
    """left with `value` of the right row whose day is nearest within max_days, and gap_days; ties go to the smaller value.

    Only the distinct days of left (within `by`) meet the right side, by an equi-join on day buckets of max_days + 1, each right day being
    in its own and both neighbouring buckets; the answers then join left on the day. So the shuffle follows the number of days, not of rows. Rows without
    a match, or without a time, have nulls (or go, with drop_misses).
    """
    keys, width = list(by), max_days + 1
    days = left.select(*keys, F.to_date(left_time).alias("_day")).where("_day is not null").distinct()
    days = days.withColumn("_bucket", F.floor(F.unix_date("_day") / width))
    side = right.select(*keys, F.to_date(right_time).alias("_rday"), F.col(value).alias("_value")).where("_rday is not null").distinct()
    side = side.withColumn("_bucket", F.explode(F.array(*[F.floor(F.unix_date("_rday") / width) + k for k in (-1, 0, 1)])))
    gap = F.abs(F.date_diff("_day", "_rday"))
    pairs = days.join(side, [*keys, "_bucket"]).where(gap <= max_days)
    best = pairs.groupBy(*keys, "_day").agg(F.min(F.struct(gap.alias("gap_days"), F.col("_value"))).alias("_best"))
    out = left.withColumn("_day", F.to_date(left_time)).join(best, [*keys, "_day"], "inner" if drop_misses else "left")
    return out.select(*left.columns, F.col("_best._value").alias(value), F.col("_best.gap_days").alias("gap_days"))


def last_of(df: DataFrame, key: str, position: str) -> DataFrame:
    """One row a key, the last by position: how a lookup table reads when later rows overwrite earlier ones.

    Of rows that share the last position the one with the greatest values wins, column by column, so a repeated run gives the same row.
    Null positions come first; columns must be orderable.
    """
    cols = [c for c in df.columns if c not in (key, position)]
    return df.groupBy(key).agg(F.max(F.struct(F.col(position).alias("_p"), *cols)).alias("_r")).select(key, *[F.col(f"_r.{c}") for c in cols])


def lookup(left: DataFrame, table: DataFrame, key: str, *, how: str = "left", keep_old: Sequence[str] = ()) -> DataFrame:
    """Equi-join with a table of one row a key. how='inner' drops rows without a match; columns in keep_old take the table's value where it has one."""
    renamed = table.select(key, *[F.col(c).alias(f"_new_{c}") if c in keep_old else F.col(c) for c in table.columns if c != key])
    out = left.join(renamed, key, how)
    for c in keep_old:
        old = F.col(c) if c in left.columns else F.lit(None)
        out = out.withColumn(c, F.coalesce(F.col(f"_new_{c}"), old)).drop(f"_new_{c}")
    return out


def nested(parents: DataFrame, children: DataFrame, key: str, child_key: str, fields: Sequence[str], name: str = "items", order: Sequence[str] = ()) -> DataFrame:
    """parents with an array of their children's fields, in order, empty where there are none."""
    item = F.struct(*[F.col(c) for c in (*order, *[f for f in fields if f not in order])])
    kids = children.groupBy(F.col(child_key).alias("_k")).agg(F.array_sort(F.collect_list(item)).alias(name))
    return parents.join(kids, parents[key] == kids["_k"], "left").drop("_k").withColumn(name, F.coalesce(name, F.array().cast(dict(kids.dtypes)[name])))


def first_existing(df: DataFrame, candidates: Sequence[Column], listing: DataFrame, path_col: str = "path") -> DataFrame:
    """resolved: the first candidate path that the listing has, null for none."""
    tried = df.withColumn("_row", F.monotonically_increasing_id()).select("*", F.posexplode(F.array(*candidates)).alias("_k", "_path"))
    hit = tried.join(listing.select(F.col(path_col).alias("_path")).distinct(), "_path", "left_semi")
    best = hit.groupBy(*df.columns).agg(F.min_by("_path", "_k").alias("resolved"))
    return df.join(best, list(df.columns), "left")
