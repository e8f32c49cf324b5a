"""What several operators of this subpackage need."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import written

#: Rows and bytes that a task works on at a time: long texts make Arrow's usual batches too large for a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: cuts the lineage and survives lost executors. discard() of the session module deletes it."""
    return written(df)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most BATCH_ROWS rows and about BATCH_BYTES, whatever the session's limits are."""
    for b in batches:
        rows = max(1, min(BATCH_ROWS, int(b.num_rows * BATCH_BYTES / max(1, b.nbytes))))
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over parts() of the batches; fn is not called for a partition without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = parts(batches)
        for first in pieces:
            yield from fn(chain([first], pieces))

    return df.mapInArrow(run, schema)


def salted(df: DataFrame, key: str, table: DataFrame, by: str | Column, *, counts: DataFrame | None = None, rows: int = 100_000, how: str = "left", merge: bool = False) -> DataFrame:
    """df joined with table (one row a key) where some keys may hold a great part of df's rows.

    The rows of a key with more than `rows` rows are dealt over as many salts as that takes, by a hash of the column `by` (so a task that runs again deals them
    alike), and the table's row for it is repeated for each. counts: key and n, the rows of df by key, if known already. merge: the table grows with df, so it is not to be broadcast. Rows of a null key match nothing.
    """
    if counts is None:
        counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    hot = stored(counts.where(F.col("n") > rows).select(key, F.ceil(F.col("n") / rows).cast("int").alias("_salts")))
    if hot.isEmpty():
        return df.join(table.hint("merge") if merge else table, key, how)
    hot = F.broadcast(hot)  # at most df's rows over `rows`: a thousand for a hundred million
    salts = F.coalesce("_salts", F.lit(1))
    dealt = df.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("_salts")
    spread = table.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(spread.hint("merge") if merge else spread, [key, "_salt"], how).drop("_salt")


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def tokenizer_path(name: str) -> str:
    """Place of an installed public vocabulary file; TIDEMARK_TOKENIZERS overrides the folder."""
    if folder := os.environ.get("TIDEMARK_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
