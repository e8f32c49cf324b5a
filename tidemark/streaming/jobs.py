"""Structured Streaming: alerts, enrichment of arriving files, year-anchored windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from tidemark.operators.calendars import year_bin


def alerts(stream: DataFrame, score: Column, threshold: float = 2.0) -> DataFrame:
    """Rows with pred and alert (pred >= threshold): stateless, so it works on batches and streams alike."""
    return stream.withColumn("pred", score).withColumn("alert", F.coalesce(F.col("pred") >= threshold, F.lit(False)))


def year_windows(stream: DataFrame, time: str, value: str, *, days: int = 8, late: str = "8 days") -> DataFrame:
    """year, bin, n and total by year-anchored bins. Streams keep a bin's state until the watermark has passed its day windows."""
    year, k = year_bin(F.col(time), days)
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    base = stream.withWatermark(time, late) if stream.isStreaming else stream
    return base.groupBy(F.window(time, "1 day").alias("day"), year.alias("year"), k.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def arrivals(spark: SparkSession, path: str, schema: StructType | str, *, fmt: str = "parquet", archive: str | None = None, remove: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the files that land in a folder, of which those of a finished batch are moved to the archive folder, or removed.

    A file goes once the batch after its own begins, when its own is on record as done: the files of a batch that failed, and of the last one so far, stay, and the run that follows
    takes them up again or away. So nothing is lost between a result and its record.
    """
    reader = spark.readStream.schema(schema).format(fmt)
    if archive is not None:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    elif remove:
        reader = reader.option("cleanSource", "delete")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def enrich_arrivals(stream: DataFrame, enrich: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Each batch of arrivals enriched and written under its batch number: a batch that runs again replaces its own rows and no others."""

    def write(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def latest(windows: DataFrame, out: str, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Runs a stream of aggregates in update mode to the end of what is there, each batch's updates written under its number, and gives the last update of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    windows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    found = windows.sparkSession.read.parquet(out)
    rest = [c for c in windows.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r"))
    return last.select(*keys, "_r.*")


def plateau_states(stream: DataFrame, key: str, order: str, value: str, *, patience: int = 3, factor: float = 0.5) -> DataFrame:
    """key, order, value and lr_scale for every row of a stream: each key's best, rows without a new best, and rate are state that goes from batch to batch.

    Rows of a batch are taken by order; a row that comes in a later batch counts as later. The rate is multiplied by factor after more than patience rows
    without a new best.
    """
    kinds = dict(stream.dtypes)
    schema = f"{key} {kinds[key]}, {order} {kinds[order]}, {value} double, lr_scale double"

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, bad, scale = state.get if state.exists else (float("inf"), 0, 1.0)
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order, kind="stable")
        out = []
        for at, v in zip(rows[order], rows[value]):
            better = v < best
            best, bad = (v, 0) if better else (best, bad + 1)
            if bad > patience:
                scale, bad = scale * factor, 0
            out.append((name[0], at, float(v), scale))
        state.update((float(best), int(bad), float(scale)))
        yield pd.DataFrame(out, columns=[key, order, value, "lr_scale"])

    return stream.groupBy(key).applyInPandasWithState(step, schema, "best double, bad long, scale double", "append", GroupStateTimeout.NoTimeout)
