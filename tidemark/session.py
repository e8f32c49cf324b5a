"""Session factory, and tables written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from typing import ParamSpec, TypeVar

from pyspark.sql import DataFrame, SparkSession

P, R = ParamSpec("P"), TypeVar("R")
#: Places that the run in this thread's context has written and discard() has not deleted, in order; outside of run(), one list for the process.
_WRITTEN: ContextVar[list[str]] = ContextVar("tidemark_written", default=[])  # noqa: B039  the process's list


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.ui.enabled": "false"}
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder on one machine (local mode), and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which discard() deletes like a written table."""
    path = f"{shared_folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    _WRITTEN.get().append(path)
    return path


#: Whether the shuffles of an execution are deleted when it ends; else they lie on the executors' disks until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffles of what is executed here are deleted at its end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame) -> DataFrame:
    """Write df once into the shared folder and read it back: one evaluation for all readers, no lineage, and safe from lost executors. Nobody reads the write's shuffles again, so they go with it."""
    path = folder(df.sparkSession, "table")
    with _cleaned(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def run() -> Iterator[None]:
    """A run of its own: within it, mark() and discard() see only what it writes, whatever other threads or the caller write. What it leaves is the caller's to discard."""
    own: list[str] = []
    outer = _WRITTEN.get()
    token = _WRITTEN.set(own)
    try:
        yield
    finally:
        _WRITTEN.reset(token)
        outer.extend(own)


def own_run(fn: Callable[P, R]) -> Callable[P, R]:
    """fn as a run of its own."""

    @wraps(fn)
    def inner(*args: P.args, **kwargs: P.kwargs) -> R:
        with run():
            return fn(*args, **kwargs)

    return inner


def mark() -> int:
    """A point in the run for discard()."""
    return len(_WRITTEN.get())


def discard(spark: SparkSession, since: int = 0, keep: Sequence[DataFrame] = ()) -> None:
    """Delete what the run wrote after `since`, but for what the frames in keep are read from.

    Frames that were planned on a deleted table can no longer be computed, so call this once the results that need them are written.
    """
    files = [f for df in keep for f in df.inputFiles()]
    made = _WRITTEN.get()
    gone = [p for p in made[since:] if not any(f"/{p.rsplit('/', 1)[-1]}/" in f for f in files)]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in gone:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)
        made.remove(p)
