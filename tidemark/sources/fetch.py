"""Acquisition at the edge: which files to fetch, and fetching them on the driver."""

from __future__ import annotations

import bz2
import gzip
import time
import urllib.error
import urllib.request
import zlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OK, NOT_MODIFIED = 0, 304
#: First bytes of packed files, by suffix, and what unpacks them. Fixed values.
PACKED = {"gz": (b"\x1f\x8b", gzip.decompress), "bz2": (b"BZh", bz2.decompress)}


def needed(remote: DataFrame, local: DataFrame, *, force: bool = False) -> DataFrame:
    """Remote files (name, modified, ...) that are not here, are empty here, or are newer there than here."""
    if force:
        return remote
    here = local.where("length > 0").select("name", F.col("modified").alias("_m"))
    out = remote.join(here, "name", "left")
    return out.where(F.col("_m").isNull() | (F.col("modified") > F.col("_m"))).drop("_m")


def checked(files: DataFrame, sums: DataFrame) -> DataFrame:
    """path, ok: whether the SHA-1 of a file's content is the one listed (path, sha1)."""
    return files.join(sums, "path").select("path", (F.sha1("content") == F.lower("sha1")).alias("ok"))


def unpacked(files: DataFrame) -> DataFrame:
    """path without its suffix of packing, content and packed (gz, bz2 or null) of files (path, content), by what their contents begin with; a broken one keeps its row with null content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, value in zip(b.column(0).to_pylist(), b.column(1)):  # one at a time, as they may be large
                content = value.as_py()
                kind = next((k for k, (magic, _) in PACKED.items() if (content or b"").startswith(magic)), None)
                if kind:
                    path = path.removesuffix(f".{kind}")
                    try:
                        content = PACKED[kind][1](content)
                    except (OSError, EOFError, zlib.error):
                        content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary()), pa.array([kind], pa.string())], names=["path", "content", "packed"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary, packed string")


def failures(results: DataFrame) -> DataFrame:
    """Results (name, status) that are neither done nor unchanged."""
    return results.where(~F.col("status").isin(OK, NOT_MODIFIED))


def get(url: str, out: str | Path, *, tries: int = 3, wait: float = 2.0, token: str | None = None, timeout: float = 60) -> int:
    """Fetch into a file, unless it is here and unchanged: 0, 304, or the last error's status. A page of HTML where data was asked for counts as 401.

    Written beside and moved, so a failure leaves no part of a file; waits grow by `wait` from try to try.
    """
    out = Path(out)
    request = urllib.request.Request(url)
    if token:
        request.add_header("Authorization", f"Bearer {token}")
    if out.exists() and out.stat().st_size:
        request.add_header("If-Modified-Since", time.strftime("%a, %d %b %Y %H:%M:%S GMT", time.gmtime(out.stat().st_mtime)))
    status = -1
    for k in range(tries):
        try:
            with urllib.request.urlopen(request, timeout=timeout) as r:
                body = r.read()
                if "html" in r.headers.get("Content-Type", "") or body[:64].lstrip().lower().startswith((b"<!doctype html", b"<html")):
                    return 401
                part = out.with_name(out.name + ".part")
                part.write_bytes(body)
                part.replace(out)
                return OK
        except urllib.error.HTTPError as e:
            status = e.code
            if status == NOT_MODIFIED:
                return NOT_MODIFIED
        except (urllib.error.URLError, TimeoutError, ConnectionError):
            status = -1
        if k < tries - 1:
            time.sleep(wait * (k + 1))
    return status
