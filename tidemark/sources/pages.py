"""A paged catalogue: JSON pages with a manifest of what each holds, and a source that reads only the pages a search needs."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from tidemark.sources.store import listed, located, registered, write_files

#: Columns that a page's manifest line has the least and the largest value of.
RANGES = ("datetime", "cloudcov", "xmin", "ymin", "xmax", "ymax")
ITEM = "id string, datetime timestamp, collection string, cloudcov double, xmin double, ymin double, xmax double, ymax double, href string"
NAMES = [c.split()[0] for c in ITEM.split(", ")]


def _plain(v):
    """A value as JSON has it: times are microseconds."""
    return int(pd.Timestamp(v).value // 1000) if isinstance(v, (datetime, pd.Timestamp)) else v


def _stored(items: DataFrame, page_items: int) -> DataFrame:
    """name, content of pages and of one manifest for each partition; items are in the pages' order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines, held, part = [], [], 0

        def page() -> tuple[str, bytes]:
            rows = [{c: None if pd.isna(v) else _plain(v) for c, v in zip(NAMES, r)} for r in pd.concat(held)[NAMES].itertuples(index=False)]
            held.clear()
            ranges = {c: [f(v) for f in (min, max)] if (v := [r[c] for r in rows if r[c] is not None]) else None for c in RANGES}
            name = f"page-{part:06d}-{len(lines):06d}.json"
            lines.append(json.dumps({"page": name, "items": len(rows), "collections": sorted({r["collection"] for r in rows if r["collection"]}), **ranges}))
            return name, "\n".join(map(json.dumps, rows)).encode()

        files = lambda rows: pd.DataFrame(rows, columns=["name", "content"])
        for pdf in frames:
            full = []
            while len(pdf):
                part = int(pdf["_part"].iloc[0])
                held.append(pdf.iloc[: page_items - sum(map(len, held))])
                pdf = pdf.iloc[len(held[-1]) :]
                if sum(map(len, held)) == page_items:
                    full.append(page())
            yield files(full)
        if held:
            yield files([page()])
        if lines:
            yield files([(f"manifest-{part:06d}.jsonl", "\n".join(lines).encode())])

    return items.select(*NAMES).withColumn("_part", F.spark_partition_id()).mapInPandas(run, "name string, content binary")


def write_pages(items: DataFrame, path: str, *, page_items: int = 1000, partitions: int | None = None) -> None:
    """Write items (the columns of ITEM) as pages of about page_items, collection by collection and in order of time, each partition with a manifest of its pages.

    Items without a time come first, nulls in other columns leave a page's ranges alone. The folder is a new one.
    """
    n = partitions or items.sparkSession.sparkContext.defaultParallelism
    ranged = items.repartitionByRange(n, "collection", "datetime", "id").sortWithinPartitions("collection", "datetime", "id")
    write_files(_stored(ranged, page_items), path)


@dataclass
class Pages(InputPartition):
    """Pages of one partition."""

    names: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.run_items = options["path"], int(options.get("runitems", 20_000))
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.collections: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Bounds of ranged columns and names of collections choose pages; Spark still applies every filter to their items."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in RANGES and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo, EqualNullSafe)) and f.value is not None:
                v = f.value
                v = int((v if v.tzinfo else v.replace(tzinfo=UTC)).timestamp() * 1_000_000) if isinstance(v, datetime) else v
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low[name] = max(v, self.low.get(name, v))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.high[name] = min(v, self.high.get(name, v))
            if name == "collection" and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.collections = wanted if self.collections is None else self.collections & wanted
            yield f

    def needed(self) -> list[tuple[str, int]]:
        """Pages that can hold a match, and their items. A page without any value in a bounded column has none, as comparisons with null fail."""
        store, _ = located(self.path)
        out = []
        for name in listed(self.path, "manifest-*.jsonl"):
            with store.open_input_stream(name, compression=None) as f:
                for line in f.read().decode().splitlines():
                    m = json.loads(line)
                    fine = self.collections is None or self.collections & set(m["collections"])
                    fine = fine and all(m[c] and m[c][1] >= v for c, v in self.low.items()) and all(m[c] and m[c][0] <= v for c, v in self.high.items())
                    if fine:
                        out.append((m["page"], m["items"]))
        return out

    def partitions(self) -> list[Pages]:
        runs, held = [], 0
        for page, n in self.needed():
            if not runs or held >= self.run_items:
                runs.append(Pages([]))
                held = 0
            runs[-1].names.append(page)
            held += n
        return runs or [Pages([])]

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        store, at = located(self.path)
        kinds = [pa.string(), pa.timestamp("us", tz="UTC"), pa.string(), *[pa.float64()] * 5, pa.string(), pa.string()]
        for name in partition.names:
            with store.open_input_stream(f"{at}/{name}", compression=None) as f:
                rows = [json.loads(line) for line in f.read().decode().splitlines()]
            yield pa.RecordBatch.from_arrays([pa.array([name if c == "page" else r[c] for r in rows], k) for c, k in zip([*NAMES, "page"], kinds)], names=[*NAMES, "page"])


class PagedCatalogue(DataSource):
    """Items of a paged catalogue and the page of each. Options: path, runitems."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_pages"

    def schema(self) -> str:
        return f"{ITEM}, page string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_pages(spark: SparkSession, path: str, run_items: int | None = None) -> DataFrame:
    """The items of a paged catalogue. Filters on times, cloud cover, boxes and collections choose by the manifests which pages are read; a partition is a run of pages."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return registered(spark, PagedCatalogue, path=path, runitems=run_items).load()
