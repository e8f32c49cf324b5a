"""Vector code compression by delta-maintained Lloyd rounds (operator 13)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, salted, stored

#: Components of this size or more raise: beyond it squared distances of whole vectors need not fit in 64 bits.
LARGEST = 1 << 20


@dataclass
class Compressed:
    """rows: id, label, code (binary, an entry's number for each part) and error; codebooks: parts x entries x width."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        """SHA-256 of the codebooks' components as decimal integers by part, entry and position."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def whole(vector: Column) -> Column:
    """floor(256 x) of every component, or null for a vector that is null, empty, or holds a null or a component that is not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    large = F.exists(vector, lambda x: F.abs(x) >= F.lit(float(LARGEST)))
    ints = F.transform(vector, lambda x: F.floor(x.cast("double") * 256))
    return F.when((F.size(vector) > 0) & fine, F.when(large, F.raise_error(F.lit(f"a component of {LARGEST} or more"))).otherwise(ints))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For parts x (n x width) the number of the nearest entry of book (entries x width), the lower one of equals, and the squared distance; whole numbers throughout."""
    d = np.zeros((len(x), len(book)), np.int64)
    for k in range(x.shape[1]):
        gap = x[:, k, None] - book[None, :, k]
        d += gap * gap
    code = d.argmin(1)
    return code, d[np.arange(len(x)), code]


def _list(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2) -> Compressed:
    """Codes of all vectors under one codebook a part, learnt by `rounds` Lloyd rounds over every vector in whole numbers (floor(256 x)).

    A codebook starts as the parts of the `entries` smallest ids. Each round writes the rows with the assignment they had and the one they have now; what is shuffled is, a
    task, one row for each (part, entry) that some part of it left or joined: minus and plus counts and component sums of the parts that changed. They are added to the running
    sums, whose size is that of the codebooks; an entry without parts stays. So a round shuffles at most parts x entries rows a task, and none for what stays.

    Vectors that are null, empty, or hold null or non-finite components are left out, and so are those of another length than the commonest (the longer of equally
    common ones), which must be a multiple of `parts`. Fewer vectors than entries make as many entries. Equal ids start in the order of their vectors; rows without an id are coded but
    start no entry, and if no row has one there is nothing to code with and the result is empty. Repeated rows count each. An empty table gives no rows and codebooks without entries. Other columns are ignored.
    """
    label = vectors[label_col] if label_col else F.lit(None).cast("int")
    kept = stored(vectors.select(vectors[id_col].cast("long").alias("vec_id"), label.alias("label"), whole(vectors[vector_col]).alias("x")).where("x is not null"))
    sizes = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = sizes["d"] if sizes else parts
    if dims % parts:
        raise ValueError(f"vectors of {dims} components cannot be cut into {parts} equal parts")
    kept, width = kept.where(F.size("x") == dims), dims // parts
    first = kept.where("vec_id is not null").orderBy("vec_id", "x").limit(entries).collect()  # as many rows as entries
    books = np.array([r["x"] for r in first], np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    counts, sums = np.zeros(books.shape[:2], np.int64).astype(object), np.zeros(books.shape, np.int64).astype(object)

    def assigned(rows: DataFrame, books: np.ndarray) -> DataFrame:
        """Rows with their code under books, the code they had before (empty at first) and the error of the new one."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _list(b.column(2), dims).reshape(-1, parts, width)
                found = [nearest(x[:, p], books[p]) for p in range(parts)]
                code = np.stack([c for c, _ in found], 1).astype(">u2" if entries > 256 else np.uint8)
                error = np.sum([d for _, d in found], 0)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], b.column(3), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=["vec_id", "label", "x", "was", "code", "error"])

        kind = dict(kept.dtypes)["label"]
        return stored(arrow_map(rows, run, f"vec_id long, label {kind}, x array<bigint>, was binary, code binary, error long"))

    def changes(rows: DataFrame) -> DataFrame:
        """part, entry, n, s: what parts that changed add to and take from the counts and sums of entries, summed within a task and then over all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for b in batches:
                x = _list(b.column(0), dims).reshape(-1, parts, width)
                now, was = (np.array([np.frombuffer(c or b"", ">u2" if entries > 256 else np.uint8) for c in b.column(k).to_pylist()], np.int64).reshape(len(x), -1) for k in (2, 1))
                for p in range(parts):
                    moved = now[:, p] != was[:, p] if was.size else np.ones(len(x), bool)
                    for codes, sign in ((now, 1), (was, -1)):
                        if codes.size:
                            at = codes[moved, p]
                            np.add.at(n[p], at, sign)
                            np.add.at(s[p], at, sign * x[moved, p])
            p, e = np.nonzero((n != 0) | s.any(-1))
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(s[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

        own = arrow_map(rows.select("x", "was", "code"), run, "part int, entry int, n long, s array<bigint>")
        exact = [F.sum(F.col("s")[k].cast("decimal(19,0)")).alias(f"s{k}") for k in range(width)]
        return own.groupBy("part", "entry").agg(F.sum("n").alias("n"), *exact)

    rows = kept.withColumn("was", F.lit(None).cast("binary"))
    for _ in range(rounds if len(first) else 0):
        rows = assigned(rows, books)
        for r in changes(rows).collect():  # at most parts x entries rows
            counts[r["part"], r["entry"]] += r["n"]
            sums[r["part"], r["entry"]] += np.array([int(r[f"s{k}"]) for k in range(width)], object)
        used = counts > 0
        books[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
        rows = rows.select("vec_id", "label", "x", F.col("code").alias("was"))
    if len(first):
        rows = assigned(rows, books).select("vec_id", "label", "code", "error")
    else:
        rows = rows.where(F.lit(False)).select("vec_id", "label", F.col("was").alias("code"), F.lit(0).cast("long").alias("error"))
    return Compressed(rows, books)


def restored(rows: DataFrame, codebooks: np.ndarray, *, code_col: str = "code", vector_col: str = "restored") -> DataFrame:
    """rows with the vectors that their codes stand for, in the original scale (the middle of a component's step)."""
    kind = ">u2" if codebooks.shape[1] > 256 else np.uint8
    parts = np.arange(len(codebooks))
    books = ((codebooks + 0.5) / 256).astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(code_col)
            out = [None if c is None else books[parts, np.frombuffer(c, kind)].ravel().tolist() for c in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float64()))], names=[*b.schema.names, vector_col])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return arrow_map(rows, run, f"{schema}, `{vector_col}` array<double>")


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows with label_error, the errors summed over equal labels (nulls are one label). A label with a great part of the rows is dealt over several tasks."""
    keyed = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    totals = stored(keyed.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")))
    return salted(keyed, "_label", totals.drop("n"), F.struct("vec_id", "code"), counts=totals.select("_label", "n"), how="inner").drop("_label")
