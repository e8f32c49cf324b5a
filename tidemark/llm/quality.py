"""Quality scores by ridge regression on random Fourier features of document statistics (operator 8)."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, stored

#: Byte groups whose shares are statistics: fixed values.
GROUPS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "symbol": b"#*$%&<>", "bar": b"|", "blank": b" \t", "line": b"\n", "mark": b"\"'():;[]{}-_/\\@+=~^"}
_MEMBER = np.zeros((256, len(GROUPS) + 1))
for _k, _bytes in enumerate(GROUPS.values()):
    _MEMBER[list(_bytes), _k] = 1
_MEMBER[128:, -1] = 1


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text's shape; an empty one has all but its size at zero."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, m = len(raw), len(words)
    bytes_ = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = (bytes_ @ _MEMBER) / max(n, 1)
    p = bytes_[bytes_ > 0] / max(n, 1)
    sizes = np.array([len(w) for w in words] or [0], float)
    counts = Counter(words)
    top = [c for _, c in counts.most_common(10)]
    same_next = sum(a == b for a, b in zip(words, words[1:]))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    shouted = sum(w.isupper() for w in words)
    return [
        *np.sqrt(shares), float(-(p * np.log2(p)).sum()) if n else 0.0,
        np.log1p(n), np.log1p(m), np.log1p(len(lines)), sizes.mean(), sizes.std(), np.log1p(sizes.max()),
        len(counts) / max(m, 1), (top[0] / m) if m else 0.0, sum(top) / max(m, 1), np.sqrt(same_next / max(m, 1)), np.sqrt(shouted / max(m, 1)),
        1 - len(set(lines)) / max(len(lines), 1), len(zlib.compress(raw, 1)) / max(n, 1), m / max(len(lines), 1) / 100,
    ]


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, x (array of the statistics) per row of docs; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[float(v) for v in statistics(t.as_py() or "")] for t in b.column(1)], pa.list_(pa.float64()))], names=[id_col, "x"])

    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")), run, f"{id_col} long, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # of the calibration: raw scores, and the share of label 1 at each
    shares: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """A constant and the cosines; statistics count up to eight deviations from their mean, beyond which the kernel is flat."""
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.ones(len(z)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.omega + self.phase)]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.steps, self.shares)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean place and share of ones of each block, ascending."""
    blocks: list[list[float]] = []
    for a, o, k in zip(at, ones, n):
        blocks.append([a * k, o, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            s = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], s)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(described: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", size: int = 256, gamma: float = 0.15, ridge: float = 1e-3, folds: int = 4, bins: int = 1000, part_rows: int = 5000, seed: int = 11) -> Model:
    """Weights from all labelled rows, by sums over partitions.

    The rows are dealt into partitions of about part_rows. Each partition adds up the products of its rows' features, one sum for each of `folds` folds; the driver gets their totals, whose size is fixed,
    and solves for the weights of all rows and of all but each fold. The scores of each fold under the latter, counted in `bins` bins, give the isotonic
    calibration. With one class only, or no labelled row, every score is that class's share (0.5 for none).
    """
    y = labels.where(F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("y"))
    parts = max(1, -(-y.count() // part_rows))  # each sends sums of a fixed size
    rows = stored(described.dropDuplicates([id_col]).join(y, id_col).select("x", "y", F.pmod(F.xxhash64(id_col), F.lit(folds)).cast("int").alias("fold")).repartition(parts))
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).first()
    n, ones = first["n"], first["ones"] or 0
    dims = len(statistics(""))
    rng = np.random.default_rng(seed)
    omega, phase = rng.normal(0, np.sqrt(2 * gamma / dims * 4), (dims, size)), rng.uniform(0, 2 * np.pi, size)
    width = 1 + size
    if not n or ones in (0, n):
        share = ones / n if n else 0.5
        return Model(np.zeros(dims), np.ones(dims), omega, phase, np.zeros(width), np.array([0.0]), np.array([share]))
    moments = rows.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()  # one row a statistic
    mean, scale = np.array([r["m"] for r in moments]), np.maximum(np.array([r["s"] for r in moments]), 1e-6)
    model = Model(mean, scale, omega, phase, np.zeros(width), np.array([0.0]), np.array([0.5]))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, width, width + 1))
        for b in batches:
            if b.num_rows:
                f = model.features(np.array(b.column(0).to_pylist()))
                t = b.column(1).to_numpy().astype(float)
                fold = b.column(2).to_numpy()
                for k in range(folds):
                    own = f[fold == k]
                    total[k] += own.T @ np.c_[own, t[fold == k]]
        for k in range(folds):
            yield pa.RecordBatch.from_arrays([pa.array([k] * width), pa.array(range(width)), pa.array([TaskContext.get().partitionId()] * width), pa.array(list(total[k]), pa.list_(pa.float64()))], names=["fold", "i", "part", "v"])

    def total_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"fold": [pdf["fold"].iloc[0]], "i": [pdf["i"].iloc[0]], "part": [0], "v": [np.sum(np.stack(pdf["v"].to_numpy()), axis=0)]})

    sum_schema = "fold long, i long, part long, v array<double>"
    partial = arrow_map(rows, sums, sum_schema).withColumn("part", F.col("part") % max(1, math.isqrt(parts)))  # two levels, so no group has over twice the root of the partitions
    some = partial.groupBy("fold", "i", "part").applyInPandas(total_of, sum_schema)
    gram = np.zeros((folds, width, width + 1))
    for r in some.groupBy("fold", "i").applyInPandas(total_of, sum_schema).toLocalIterator():
        gram[r["fold"], r["i"]] = r["v"]
    solve = lambda g: np.linalg.solve(g[:, :-1] + (ridge * max(1.0, g[0, 0]) + 1e-3) * np.diag(np.r_[0, np.ones(width - 1)]) + 1e-9 * np.eye(width), g[:, -1])
    model.weights = solve(gram.sum(0))
    without = np.array([solve(gram.sum(0) - gram[k]) for k in range(folds)])

    def bin_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                f = model.features(np.array(b.column(0).to_pylist()))
                s = (f * without[b.column(2).to_numpy()]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.clip(np.floor((s + 0.5) * bins / 2), 0, bins - 1).astype(np.int64)), b.column(1)], names=["bin", "y"])

    counted = arrow_map(rows, bin_, "bin long, y int").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("ones")).orderBy("bin").collect()  # at most `bins` rows
    at = np.array([(r["bin"] + 0.5) * 2 / bins - 0.5 for r in counted])
    model.steps, model.shares = isotonic(at, np.array([r["ones"] for r in counted], float), np.array([r["n"] for r in counted], float))
    return model


def score(described: DataFrame, model: Model, *, id_col: str = "doc_id") -> DataFrame:
    """id, score (0 to 1) and predicted (1 from 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array(b.column(1).to_pylist())) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    return arrow_map(described.select(id_col, "x"), run, f"{id_col} long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Scores of every row of docs, learnt from the labels where learn_from holds.

    Statistics are taken once over every whole text and kept in the shared folder; only they meet the labels, so texts are never shuffled. A very long text is described
    whole, in one task. Null texts count as
    empty, repeated rows give repeated results (and count once in learning), an empty table gives no rows, other columns are ignored.
    """
    described = stored(describe(docs, id_col=id_col, text_col=text_col))
    return score(described, fit(described, labels.where(learn_from), id_col=id_col, label_col=label_col), id_col=id_col)
