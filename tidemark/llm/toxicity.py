"""Toxicity by compression distance between two trained zstandard dictionaries (operator 2)."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import arrow_map, stored

#: Precisions, on the labelled rows, that the thresholds of savings are calibrated to.
LEVELS = (0.25, 0.5, 0.75, 0.9)


def clean(text: str) -> bytes:
    """Lower case, single blanks, and a blank at both ends, so that a word looks the same wherever it stands."""
    return b" " + " ".join(text.lower().split()).encode("utf-8", "surrogatepass") + b" "


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, intercept first, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-6:
            break
    return w


def grams(text: bytes, n: int) -> np.ndarray:
    """The n-byte pieces of a text as numbers, n at most 8."""
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, len(b) - n + 1), np.uint64)
    for i in range(n if len(out) else 0):
        out = out << np.uint64(8) | b[i : i + len(out)]
    return out


def texts_with(texts: Sequence[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-byte piece, and the number of texts that hold it."""
    each = [np.unique(grams(t, n)) for t in texts]
    return np.unique(np.concatenate(each), return_counts=True) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def among(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of x would be in the ascending `known`, and whether it is there."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


def own_runs(toxic: Sequence[bytes], ordinary: Sequence[bytes], pieces: Sequence[int], least_share: float, least_ratio: float) -> list[bytes]:
    """The runs of toxic texts that ordinary texts lack: covered by pieces of the given byte lengths that least_share of the toxic texts hold (and four),
    and least_ratio times as large a share of them as of the ordinary ones. Each run counts once a text."""
    good = {}
    for n in pieces:
        x, held = texts_with(toxic, n)
        known, count = texts_with(ordinary, n)
        at, there = among(x, known)
        beside = np.where(there, count[at] if len(count) else 0, 0)
        good[n] = x[(held >= max(4, least_share * len(toxic))) & (held / len(toxic) > least_ratio * (beside + 1) / len(ordinary))]
    out = []
    for t in toxic:
        marks = np.zeros(len(t) + 1, np.int64)
        for n in pieces:
            hits = np.flatnonzero(among(grams(t, n), good[n])[1])
            np.add.at(marks, hits, 1)
            np.add.at(marks, hits + n, -1)
        edges = np.flatnonzero(np.diff(np.r_[0, np.cumsum(marks[:-1]) > 0, 0]))
        out += sorted({t[a:b] for a, b in zip(edges[::2], edges[1::2])})
    return out


def trained(size: int, samples: list[bytes], k: int) -> bytes | None:
    """A zstandard dictionary trained on the samples; None where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, [s for s in samples if len(s) >= 8], k=k, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return None


@dataclass
class Model:
    """ordinary, toxic: the trained dictionaries; thresholds in saved bytes; weights of the calibration."""

    ordinary: bytes = b""
    toxic: bytes = b""
    thresholds: tuple[int, ...] = (1, 2, 3, 4)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1))
    level: int = 12
    window: int = 128

    def measure(self) -> _Measure:
        return _Measure(self)


class _Measure:
    """Compressors of one worker."""

    def __init__(self, model: Model):
        self.model = model

        def sizer(content: bytes):
            d = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(model.level)
            return zstandard.ZstdCompressor(level=model.level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        # what ordinary text repeats lies at the same distance in both, so that windows of it come to the same length
        self.ordinary, self.toxic = sizer(model.ordinary), sizer(model.toxic + model.ordinary)

    def savings(self, text: str) -> list[int]:
        """How many windows of the whole text there are, and the bytes that those save that save any under the toxic dictionary, the most first."""
        b, at, saved, n = clean(text), 0, [], 0
        while at < len(b):
            end = b.find(b" ", at + self.model.window)
            end = len(b) if end < 0 else end + 1
            for a in range(at, end, 4096):  # a word without end is cut
                w = b[max(0, a - 1) : min(end, a + 4096)]
                n += 1
                if (less := len(self.ordinary(w)) - len(self.toxic(w))) > 0:
                    saved.append(less)
            at = end
        return [n, *sorted(saved, reverse=True)]

    def score(self, text: str) -> float:
        if len(self.model.weights) == 1:
            z = self.model.weights[0]
        else:
            z = self.model.weights[0] + float(features([self.savings(text)], self.model.thresholds)[0] @ self.model.weights[1:])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(savings: Sequence[Sequence[int]], thresholds: Sequence[int]) -> np.ndarray:
    """Of each row of savings(): the two best windows, the windows over each threshold and whether there is any, the windows, the mean saving."""
    out = []
    for n, *saved in savings:
        at = [sum(s >= t for s in saved) for t in thresholds]
        best = [*saved[:2], 0, 0][:2]
        out.append([*map(np.log1p, best), *map(np.log1p, at), *[k > 0 for k in at], -np.log1p(n), sum(saved) / n])
    return np.array(out, float)


def calibrated(best: np.ndarray, y: np.ndarray, weight: np.ndarray, levels: Sequence[float] = LEVELS) -> tuple[int, ...]:
    """For each level the least saving at which texts whose best window saves as much are toxic in that share, weighted; else one more than the largest there is."""
    most = int(best.max(initial=0))
    shares = [(weight * y)[best >= t].sum() / weight[best >= t].sum() for t in range(1, most + 1)]
    return tuple(next((t for t, s in enumerate(shares, 1) if s >= level), most + 1) for level in levels)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 3000, sample_bytes: int = 64 << 20, pieces: Sequence[int] = (6, 8), least_share: float = 0.02, least_ratio: float = 10.0, ordinary_size: int = 8192, toxic_size: int = 2048) -> Model:
    """Both dictionaries, the thresholds and the calibration, from at most about sample_rows labelled rows of each class, drawn by a hash of the id.

    The ordinary dictionary is trained on the windows of ordinary texts, the toxic one on the runs of toxic texts that ordinary texts lack (own_runs): trained on whole
    toxic texts, it would mostly hold what both share. Equal texts count once. The driver holds the sampled rows, whose number does not grow with the
    table, and of each class no more once they come to sample_bytes. With one class only, or none, every score is that class's share, and with samples too few to train a dictionary on it is the share of toxic rows.
    """
    spark = docs.sparkSession
    y = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in y.groupBy("y").count().collect()}  # two rows
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not (n0 and n1):
        return Model(weights=np.array([30.0 if n1 else -30.0]))
    share = F.when(F.col("y") == 1, F.lit(n1)).otherwise(F.lit(n0))
    drawn = y.where(F.pmod(F.xxhash64("_id"), share) < sample_rows)  # about sample_rows of each class
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sample = stored(texts.join(F.broadcast(drawn), "_id").dropDuplicates(["_id"]))
    rng = random.Random(5)
    of: dict[int, list[bytes]] = {0: [], 1: []}
    held = {0: 0, 1: 0}
    for r in sample.orderBy(F.xxhash64("_id")).select("y", "text").toLocalIterator():
        if held[r["y"]] < sample_bytes:
            of[r["y"]].append(clean(r["text"]))
            held[r["y"]] += len(of[r["y"]][-1])
    if not (of[0] and of[1]):
        return Model(weights=np.array([float(np.log(n1 / n0))]))
    got = {k: len(v) for k, v in of.items()}
    of = {k: sorted(set(v)) for k, v in of.items()}
    for v in of.values():
        rng.shuffle(v)
    model = Model()
    windows = [t[i : i + model.window] for t in of[0] for i in range(0, len(t), model.window)]
    rng.shuffle(windows)
    runs = own_runs(of[1], of[0], pieces, least_share, least_ratio)
    ordinary, toxic = trained(ordinary_size, windows, 64), trained(toxic_size, [b"".join(runs[k : k + 16]) for k in range(0, len(runs), 16)], 16)
    if ordinary is None or toxic is None:
        return Model(weights=np.array([float(np.log(n1 / n0))]))
    model.ordinary, model.toxic = ordinary, toxic

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.measure()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([measure.savings(t.as_py()) for t in b.column(0)], pa.list_(pa.int64()))], names=["y", "s"])

    rows = arrow_map(sample.select("text", "y").repartition(max(1, spark.sparkContext.defaultParallelism)), run, "y int, s array<long>").collect()
    rows.sort(key=lambda r: (r["y"], r["s"]))
    savings, label = [r["s"] for r in rows], np.array([r["y"] for r in rows], float)
    model.thresholds = calibrated(np.array([max(s[1:], default=0) for s in savings]), label, np.where(label == 1, n1 / got[1], n0 / got[0]))
    model.weights = logistic(features(savings, model.thresholds), label)
    model.weights[0] += np.log(n1 / n0) - np.log(got[1] / got[0])  # the classes were drawn at different rates
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and predicted (1 from 0.5) for every whole text.

    Null texts count as empty, of which all have one score; a very long text is worked through window by window; repeated rows give repeated results; an empty
    table gives none; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = model.measure()
        for b in batches:
            s = [measure.score(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[id_col, "score", "predicted"])

    return arrow_map(docs.select(docs[id_col].cast("long").alias(id_col), docs[text_col].cast("string").alias("_text")), run, f"{id_col} long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """score() of every row of docs by what fit() learns from the labels where learn_from holds; rows, nulls and other columns as stated there."""
    return score(docs, fit(docs, labels.where(learn_from), id_col=id_col, text_col=text_col, label_col=label_col), id_col=id_col, text_col=text_col)
