"""Tabular classifier, batch scoring and model comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.parse import finite


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns all hold finite numbers."""
    for c in columns:
        df = df.where(finite(F.col(c)))
    return df


def fit_classifier(df: DataFrame, features: Sequence[str], label: str, *, max_iter: int = 200) -> PipelineModel:
    """Class-balanced logistic regression with unit inverse regularisation, on features standardised by their population deviation."""
    rows = complete(df, [*features, label])
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}  # one row a class
    n = sum(counts.values())
    weight = F.lit(1.0)
    for k, v in counts.items():
        weight = F.when(F.col(label) == k, F.lit(n / (len(counts) * v))).otherwise(weight)
    population = math.sqrt(n / max(1, n - 1))  # the scaler divides by the sample deviation
    stages = [
        VectorAssembler(inputCols=list(features), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_sample", withMean=True, withStd=True),
        ElementwiseProduct(inputCol="_sample", outputCol="_scaled", scalingVec=Vectors.dense([population] * len(features))),
        LogisticRegression(featuresCol="_scaled", labelCol=label, weightCol="_weight", maxIter=max_iter, regParam=1 / max(n, 1), tol=1e-12, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_weight", weight))


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def classify(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """df with probability and predicted (1 above the threshold)."""
    out = model.transform(df.withColumn("_weight", F.lit(1.0)))
    p = vector_to_array("probability")[1]
    return out.withColumn("_p", p).select(*df.columns, F.col("_p").alias("probability"), (F.col("_p") > threshold).cast("int").alias("predicted"))


def linear_onnx(weights: Sequence[float], bias: float = 0.0) -> bytes:
    """An ONNX model file of one linear unit: x (rows, len(weights)) to y (rows, 1). Field numbers are those of the format."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    number = lambda field, n: varint(field << 3) + varint(n)
    block = lambda field, b: varint(field << 3 | 2) + varint(len(b)) + b
    text = lambda field, s: block(field, s.encode())
    tensor = lambda name, dims, values: b"".join(number(1, d) for d in dims) + number(2, 1) + text(8, name) + block(9, np.asarray(values, "<f4").tobytes())
    dims = lambda n: block(1, text(2, "rows")) + block(1, number(1, n))
    value = lambda name, n: text(1, name) + block(2, block(1, number(1, 1) + block(2, dims(n))))
    node = lambda op, ins, out: b"".join(text(1, i) for i in ins) + text(2, out) + text(4, op)
    graph = block(1, node("MatMul", ["x", "w"], "z")) + block(1, node("Add", ["z", "b"], "y")) + text(2, "linear")
    graph += block(5, tensor("w", [len(weights), 1], weights)) + block(5, tensor("b", [1], [bias])) + block(11, value("x", len(weights))) + block(12, value("y", 1))
    return number(1, 8) + block(7, graph) + block(8, text(1, "") + number(2, 13))


def score_onnx(df: DataFrame, model: bytes, column: str, *, shape: Sequence[int] | None = None, output: str = "pred", inverse: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """df with the model's first output for an array column; the session opens once a task. Needs onnxruntime on the executors."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # one model file

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import onnxruntime

        session = onnxruntime.InferenceSession(shared.value, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for s in frames:
            if not len(s):
                yield pd.Series([], dtype="float64")
                continue
            x = np.stack(s.to_numpy()).astype(np.float32)
            y = np.asarray(session.run(None, {name: x.reshape(len(x), *shape) if shape else x})[0], float).reshape(len(x), -1)[:, 0]
            yield pd.Series(inverse(y) if inverse else y)

    return df.withColumn(output, F.pandas_udf(run, "double")(F.col(column)))


def compare(spark: SparkSession, models: dict[str, Callable[[], dict[str, float]]]) -> DataFrame:
    """model, metrics (map), error: a model that fails keeps its row."""
    rows = []
    for name, run in models.items():
        error, got = None, {}
        try:
            got = {k: float(v) for k, v in run().items()}
        except Exception as e:  # noqa: BLE001  the row says what went wrong
            error = f"{type(e).__name__}: {e}"
        rows.append((name, got, error))
    return spark.createDataFrame(rows, "model string, metrics map<string,double>, error string")


def joined_curves(train: DataFrame, val: DataFrame, key: str = "epoch") -> DataFrame:
    return train.join(val, key)
