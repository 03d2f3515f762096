"""A neural network fitted on counted rows: Spark's perceptron, whose own fit knows no weights, with given weights.

Equal rows are one row with a number, so the fit works on distinct inputs and not on rows. Start values and the fitted
model are those of Spark's :class:`MultilayerPerceptronClassifier`; in between, tasks add up loss and gradient of their
rows and the driver takes the steps of L-BFGS. One array of weights per task reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.session import cut_lineage

KEPT_STEPS, LEAST_STEP = 10, 1e-10


def _parts(w: np.ndarray, layers: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of matrix and constants of each layer, in the order in which Spark lays them out."""
    out, at = [], 0
    for wide, narrow in zip(layers, layers[1:], strict=False):
        end = at + wide * narrow
        out.append((w[at:end].reshape(wide, narrow), w[end : end + narrow]))
        at = end + narrow
    return out


def loss_and_gradient(w: np.ndarray, layers: list[int], x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Sums of cross-entropy and its gradient over rows that count ``n`` times: sigmoid layers below a softmax."""
    parts, held = _parts(w, layers), [x]
    for i, (matrix, constants) in enumerate(parts):
        z = held[-1] @ matrix + constants
        held.append(1 / (1 + np.exp(-np.clip(z, -700, 700))) if i + 1 < len(parts) else z)
    z = held.pop()
    z = z - z.max(axis=1, keepdims=True)
    logs = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    rows, gradient = np.arange(len(y)), np.zeros(len(w))
    loss = -float((n * logs[rows, y]).sum())
    delta = np.exp(logs)
    delta[rows, y] -= 1
    delta *= n[:, None]
    for i, (into, constants) in reversed(list(enumerate(_parts(gradient, layers)))):
        into[:], constants[:] = held[i].T @ delta, delta.sum(axis=0)
        if i:
            delta = (delta @ parts[i][0].T) * held[i] * (1 - held[i])
    return loss, gradient


def least(value: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, steps: int, tolerance: float = 1e-6) -> np.ndarray:
    """L-BFGS from ``w`` on: at most ``steps`` steps, halved until the value falls."""
    (f, g), pairs = value(w), []
    for _ in range(steps):
        if np.linalg.norm(g) <= max(tolerance * abs(f), 1e-8):
            break
        d, used = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            used.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(used), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        step = 1.0 if pairs else 1 / np.linalg.norm(d)
        slope = g @ d
        while True:
            moved = w + step * d
            f_moved, g_moved = value(moved)
            if f_moved <= f + 1e-4 * step * slope:
                break
            step /= 2
            if step < LEAST_STEP:
                return w
        s, y = moved - w, g_moved - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            pairs = [*pairs, (s, y)][-KEPT_STEPS:]
        w, f, g = moved, f_moved, g_moved
    return w


def fit_network(
    rows: DataFrame, hidden: list[int], labels: int, steps: int, seed: int,
    features: str = "features", label: str = "label_index", number: str = "n",
) -> MultilayerPerceptronClassificationModel:
    """The network of ``rows`` that count ``number`` times each; it equals that of the rows repeated so often."""
    spark = rows.sparkSession
    stored = rows.select(
        vector_to_array(features).alias("x"), F.col(label).cast("int").alias("y"), F.col(number).cast("double").alias("n")
    )
    stored = cut_lineage(stored.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("x")))
    first = stored.select(F.size("x")).first()
    if first is None:
        raise ValueError("a network needs rows to learn from")
    layers = [first[0], *hidden, labels]

    def model(**given) -> MultilayerPerceptronClassificationModel:
        # without steps the fit only builds the model; its rows just name the labels
        plain = spark.createDataFrame([(Vectors.sparse(layers[0], []), float(i)) for i in range(labels)], ["f", "l"])
        fit = MultilayerPerceptronClassifier(featuresCol="f", labelCol="l", layers=layers, maxIter=0, seed=seed, **given)
        return fit.fit(plain).setFeaturesCol(features)

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(w)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, count, gradient = 0.0, 0.0, np.zeros(len(sent.value))
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, layers[0])
                y, n = batch.column("y").to_numpy(), batch.column("n").to_numpy()
                more, slope = loss_and_gradient(sent.value, layers, x, y, n)
                loss, count, gradient = loss + more, count + n.sum(), gradient + slope
            yield pa.RecordBatch.from_arrays(
                [pa.array([loss]), pa.array([count]), pa.array([gradient], pa.list_(pa.float64()))], ["loss", "n", "g"]
            )

        found = stored.mapInArrow(add, "loss double, n double, g array<double>").toArrow()
        sent.unpersist()
        total = sum(found.column("n").to_pylist())
        gradients = found.column("g").combine_chunks().flatten().to_numpy().reshape(-1, len(w))
        return sum(found.column("loss").to_pylist()) / total, gradients.sum(axis=0) / total

    start = model().weights.toArray()
    return model(initialWeights=Vectors.dense(least(value, start, steps)))
