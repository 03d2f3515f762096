"""Quality classifier: random-indexing word vectors, pooled per text, into a small calibrated network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from curbline.llm.common import fresh
from curbline.llm.tokens import U, chunks, mix, word_hashes

SLOT_BITS = 14  # word slots; words share a slot by hash, so the vector table is bounded
SLOTS, DIM, SIGNS, WINDOW = 1 << SLOT_BITS, 64, 4, 2
FEATURES = 2 * DIM + 2
MAX_TRAINING_ROWS = 20_000  # bound of the labelled sample a model is fitted on
HIDDEN, EPOCHS, BATCH, RATE = 32, 14, 256, 0.004


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Per slot the ``SIGNS`` dimensions of its random index vector and their signs."""
    base = np.arange(SLOTS * SIGNS, dtype=np.uint64).reshape(SLOTS, SIGNS)
    h = mix(base * U(0x9E3779B97F4A7C15) + U(77))
    return (h % U(DIM)).astype(np.int64), np.where(h >> U(63), 1.0, -1.0)


def _slots(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, row = word_hashes(data, offsets, classes=True)
    return (h >> U(64 - SLOT_BITS)).astype(np.int64), row


def word_vectors(texts: DataFrame, text: str = "text") -> np.ndarray:
    """SLOTS x DIM: per word slot the sum of the index vectors of its neighbours (``WINDOW`` words
    each side) over all texts, centred and scaled to length 1.

    Each task adds up its own table; Spark sums the rows per slot. The sums are whole numbers, so
    no order of tasks changes them. The table that reaches the driver has SLOTS rows at any input size.
    """
    names = [f"c{i}" for i in range(DIM)]
    schema = StructType([StructField("slot", IntegerType()), *[StructField(n, LongType()) for n in names]])

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(SLOTS * DIM)
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                slot, row = _slots(data, offsets)
                for gap in range(1, WINDOW + 1):
                    same = row[gap:] == row[:-gap]
                    left, right = slot[:-gap][same], slot[gap:][same]
                    for a, b in ((left, right), (right, left)):
                        for k in range(SIGNS):
                            np.add.at(total, a * DIM + places[b, k], signs[b, k])
        table = total.reshape(SLOTS, DIM).astype(np.int64)
        used = np.flatnonzero(table.any(axis=1))
        columns = [pa.array(used, pa.int32()), *[pa.array(table[used, i]) for i in range(DIM)]]
        yield pa.RecordBatch.from_arrays(columns, ["slot", *names])

    sums = (
        texts.select(F.col(f"`{text}`"))
        .mapInArrow(contexts, schema)
        .groupBy("slot")
        .agg(*[F.sum(n).alias(n) for n in names])
        .toArrow()
    )
    out = np.zeros((SLOTS, DIM))
    if sums.num_rows:
        out[sums["slot"].to_numpy()] = np.stack([sums[n].to_numpy() for n in names], axis=1)
    out -= out.sum(axis=0) / max(np.abs(out).sum(), 1.0) * np.abs(out).sum(axis=1, keepdims=True)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32)


def pooled(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Per text: the mean and the mean square of its word vectors, the mean cosine of neighbours in the
    text, and the logarithm of its length."""
    out = np.zeros((len(column), FEATURES), np.float32)
    for first, _, data, offsets in chunks(column):
        slot, row = _slots(data, offsets)
        for at in range(0, len(slot), 1 << 15):  # bounds the gathered vectors
            v, r = vectors[slot[at : at + (1 << 15)]], row[at : at + (1 << 15)]
            starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            own = first + r[starts]
            out[own, :DIM] += np.add.reduceat(v, starts)
            out[own, DIM : 2 * DIM] += np.add.reduceat(v * v, starts)
            before = np.concatenate((vectors[slot[max(at - 1, 0) : max(at - 1, 0) + 1]], v[:-1]))
            near = np.einsum("ij,ij->i", v, before)
            near[row[np.maximum(np.arange(at, at + len(r)) - 1, 0)] != r] = 0
            near[: at == 0] = 0
            out[own, -2] += np.add.reduceat(near, starts)
            out[own, -1] += np.diff(np.append(starts, len(r)))
    n = np.maximum(out[:, -1:], 1)
    out[:, : FEATURES - 1] /= n
    out[:, -1] = np.log1p(out[:, -1]) / 8
    return out


@dataclass
class Network:
    """Two layers and a temperature. Without both labels in the sample: a constant."""

    constant: float
    layers: tuple | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        mean, scale, w1, b1, w2, b2 = self.layers
        return np.tanh(((x - mean) / scale) @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(x.astype(np.float64)) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on log loss over four fifths of the rows; the rest sets the temperature."""
    constant = (y.sum() + 1) / (len(y) + 2)
    if len(np.unique(y)) < 2:
        return Network(float(constant))
    x, rng = x.astype(np.float64), np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = rng.permutation(len(x))
    held, used = order[: len(x) // 5], order[len(x) // 5 :]
    w = [
        rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)),
        np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        np.zeros(1),
    ]
    m, v, step = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0
    z = (x - mean) / scale
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for at in range(0, len(used), BATCH):
            rows = used[at : at + BATCH]
            h = np.tanh(z[rows] @ w[0] + w[1])
            error = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - y[rows]) / len(rows)
            back = np.outer(error, w[2]) * (1 - h * h)
            step += 1
            for i, g in enumerate((z[rows].T @ back, back.sum(0), h.T @ error, error.sum(keepdims=True))):
                g = g + 1e-3 * w[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                w[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(float(constant), (mean, scale, *w))
    if len(held):
        logits, target = net.logits(x[held]), y[held]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        loss = [np.mean(np.logaddexp(0, np.where(target > 0, -1, 1) * logits / t)) for t in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> DataFrame:
    """(key, y, text) of up to ``MAX_TRAINING_ROWS`` labelled texts, those with the smallest id hash.

    The sample of label rows is bounded, so it is broadcast to the scan of the texts.
    """
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & usable)
        .groupBy(F.col("doc_id").alias("key"))
        .agg(F.max(label).alias("y"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(MAX_TRAINING_ROWS)
    )
    return docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(chosen), "key").select("key", "y", "text")


def train(docs: DataFrame, labels: DataFrame, label: str, usable: Column) -> tuple[np.ndarray, Network]:
    """Word vectors of all ``docs`` and a network fitted on labelled rows that meet ``usable``."""
    vectors = word_vectors(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column(2), shared.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "y", "x"]
            )

    sample = labelled_sample(docs, labels, label, usable)
    rows = sample.mapInArrow(features, "key long, y int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(rows.num_rows, FEATURES)
    order = np.lexsort((x[:, -1], rows["key"].to_numpy()))
    y = rows["y"].to_numpy()[order].astype(np.float64)
    return vectors, fit_network(x[order], y)


def score(df: DataFrame, vectors: np.ndarray, network: Network, text: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); same-named columns are replaced.

    NULL and empty texts have a zero vector and its score; repeated texts score alike; an empty frame
    stays empty.
    """
    source = fresh(df.columns, "text")[0]
    given = df.drop("score", "predicted").withColumn(source, F.col(f"`{text}`"))
    keep = [f for f in given.schema.fields if f.name != source]
    shared = df.sparkSession.sparkContext.broadcast((vectors, network))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, net = shared.value
        for batch in batches:
            p = net.probabilities(pooled(batch.column(batch.num_columns - 1), table))
            columns = [*batch.columns[:-1], pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*[f.name for f in keep], "score", "predicted"])

    schema = StructType([*keep, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return given.mapInArrow(scored, schema)
