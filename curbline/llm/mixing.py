"""Document rates that bring soft domain memberships to target token totals."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from curbline.llm.common import fresh
from curbline.llm.tokens import U, chunks, word_hashes

FEATURE_BITS = 18  # word slots of the domain classifier
MAX_TRAINING_ROWS = 20_000  # bound of the labelled sample it is fitted on
BLOCK_WORDS = 1 << 18  # words of the sample that a step of the fit looks at together
EPOCHS, STEP, RIDGE = 120, 0.5, 10.0
MAX_ROUNDS, TOLERANCE = 150, 1e-4  # targets that rates can meet take a few rounds


def _present(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, row, slot) with each (row, slot) once; case is ignored."""
    counts, rows, slots = np.zeros(len(column), np.int64), [], []
    for first, end, data, offsets in chunks(column):
        h, row = word_hashes(data, offsets, lower=True)
        counts[first:end] = np.bincount(row, minlength=end - first)
        h, row = word_hashes(data, offsets, lower=True, classes=True)
        key = np.unique((row.astype(np.uint64) << U(FEATURE_BITS)) | (h >> U(64 - FEATURE_BITS)))
        rows.append((key >> U(FEATURE_BITS)).astype(np.int64) + first)
        slots.append((key & U((1 << FEATURE_BITS) - 1)).astype(np.int64))
    if not rows:
        return counts, np.zeros(0, np.int64), np.zeros(0, np.int64)
    return counts, np.concatenate(rows), np.concatenate(slots)


def _posterior(weights: np.ndarray, bias: np.ndarray, n: int, row: np.ndarray, slot: np.ndarray) -> np.ndarray:
    z = np.tile(bias, (n, 1))
    for k in range(len(bias)):
        z[:, k] += np.bincount(row, weights=weights[k][slot], minlength=n)
    z = np.exp(z - z.max(axis=1, keepdims=True)) if n else z
    return z / z.sum(axis=1, keepdims=True) if n else z


def fit_domains(docs: DataFrame, labels: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """(domains, weights, bias) of a softmax regression on the words present in a text.

    ``labels`` has (doc_id, domain); rows with a NULL are left out, and of several labels of one id the
    smallest counts. The model is fitted on the ``MAX_TRAINING_ROWS`` labelled ids with the smallest hash; all
    words of these texts count, rare ones held back by the ridge term only.
    Without any label there is one domain, NULL.
    """
    chosen = (
        labels.where("doc_id IS NOT NULL AND domain IS NOT NULL")
        .groupBy(F.col("doc_id").alias("key"))
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(MAX_TRAINING_ROWS)
    )
    sample = docs.select(F.col("doc_id").alias("key"), "text").join(F.broadcast(chosen), "key")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, slot = _present(batch.column(1))
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
            slots = [slot[a:b].astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(slots, pa.binary())], ["key", "domain", "slots"]
            )

    rows = sample.select("key", "text", "domain").mapInArrow(features, "key long, domain string, slots binary").toArrow()
    rows = rows.sort_by([("key", "ascending"), ("domain", "ascending"), ("slots", "ascending")])
    domains = sorted(rows.column("domain").unique().to_pylist()) or [None]
    weights, bias = np.zeros((len(domains), 1 << FEATURE_BITS)), np.zeros(len(domains))
    if len(domains) == 1:
        return domains, weights.astype(np.float32), bias
    n, y = len(rows), np.searchsorted(domains, rows.column("domain").to_pylist())
    lists = rows.column("slots").cast(pa.large_binary()).combine_chunks()
    ends = np.frombuffer(lists.buffers()[1], np.int64)[lists.offset : lists.offset + n + 1] // 4
    slot = np.frombuffer(lists.buffers()[2] or b"", np.int32)
    del rows
    # a few texts at a time: the temporary arrays of a step are bounded, whatever the sample holds
    cuts = np.unique(np.searchsorted(ends, np.arange(ends[0], ends[-1], BLOCK_WORDS)).tolist() + [0, n])
    truth = np.eye(len(domains))[y]
    bias = np.log(truth.mean(axis=0) + 1e-9)
    seen, seen_bias = np.full_like(weights, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(EPOCHS):
        error, sums = np.empty_like(truth), np.zeros_like(weights)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            row, own = np.repeat(np.arange(b - a), np.diff(ends[a : b + 1])), slot[ends[a] : ends[b]]
            error[a:b] = (_posterior(weights, bias, b - a, row, own) - truth[a:b]) / n
            for k in range(len(domains)):
                np.add.at(sums[k], own, error[a:b, k][row])  # in the order of the rows, so blocks change no place
        for k in range(len(domains)):
            g = sums[k] + RIDGE / n * weights[k]
            seen[k] += g * g
            weights[k] -= STEP * g / np.sqrt(seen[k])
        g = error.sum(axis=0)
        seen_bias += g * g
        bias = bias - STEP * g / np.sqrt(seen_bias)
    return domains, weights.astype(np.float32), bias


def add_posteriors(df: DataFrame, weights: np.ndarray, bias: np.ndarray, text: str = "text") -> DataFrame:
    """``df`` with ``n_tokens`` (words) and ``posterior`` (one probability per domain); replaces same names."""
    source = fresh(df.columns, "text")[0]
    given = df.drop("n_tokens", "posterior").withColumn(source, F.col(f"`{text}`"))
    keep = [f for f in given.schema.fields if f.name != source]
    shared = df.sparkSession.sparkContext.broadcast((weights, bias))
    schema = StructType(
        [*keep, StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))]
    )

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        for batch in batches:
            counts, row, slot = _present(batch.column(batch.num_columns - 1))
            p = _posterior(w, b, batch.num_rows, row, slot)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, p.size + 1, len(b)), pa.int32()), pa.array(p.ravel())
            )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts), lists], schema.names)

    return given.mapInArrow(scored, schema)


Step = tuple[np.ndarray, float]  # what a posterior is multiplied with, and the momentum after the step


def _rates(p: np.ndarray, steps: list[Step]) -> tuple[np.ndarray, np.ndarray]:
    """(rates, point of the next gradient) of documents with posteriors ``p`` after the given steps."""
    r = y = np.ones(len(p))
    for g, momentum in steps:
        before, r = r, np.maximum(0.0, y - p @ g)
        y = r + momentum * (r - before)
    return r, y


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _totals(scored: DataFrame, steps: list[Step], k: int) -> np.ndarray:
    """Rows: expected domain totals under the rates, and under the point of the next gradient; then the sum
    of n p p' over the documents. Each task sends one row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k + 2, k))
        for batch in batches:
            n, p = batch.column(0).to_numpy().astype(float), _matrix(batch.column(1), k)
            r, y = _rates(p, steps)
            out[0] += (n * r) @ p
            out[1] += (n * y) @ p
            out[2:] += (p * n[:, None]).T @ p
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in out.ravel()], names)

    names = [f"v{i}" for i in range(k * (k + 2))]
    out = (
        scored.select("n_tokens", "posterior")
        .mapInArrow(part, ", ".join(f"{n} double" for n in names))
        .agg(*[F.sum(n).alias(n) for n in names])
        .first()
    )
    return np.array([v or 0.0 for v in out]).reshape(k + 2, k)


def fit_rates(scored: DataFrame, targets: np.ndarray) -> tuple[list[Step], np.ndarray]:
    """Steps of projected gradient least squares for rates r >= 0, and the totals they reach.

    Minimises (S - T)' M (S - T) with S the sum of r n p over the documents, T the target totals and
    M the inverse of the sum of n p p', which makes a step of length 1 right. It starts at r = 1 and
    uses momentum, which starts anew whenever it overshoots. The gradient of a document is its posterior times one vector that all documents
    share, so a round needs only the totals: a few numbers cross the cluster, and a document's rate
    follows from its posterior and the list of these vectors. Stops once the totals meet the targets; a warning
    names the widest gap if ``MAX_ROUNDS`` do not suffice, as with targets that no rates can meet.
    """
    k, steps = len(targets), []
    sums = _totals(scored, steps, k)
    size = max(np.trace(sums[2:]), 1.0)
    metric = np.linalg.inv(sums[2:] / size + 1e-9 * np.eye(k)) / size
    run, last = 0, np.inf
    for _ in range(MAX_ROUNDS):
        gap, ahead = sums[0] - targets, sums[1] - targets
        if np.abs(gap).max() <= TOLERANCE * max(targets.sum(), 1.0):
            break
        now = gap @ metric @ gap
        if now > last:  # overshot: go on from the rates themselves
            steps[-1], ahead, run = (steps[-1][0], 0.0), gap, 0
        last, run = now, run + 1
        steps.append((metric @ ahead, run / (run + 3)))
        sums = _totals(scored, steps, k)
    else:
        gap = np.abs(sums[0] - targets).max()
        if gap > TOLERANCE * max(targets.sum(), 1.0):
            warnings.warn(f"rates miss the targets by up to {gap:.0f} tokens after {MAX_ROUNDS} rounds", stacklevel=2)
    return steps, sums[0]


def add_rates(scored: DataFrame, steps: list[Step], k: int) -> DataFrame:
    """``scored`` with ``rate``, the times a document is to be used; replaces a column of that name."""
    given = scored.drop("rate")
    at = given.columns.index("posterior")
    schema = StructType([*given.schema.fields, StructField("rate", DoubleType())])

    def rated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, _ = _rates(_matrix(batch.column(at), k), steps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], schema.names)

    return given.mapInArrow(rated, schema)


def whole_copies(rate, *key):
    """Copies of a document: its rate rounded up or down by the hash of its key, right on average."""
    share = F.pmod(F.xxhash64(*key, F.lit("mixing")), F.lit(1_000_000)) / 1_000_000
    return (F.floor(rate) + (share < rate - F.floor(rate)).cast("long")).cast("int")
