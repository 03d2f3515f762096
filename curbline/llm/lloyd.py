"""Exact k-means on whole numbers, sharded by columns.

Vectors are cut into chunks of rows and blocks of columns. A task holds cells (chunk, block) and the slice of
every centroid in these columns; it computes exact partial squared distances. ``reduceByKey`` adds the
blocks of a chunk and takes the nearest centroid. The choice goes back to the shards of the columns, which stay
where they are, and each updates its own slice of the centroids. Per round and vector, what crosses the cluster
is one number per centroid and block, and one label per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import stored
from curbline.llm.vectorrows import EXACT, dense
from curbline.session import cut_lineage

COLUMNS = 16  # columns of a block
ROWS = 1_024  # rows of a chunk
LARGEST = 1 << 26  # of a whole-numbered component: its squares still add up in a long
MODEL = 1 << 22  # numbers of all centroids, which the driver and each task hold


def whole_vectors(df: DataFrame, vec_id: str, vector: str, width: int, scale: int) -> DataFrame:
    """(chunk, block, n, x, ids): vectors of exactly ``width`` finite components as floor(scale * component).

    ``x`` holds ``n`` rows of the block's columns; block 0 of a chunk has the ids.
    """

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, part = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            out, good = dense(batch.column(1), width)
            sizes = np.asarray(pa.compute.list_value_length(batch.column(1)).fill_null(-1))
            rows = np.flatnonzero(good & (sizes == width))
            x = np.floor(scale * out[rows])
            if np.abs(x).max(initial=0) > LARGEST:
                raise ValueError(f"components beyond {LARGEST} after scaling")
            for at in range(0, len(rows), ROWS):
                piece = x[at : at + ROWS].astype("<i4")
                ids = batch.column(0).take(pa.array(rows[at : at + ROWS]))
                cells = [np.ascontiguousarray(piece[:, c : c + COLUMNS]).tobytes() for c in range(0, width, COLUMNS)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part + chunk] * len(cells), pa.int64()),
                        pa.array(range(len(cells)), pa.int32()),
                        pa.array([len(piece)] * len(cells), pa.int32()),
                        pa.array(cells, pa.binary()),
                        pa.array([ids.to_pylist()] + [None] * (len(cells) - 1), pa.list_(pa.int64())),
                    ],
                    ["chunk", "block", "n", "x", "ids"],
                )
                chunk += 1

    given = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return given.mapInArrow(floored, "chunk long, block int, n int, x binary, ids array<long>")


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances between rows of whole numbers, as exact int64."""
    x, c = x.astype(np.int64), c.astype(np.int64)
    top = (float(np.abs(x).max(initial=0)) + float(np.abs(c).max(initial=0))) ** 2 * max(1, x.shape[1])
    cross = (x.astype(float) @ c.T.astype(float)).astype(np.int64) if top < EXACT else x @ c.T
    return (x * x).sum(axis=1)[:, None] - 2 * cross + (c * c).sum(axis=1)


def _nearest(distances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label, distance); the smaller number wins a tie."""
    label = distances.argmin(axis=1)
    return label.astype(np.int32), distances[np.arange(len(label)), label]


class Shards:
    """Cells keyed by (chunk, block); a block's cells share partitions, and labels are sent to them."""

    def __init__(self, cells: DataFrame, blocks: int, parts: int):
        self.blocks, self.each = blocks, max(1, parts // blocks)
        blocks_, each = self.blocks, self.each

        def place(key: tuple[int, int]) -> int:
            chunk, block = key
            return block * each + (chunk ^ (chunk >> 33)) % each

        self.place, self.parts, self.context = place, blocks_ * each, cells.sparkSession.sparkContext
        keyed = cells.select("chunk", "block", "x").rdd.map(lambda r: ((r[0], r[1]), bytes(r[2])))
        self.cells = keyed.partitionBy(self.parts, place)

    def _slices(self, centroids: np.ndarray):
        return self.context.broadcast([centroids[:, c : c + COLUMNS] for c in range(0, centroids.shape[1], COLUMNS)])

    def labels(self, centroids: np.ndarray) -> RDD:
        """(chunk, (labels, distances)) of all rows."""
        slices = self._slices(centroids)

        def partial(cell):
            (chunk, block), raw = cell
            c = slices.value[block]
            return chunk, squared_distances(np.frombuffer(raw, "<i4").reshape(-1, c.shape[1]), c)

        return self.cells.map(partial).reduceByKey(np.add, self.parts, lambda chunk: chunk ^ (chunk >> 33)).mapValues(_nearest)

    def updated(self, centroids: np.ndarray) -> np.ndarray:
        """Centroids after one round: exact floored means, empty ones as they were."""
        k, blocks = len(centroids), self.blocks
        sent = self.labels(centroids).flatMap(lambda kv: [((kv[0], b), kv[1][0]) for b in range(blocks)])
        both = sent.partitionBy(self.parts, self.place).union(self.cells)
        if both.getNumPartitions() != self.cells.getNumPartitions():
            raise RuntimeError("labels and cells are not dealt alike")

        def added(rows: Iterator[tuple]) -> Iterator[tuple]:
            waiting: dict[tuple, object] = {}
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for key, value in rows:
                other = waiting.pop(key, None)
                if other is None:
                    waiting[key] = value
                    continue
                raw, label = (value, other) if isinstance(value, bytes) else (other, value)
                x = np.frombuffer(raw, "<i4").reshape(len(label), -1)
                if key[1] not in sums:
                    sums[key[1]] = np.zeros((k, x.shape[1]), np.int64), np.zeros(k, np.int64)
                total, count = sums[key[1]]
                np.add.at(total, label, x)
                count += np.bincount(label, minlength=k)
            if waiting:
                raise RuntimeError("a cell has no labels")
            yield from sums.items()

        merged = both.mapPartitions(added).reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), self.blocks)

        def moved(entry):
            block, (total, count) = entry
            old = centroids[:, block * COLUMNS : (block + 1) * COLUMNS]
            return block, np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], old)

        slices = dict(merged.map(moved).collect())  # one slice of all centroids per block of columns
        return np.concatenate([slices[b] for b in range(blocks)], axis=1) if slices else centroids


def first_centroids(cells: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<id>``, by ascending hash.

    Hashes are sorted without vectors; then the ``k`` places are broadcast to the chunks.
    """
    ids = cells.where("block = 0").select("chunk", F.posexplode("ids").alias("row", "id")).where("id IS NOT NULL")
    sha = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    chosen = ids.select(sha.alias("sha"), "chunk", "row").orderBy("sha", "chunk", "row").limit(k)
    found: dict[tuple, dict[int, bytes]] = {}
    for sha, chunk, row, block, x in cells.join(F.broadcast(chosen), "chunk").select(
        "sha", "chunk", "row", "block", F.expr("substring(x, row * (length(x) div n) + 1, length(x) div n)")
    ).collect():
        found.setdefault((sha, chunk, row), {})[block] = bytes(x)
    rows = [np.frombuffer(b"".join(found[at][b] for b in sorted(found[at])), "<i4") for at in sorted(found)]
    return np.stack(rows).astype(np.int64) if rows else np.zeros((0, 0), np.int64)


def centroid_clusters(
    df: DataFrame, k: int, rounds: int, width: int, scale: int = 256, seed: int = 2,
    vec_id: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that takes part.

    Vectors of exactly ``width`` components, none NULL or non-finite, take part as whole numbers
    floor(scale * component); other columns are ignored. The first centroids are the ``k`` vectors with the
    smallest hash of their id (fewer, if there are fewer; rows with one id start one centroid each, those stored
    first before others; a NULL id starts none but is assigned). After ``rounds`` rounds all vectors are assigned once more. An empty table, or
    one without any id, gives an empty result. Components above 2^26 after scaling raise an error, as
    do models of more than ``MODEL`` numbers. The rows are read once and stored in chunks.
    """
    if k * width > MODEL:
        raise ValueError(f"the centroids hold more than {MODEL} numbers")
    spark = df.sparkSession
    cells = cut_lineage(whole_vectors(df, vec_id, vector, width, scale))
    centroids = first_centroids(cells, k, seed)
    told = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id long, cluster int, distance long, {told.split(', ', 1)[1]}")
    shards = Shards(cells, -(-width // COLUMNS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(rounds):
        centroids = shards.updated(centroids)
    labels = shards.labels(centroids).map(lambda kv: (kv[0], kv[1][0].tolist(), kv[1][1].tolist()))
    named = spark.createDataFrame(labels, "chunk long, cluster array<int>, distance array<long>")
    rows = named.join(cells.where("block = 0").select("chunk", "ids"), "chunk")
    rows = stored(
        rows.select(F.inline(F.arrays_zip(F.col("ids").alias("vec_id"), "cluster", "distance")))
    )
    sums = dict(rows.groupBy("cluster").agg(F.sum("distance")).collect())  # k rows at most
    total = sum(sums.values())
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    model = spark.createDataFrame([(c, sums[c], total, shas[c]) for c in sums], told)
    return rows.join(F.broadcast(model), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
