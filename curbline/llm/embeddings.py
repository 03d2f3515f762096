"""Near-duplicate vectors: spherical k-means cells, pruned blocks of cosine products, one vector kept per group."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from curbline.llm.common import components, release, stored

MAX_SAMPLE = 20_000  # bound of the sample that the cell centres are fitted on
MAX_CELLS = 4_096  # bound of the centres that are broadcast
CELL_ROWS = 2_048  # vectors a cell is meant to hold
BLOCK = 2_048  # vectors of one side of a product, at most
SLAB = 128  # vectors of the left side that share one bound between two cells, at most
SLABS = np.concatenate([[0, 16, 48], np.arange(112, 1 << 22, SLAB)])  # where they begin: the nearest meet the most
LEAD = 24  # leading components that are compared first
CHUNK_ROWS, CHUNK_BYTES = 32_768, 1 << 23  # bounds of the vectors that travel together
PART_CHUNKS = 2  # chunks of one partition: a task meets the square of it
ROUNDS = 8


def _filled(column: pa.Array, width: int) -> np.ndarray:
    """Vectors in double precision, short ones ending in zeros; NULL components are NaN, NULL vectors zero."""
    n = len(column)
    out, sizes = np.zeros((n, width)), np.asarray(pa.compute.list_value_length(column).fill_null(0))
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # NULL components become NaN
    row = np.repeat(np.arange(n), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors in double precision, usable): NULL or zero vectors and those that hold NULL or
    non-finite components are not usable. Each row is scaled by itself, so its bits never depend on others."""
    out = vectors.astype(np.float64)
    good = np.isfinite(out).all(axis=1)
    out[~good] = 0
    top = np.abs(out).max(axis=1, initial=0.0)
    good &= top > 0
    out /= np.where(top > 0, top, 1)[:, None]  # no overflow in the squares
    norm = np.sqrt((out * out).sum(axis=1))
    return out / np.where(norm > 0, norm, 1)[:, None], good


def unit_vectors(df: DataFrame, vec_id: str, vector: str, width: int, kind: str = "f8", with_vectors: bool = True) -> DataFrame:
    """(id, key, v): usable vectors as stored, as ``width`` numbers of ``kind`` in binary, and a hash of 128 bits
    that bit-equal unit vectors share. Without ``with_vectors`` (id, key) alone."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = _filled(batch.column(1), width)
            unit, good = _unit(raw)
            keys = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in unit[good]]
            out = [batch.column(0).filter(pa.array(good)), pa.array(keys, pa.binary())]
            if with_vectors:
                out.append(pa.array([r.tobytes() for r in raw[good].astype(kind)], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["id", "key", "v"][: len(out)])

    schema = "id long, key binary" + ", v binary" * with_vectors
    return df.select(F.col(vec_id).cast("long").alias("id"), vector).mapInArrow(keyed, schema)


def _matrix(column: pa.Array, width: int, kind: str = "f8") -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def fit_centres(
    classes: DataFrame, width: int, cells: int, kind: str = "f8", seed: int = 11
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spherical k-means on the ``MAX_SAMPLE`` vectors with the smallest id hash: (centres, vectors of the sample
    that each is the nearest of, the sample's ``LEAD`` principal directions as orthonormal columns)."""
    sample = classes.orderBy(F.xxhash64("id"), "id", "key").limit(MAX_SAMPLE).select("v").toArrow()
    x, rng = _unit(_matrix(sample["v"].combine_chunks(), width, kind))[0], np.random.default_rng(seed)
    if not len(x):
        return np.eye(1, width), np.zeros(1, np.int64), np.eye(width, min(LEAD, width))
    centres = x[rng.choice(len(x), min(cells, len(x)), replace=False)]

    def nearest() -> np.ndarray:
        return np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])

    for _ in range(ROUNDS):
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest(), x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.where(norm > 1e-9, norm, 1), centres)
    moved = x - x.mean(axis=0)
    lead = np.linalg.eigh(moved.T @ moved)[1][:, ::-1][:, :LEAD]
    return centres, np.bincount(nearest(), minlength=len(centres)), lead


def chunked(classes: DataFrame, centres: np.ndarray, held: np.ndarray, width: int, kind: str, rows: int) -> DataFrame:
    """(chunk, ids, copies, cells, v): the vectors once, about ``rows`` of neighbouring cells in a row, sorted by cell.

    A vector's cell is the centre with the largest cosine. The sample's vectors per cell, ``held``, tell how
    cells share the chunks; a cell larger than a chunk is dealt over several by the hash of the ids.
    """
    total = classes.count()
    parts, share = max(1, -(-total // rows)), held / max(1, held.sum())
    shared = classes.sparkSession.sparkContext.broadcast((centres.astype(np.float32), np.cumsum(share) - share, share))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, first, part_of = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                unit = _unit(_matrix(part.column(2), width, kind))[0]
                cell = (unit.astype(np.float32) @ c.T).argmax(axis=1)
                mixed = part.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                spread = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(11)
                spot = first[cell] + part_of[cell] * (spread.astype(np.float64) / 2.0**53)
                dealt = np.clip((spot * parts).astype(np.int64), 0, parts - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(dealt), pa.array(cell.astype(np.int32)), *part.columns], ["part", "cell", "id", "copies", "v"]
                )

    def packed(table: pa.Table) -> pa.Table:
        table, part, n = table.sort_by("cell"), table.column("part")[0].as_py(), table.num_rows
        pieces, found = max(1, round(n / rows)), []
        for k in range(pieces):
            piece = table.slice(k * n // pieces, (k + 1) * n // pieces - k * n // pieces)
            numbers = [piece.column(name).to_numpy().tobytes() for name in ("id", "copies", "cell")]
            found.append((part * (1 << 20) + k, *numbers, b"".join(piece.column("v").to_pylist())))
        kinds = [pa.int64()] + [pa.binary()] * 4
        return pa.Table.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*found, strict=True), kinds, strict=True)], ["chunk", "ids", "copies", "cells", "v"]
        )

    dealt = classes.select("id", "copies", "v").mapInArrow(placed, "part long, cell int, id long, copies long, v binary")
    return dealt.groupBy("part").applyInArrow(packed, "chunk long, ids binary, copies binary, cells binary, v binary")


def _trees(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of pairs (a, b) of numbers below ``n`` that connect all that the pairs connect, tree of each number).

    In each round every tree hooks its root onto the lowest root it has a pair with.
    """
    root, left, kept = np.arange(n), np.arange(len(a)), []
    while len(left):
        x, y = root[a[left]], root[b[left]]
        apart = x != y
        left, low, high = left[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        if not len(left):
            break
        order = np.lexsort((low, high))
        first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
        kept.append(left[first])
        up = np.arange(n)
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64), root


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Places of pairs (a, b) of numbers below ``n`` that connect all that the pairs connect."""
    return _trees(a, b, n)[0]


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of true places that connect the rows and columns which all true places connect."""
    n, m = hit.shape
    if np.count_nonzero(hit) <= 4 * (n + m):
        a, b = np.nonzero(hit)
    else:  # the first place of each row and column, then what lies between their trees
        i, j = np.flatnonzero(hit.any(axis=1)), np.flatnonzero(hit.any(axis=0))
        a, b = np.concatenate([i, hit.argmax(axis=0)[j]]), np.concatenate([hit.argmax(axis=1)[i], j])
        root = _trees(a, n + b, n + m)[1].astype(np.int32)
        more_a, more_b = np.nonzero(hit & (root[:n, None] != root[None, n:]))
        a, b = np.concatenate([a, more_a]), np.concatenate([b, more_b])
    tree = forest(a, n + b, n + m)
    return a[tree], b[tree]


class Chunk:
    """Vectors of neighbouring cells, in single precision, and as stored.

    ``lead`` holds minus half the square of a vector's leading components, 1 and these components: with the first
    two changed about on one side, a product of rows is minus half the squared distance in leading components.
    """

    def __init__(self, ids: bytes, copies: bytes, cells: bytes, v: bytes, centres: np.ndarray, lead: np.ndarray, kind: str):
        self.ids, self.copies = np.frombuffer(ids, np.int64), np.frombuffer(copies, np.int64)
        self.raw, cell = np.frombuffer(v, kind).reshape(-1, centres.shape[1]), np.frombuffer(cells, np.int32)
        self.x = np.empty(self.raw.shape, np.float32)
        for at in range(0, len(cell), 2048):
            self.x[at : at + 2048] = _unit(self.raw[at : at + 2048])[0]
        self.cells, self.starts = np.unique(cell, return_index=True)
        self.ends = np.append(self.starts[1:], len(cell))
        self.own = np.einsum("ij,ij->i", self.x, centres[cell])
        self.links = np.zeros(len(cell), np.int64)
        z = self.x @ lead
        self.lead = np.hstack([-(z * z).sum(axis=1, keepdims=True) / 2, np.ones((len(z), 1), np.float32), z])


class Products:
    """Links between the vectors of chunks: counted per vector, with pairs that span what they connect.

    With x, y unit vectors, x in cell i, y in cell j: (x(c_i - c_j)) + (y(c_j - c_i)) <= |x - y| |c_i - c_j|, and
    |x - y| <= sqrt(2 - 2 cosine) if they are linked. So a link needs both sides near the border of their cells,
    and near in sum: the sides are sorted by that distance, and each ``SLAB`` of the left one meets only the
    right ones within the bound. It holds for any centres and loses no link. What is left is compared in its
    leading components first, whose distance is no larger than that of the vectors, as long as that saves work.
    Products are taken in single precision; those within its error of ``cosine`` are taken again in double
    precision.
    """

    def __init__(self, centres: np.ndarray, lead: np.ndarray, cosine: float, reach: float | None):
        self.centres, self.cosine, self.reach = centres.astype(np.float32), cosine, reach
        self.lead, self.tried, self.failed = lead.astype(np.float32), 0, 0
        self.error = 1.2e-7 * (centres.shape[1] + 16)
        self.bound = np.sqrt(2 - 2 * cosine) + 1e-9
        self.apart = -(self.bound**2) / 2 - 8 * self.error
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []

    def gaps(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.centres[i].astype(np.float64), self.centres[j].astype(np.float64)
        return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T) + 1e-12)

    def meet(self, left: Chunk, right: Chunk) -> None:
        """All links between two chunks, or within one."""
        self.tried = self.failed = 0
        beyond = left.own - self.centres[right.cells] @ left.x.T  # per cell of the right, how far x lies from it
        back = right.own - self.centres[left.cells] @ right.x.T
        least = np.minimum.reduceat(beyond, left.starts, axis=1).T
        least_back = np.minimum.reduceat(back, right.starts, axis=1)
        gaps = self.gaps(left.cells, right.cells)
        limit = (self.bound * gaps + 4 * self.error).astype(np.float32)
        same = left.cells[:, None] == right.cells
        near = same | (least + least_back <= limit)
        if left is right:
            near &= left.cells[:, None] <= right.cells
        edges = []
        for i, j in zip(*np.nonzero(near), strict=True):
            x, y = np.arange(left.starts[i], left.ends[i]), np.arange(right.starts[j], right.ends[j])
            if same[i, j]:
                step = min(BLOCK, 256) if left is right else BLOCK
                for at in range(0, len(x), step):
                    block = x[at : at + step]
                    if left is right:
                        self.tiles(left, right, block, block, edges, True)
                    self.tiles(left, right, block, y[at + step :] if left is right else y, edges, False)
                continue
            far, far_back = beyond[j, x], back[i, y]
            take, take_back = far <= limit[i, j] - least_back[i, j], far_back <= limit[i, j] - least[i, j]
            if self.reach is not None:  # the one with the higher home visits the lower cell only within reach
                visit = self.reach * gaps[i, j] + 4 * self.error
                if left.cells[i] > right.cells[j]:
                    take &= far <= visit
                else:
                    take_back &= far_back <= visit
            x, y = x[take], y[take_back]
            far, far_back = far[take], far_back[take_back]
            order, order_back = far.argsort(), far_back.argsort()
            far, far_back = far.take(order), far_back.take(order_back)
            starts = SLABS[: np.searchsorted(SLABS, len(x))]
            ends = np.searchsorted(far_back, limit[i, j] - far.take(starts), "right")
            slabs = np.count_nonzero(ends)
            if not slabs:
                continue
            x, y = x.take(order[: SLABS[slabs]]), y.take(order_back[: ends[0]])
            first = self.first(left)
            u, v, bound = (left.lead, right.lead, self.apart) if first else (left.x, right.x, self.cosine - self.error)
            u, v = u.take(x, axis=0), v.take(y, axis=0)
            if first:
                v[:, :2] = v[:, 1::-1]
            for at, to, n in zip(SLABS, SLABS[1:], ends[:slabs], strict=False):
                self.tried += first
                if (u[at:to] @ v[:n].T).max() >= bound:
                    self.failed += first
                    self.tiles(left, right, x[at:to], y[:n], edges, False)
        if edges:
            a, b = (np.concatenate(e) for e in zip(*edges, strict=True))
            tree = forest(a, b if left is right else b + len(left.ids), len(left.ids) + len(right.ids))
            self.a.append(left.ids[a[tree]])
            self.b.append(right.ids[b[tree]])

    def first(self, left: Chunk) -> bool:
        """Whether leading components are worth their own product: few components less, or many failures, are not."""
        return 2 * left.lead.shape[1] <= left.x.shape[1] and 2 * self.failed <= self.tried + 100

    def tiles(self, left: Chunk, right: Chunk, x: np.ndarray, y: np.ndarray, edges: list, upper: bool) -> None:
        """Links of the places ``x`` with the places ``y``; with ``upper`` only those with a larger place."""
        u = left.x[x]
        for at in range(0, len(y), BLOCK):
            rows = y[at : at + BLOCK]
            score = u @ right.x[rows].T
            if score.max() < self.cosine - self.error:
                continue
            if not upper and score.min() >= self.cosine + self.error:  # all are linked
                left.links[x] += right.copies[rows].sum()
                right.links[rows] += left.copies[x].sum()
                edges.append((np.concatenate([np.full(len(rows), x[0]), x[1:]]), np.append(rows, np.full(len(x) - 1, rows[0]))))
                continue
            hit, low = score >= self.cosine + self.error, score >= self.cosine - self.error
            if np.count_nonzero(low) > np.count_nonzero(hit):
                i, j = np.nonzero(low & ~hit)
                for k in range(0, len(i), 1 << 14):
                    p, q = i[k : k + (1 << 14)], j[k : k + (1 << 14)]
                    exact = (_unit(left.raw[x[p]])[0] * _unit(right.raw[rows[q]])[0]).sum(axis=1)
                    hit[p, q] = exact >= self.cosine
            if upper:
                hit &= x[:, None] < rows
            if not hit.any():
                continue
            if 16 * np.count_nonzero(hit) <= hit.size:
                i, j = np.nonzero(hit)
                np.add.at(left.links, x[i], right.copies[rows[j]])
                np.add.at(right.links, rows[j], left.copies[x[i]])
            else:
                some = hit.astype(np.float64)
                left.links[x] += (some @ right.copies[rows].astype(np.float64)).astype(np.int64)
                right.links[rows] += (left.copies[x].astype(np.float64) @ some).astype(np.int64)
            a, b = spanning(hit)
            edges.append((x[a], rows[b]))


def links(
    chunks: DataFrame, centres: np.ndarray, lead: np.ndarray, cosine: float, kind: str, reach: float | None = None
) -> DataFrame:
    """(kind, a, b): kind 0 adds b links to vector a, kind 1 is an edge (a, b) of a spanning forest.

    Each two chunks meet once, by a Cartesian product of partitions that are read where they are stored: no
    vector is shuffled or copied to disk for it, however many cells it has to meet. A task returns a count per
    vector and spanning forests, so pairs never leave it however many vectors are alike.
    """
    names = ["chunk", "ids", "copies", "cells", "v"]
    sides = [chunks.select(*[F.col(n).alias(f"{side}_{n}") for n in names]) for side in ("l", "r")]
    low, high = F.least("l_chunk", "r_chunk"), F.greatest("l_chunk", "r_chunk")
    # one of the two orders of a pair, dealt by a hash, so that no part of the product has them all
    once = (F.col("l_chunk") < F.col("r_chunk")) == (F.pmod(F.xxhash64(low, high), F.lit(2)) == 0)
    met = sides[0].hint("shuffle_replicate_nl").join(sides[1], (F.col("l_chunk") == F.col("r_chunk")) | once)
    shared = chunks.sparkSession.sparkContext.broadcast((centres, lead))

    def rows(number: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        kinds = pa.array(np.full(len(a), number), pa.int32())
        return pa.RecordBatch.from_arrays([kinds, pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["kind", "a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, held = Products(*shared.value, cosine, reach), {}

        def counted(chunk: Chunk) -> pa.RecordBatch:
            some = np.flatnonzero(chunk.links)
            return rows(0, chunk.ids[some], chunk.links[some])

        for batch in batches:
            for k in range(batch.num_rows):
                pair = []
                for side in (0, len(names)):
                    number = batch.column(side)[k].as_py()
                    if number in held:
                        held[number] = held.pop(number)  # used last
                    else:
                        cells = [batch.column(side + c)[k].as_py() for c in range(1, len(names))]
                        held[number] = Chunk(*cells, products.centres, products.lead, kind)
                    pair.append(held[number])
                products.meet(*pair)
                while len(held) > PART_CHUNKS + 2:
                    yield counted(held.pop(next(iter(held))))
                if products.a:
                    yield rows(1, np.concatenate(products.a), np.concatenate(products.b))
                    products.a, products.b = [], []
        for chunk in held.values():
            yield counted(chunk)

    return met.mapInArrow(compare, "kind int, a long, b long")


def near_duplicates(
    df: DataFrame, cosine: float = 0.95, vec_id: str = "vec_id", vector: str = "embedding", reach: float | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``df``; other columns are ignored.

    Bit-equal unit vectors are one class with its smallest id and number of copies. Classes go through
    cells and block products; links count the copies. NULL ids and unusable vectors (NULL, zero, with NULL
    or non-finite components) link with nothing; shorter vectors count as filled up with zeros. Rows that
    share an id are one vertex. ``kept`` marks the smallest id of each component. Without a ``reach`` no
    link is lost; data without any cluster structure then cost a share of all products that falls slowly
    with the number of cells. A ``reach`` below sqrt(2 - 2 cosine) compares a vector with those of a lower cell
    only if it lies so near to it, and may lose links near cell borders. Vectors are stored twice at most,
    as wide as ``df`` has them.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    kind = "f4" if isinstance(rows.schema["v"].dataType.elementType, FloatType) else "f8"
    width = max(rows.agg(F.max(F.size("v"))).first()[0] or 1, 1)
    usable = rows.where("id IS NOT NULL")
    units = unit_vectors(usable, "id", "v", width, kind)
    classes = stored(units.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    release(spark)
    total = classes.count()
    cells = min(MAX_CELLS, max(1, -(-total // CELL_ROWS)))
    centres, held, lead = fit_centres(classes, width, cells, kind)
    # at least so many chunks that all cores meet some of their products
    side = math.ceil(math.sqrt(16 * spark.sparkContext.defaultParallelism))
    fit = max(1, min(CHUNK_ROWS, CHUNK_BYTES // (width * np.dtype(kind).itemsize)))
    size = min(fit, max(CELL_ROWS, -(-total // side)))
    chunks = chunked(classes, centres, held, width, kind, size)
    release(spark)  # the shuffle of the classes, if it is still there
    chunks = stored(chunks.coalesce(max(side, -(-total // (size * PART_CHUNKS)))))
    release(spark)
    found = stored(links(chunks, centres, lead, cosine, kind, reach))
    del chunks
    release(spark)
    groups = components(found.where("kind = 1").select("a", "b"))
    others = found.where("kind = 0").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("others"))
    # classes that link or have copies; all other vectors stand alone
    told = classes.select("key", F.col("id").alias("class"), "copies").join(others, "class", "left")
    told = told.join(groups.withColumnRenamed("id", "class"), "class", "left")
    told = stored(told.where("copies > 1 OR others IS NOT NULL OR component IS NOT NULL"))
    del classes, found, groups, others
    release(spark)
    told = unit_vectors(usable, "id", "v", width, with_vectors=False).join(told, "key").groupBy("id").agg(
        F.sum(F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.min(F.coalesce("component", "class")).alias("c"),
    )
    return (
        rows.select("id")
        .join(told, "id", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("c", "id").alias("component_id"),
            F.coalesce(F.coalesce("c", "id") == F.col("id"), F.lit(True)).alias("kept"),
        )
    )
