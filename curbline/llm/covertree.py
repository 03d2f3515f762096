"""Hard negatives by exact search in cover trees over norm-augmented rows.

With M the largest length, a row x is seen as (x, sqrt(M^2 - |x|^2)) and an anchor q as (q, 0). All rows then
have length M, and |q - x|^2 = |q|^2 + M^2 - 2 q.x, so a ball of rows bounds their inner products with q from
both sides. The top of the tree is a set of centres that all rows are dealt to; below it a task builds the levels
of its own rows: every level's centres are further apart than its radius, and each node knows the
covering radius of what it holds. A search goes through nodes from the best bound on, skips those outside its
window of scores or below what it has already found, and verifies the rows of a leaf by exact whole products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbline.llm.vectorrows import dense, matrix, packed, smallest_hashes, whole_products, widest
from curbline.session import cut_lineage

SAMPLE_IDS = 2_048  # ids whose rows the centres of the top are taken from
CENTRES = 256  # bound of the top's centres, which are broadcast
BLOCK = 2_048  # rows of one tree, on average
ASKED = 4_096  # windows that meet a tree at once, on average
LEAF = 32  # rows that a leaf is meant to hold
BASE = 1.3  # ratio of the radii of two levels
SLACK = 1e-9  # relative, for the rounding of bounds
ROW = "uid long, id long, label long, x binary, cell int, far double"


def _augmented(x: np.ndarray, longest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, longest**2 - (x * x).sum(axis=1)))])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    return np.sqrt(np.maximum(square, 0.0))


def bounds(distance: np.ndarray, radius: np.ndarray, length: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) inner product of anchors (rows) with what nodes (columns) hold."""
    size = (length**2 + longest**2)[:, None]
    slack = SLACK * (size + 1) + 1e-6
    low = (size - (distance + radius) ** 2) / 2 - slack
    high = (size - np.maximum(0.0, distance - radius) ** 2) / 2 + slack
    # nothing is longer than the longest row
    most = (length * longest)[:, None] + slack
    return np.maximum(low, -most), np.minimum(high, most)


@dataclass
class Level:
    centre: np.ndarray  # augmented
    radius: np.ndarray  # covering radius of all rows below each node
    parent: np.ndarray  # place in the level above


def spread_order(y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, gap of each to the earlier ones, nearest place number of every row): a farthest-first order
    that ends at ``most`` places or once every row is one of them."""
    near, own = np.full(len(y), np.inf), np.zeros(len(y), np.int64)
    places, gaps = [], []
    at = 0
    while len(places) < most:
        gap = near[at]
        if gap <= 0:
            break
        d = _distances(y, y[at : at + 1])[:, 0]
        d[at] = 0.0
        closer = d < near
        own[closer], near[closer] = len(places), d[closer]
        places.append(at)
        gaps.append(gap)
        at = int(near.argmax())
    return np.array(places, np.int64), np.array(gaps), own


def build(y: np.ndarray) -> tuple[list[Level], np.ndarray]:
    """(levels from the root down, leaf of every row) over augmented rows."""
    places, gaps, leaf = spread_order(y, max(1, -(-len(y) // LEAF)))
    # a level's centres are those whose gap to the earlier ones is larger than its radius
    cuts, radius = {1, len(places)}, gaps[1] if len(gaps) > 1 else 0.0
    for _ in range(64):
        radius /= BASE
        held = int((gaps > radius).sum())
        if held >= len(places):
            break
        cuts.add(held)
    cuts = sorted(cuts)
    levels: list[Level] = []
    below, node = [], leaf
    for at in range(len(cuts) - 1, -1, -1):
        centre = y[places[: cuts[at]]]
        if at < len(cuts) - 1:
            up = _distances(y[places[: cuts[at + 1]]], centre).argmin(axis=1)
            below.append(up)
            node = up[node]
        far = np.zeros(len(centre))
        np.maximum.at(far, node, np.sqrt(((y - centre[node]) ** 2).sum(axis=1)))
        levels.append(Level(centre, far, np.zeros(len(centre), np.int64)))
    levels.reverse()
    for level, up in zip(levels[1:], reversed(below), strict=True):
        level.parent = up
    return levels, leaf


@dataclass
class Windows:
    """Searches: the ``k`` best rows by score within [low, high], of the anchor's label or of all others."""

    q: np.ndarray
    uid: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    floor: np.ndarray  # what is already known to be found: k rows with this score or more


def search(x: np.ndarray, uid: np.ndarray, ids: np.ndarray, label: np.ndarray, w: Windows, longest: float, k: int, same: bool):
    """(window, row, score) of the ``k`` best rows of each window, by falling score and rising id."""
    levels, leaf = build(_augmented(x, longest))
    length = np.sqrt((w.q * w.q).sum(axis=1))
    anchors = np.column_stack([w.q, np.zeros(len(w.q))])
    open_ = np.ones((len(w.q), 1), bool)
    for i, level in enumerate(levels):
        open_ = open_ if i == 0 else open_[:, level.parent]
        low, high = bounds(_distances(anchors, level.centre), level.radius, length, longest)
        open_ = open_ & (low <= w.high[:, None]) & (high >= np.maximum(w.low, w.floor)[:, None])
    order = np.argsort(-np.where(open_, high, -np.inf), axis=1, kind="stable")
    members = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[members], np.arange(len(levels[-1].centre) + 1))
    best = np.full((len(w.q), k), -np.inf)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    left = np.arange(len(w.q))
    for wave in range(order.shape[1]):
        node = order[left, wave]
        least = np.maximum(np.maximum(w.low, w.floor), best[:, -1])[left]
        going = open_[left, node]
        left, node, least = left[going], node[going], least[going]
        # nodes come by falling bound, so a search whose next node is too low has ended
        keep = high[left, node] >= least
        left, node = left[keep], node[keep]
        if not len(left):
            break
        for leaf_no in np.unique(node):
            rows, who = members[starts[leaf_no] : starts[leaf_no + 1]], left[node == leaf_no]
            score = whole_products(w.q[who], x[rows])
            good = (label[rows] == w.label[who][:, None]) == same
            good &= (uid[rows] != w.uid[who][:, None]) & (score >= w.low[who][:, None]) & (score <= w.high[who][:, None])
            good &= score >= np.maximum(w.floor, best[:, -1])[who][:, None]
            i, j = np.nonzero(good)
            if len(i):
                found.append((who[i], rows[j], score[i, j]))
                both = np.concatenate([best[who], np.where(good, score, -np.inf)], axis=1)
                best[who] = -np.sort(-both, axis=1)[:, :k]
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    who, rows, score = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((ids[rows], -score, who))
    who, rows, score = who[order], rows[order], score[order]
    first = np.searchsorted(who, who, "left")
    top = np.arange(len(who)) - first < k
    return who[top], rows[top], score[top]


def labelled_rows(df: DataFrame, vec_id: str, vector: str, label: str, scale: int) -> tuple[DataFrame, int]:
    """((uid, id, label, x), width): rows that take part, as floor(scale * component), stored and numbered."""
    width = widest(df, vector)

    def floored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = dense(batch.column(2), width)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(keep), batch.column(1).filter(keep), packed(np.floor(scale * x[good]))],
                ["id", "label", "x"],
            )

    given = df.select(
        F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")
    ).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = given.mapInArrow(floored, "id long, label long, x binary")
    return cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id())), width


class Forest:
    """All rows as trees: dealt to the centres of the top, and within a centre to blocks by hash."""

    def __init__(self, rows: DataFrame, width: int):
        self.spark, self.width = rows.sparkSession, width
        self.longest = self._longest(rows)
        centres = self._centres(rows)
        self.centres = self.spark.sparkContext.broadcast(_augmented(centres, self.longest))
        self.rows = cut_lineage(self._dealt(rows))
        # at most CENTRES rows: how far a centre's rows lie, and their blocks
        held = self.rows.groupBy("cell").agg(F.max("far"), F.count(F.lit(1))).collect()
        self.radius = np.full(len(centres), -1.0)
        self.blocks = {}
        for cell, far, n in held:
            self.radius[cell], self.blocks[cell] = far, -(-n // BLOCK)

    def _longest(self, rows: DataFrame) -> float:
        width = self.width

        def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(0), width)
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max(initial=0.0))])], ["s"])

        found = rows.select("x").mapInArrow(longest, "s double").agg(F.max("s")).first()[0]
        return float(np.sqrt(found or 0.0))

    def _centres(self, rows: DataFrame) -> np.ndarray:
        different = smallest_hashes(rows, "id", SAMPLE_IDS, 13).select("x").distinct()
        few = matrix(different.orderBy(F.xxhash64("x"), "x").limit(SAMPLE_IDS).toArrow()["x"], self.width)
        wanted = min(CENTRES, -(-rows.count() // BLOCK))
        places, _, _ = spread_order(_augmented(few, self.longest), max(1, wanted)) if len(few) else ([], None, None)
        return few[places] if len(few) else np.zeros((1, self.width))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        width, longest, shared = self.width, self.longest, self.centres

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                y = _augmented(matrix(batch.column(3), width), longest)
                d = _distances(y, shared.value)
                cell = d.argmin(axis=1)
                far = np.sqrt(((y - shared.value[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(cell, pa.int32()), pa.array(far)], ["uid", "id", "label", "x", "cell", "far"]
                )

        return rows.select("uid", "id", "label", "x").mapInArrow(nearest, ROW)

    def _visits(self, windows: DataFrame, home: bool) -> DataFrame:
        """``windows`` once per cell they visit: that with the best bound, or all others their window allows."""
        width, longest, shared, radius = self.width, self.longest, self.centres, self.radius
        names = windows.columns

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = matrix(batch.column("x"), width)
                low, high, floor = (batch.column(c).to_numpy() for c in ("low", "high", "floor"))
                anchors = np.column_stack([q, np.zeros(len(q))])
                least, most = bounds(_distances(anchors, shared.value), radius, np.sqrt((q * q).sum(axis=1)), longest)
                inside = (radius >= 0) & (least <= high[:, None]) & (most >= low[:, None])
                best = np.where(inside, np.minimum(most, high[:, None]) - 1e-9 * np.arange(len(radius)), -np.inf).argmax(axis=1)
                first = np.zeros_like(inside)
                first[np.arange(len(q)), best] = True
                go = inside & first if home else inside & ~first & (most >= floor[:, None])
                row, cell = np.nonzero(go)
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(row)) for c in names], pa.array(cell, pa.int32())], [*names, "cell"]
                )

        return windows.mapInArrow(placed, f"{_ddl(windows)}, cell int")

    def _searched(self, windows: DataFrame, groups: int, k: int, home: bool, same: bool) -> DataFrame:
        width, longest = self.width, self.longest
        # one frame per side, as both sides of the cogroup may not come from one frame
        counts, again = (self.spark.createDataFrame(list(self.blocks.items()), "cell int, blocks int") for _ in range(2))
        visits = (
            self._visits(windows, home)
            .join(F.broadcast(counts), "cell")
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("group", F.pmod(F.xxhash64("wid"), F.lit(groups)).cast("int"))
        )
        trees = (
            self.rows.join(F.broadcast(again), "cell")
            .withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
            .withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        )

        def look(tree: pa.Table, asked: pa.Table) -> pa.Table:
            out: tuple = ([], [], [])
            if tree.num_rows and asked.num_rows:
                uid, ids, label = (tree.column(c).to_numpy() for c in ("uid", "id", "label"))
                w = Windows(
                    matrix(asked.column("x"), width),
                    *[asked.column(c).to_numpy() for c in ("uid", "label", "low", "high", "floor")],
                )
                x = matrix(tree.column("x"), width)
                who, rows, score = search(x, uid, ids, label, w, longest, k, same)
                out = (asked.column("wid").to_numpy()[who], ids[rows], score)
            return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("wid", "vec_id", "score"), out, strict=True)})

        key = ("cell", "block", "group")
        sides = trees.groupBy(*key).cogroup(visits.groupBy(*key))
        return sides.applyInArrow(look, "wid long, vec_id long, score long")

    def best(self, windows: DataFrame, k: int, same: bool) -> DataFrame:
        """(wid, vec_id, score, rank): the ``k`` best rows of every window, ties by the smaller id.

        ``windows``: (wid, uid, label, x, low, high). A window first searches the cell with the best bound; the
        score it then has at rank ``k`` keeps it away from cells that cannot do better.
        """
        groups = max(1, -(-windows.count() // ASKED))
        order = Window.partitionBy("wid").orderBy(F.col("score").desc(), "vec_id")
        start = windows.withColumn("floor", F.lit(float("-inf")))
        first = cut_lineage(self._searched(start, groups, k, home=True, same=same))
        ranked = first.withColumn("rank", F.row_number().over(order))
        floors = ranked.where(F.col("rank") == k).select("wid", F.col("score").cast("double").alias("floor"))
        again = windows.join(floors, "wid", "left").fillna({"floor": float("-inf")})
        rest = self._searched(again, groups, k, home=False, same=same)
        both = first.unionAll(rest).withColumn("rank", F.row_number().over(order))
        return both.where(F.col("rank") <= k)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def hard_negatives(
    df: DataFrame, anchor: str, positives: int = 5, negatives: int = 10, share: tuple[int, int] = (30, 90),
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), ranks from 1.

    Scores are inner products of whole numbers floor(scale * component). Anchors are the rows that the SQL
    condition ``anchor`` on ``id`` holds for. An anchor's positives are its first ``positives`` other rows of the
    same label by falling score, ties by the smaller id; for each, the first ``negatives`` rows of other
    labels whose score is between both ``share`` percentages of the positive's are returned. A positive with a
    negative score has no such rows; pairs without rows do not occur in the result.

    Rows with a NULL id, label or vector, or with NULL or non-finite components take no part; shorter
    vectors count as filled up with zeros, an empty or zero vector scores 0. Repeated rows are rows of their own: a
    repeated anchor is answered as often and may be its own copy's positive. An empty table gives an empty
    result. The search is exact; components whose products do not fit a long raise an error.
    """
    rows, width = labelled_rows(df, vec_id, vector, label, scale)
    forest = Forest(rows, width)
    anchors = cut_lineage(rows.where(anchor))
    wide = anchors.select(
        F.col("uid").alias("wid"), "uid", "label", "x", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")
    )
    found = forest.best(wide, positives, same=True).select(
        F.col("wid").alias("uid"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")
    )
    pairs = found.join(anchors.select("uid", F.col("id").alias("anchor_id"), "label", "x"), "uid")
    pairs = cut_lineage(pairs.withColumn("wid", F.monotonically_increasing_id()))
    ps = F.col("positive_score")
    windows = pairs.select(
        "wid", "uid", "label", "x",
        F.ceil(F.lit(share[0]) * ps / 100.0).cast("double").alias("low"),
        F.floor(F.lit(share[1]) * ps / 100.0).cast("double").alias("high"),
    ).where("low <= high")
    chosen = forest.best(cut_lineage(windows), negatives, same=False)
    return chosen.join(pairs.select("wid", "anchor_id", "positive_id", "positive_score"), "wid").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"),
    )
