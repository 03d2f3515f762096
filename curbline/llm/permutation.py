"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots. Per block of rows, the inverted file of a pivot is
the list of its ranks in the permutations of all rows of the block. A query walks the files of all pivots and adds
how far its own rank is from each row's: the footrule distance. The rows with the smallest distances are
ranked again by their exact inner product.

Inner products are distances among vectors of one length: a row x is seen as (x, sqrt(M^2 - |x|^2)) with M the
largest length, a query as (q, 0). Only the permutations use that form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.llm.vectorrows import dense, matrix, packed, smallest_hashes, widest
from curbline.session import cut_lineage

PIVOTS = 128  # at most 256, as a rank takes one byte
SAMPLE_IDS = 2_048  # ids whose rows the pivots are taken from
SHARE = 0.25  # of a block that is ranked again, the rows with the smallest footrule distance
LEAST = 256  # rows of a block that are ranked again, at least
BLOCK = 4_096  # rows of a block, on average
ASKED = 4_096  # queries that meet a block at once, on average


def usable_vectors(df: DataFrame, vec_id: str, vector: str, width: int) -> DataFrame:
    """(id, v, length): rows with an id whose vector is finite and not zero."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = dense(batch.column(1), width)
            length = np.sqrt((x * x).sum(axis=1))
            good &= (x != 0).any(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good)), packed(x[good]), pa.array(length[good])], ["id", "v", "length"]
            )

    given = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).where("id IS NOT NULL")
    return given.mapInArrow(chosen, "id long, v binary, length double")


def choose_pivots(rows: DataFrame, width: int, pivots: int, seed: int = 12) -> np.ndarray:
    """Up to ``pivots`` different vectors among the rows of the ``SAMPLE_IDS`` ids with the smallest hash."""
    different = smallest_hashes(rows, "id", SAMPLE_IDS, seed).select("v").distinct()
    few = different.orderBy(F.xxhash64(F.lit(seed), "v"), "v").limit(min(pivots, 256)).toArrow()
    return matrix(few["v"], width)


def ranks(near: np.ndarray) -> np.ndarray:
    """Rank of each pivot (column) in each row's order of falling nearness, one byte each."""
    order = np.argsort(-near, axis=1, kind="stable")
    out = np.empty(order.shape, np.uint8)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.uint8)[None], axis=1)
    return out


def with_permutation(rows: DataFrame, pivots: np.ndarray, longest: float, as_query: bool) -> DataFrame:
    """``rows`` with ``ranks``; the last component that makes all rows equally long is 0 for queries."""
    width = pivots.shape[1]
    rest = np.sqrt(np.maximum(0.0, longest**2 - (pivots * pivots).sum(axis=1)))
    shared = rows.sparkSession.sparkContext.broadcast((pivots, rest))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, last = shared.value
        for batch in batches:
            x = matrix(batch.column(1), width)
            near = x @ p.T
            if not as_query:
                length = batch.column(2).to_numpy()
                near += np.sqrt(np.maximum(0.0, longest**2 - length**2))[:, None] * last
            yield pa.RecordBatch.from_arrays([*batch.columns, packed(ranks(near))], ["id", "v", "length", "ranks"])

    return rows.select("id", "v", "length").mapInArrow(ranked, "id long, v binary, length double, ranks binary")


def footrule(files: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Footrule distance of every row of a block to one query; ``files`` has one inverted file per row."""
    asked = own[:, None]
    return (np.maximum(files, asked) - np.minimum(files, asked)).sum(axis=0, dtype=np.int32)


def nearest_of_block(
    files: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, own_id: int, q: np.ndarray, k: int, again: int
) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores) of the ``k`` best among the ``again`` rows with the smallest footrule distance."""
    far = footrule(files, own)
    far[ids == own_id] = np.iinfo(np.int32).max
    rows = np.argpartition(far, again - 1)[:again] if again < len(far) else np.arange(len(far))
    rows = rows[ids[rows] != own_id]
    score = (x[rows] * q).sum(axis=1)  # row by row, so that equal rows have equal scores
    best = np.lexsort((ids[rows], -score))[:k]
    return ids[rows][best], score[best]


def nearest(
    df: DataFrame, asked: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding",
    pivots: int = PIVOTS, share: float = SHARE, least: int = LEAST,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows with the largest inner product found for every row of
    ``df`` that ``asked``, a condition on ``id``, holds for; all other columns are ignored.

    Rows whose vector is NULL, zero, or holds NULL or non-finite components take no part, nor do rows with a NULL
    id; shorter vectors count as filled up with zeros. A row with the query's id is not a candidate. Other
    repeated rows are candidates of their own, and a query row that occurs n times is answered n times. Ties go to
    the smaller id. Fewer candidates than ``k`` are all returned; an empty table gives an empty result.

    All rows are indexed. The pivots come from a bounded sample; per query and block, ``share`` of the rows
    and at least ``least`` are ranked again, so small tables are searched exactly. Blocks of rows and of queries
    are dealt by hash and their number grows with the table; a task holds one of each.
    """
    spark = df.sparkSession
    width = widest(df, vector)
    rows = cut_lineage(usable_vectors(df, vec_id, vector, width))
    n, longest = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("length"), F.lit(0.0))).first()
    schema = "query long, query_id long, vec_id long, score double"
    p = choose_pivots(rows, width, pivots)
    asked_rows = rows.where(asked)
    m = asked_rows.count()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // ASKED))
    dealt = F.monotonically_increasing_id()
    index = with_permutation(rows, p, longest, as_query=False).withColumn(
        "block", F.pmod(F.xxhash64("id", dealt), F.lit(blocks)).cast("int")
    )
    queries = cut_lineage(
        with_permutation(asked_rows, p, longest, as_query=True)
        .withColumn("query", F.monotonically_increasing_id())
        .withColumn("group", F.pmod(F.xxhash64("query"), F.lit(groups)).cast("int"))
    )
    left = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(block: pa.Table, group: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if block.num_rows and group.num_rows:
            ids, x = block.column("id").to_numpy(), matrix(block.column("v"), width)
            files = np.ascontiguousarray(matrix(block.column("ranks"), len(p), np.uint8).T)
            own_ids, q = group.column("id").to_numpy(), matrix(group.column("v"), width)
            own = matrix(group.column("ranks"), len(p), np.uint8)
            again = max(least, int(np.ceil(share * len(ids))))
            for i, name in enumerate(group.column("query").to_pylist()):
                near, score = nearest_of_block(files, ids, x, own[i], own_ids[i], q[i], k, again)
                found.append((np.full(len(near), name), np.full(len(near), own_ids[i]), near, score))
        whole = [np.concatenate([f[c] for f in found]) if found else [] for c in range(4)]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("query", "query_id", "vec_id", "score"), whole, kinds, strict=True)})

    if not n or not m:
        best = spark.createDataFrame([], schema)
    else:
        best = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(search, schema)
    order = Window.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
