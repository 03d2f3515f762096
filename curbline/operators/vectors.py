"""Vector retrieval: normalising, exact top-k by cosine, context text and quality measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curbline.operators import keyed

EPSILON = 1e-9  # fixed value: added to a norm before dividing
SCORE_PLACES = 6  # scores that agree to this many places tie, and the smaller id wins
BLOCK_ROWS = 4096  # rows of one side of a block product
PRODUCT_CELLS = 1 << 19  # scores a task holds at once


def norm(vector: Column) -> Column:
    squares = F.aggregate(
        vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    return F.sqrt(squares)


def normalise(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Scale vectors to unit length."""
    scale = F.transform(column, lambda x: x.cast("double") / (F.col("_norm") + EPSILON))
    return df.withColumn("_norm", norm(F.col(column))).withColumn(column, scale).drop("_norm")


def mean_vectors(df: DataFrame, group: str, column: str = "embedding") -> DataFrame:
    """Mean vector per group; sums are formed per position, so no group is gathered."""
    cells = df.select(group, F.posexplode(column).alias("pos", "x"))
    means = cells.groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(group).agg(
        F.sort_array(F.collect_list(F.struct("pos", "x"))).getField("x").alias(column)
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as a matrix, straight from their shared buffer."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype("float64", copy=False)


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / (np.linalg.norm(matrix, axis=1, keepdims=True) + EPSILON)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best scores, ties by id; a copy, as a slice would keep the whole order in memory."""
    return np.lexsort((ids, -scores))[:k].copy()


def _score_group(id_name: str, k: int):
    def score(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names, ids = queries.column("query_id"), vectors.column(id_name)
        picked, query, scores = [], [], []
        if len(names) and len(ids):
            asked, stored = _unit(_matrix(queries.column("embedding"))), _unit(_matrix(vectors.column("embedding")))
            order, step = ids.to_numpy(), max(1, PRODUCT_CELLS // len(ids))
            for first in range(0, len(asked), step):
                products = asked[first : first + step] @ stored.T
                np.round(products, SCORE_PLACES, out=products)
                for i, row in enumerate(products, first):
                    pick = _best(row, order, k)
                    picked.append(pick)
                    query.append(np.full(len(pick), i))
                    scores.append(row[pick])
        whole = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        return pa.table(
            {
                "query_id": names.take(pa.array(whole(query, "int64"))),
                id_name: ids.take(pa.array(whole(picked, "int64"))),
                "score": pa.array(whole(scores, "float64")),
            }
        )

    return score


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5, id_name: str = "vec_id") -> DataFrame:
    """The ``k`` most similar vectors of every query: ``query_id, id, score, rank``.

    Exact, as a block matrix product: every group holds one block of queries and
    one of vectors and passes on ``k`` rows per query. Block numbers come from a
    hash of the ids, so blocks stay near ``BLOCK_ROWS`` rows. The work is the
    product of both sides; a vector is sent once per block of queries. A task
    multiplies a few queries at a time, so it holds ``PRODUCT_CELLS`` scores.
    ``queries`` has ``query_id, embedding``; NULL vectors match nothing.
    """
    queries = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    vectors = vectors.select(id_name, "embedding").filter(F.col("embedding").isNotNull())
    schema = T.StructType(
        [queries.schema["query_id"], vectors.schema[id_name], T.StructField("score", T.DoubleType())]
    )

    def blocks(df: DataFrame) -> Column:
        return df.agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.lit(1)).cast("long")).scalar()

    def tile(df: DataFrame, key: str, own: str, other: str, own_n: Column, other_n: Column) -> DataFrame:
        return df.withColumn(own, F.pmod(F.xxhash64(key), own_n)).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), other_n - 1))
        )

    q_blocks, v_blocks = blocks(queries), blocks(vectors)
    left = tile(queries, "query_id", "_q", "_v", q_blocks, v_blocks).groupBy("_q", "_v")
    right = tile(vectors, id_name, "_v", "_q", v_blocks, q_blocks).groupBy("_q", "_v")
    best = left.cogroup(right).applyInArrow(_score_group(id_name, k), schema)
    return keyed.top_k_per_group(best, ["query_id"], k, F.desc("score"), F.asc(id_name))


def cosine_distance_top_k(
    queries: DataFrame, vectors: DataFrame, k: int = 5, id_name: str = "vec_id"
) -> DataFrame:
    """Nearest by cosine distance, smallest first."""
    found = cosine_top_k(queries, vectors, k, id_name)
    return found.withColumn("distance", F.round(1 - F.col("score"), SCORE_PLACES)).drop("score")


def with_chunk_text(embeddings: DataFrame, chunks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Vectors with their chunk text: of one chunk, or with the key ``source`` of all chunks of a source."""
    return embeddings.join(chunks, keys or ["source", "chunk_id"])


def _fixed(score: Column, places: int = 3) -> Column:
    """A score as text, rounded by its exact value as ``f"{score:.3f}"`` does, halves to even.

    ``format_string`` rounds the shortest decimal text instead: 0.0135, a little less in binary, would become 0.014.
    """
    scale = 10.0**places
    size = F.abs(score)
    high = size.cast("float").cast("double")  # 24 bits, so this part and the rest times the scale are exact
    steps = F.floor(size * scale)
    over = (high * scale - (steps + 0.5)) + (size - high) * scale
    up = F.when((over > 0) | ((over == 0) & (steps % 2 == 1)), 1).otherwise(0)
    rounded = F.when(size < 2.0**31, (steps + up) / scale * F.signum(score)).otherwise(score)
    return F.format_string(f"%.{places}f", rounded)


def context_block(hits: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """The retrieved chunks of each query as one text, best first.

    ``hits`` has ``query_id, rank, source, chunk_id, score, chunk_text``; chunks
    of one rank follow in their order.
    """
    entry = F.concat(
        F.lit("[source="), F.col("source"), F.lit(", chunk_id="), F.col("chunk_id").cast("string"),
        F.lit(", score="), _fixed(F.col("score")), F.lit("]\n"), F.col("chunk_text"),
    )
    return hits.groupBy("query_id").agg(
        F.concat_ws(
            separator, F.sort_array(F.collect_list(F.struct("rank", "chunk_id", entry.alias("entry")))).getField("entry")
        ).alias("context")
    )


def retrieval_scores(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Precision, recall, nDCG, reciprocal rank and average precision at ``k`` per query.

    ``ranked`` has ``query_id, id, rank``; ``relevant`` one row per relevant
    ``query_id, id``. A query without relevant entries is not scored.
    """
    totals = relevant.groupBy("query_id").agg(F.count("*").alias("relevant_n"))
    hits = (
        ranked.filter(F.col("rank") <= k)
        .join(relevant.withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
        .filter(F.col("_hit") == 1)
        .groupBy("query_id")
        .agg(F.sort_array(F.collect_list("rank")).alias("ranks"))
    )
    gains = F.aggregate("ranks", F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least("relevant_n", F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda s, r: s + 1 / F.log2(r + 1.0),
    )
    precisions = F.aggregate(
        F.transform("ranks", lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, p: s + p
    )
    found = F.size("ranks")
    measures = {
        "precision": found / F.lit(k),
        "recall": found / F.col("relevant_n"),
        "ndcg": gains / ideal,
        "reciprocal_rank": 1 / F.col("ranks")[0],
        "average_precision": precisions / F.least(F.col("relevant_n"), F.lit(k)),
    }
    scored = totals.join(hits, "query_id", "left")
    return scored.select(
        "query_id", *[F.coalesce(value, F.lit(0.0)).alias(name) for name, value in measures.items()]
    )


def mean_retrieval_scores(scores: DataFrame) -> DataFrame:
    names = ["precision", "recall", "ndcg", "reciprocal_rank", "average_precision"]
    return scores.agg(F.count("*").alias("queries"), *[F.avg(c).alias(f"mean_{c}") for c in names])


def judgement_means(judged: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Mean of stored judgements (router hits, faithfulness, completeness) per group."""
    return judged.groupBy(group).agg(
        F.count("*").alias("judged"), *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns]
    )
