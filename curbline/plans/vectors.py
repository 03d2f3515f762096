"""Vector retrieval. Searches ask every row whose id is divisible by 20 against all rows; retrieval scores ask the
mean vectors of the labels, as the label defines relevance."""

from pyspark.sql import functions as F

from curbline.operators import chunks, vectors
from curbline.plans.registry import query
from curbline.plans.text import DOCUMENT_WINDOWS


def label_queries(t):
    return vectors.mean_vectors(t.table("embeddings"), "label").withColumnRenamed("label", "query_id")


def hits(t, k=5):
    return vectors.cosine_top_k(label_queries(t), t.table("embeddings"), k)


def row_queries(t):
    return t.table("embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def row_hits(t, k=5):
    return vectors.cosine_top_k(row_queries(t), t.table("embeddings"), k)


@query(
    "unit_vectors",
    "X-6",
    """
SELECT vec_id, pos - 1 AS pos, round(embedding[pos] / (sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) + 1e-9), 6) AS x
FROM embeddings, range(1, 65) r(pos)""",
)
def unit_vectors(t):
    scaled = vectors.normalise(t.table("embeddings"))
    return scaled.select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("x", F.round("x", 6))


@query("cosine_top_five", "X-7 K-5", "SELECT query_id, vec_id, score, rank FROM row_hits")
def cosine_top_five(t):
    return row_hits(t)


@query(
    "cosine_distance_top_five",
    "X-8 K-5",
    "SELECT query_id, vec_id, round(1 - score, 6) AS distance, rank FROM row_hits",
)
def cosine_distance_top_five(t):
    return vectors.cosine_distance_top_k(row_queries(t), t.table("embeddings"))


@query(
    "chunks_with_vectors",
    "J-12",
    """
SELECT CAST(w.doc_id AS VARCHAR) AS source, w.chunk_id, v.vec_id, w.chunk_text FROM embeddings v JOIN (""" + DOCUMENT_WINDOWS + """) w ON w.doc_id = v.vec_id""",
)
def chunks_with_vectors(t):
    return _stored_chunks(t).drop("embedding", "label")


def _stored_chunks(t):
    """Every chunk of each document that has a vector."""
    pieces = chunks.overlapping_windows(t.documents, ["doc_id"])
    texts = pieces.select(F.col("doc_id").cast("string").alias("source"), "chunk_id", "chunk_text")
    stored = t.table("embeddings").withColumn("source", F.col("vec_id").cast("string"))
    return vectors.with_chunk_text(stored, texts, ["source"])


@query(
    "retrieval_context",
    "X-9",
    r"""
SELECT query_id, string_agg('[source=' || CAST(vec_id AS VARCHAR) || ', chunk_id=' || chunk_id || ', score=' || printf('%.3f', score) || ']' || chr(10) || chunk_text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank, chunk_id) AS context FROM row_hits h JOIN (""" + DOCUMENT_WINDOWS + """) w ON w.doc_id = h.vec_id GROUP BY query_id""",
)
def retrieval_context(t):
    texts = _stored_chunks(t).select("vec_id", "source", "chunk_id", "chunk_text")
    return vectors.context_block(row_hits(t).join(texts, "vec_id"))


_QUALITY = """
WITH rel AS (SELECT label AS query_id, count(*) AS n FROM embeddings GROUP BY label),
h AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM vector_hits WHERE label = query_id),
s AS (SELECT query_id, count(*) AS found, sum(1 / log2(rank + 1.0)) AS gain, min(rank) AS first, sum(nth / CAST(rank AS DOUBLE)) AS prec FROM h GROUP BY query_id),
q AS (SELECT r.query_id, coalesce(found, 0) / 5.0 AS p, coalesce(found, 0) / r.n AS rc,
  coalesce(gain / list_sum(list_transform(range(1, least(r.n, 5) + 1), lambda i: 1 / log2(i + 1.0))), 0) AS nd, coalesce(1.0 / first, 0) AS rr, coalesce(prec / least(r.n, 5), 0) AS ap
  FROM rel r LEFT JOIN s ON s.query_id = r.query_id)
"""


def _relevant(t):
    return t.table("embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"))


@query(
    "retrieval_scores",
    "X-10",
    _QUALITY + "SELECT query_id, round(p, 6) AS precision, round(rc, 6) AS recall, round(nd, 6) AS ndcg, round(rr, 6) AS reciprocal_rank, round(ap, 6) AS average_precision FROM q",
)
def retrieval_scores(t):
    scores = vectors.retrieval_scores(hits(t).withColumnRenamed("vec_id", "id"), _relevant(t), 5)
    names = ["precision", "recall", "ndcg", "reciprocal_rank", "average_precision"]
    return scores.withColumns({c: F.round(c, 6) for c in names})


@query(
    "mean_retrieval_scores",
    "X-10",
    _QUALITY
    + """SELECT count(*) AS queries, round(avg(p), 6) AS mean_precision, round(avg(rc), 6) AS mean_recall, round(avg(nd), 6) AS mean_ndcg,
  round(avg(rr), 6) AS mean_reciprocal_rank, round(avg(ap), 6) AS mean_average_precision FROM q""",
)
def mean_retrieval_scores(t):
    scores = vectors.retrieval_scores(hits(t).withColumnRenamed("vec_id", "id"), _relevant(t), 5)
    means = vectors.mean_retrieval_scores(scores)
    return means.withColumns({c: F.round(c, 6) for c in means.columns if c.startswith("mean_")})


@query(
    "judgement_means",
    "X-11",
    """
SELECT d.lang, count(*) AS judged, round(avg(l.quality), 6) AS mean_quality, round(avg(l.toxic), 6) AS mean_toxic FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.lang""",
)
def judgement_means(t):
    judged = t.table("labels").join(t.table("documents").select("doc_id", "lang"), "doc_id")
    means = vectors.judgement_means(judged, "lang", ["quality", "toxic"])
    return means.withColumns({c: F.round(c, 6) for c in ("mean_quality", "mean_toxic")})
