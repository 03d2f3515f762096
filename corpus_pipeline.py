"""Corpus pipeline: quality, repeated lines and passages, near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is stored before the next one reads
it; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import lines, mixing, packing, parity, quality
from curbline.llm.common import numbered, release, stored
from curbline.llm.queries import CAPACITY, domain_labels, quality_model
from curbline.llm.registry import query
from curbline.session import cut_lineage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

# Domains that the mixture is to hold, and the growth of their tokens: the targets are what documents that
# most likely belong to a wanted domain hold of each domain, times the growth.
WANTED, GROWTH = ("1-0", "0-0"), 1.2


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    vectors, network = quality_model(spark, docs, sf_dir)
    return quality.score(docs, vectors, network).where("predicted = 1").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages of 50 words or more are cut, in whole lines or inside them.

    A text that loses all its words goes; NULL texts, texts without words and all others stay. Rows with one id
    and one text end alike; ``n_chars`` follows a changed text.
    """
    done = lines.remove_repeated_passages(docs)
    left = done.where((F.col("n_words_removed") == 0) | F.col("text").rlike("[^ \\t-\\r]"))
    changed = F.when(F.col("n_words_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", changed).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: the smallest id, NULL first, then the smallest hash of the text.

    Rows with one id (or none) and one text, or none, are copies; the one with the smallest other columns
    stays. Each text of an id is a vertex of its own, so an id with several texts links no groups.
    """
    d, t = lines.document_key("doc_id", "text")
    least = F.min(F.struct(*COLUMNS)).alias("row")
    rows = docs.groupBy(d.alias("d"), t.alias("t")).agg(least).select("d", "t", "row.*")
    order = numbered(docs.select(d.alias("d"), t.alias("t")).distinct(), [F.col("d"), F.col("t")], "vertex")
    rows = stored(rows.join(order, ["d", "t"]).drop("d", "t"))
    release(spark)
    groups = stored(parity.jaccard_components(rows.drop("doc_id"), "vertex"))
    release(spark)
    gone = groups.where("component_id <> id").select(F.col("id").alias("vertex"))
    return rows.join(gone, "vertex", "left_anti").select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, the fraction decided by the hash of the id.

    The classifier learns from the labelled documents that are left. A document beyond its first copy
    keeps its id.
    """
    domains, weights, bias = mixing.fit_domains(docs, domain_labels(spark, sf_dir))
    # each text is classified once; its posterior is stored with the row
    scored = stored(mixing.add_posteriors(docs, weights, bias))
    narrow = scored.select("n_tokens", "posterior")
    k = len(domains)
    likeliest = F.array_position("posterior", F.array_max("posterior")) - 1
    wanted = [i for i, d in enumerate(domains) if d in WANTED] or list(range(k))
    hold = F.when(likeliest.isin(wanted), F.col("n_tokens")).otherwise(0)
    have = narrow.agg(*[F.sum(hold * F.get("posterior", F.lit(i))) for i in range(k)]).first()
    targets = np.array([GROWTH * (x or 0.0) for x in have])
    steps, _ = mixing.fit_rates(narrow, targets)
    rated = mixing.add_rates(scored, steps, k)
    copies = mixing.whole_copies(F.col("rate"), F.col("doc_id"))
    return rated.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in sequences of up to 2048 tokens: one row per piece."""
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, with_ids=False)
    return packing.pack(pieces, CAPACITY).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_domains),
    ("packing", pack_sequences),
]

# The classifiers, the tokenizer and the packing cannot be said in SQL.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
            release(spark)
    return docs
