"""The thin queries ``opN_<name>``: each applies its operator to the whole table."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import reference
from curbline.llm.chat import format_conversations, read_loss_texts, read_turns
from curbline.llm import covertree, embeddings, lines, lloyd, mixing, packing, parity, permutation, quality, tokenfiles
from curbline.llm.common import stored, table
from curbline.llm.registry import QUERIES, SQL, query  # noqa: F401
from curbline.llm.rules import BASE_RULES, apply_rules
from curbline.llm.sharding import shard
from curbline.session import scratch_dir

SHARDS = 40


@query("op1_shards")
def op1_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Equal row counts per shard. A NULL text has no bytes: size 16 and checksum 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, folder, "documents").select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shard(docs, [F.col("doc_id")], SHARDS, seed=20).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


PROBE_CONVERSATION = -7
PROBE_TEXT = "\\### Assistant: </turn> ok"


@query("op4_chat", reference.CHAT)
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one made of control strings, read back from the formatted texts."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(
        [(PROBE_CONVERSATION, 0, "user", PROBE_TEXT), (PROBE_CONVERSATION, 1, "assistant", PROBE_TEXT)],
        "conv_id long, turn long, role string, text string",
    )
    done = format_conversations(turns.unionByName(probe))
    read = done.select(
        "conv_id",
        "formatted",
        read_turns(F.col("formatted")).alias("turns"),
        F.array_join(read_loss_texts(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


@query("op8_rules", reference.RULES)
def op8_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The measures asked for and the verdict of every text; the cascade takes the others where it gets to them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    done = apply_rules(docs, "text", keep_measures=names)
    base = BASE_RULES[0].fails({n: F.col(n) for n in names}) | BASE_RULES[1].fails({n: F.col(n) for n in names})
    return done.select("doc_id", *names, base.alias("base_failed"), (~base & F.col("kept")).alias("kept"))


def held_out(doc_id) -> Column:
    """Rows whose label may not be learned: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def quality_model(spark: SparkSession, docs: DataFrame, folder: str):
    return quality.train(docs, table(spark, folder, "labels"), "quality", ~held_out(F.col("doc_id")))


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    vectors, network = quality_model(spark, docs, folder)
    return quality.score(docs, vectors, network).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


# Share of the tokens that each label class is to have: (quality, toxic) -> share.
TARGET_SHARES = {"1-0": 0.9, "1-1": 0.02, "0-0": 0.07, "0-1": 0.01}


def domain_labels(spark: SparkSession, folder: str) -> DataFrame:
    """The label classes as domains."""
    return table(spark, folder, "labels").select(
        "doc_id", F.concat(F.col("quality").cast("string"), F.lit("-"), F.col("toxic").cast("string")).alias("domain")
    )


def target_totals(domains: list, tokens: int, shares: dict = TARGET_SHARES):
    """Target tokens per domain, the shares of the domains that occur scaled to add up to ``tokens``."""
    wanted = np.array([shares.get(d, 0.0) for d in domains])
    return wanted / wanted.sum() * tokens if wanted.sum() else np.full(len(domains), tokens / len(domains))


@query("op2_mixing")
def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rate of every document so that expected tokens per label class have the target shares; each row
    also tells the totals wanted and reached, by domain."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    domains, weights, bias = mixing.fit_domains(docs, domain_labels(spark, folder))
    scored = stored(mixing.add_posteriors(docs, weights, bias).drop("text"))
    tokens = scored.agg(F.sum("n_tokens")).first()[0] or 0
    targets = target_totals(domains, tokens)
    steps, reached = mixing.fit_rates(scored, targets)
    rated = mixing.add_rates(scored, steps, len(domains))
    return rated.select(
        "doc_id", "n_tokens", "posterior", "rate",
        mixing.whole_copies(F.col("rate"), F.col("doc_id")).alias("copies"),
        F.array(*[F.lit(float(v)) for v in targets]).alias("target_tokens"),
        F.array(*[F.lit(float(v)) for v in reached]).alias("reached_tokens"),
    )


CAPACITY = 2048


@query("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of up to 2048 tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = packing.tokenized_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY, with_ids=False)
    return packing.pack(pieces, CAPACITY).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query("op5_embeddings")
def op5_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Links with a cosine of 0.95 or more between all vectors, none lost."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings"), 0.95)


@query("op6_jaccard")
def op6_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all whole texts."""
    docs = table(spark, folder, "documents")
    return parity.jaccard_components(docs).withColumnRenamed("id", "doc_id")


@query("op9_lines")
def op9_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without later copies of passages of 50 words and more, in whole lines or inside them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lines.remove_repeated_passages(docs).select("doc_id", "text", "n_words_removed")


@query("op10_tokens")
def op10_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """All documents as coded token files in the shared folder, read back."""
    path = scratch_dir(spark, "tokens")
    tokenfiles.write_token_files(
        table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2
    )
    return tokenfiles.read_token_files(spark, path, with_ids=False)


CENTROIDS, ROUNDS, COMPONENTS = 40, 5, 64


@query("op11_centroids", reference.centroids(CENTROIDS, ROUNDS, COMPONENTS))
def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors of 64 components in 40 clusters."""
    return lloyd.centroid_clusters(table(spark, folder, "embeddings"), CENTROIDS, ROUNDS, COMPONENTS)


@query("op12_neighbours")
def op12_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    return permutation.nearest(table(spark, folder, "embeddings"), F.col("id") % 20 == 0, 20)


@query("op13_negatives", reference.NEGATIVES)
def op13_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every row whose id is divisible by 100."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", label)
    return covertree.hard_negatives(rows, "id % 100 = 0")
