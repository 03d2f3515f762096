"""Text chunks: sentences packed up to a length, and overlapping windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import text

PACK_CHARS = 800  # fixed value
WINDOW_CHARS, WINDOW_OVERLAP = 1000, 100  # fixed values


def _chunk_starts(lengths: Column, limit: int) -> Column:
    """Indexes (from 1) of the sentences that open a chunk.

    Only lengths and positions take part, so the text itself is never copied
    while packing. A sentence over the limit stays whole.
    """
    state = F.struct(
        F.lit(0).alias("i"), F.lit(0).cast("bigint").alias("used"),
        F.array().cast("array<int>").alias("starts"),
    )

    def place(acc: Column, length: Column) -> Column:
        index = acc["i"] + 1
        opens = (F.size(acc["starts"]) == 0) | (acc["used"] + length > limit)
        return F.struct(
            index.alias("i"),
            F.when(opens, length.cast("bigint")).otherwise(acc["used"] + length).alias("used"),
            F.when(opens, F.concat(acc["starts"], F.array(index))).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(lengths, state, place)["starts"]


def pack_sentences(
    documents: DataFrame, keys: list[str], column: str = "text", limit: int = PACK_CHARS
) -> DataFrame:
    """Whole sentences packed in order into chunks, numbered from 0 per document.

    A chunk is closed before the sentence that would take its sentence
    characters over ``limit``; the joining blanks are not counted.
    """
    split = documents.select(*keys, text.sentences(F.col(column)).alias("_s")).withColumn(
        "_starts", _chunk_starts(F.transform("_s", F.length), limit)
    )
    # The last chunk ends with the text. No sentences, no starts, no rows.
    after = F.size("_s") + 1

    def piece(start: Column, index: Column) -> Column:
        end = F.coalesce(F.get("_starts", index + 1), after)
        return F.concat_ws(" ", F.slice("_s", start, end - start))

    return split.select(*keys, F.posexplode(F.transform("_starts", piece)).alias("chunk_id", "chunk_text"))


def overlapping_windows(
    documents: DataFrame,
    keys: list[str],
    column: str = "text",
    size: int = WINDOW_CHARS,
    overlap: int = WINDOW_OVERLAP,
) -> DataFrame:
    """Windows of ``size`` characters, each starting ``overlap`` before the last one's end.

    The window that reaches the end of the text is the last.
    """
    step = size - overlap
    length = F.length(column)
    last = 1 + step * F.greatest(F.ceil((length - size) / step), F.lit(0)).cast("int")
    starts = F.sequence(F.lit(1), last, F.lit(step))
    return (
        documents.filter(F.length(column) > 0)
        .select(*keys, column, F.posexplode(starts).alias("chunk_id", "_start"))
        .select(*keys, "chunk_id", F.substring(column, F.col("_start"), F.lit(size)).alias("chunk_text"))
    )


def vector_records(chunks: DataFrame, source: str, text_chars: int | None = None) -> DataFrame:
    """Id and metadata under which a chunk's vector is stored; ``text_chars`` shortens the stored text."""
    text_column = F.col("chunk_text")
    if text_chars is not None:
        text_column = F.substring("chunk_text", 1, text_chars)
    return chunks.select(
        F.concat_ws("_chunk_", F.col(source).cast("string"), F.col("chunk_id").cast("string")).alias("id"),
        F.col(source).cast("string").alias("source"),
        "chunk_id",
        text_column.alias("chunk_text"),
    )


def missing_sources(expected: DataFrame, chunked: DataFrame, source: str) -> DataFrame:
    """Expected sources that gave no chunk."""
    return expected.select(source).distinct().join(chunked.select(source).distinct(), source, "left_anti")


def station_documents(transit: DataFrame, agency: str) -> DataFrame:
    """One sentence per station, ready for embedding."""
    one = transit.filter(F.col("station_id").isNotNull()).groupBy("station_id").agg(
        *[F.min(c).alias(c) for c in ("station_name", "lat", "lng")]
    )
    return one.select(
        F.concat(F.lit("station_"), "station_id").alias("id"),
        text.station_sentence(
            agency, F.col("station_name"), F.col("station_id"), F.col("lat"), F.col("lng")
        ).alias("text"),
        F.lit("station").alias("source_type"),
        F.col("station_id").alias("stop_id"),
        F.lit(None).cast("string").alias("route_id"),
    )
