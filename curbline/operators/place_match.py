"""Batch place matching: typed place names to stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import text

GRAM = 3  # characters of the longest indexed piece


def _grams(value: Column, size: Column) -> Column:
    """All different pieces of ``size`` characters, of whatever kind they are."""
    last = F.length(value) - size + 1
    return F.when(
        last >= 1,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.substring(value, at, size))),
    )


def match_places(requests: DataFrame, transit: DataFrame) -> DataFrame:
    """The station whose name contains the cleaned place text, literally and in any case.

    Among several the shortest name wins, then the smallest id. Names are indexed by their pieces of one to ``GRAM``
    characters, so the index grows with the length of the names and a text of symbols is found like any other. A text
    looks up its rarest piece of the longest size it has, and the names there are compared as a whole. A text with a
    piece that no name has matches nothing. Equal texts are matched once. The exploded sides are never broadcast: their
    size is not known when the plan is made.
    """
    cleaned = text.clean_place(F.col("place")).alias("cleaned")
    texts = requests.select(cleaned).distinct().filter(F.length("cleaned") > 0)
    size = F.col("size")
    names = transit.filter(F.col("station_name").isNotNull()).select(
        "station_id", "station_name", "lat", "lng", F.lower("station_name").alias("low"),
        F.explode(F.array(*[F.lit(n) for n in range(1, GRAM + 1)])).alias("size"),
    )
    index = names.select("station_id", "station_name", "lat", "lng", "low", F.explode(_grams(F.col("low"), size)).alias("gram"))
    spread = index.groupBy("gram").agg(F.count("*").alias("names"))
    low = F.lower("cleaned")
    pieces = texts.select("cleaned", F.explode(_grams(low, F.least(F.length(low), F.lit(GRAM)))).alias("gram"))
    probes = (
        pieces.join(spread, "gram", "left")
        .groupBy("cleaned")
        .agg(
            F.min_by("gram", F.struct("names", "gram")).alias("gram"),
            F.bool_or(F.col("names").isNull()).alias("unknown"),
        )
        .filter(~F.col("unknown"))
        .select("cleaned", "gram")
    )
    candidates = probes.join(index.hint("merge"), "gram").filter(F.contains("low", F.lower("cleaned")))
    best = candidates.groupBy("cleaned").agg(
        F.min_by(
            F.struct("station_id", "station_name", "lat", "lng"),
            F.struct(F.length("station_name"), "station_id"),
        ).alias("_hit")
    )
    return (
        requests.withColumn("cleaned", cleaned)
        .join(best, "cleaned", "left")
        .select(*requests.columns, "cleaned", "_hit.*")
    )
