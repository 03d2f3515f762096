"""Exact percentiles of very many values without sorting or gathering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 1 << 16  # parts that a step which holds a wanted rank is cut into


def _part(v: Column, low: Column, high: Column) -> Column:
    """Number of the part of [low, high] that holds ``v``; a greater value is never in a lower part."""
    return F.when(high > low, F.least(F.floor((v - low) / (high - low) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0).cast("long"))


def _placed(counts: DataFrame, groups: list[str], order: str) -> DataFrame:
    """``counts`` (n) with ``first`` and ``last``, the ranks of its values; ``first`` was that of the group."""
    upto = F.sum("n").over(Window.partitionBy(*groups).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("last", F.col("first") + upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)


def _holds(rank: Column) -> Column:
    return (F.col("first") <= rank) & (rank <= F.col("last"))


def exact_percentiles(df: DataFrame, column: str, fractions: list[float], width: float) -> DataFrame:
    """One row with ``percentiles``, an array: interpolated between neighbours, NULL without any value.

    Values are counted per step of ``width``. Each step that holds a wanted rank is cut into ``PARTS`` parts
    between its own least and greatest value, which are counted as well; only the parts that hold a wanted
    rank keep their values. So what meets in one task is a row per step, or per part of two steps for each
    fraction, or per distinct value of so small a part, also where all values fall in one step. NULL and NaN
    are no values. ``df`` is read three times.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    values = values.withColumn("s", F.floor(F.col("v") / width))
    ranks = [(F.col("all") - 1) * F.lit(float(q)) for q in fractions]

    def wanted(placed: DataFrame) -> DataFrame:
        held = F.lit(False)
        for rank in ranks:
            held = held | _holds(F.floor(rank)) | _holds(F.ceil(rank))
        return placed.where(held)

    counted = [F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")]
    steps = values.groupBy("s").agg(*counted).withColumn("all", F.sum("n").over(Window.partitionBy()))
    steps = wanted(_placed(steps.withColumn("first", F.lit(0).cast("long")), [], "s"))
    edges = ["s", "low", "high", "all"]
    cut = values.join(F.broadcast(steps.select(*edges, "first")), "s")
    parts = cut.groupBy(*edges, "first", _part(F.col("v"), F.col("low"), F.col("high")).alias("part")).agg(counted[0])
    parts = wanted(_placed(parts, ["s"], "part")).select(*edges, "first", "part")
    inside = values.join(F.broadcast(parts), "s").where(_part(F.col("v"), F.col("low"), F.col("high")) == F.col("part"))
    last = inside.groupBy("s", "part", "all", "first", "v").agg(counted[0])
    last = _placed(last, ["s", "part"], "v")

    def value(rank: Column) -> Column:
        below, above = (F.max(F.when(_holds(r), F.col("v"))) for r in (F.floor(rank), F.ceil(rank)))
        share = F.max(rank - F.floor(rank))
        return F.when(share == 0, below).otherwise(below * (1 - share) + above * share)

    return last.agg(F.when(F.count(F.lit(1)) > 0, F.array(*[value(r) for r in ranks])).alias("percentiles"))
