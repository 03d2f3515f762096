"""Latest row per key, top-k, ties-kept minimum and other per-key selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], newest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    ranking = F.struct(*order, *[c for c in sorted(rest) if c not in order])
    choose = F.max_by if newest else F.min_by
    return (
        df.groupBy(*keys)
        .agg(choose(F.struct(*rest), ranking).alias("_row"))
        .select(*keys, "_row.*")
        .select(*df.columns)
    )


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, ties settled by the other columns.

    An aggregate rather than a row number: every task first reduces its own rows
    to one per key, so a key with very many snapshots is no larger than others.
    """
    return _pick(df, keys, order, newest=True)


def earliest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, newest=False)


def keep_minimum(df: DataFrame, column: str) -> DataFrame:
    """All rows that hold the least value of ``column``: ties stay, NULL never does."""
    return df.filter(F.col(column) == df.agg(F.min(column)).scalar())


def latest_run(df: DataFrame, run: str = "run_id") -> DataFrame:
    """Distinct rows of the greatest run id."""
    return df.filter(F.col(run) == df.agg(F.max(run)).scalar()).drop(run).distinct()


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_per_group(
    df: DataFrame, groups: list[str], k: int, *order: Column, rank: str = "rank"
) -> DataFrame:
    """The first ``k`` rows per group. Spark keeps only k rows per group and task before
    the shuffle, so a large group costs no more than k rows for each task."""
    window = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def with_share(df: DataFrame, value: str, share: str = "share_pct", places: int = 1) -> DataFrame:
    """Each row's part of the column total, in percent."""
    total = df.agg(F.sum(value)).scalar()
    return df.withColumn(share, F.round(F.col(value) * 100.0 / total, places))
