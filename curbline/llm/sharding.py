"""Reproducible global shuffle into shards by a Feistel permutation of row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import fresh, numbered

ROUNDS = 6


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 64-bit finalizer, keyed."""
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def permute(numbers: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place in 0..n-1 of each row number in 0..n-1: a bijection fixed by ``n`` and ``seed``.

    A balanced Feistel network permutes the smallest domain of 2^(2h) >= n numbers. A number
    that lands outside 0..n-1 walks on along its cycle until it is inside; as the domain is
    below 4n, few steps are needed.
    """
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [(seed * 0x100000001B3 + (r + 1) * 0x9E3779B97F4A7C15) % (1 << 64) for r in range(ROUNDS)]
    out = np.asarray(numbers).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> h, x & mask
        for key in keys:
            left, right = right, left ^ (_mix(right, key) & mask)
        x = (left << h) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def place_of(number: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of one row number, computed without any table."""
    p = int(permute(np.array([number]), n, seed)[0])
    return p % shards, p // shards


def shard(df: DataFrame, order: list[Column], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` (0..shards-1) and ``slot`` (gapless from 0 per shard).

    Row numbers follow ``order`` and then the hash of all columns, so the result depends on the
    rows alone and not on files or partitions. The permuted number p gives shard p mod shards and
    slot p div shards: shard sizes differ by one row at most, whatever the keys. Rows equal in every
    column are interchangeable and get different slots; NULLs sort first; an empty frame gives an
    empty result; a column of ``df`` named like an added one is replaced by it.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("row_number", "shard", "slot")
    n, tie = df.count(), F.xxhash64(*[F.to_json(F.struct(c)) if "map" in t else F.col(f"`{c}`") for c, t in df.dtypes])
    place = fresh(df.columns, "place")[0]

    @F.pandas_udf("long")
    def placed(number: pd.Series) -> pd.Series:
        return pd.Series(permute(number.to_numpy(), n, seed))

    return (
        numbered(df, [*order, tie], "row_number")
        .withColumn(place, placed("row_number"))
        .withColumn("shard", (F.col(place) % shards).cast("int"))
        .withColumn("slot", F.floor(F.col(place) / shards).cast("long"))
        .drop(place)
    )
