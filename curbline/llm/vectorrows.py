"""Vectors of Arrow columns as matrices, exact products of whole numbers, and bounded samples of rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT = float(1 << 53)  # whole numbers below it are exact in double precision


def dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors in double precision, usable): vectors shorter than ``width`` end in zeros, longer ones and
    those that are NULL or hold NULL or non-finite components are not usable and all zero."""
    n = len(column)
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(-1)).astype(np.int64)
    good, held = (sizes >= 0) & (sizes <= width), np.maximum(sizes, 0)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # NULL components become NaN
    row = np.repeat(np.arange(n), held)
    place = np.arange(len(values)) - np.repeat(np.cumsum(held) - held, held)
    out = np.zeros((n, width))
    inside = good[row]
    out[row[inside], place[inside]] = values[inside]
    good &= np.isfinite(out).all(axis=1)
    out[~good] = 0
    return out, good


def matrix(column: pa.Array | pa.ChunkedArray, width: int, kind=np.float64) -> np.ndarray:
    """Rows of a binary column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def packed(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    return pa.array([r.tobytes() for r in rows], pa.binary())


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of whole numbers held in doubles, exact as int64; an error where a long may not hold it."""
    top = max(1.0, float(np.abs(a).max(initial=0))) * max(1.0, float(np.abs(b).max(initial=0))) * max(1, a.shape[1])
    if top < EXACT:
        return (a @ b.T).astype(np.int64)
    if top >= 2.0**62:
        raise ValueError("the components are too large for products that fit a long")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def widest(df: DataFrame, vector: str) -> int:
    """Largest number of components among the vectors, 1 at least."""
    return max(df.agg(F.max(F.size(vector))).first()[0] or 1, 1)


def smallest_hashes(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """Rows of the ``n`` keys with the smallest hash. Only keys are sorted; at most ``n`` of them are broadcast."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    few = keys.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)
    return df.join(F.broadcast(few), key, "left_semi")
