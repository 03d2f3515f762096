"""Words and shingles of whole Arrow text columns as 64-bit hashes, in numpy.

Everything works on the UTF-8 bytes of many texts at once. White space and letters A-Z are
single bytes, so no text has to be decoded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from curbline.llm import subwords

U = np.uint64
CHUNK = 1 << 20  # bytes of text handled at once; a longer text is a chunk of its own

_rng = np.random.default_rng(20_240_601)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _rng.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)

_CLASS = np.full(256, 1, np.uint8)  # letters, and all of UTF-8 beyond ASCII
_CLASS[:128] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[ord("A") : ord("Z") + 1] = _CLASS[ord("a") : ord("z") + 1] = 1
_WORD = (_CLASS > 0).astype(np.uint8)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK + 1), base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of up to ``limit`` bytes; NULL is empty."""
    subwords.forget()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers, n = column.buffers(), len(column)
    if n == 0:
        return
    offsets = np.frombuffer(buffers[1], wide, n + 1 + column.offset)[column.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, lower: bool = False, classes: bool = False
) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each word in order. Words are runs without white space; with ``classes``
    they also end where letters, digits and other characters meet."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if lower:
        data = _LOWER[data]
    kind = (_CLASS if classes else _WORD)[data]
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    np.not_equal(kind[1:], kind[:-1], out=cut[1:n])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    keep = kind[edges[:-1]] > 0
    start, end = edges[:-1][keep], edges[1:][keep]
    power, inverse = _power(n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[:n], out=sums[1:])
    hashed = mix((sums[end] - sums[start]) * inverse[start])
    # an empty row shares its offset with the next: 'right' finds the last row that starts there
    return hashed, np.searchsorted(offsets, start, "right") - 1


def shingles(words: np.ndarray, row: np.ndarray, rows: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the distinct ``size``-word shingles of each row, ordered by row; a row with
    fewer words has its whole sequence as one."""
    counts = np.bincount(row, minlength=rows)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    n = len(words)
    found, owner = [], []
    if n >= size:
        whole = row[size - 1 :] == row[: n - size + 1]
        h = np.zeros(n - size + 1, np.uint64)
        for k in range(size):
            h += words[k : n - size + 1 + k] * _STEP[k]
        found.append(mix(h[whole]))
        owner.append(row[: n - size + 1][whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        h = counts[short].astype(np.uint64) * _STEP[7]
        for k in range(size - 1):
            has = counts[short] > k
            h[has] += words[first[short[has]] + k] * _STEP[k]
        found.append(mix(h))
        owner.append(short)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, r = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]
