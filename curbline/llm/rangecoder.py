"""Adaptive context-mixing range coder for token ids, many blocks side by side in numpy.

Blocks of ids are coded independently: each starts from the same fresh model, and carries a checksum.
One numpy step codes the next id of every block, so Python's cost is shared by all blocks.

Per id: the order-2 and order-1 contexts (the two last ids) each predict one id, with a confidence. One
coded decision says which prediction holds, or none; its distribution is the mix of two adaptive ones,
by the confidences and by the last decisions, weighted by which did better so far. An id that nobody
predicts is coded by the order-0 model: four hexadecimal digits, each from an adaptive distribution that
its leading digits select.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
MAGIC = b"CTK1"
_U = np.uint64
_TOP = _U(1 << 48)
_BITS_D, _BITS_H = 10, 12  # probability bits of a decision and of a digit
_SLOTS1, _SLOTS2, _ROWS = 11, 12, 10  # bits of the tables of a block
_BASE = (0, 1, 17, 273)
_TABLE = 273 + (1 << _ROWS)
# Cumulated probabilities below each digit, and where they move when a digit is seen; the same with
# an end for the three outcomes of a decision.
_FLAT = (np.arange(16) << (_BITS_H - 4)).astype(np.int16)
_AIM = np.array([[i + ((1 << _BITS_H) - 16 if i > x else 0) for i in range(16)] for x in range(16)], np.int16)
_FLAT_D = np.array([0, 341, 682, 1 << _BITS_D], np.int16)
_AIM_D = np.array([[0, 1022, 1023, 1024], [0, 1, 1023, 1024], [0, 1, 2, 1024]], np.int16)


class _Model:
    """The state of all blocks."""

    def __init__(self, n: int):
        lane = np.arange(n)
        self.lane1, self.lane2, self.lane_t, self.lane_p = lane << _SLOTS1, lane << _SLOTS2, lane * 32, lane * 64
        self.t1 = np.zeros(n << _SLOTS1, np.int32)
        self.t2 = np.zeros(n << _SLOTS2, np.int32)
        self.digits = np.empty((n * _TABLE, 16), np.int16)
        self.digits[:] = _FLAT
        self.by_trust, self.by_past = np.empty((n * 32, 4), np.int16), np.empty((n * 64, 4), np.int16)
        self.by_trust[:] = self.by_past[:] = _FLAT_D
        self.weight = np.full(n, 8, np.int16)
        self.past = np.zeros(n, np.int64)
        self.last = np.zeros(n, np.int64)
        self.before = np.zeros(n, np.int64)
        self.each4 = np.arange(n) * 4

    def predict(self, n: int):
        """Contexts, predictions and the decision's cumulated probabilities of the first n blocks."""
        last = self.last[:n] * 40503
        s1 = self.lane1[:n] + ((last >> 5) & ((1 << _SLOTS1) - 1))
        s2 = self.lane2[:n] + (((last + self.before[:n] * 30011) >> 3) & ((1 << _SLOTS2) - 1))
        e1, e2 = self.t1.take(s1), self.t2.take(s2)
        p1, p2 = e1 & 0xFFFF, e2 & 0xFFFF
        a = self.lane_t[:n] + (((e1 >> 16) << 3) + ((e2 >> 16) << 1) + (p1 == p2))
        b = self.lane_p[:n] + self.past[:n]
        ca, cb = self.by_trust.take(a, axis=0), self.by_past.take(b, axis=0)
        w = self.weight[:n, None]
        mixed = cb + (((ca - cb) * w) >> 4)
        return (s1, s2, e1, e2, p1, p2, a, b, ca, cb), mixed

    def learn(self, n: int, seen, choice: np.ndarray, ids: np.ndarray) -> None:
        s1, s2, e1, e2, p1, p2, a, b, ca, cb = seen
        aim = _AIM_D.take(choice, axis=0)
        self.by_trust[a] = ca + ((aim - ca) >> 4)
        self.by_past[b] = cb + ((aim - cb) >> 4)
        at = self.each4[:n] + choice
        better = (ca.take(at + 1) - ca.take(at)) - (cb.take(at + 1) - cb.take(at))
        w = self.weight[:n]
        w += np.sign(better)
        np.clip(w, 1, 15, out=w)
        self.past[:n] = ((self.past[:n] << 2) | choice) & 63
        new = ids.astype(np.int32)
        for table, slot, entry, guess in ((self.t1, s1, e1, p1), (self.t2, s2, e2, p2)):
            trust = entry >> 16
            hit = guess == new
            # a hit adds trust; a miss takes some away, and without any left the prediction goes
            kept = guess | (np.maximum(trust - 1, 0) << 16)
            gained = guess | (np.minimum(trust + 1, 3) << 16)
            table[slot] = np.where(hit, gained, np.where(trust == 0, new, kept))
        self.before[:n] = self.last[:n]
        self.last[:n] = ids

    def row(self, level: int, lanes: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        if level == 3:
            prefix = (prefix * 40503 >> 4) & ((1 << _ROWS) - 1)
        return lanes * _TABLE + (_BASE[level] + prefix)

    def see(self, row: np.ndarray, cum: np.ndarray, digit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bounds of the digits; their distributions learn them."""
        at = np.arange(0, 16 * len(row), 16) + digit
        start = cum.take(at)
        end = ((cum.take(at + 1, mode="wrap") - 1) & ((1 << _BITS_H) - 1)) + 1  # 0 is the next row's
        move = _AIM.take(digit, axis=0)
        move -= cum
        move >>= 4
        move += cum
        self.digits[row] = move
        return start, end


def _bounds(cum: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return cum.take(at), cum.take(at + 1)


def _narrow(low, size, start, end, bits) -> None:
    size >>= _U(bits)
    low += size * start.astype(np.uint64)
    size *= (end - start).astype(np.uint64)


def _shift(low: np.ndarray, size: np.ndarray, take) -> None:
    """Leading 16 bits that are settled leave; ``take(blocks)`` writes or reads them. Keeps size >= 2^48."""
    while True:
        same = (low ^ (low + size)) < _TOP
        go = np.flatnonzero(same | (size < _TOP))
        if not len(go):
            return
        cut = go[~same[go]]
        size[cut] = (_U(0) - low[cut]) & (_TOP - _U(1))
        take(go)
        low[go] <<= _U(16)
        size[go] <<= _U(16)


def _encode(blocks: np.ndarray, tail: int) -> list[bytes]:
    """``blocks`` (n x BLOCK ids below 2^16); the last block holds ``tail`` ids."""
    n, width = blocks.shape
    model = _Model(n)
    low, size = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    out, at = np.zeros((n, width * 4 + 8), np.uint16), np.zeros(n, np.int64)
    steps = np.ascontiguousarray(blocks.T).astype(np.int64)

    def put(go: np.ndarray) -> None:
        out[go, at[go]] = (low[go] >> _U(48)).astype(np.uint16)
        at[go] += 1

    for i in range(width):
        if i == tail:
            n -= 1
            out[n, at[n] : at[n] + 4] = [int(low[n]) >> s & 0xFFFF for s in (48, 32, 16, 0)]
            at[n] += 4
            low, size = low[:n], size[:n]
            if not n:
                break
        ids = steps[i, :n]
        seen, mixed = model.predict(n)
        choice = np.where(ids == seen[5], 0, np.where(ids == seen[4], 1, 2))
        _narrow(low, size, *_bounds(mixed, model.each4[:n] + choice), _BITS_D)
        free = np.flatnonzero(choice == 2)
        x = ids[free]
        fl, fs = low[free], size[free]
        for level in range(4):
            row = model.row(level, free, x >> (16 - 4 * level))
            cum, digit = model.digits.take(row, axis=0), (x >> (12 - 4 * level)) & 15
            _narrow(fl, fs, *model.see(row, cum, digit), _BITS_H)
            if level == 1:
                low[free], size[free] = fl, fs
                _shift(low, size, put)
                fl, fs = low[free], size[free]
        low[free], size[free] = fl, fs
        _shift(low, size, put)
        model.learn(n, seen, choice, ids)
    for s in (48, 32, 16, 0):
        out[np.arange(n), at[:n]] = ((low[:n] >> _U(s)) & _U(0xFFFF)).astype(np.uint16)
        at[:n] += 1
    return [out[k, : at[k]].astype("<u2").tobytes() for k in range(len(out))]


def _decode(parts: list[np.ndarray], width: int, tail: int) -> np.ndarray:
    n = len(parts)
    longest = max(len(p) for p in parts)
    data = np.zeros((n, longest + 4), np.uint64)
    for k, p in enumerate(parts):
        data[k, : len(p)] = p
    model = _Model(n)
    low, size = np.zeros(n, np.uint64), np.full(n, (1 << 64) - 1, np.uint64)
    code, at = np.zeros(n, np.uint64), np.full(n, 4, np.int64)
    for k in range(4):
        code = (code << _U(16)) | data[:, k]
    steps = np.zeros((width, n), np.int64)

    def pull(go: np.ndarray) -> None:
        code[go] = (code[go] << _U(16)) | data[go, np.minimum(at[go], longest + 3)]
        at[go] += 1

    for i in range(width):
        if i == tail:
            n -= 1
            if not n:
                break
            low, size, code, at = low[:n], size[:n], code[:n], at[:n]
        seen, mixed = model.predict(n)
        unit = size >> _U(_BITS_D)
        spot = ((code - low) // unit).astype(np.int64)
        choice = (spot >= mixed[:, 1]).astype(np.int64) + (spot >= mixed[:, 2])
        _narrow(low, size, *_bounds(mixed, model.each4[:n] + choice), _BITS_D)
        ids = np.where(choice == 0, seen[5], seen[4]).astype(np.int64)
        free = np.flatnonzero(choice == 2)
        fl, fs, fc = low[free], size[free], code[free]
        x = np.zeros(len(free), np.int64)
        for level in range(4):
            row = model.row(level, free, x)
            cum = model.digits.take(row, axis=0)
            spot = np.minimum((fc - fl) // (fs >> _U(_BITS_H)), _U((1 << _BITS_H) - 1)).astype(np.int16)
            # how many of the 16 lower bounds are reached: count the bytes of the comparison
            reached = np.bitwise_count((cum <= spot[:, None]).view(np.uint64))
            digit = (reached[:, 0] + reached[:, 1]).astype(np.int64) - 1
            _narrow(fl, fs, *model.see(row, cum, digit), _BITS_H)
            x = (x << 4) | digit
            if level == 1:
                low[free], size[free] = fl, fs
                _shift(low, size, pull)
                fl, fs, fc = low[free], size[free], code[free]
        low[free], size[free] = fl, fs
        _shift(low, size, pull)
        ids[free] = x
        steps[i, :n] = ids
        model.learn(n, seen, choice, ids)
    return steps.T


def _planes(ids: np.ndarray) -> list[np.ndarray]:
    """The low 16 bits, and the high ones if any id has them."""
    high = ids >> 16
    return [ids & 0xFFFF, *([high] if high.any() else [])]


def encode(ids: np.ndarray) -> bytes:
    """Coded ``ids`` (unsigned 32-bit): header, then per block its length, checksum and data."""
    ids = np.asarray(ids, np.uint32)
    planes = _planes(ids) if len(ids) else []
    head = [MAGIC, struct.pack("<BQI", len(planes), len(ids), BLOCK)]
    body = []
    count = -(-len(ids) // BLOCK)
    for plane in planes:
        padded = np.zeros(count * BLOCK, np.uint32)
        padded[: len(ids)] = plane
        coded = _encode(padded.reshape(count, BLOCK), len(ids) - (count - 1) * BLOCK)
        raw = plane.astype("<u4").tobytes()
        sums = [zlib.crc32(raw[i * 4 * BLOCK : (i + 1) * 4 * BLOCK]) for i in range(count)]
        head += [np.array([len(c) for c in coded], "<u4").tobytes(), np.array(sums, "<u4").tobytes()]
        body += coded
    return b"".join(head + body)


def decode(data: bytes) -> np.ndarray:
    """The ids of :func:`encode`; raises ``ValueError`` on damaged data."""
    if data[:4] != MAGIC:
        raise ValueError("not a token file")
    planes, n, block = struct.unpack_from("<BQI", data, 4)
    count, at = -(-n // block), 17
    lengths, sums = [], []
    for _ in range(planes):
        lengths.append(np.frombuffer(data, "<u4", count, at))
        sums.append(np.frombuffer(data, "<u4", count, at + 4 * count))
        at += 8 * count
    out = np.zeros(n, np.uint32)
    for plane in range(planes):
        parts = []
        for length in lengths[plane].tolist():
            parts.append(np.frombuffer(data, "<u2", length // 2, at))
            at += length
        values = _decode(parts, block, n - (count - 1) * block).reshape(-1)[:n].astype("<u4")
        raw = values.tobytes()
        for i, want in enumerate(sums[plane].tolist()):
            if zlib.crc32(raw[i * 4 * block : (i + 1) * 4 * block]) != want:
                raise ValueError(f"block {i} is damaged")
        out |= values << (16 * plane)
    return out
