"""Sum-of-squares packing of tokenized documents into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from curbline.llm.common import fresh, stored
from curbline.llm.subwords import encoder, slices

GROUP = 20_000  # pieces that one task packs together, on average


def tokenized_pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every text: its token ids and ``end_id``,
    cut into pieces of ``capacity`` ids. NULL and empty texts are one piece that holds ``end_id``."""
    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, blanks=False).encode
        for batch in batches:
            for first, end in slices(batch.column(1)):
                ids, offsets = encode(batch.column(1).slice(first, end - first), end_id)
                size = np.diff(offsets)
                n = -(-size // capacity)
                row = np.repeat(np.arange(len(size)), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(size[row] - start, capacity)
                at = offsets[row] + start
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at.tolist(), length.tolist(), strict=True)]
                columns = [
                    batch.column(0).slice(first, end - first).take(pa.array(row)),
                    pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(np.append(at, offsets[-1]), pa.int32()), pa.array(ids.astype(np.int32))
                    ))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ddl)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset, room left in that bin at the end) of each piece, placed in the given order.

    A piece goes where the sum of the squared numbers of open bins per residual gap becomes smallest:
    into an open bin of some gap, or a new bin; the tightest gap wins a tie. Full bins are not open.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    left: list[int] = []
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, size in enumerate(lengths.tolist()):
        here, there = count[size:capacity], count[: capacity - size]
        change = np.where(here > 0, 2 * (there - here) + 2, np.iinfo(np.int64).max)
        if len(change) and here[0] > 0:
            change[0] = 1 - 2 * here[0]
        best = int(change.argmin()) if len(change) else -1
        opening = 2 * count[capacity - size] + 1 if size < capacity else 0
        if best >= 0 and change[best] <= opening:
            gap = size + best
            target = stacks[gap].pop()
            count[gap] -= 1
        else:
            gap, target = capacity, len(left)
            left.append(capacity)
        place[i], offset[i], left[target] = target, capacity - gap, gap - size
        if gap > size:
            count[gap - size] += 1
            stacks.setdefault(gap - size, []).append(target)
    return place, offset, np.array(left, np.int64)[place] if left else np.zeros(0, np.int64)


def pack(pieces: DataFrame, capacity: int, group: int = GROUP, spare: int = 16) -> DataFrame:
    """``pieces`` (with ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces are dealt by hash to tasks of about ``group`` pieces, which pack them independently. The
    bins that stay open with more than ``spare`` room are dissolved and their pieces packed once more
    in far fewer tasks, so that open bins of many tasks fill each other. A task's work is bounded by
    ``group`` at any input size, also where very many rows are equal, as their places in the stored pieces deal
    them out; equal rows are placed separately; an empty frame stays empty; columns named like an added one are
    replaced. Lengths outside the range raise an error.
    """
    pieces = stored(pieces.drop("sequence_id", "offset"))
    deal, room, order = fresh(pieces.columns, "deal", "room", "order")
    long = [StructField(n, LongType()) for n in ("sequence_id", "offset", room)]

    def packed(df: DataFrame, stage: int) -> DataFrame:
        n = df.count()
        groups = max(1, -(-n // group))
        keyed = df.withColumn(
            order, F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns], F.lit(stage))
        ).withColumn(deal, F.pmod(F.xxhash64(order, F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
        at, seq = keyed.columns.index("length"), keyed.columns.index(order)
        keep = [f for f in keyed.schema.fields if f.name not in (order, deal)]

        def fill(table: pa.Table) -> pa.Table:
            # long pieces first; equal hashes are equal rows, so any order between them packs alike
            size = table.column(at).to_numpy()
            table = table.take(pa.array(np.lexsort((table.column(seq).to_numpy(), -size))))
            size = table.column(at).to_numpy()
            if len(size) and (size.min() < 1 or size.max() > capacity):
                raise ValueError("piece lengths must be from 1 to the capacity")
            place, offset, left = sum_of_squares(size, capacity)
            first = (stage << 60) + (table.column(deal)[0].as_py() << 32)
            kept = table.select([f.name for f in keep])
            for name, values in (("sequence_id", first + place), ("offset", offset), (room, left)):
                kept = kept.append_column(name, pa.array(values, pa.int64()))
            return kept

        return keyed.groupBy(deal).applyInArrow(fill, StructType([*keep, *long]))

    once = stored(packed(pieces, 0))
    again = stored(once.where(F.col(room) > spare).drop("sequence_id", "offset", room))
    return once.where(F.col(room) <= spare).unionByName(packed(again, 1)).drop(room)
