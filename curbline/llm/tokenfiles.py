"""Token ids of whole corpora in coded files, written and read by Spark."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curbline.llm import rangecoder
from curbline.llm.subwords import encoder, slices

SEGMENT = 6_000_000  # ids of a segment from which on the next document starts a new one


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write the ids of every text, each followed by ``end_id``, in ascending order of id, to ``path``.

    One range shuffle sorts the texts (NULL ids first, equal ids by text); a task cuts them into segments of whole
    documents. A segment is one row: ``part`` and ``segment`` order it, ``before`` counts the ids of its part
    before it, ``doc_ids`` and ``lengths`` list its documents, ``payload`` holds the coded blocks. The rows
    are stored as uncompressed Parquet, so Spark's commit protocol covers lost tasks. NULL and empty texts
    are ``end_id`` alone; repeated rows stay; an empty table gives files without rows; other columns are ignored.
    """

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, blanks=True).encode
        part, segment, before = TaskContext.get().partitionId(), 0, 0
        ids, sizes, names, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            payload = rangecoder.encode(np.concatenate(ids))
            row = [part, segment, before, held, names, sizes, payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for first, end in slices(batch.column(1), 2 << 20):
                found, offsets = encode(batch.column(1).slice(first, end - first), end_id)
                ids.append(found)
                sizes += np.diff(offsets).tolist()
                names += batch.column(0).slice(first, end - first).to_pylist()
                held += len(found)
                if held >= SEGMENT:
                    yield flush()
                    segment, before = segment + 1, before + held
                    ids, sizes, names, held = [], [], [], 0
        if names:
            yield flush()

    order = [F.col("id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    spread = given.repartitionByRange(F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(*order)
    ddl = "part int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<long>, payload binary"
    spread.mapInArrow(coded, ddl).write.option("compression", "uncompressed").parquet(path)


_NAMES = ["part", "segment", "before", "n_ids", "doc_ids", "lengths", "payload"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document in the files at ``path``.

    ``start`` counts the ids of all documents before it. Damaged blocks raise an error. What is broadcast
    has one row per written partition.
    """
    rows = spark.read.parquet(path)
    total = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = total.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                first, names, lengths, payload = (batch.column(i)[row] for i in range(4))
                ids = rangecoder.decode(payload.as_py())
                sizes = lengths.values.to_numpy()
                ends = np.cumsum(sizes)
                if len(ids) != (ends[-1] if len(ends) else 0):
                    raise ValueError("the segment does not hold the ids that its documents need")
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                columns = [names.values, pa.array(first.as_py() + ends - sizes), lengths.values, pa.array(crc, pa.int64())]
                if with_ids:
                    cuts = np.concatenate(([0], ends)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    placed = rows.join(F.broadcast(starts), "part").select(
        (F.col("first") + F.col("before")).alias("first"), "doc_ids", "lengths", "payload"
    )
    return placed.mapInArrow(read, ddl)
