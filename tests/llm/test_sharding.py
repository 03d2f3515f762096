import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.llm.queries import SHARDS, op1_shards
from curbline.llm.sharding import permute, place_of, shard

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 65, 1000, 4097])
def test_permutation_is_a_bijection(n):
    out = permute(np.arange(n), n, seed=5)
    assert sorted(out.tolist()) == list(range(n))
    if n > 60:
        assert out.tolist() != list(range(n))


def test_rows_differ_by_one_and_slots_have_no_gap(spark):
    rows = op1_shards(spark, SMALL).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    slots = {}
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "rows")
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(SHARDS))
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    counts = [len(s) for s in slots.values()]
    assert max(counts) - min(counts) <= 1


def test_place_can_be_computed_and_ignores_partitions(spark):
    df = spark.range(503).select((F.col("id") * 7).alias("k"), F.lit("x").alias("shard"))
    one = {r.k: (r.row_number, r.shard, r.slot) for r in shard(df.repartition(1), [F.col("k")], 10, 3).collect()}
    many = {r.k: (r.row_number, r.shard, r.slot) for r in shard(df.repartition(9), [F.col("k")], 10, 3).collect()}
    assert one == many
    for number, s, slot in one.values():
        assert place_of(number, 503, 10, 3) == (s, slot)


def test_edge_rows(frame):
    rows = [(None, None), (None, None), (None, "a"), (3, ""), (3, ""), (3, "")]
    out = shard(frame(rows, "doc_id long, text string"), [F.col("doc_id")], 4).collect()
    assert sorted(r.row_number for r in out) == list(range(6))
    assert sorted((r.shard, r.slot) for r in out) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (3, 0)]
    assert shard(frame([], "doc_id long, text string"), [F.col("doc_id")], 4).count() == 0
