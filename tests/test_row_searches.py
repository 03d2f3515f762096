"""Searches whose queries are single rows of the table."""

import __spark_entry__ as entry
from tests.conftest import SMALL


def test_every_twentieth_row_is_asked(spark):
    rows = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    asked = {r.vec_id for r in rows.where("vec_id % 20 = 0").select("vec_id").collect()}
    for name in ("cosine_top_five", "cosine_distance_top_five"):
        got = entry.queries()[name](spark, SMALL).collect()
        assert {r.query_id for r in got} == asked and len(got) == 5 * len(asked) == 125
        assert {r.vec_id for r in got if r["rank"] == 1} == asked
    context = entry.queries()["retrieval_context"](spark, SMALL).collect()
    assert context and {r.query_id for r in context} <= asked
