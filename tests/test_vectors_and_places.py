"""Retrieval against numpy, and place matching against brute force."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curbline.operators import place_match, vectors
from tests.conftest import values


def brute(queries, stored, k):
    def unit(rows):
        m = np.array([v for _, v in rows], dtype="float64")
        return m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)

    scores = np.round(unit(queries) @ unit(stored).T, 6)
    result = set()
    for (query, _), row in zip(queries, scores):
        ranked = sorted(zip(-row, [i for i, _ in stored]))[:k]
        result |= {(query, i, rank + 1) for rank, (_, i) in enumerate(ranked)}
    return result


@pytest.mark.parametrize("block", [4096, 16, 3])
def test_top_k_with_any_block_size(spark, frame, monkeypatch, block):
    """Ties, a zero vector and k above the number of rows included."""
    monkeypatch.setattr(vectors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    stored = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(90)] + [(90, [0.0] * 4)]
    queries = [(f"q{i}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(8)]
    v = frame(stored, "vec_id long, embedding array<double>").repartition(5)
    q = frame(queries, "query_id string, embedding array<double>")
    for k in (5, 200):
        got = vectors.cosine_top_k(q, v, k)
        assert {(r.query_id, r.vec_id, r["rank"]) for r in got.collect()} == brute(queries, stored, k)


def test_a_block_is_scored_in_bounded_pieces(monkeypatch):
    """A task never holds the scores of a whole block of queries; the result does not depend on the pieces."""
    rng = np.random.default_rng(5)
    tables = [
        pa.table({n: pa.array(range(rows)), "embedding": pa.array(list(rng.normal(size=(rows, 8))), pa.list_(pa.float64()))})
        for n, rows in (("query_id", 1000), ("vec_id", 4096))
    ]
    tracemalloc.start()
    got = vectors._score_group("vec_id", 5)(*tables)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 << 20  # all scores of this block are 33 MB
    monkeypatch.setattr(vectors, "PRODUCT_CELLS", 1 << 30)
    assert vectors._score_group("vec_id", 5)(*tables).equals(got)


def test_no_queries(frame):
    q = frame([], "query_id string, embedding array<double>")
    v = frame([(1, [1.0])], "vec_id long, embedding array<double>")
    assert vectors.cosine_top_k(q, v).isEmpty()


def test_retrieval_scores_by_hand(frame):
    ranked = frame([("a", 1, 1), ("a", 2, 2), ("a", 3, 3)], "query_id string, id int, rank int")
    relevant = frame([("a", 1), ("a", 3), ("a", 9), ("b", 1)], "query_id string, id int")
    got = {r.query_id: r for r in vectors.retrieval_scores(ranked, relevant, 3).collect()}
    assert got["a"].precision == pytest.approx(2 / 3) and got["a"].recall == pytest.approx(2 / 3)
    assert got["a"].reciprocal_rank == 1.0
    assert got["a"].ndcg == pytest.approx((1 + 1 / 2) / (1 + 1 / np.log2(3) + 1 / 2))
    assert got["a"].average_precision == pytest.approx((1 + 2 / 3) / 3)
    assert got["b"].precision == 0.0 and got["b"].ndcg == 0.0


def test_place_matching_equals_brute_force(frame):
    names = ["Park Street", "Park", "North Park Square", "O'Brien Way", "Square One", "St. Mary's", None, "Quincy Center"]
    typed = ["park", "PARK station", "ark str", "square,", "zzz", "", " , ", "brien w", "mary's", "quincy center station"]
    transit = frame(
        [(str(i), n, 42.0, -71.0) for i, n in enumerate(names)], "station_id string, station_name string, lat double, lng double"
    )
    requests = frame([(p,) for p in typed * 2], "place string")
    got = place_match.match_places(requests, transit)
    assert got.count() == 2 * len(typed)
    for row in got.collect():
        hits = [n for n in names if n and row.cleaned and row.cleaned.lower() in n.lower()]
        assert row.station_name == (min(hits, key=lambda n: (len(n), names.index(n))) if hits else None), row


def test_zero_and_unit_vectors(frame):
    v = frame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = dict(values(vectors.normalise(v).select("vec_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("e")), "vec_id", "e"))
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0]}


def test_places_of_any_characters_equal_contains(frame):
    import random

    rng = random.Random(3)
    names = ["A & B", "&", "St. Mary's", "x" * 80, "Ärger", "a"] + ["".join(rng.choice("ab &-.") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    asked = ["&", "& b", "mary's", "ÄR", "zzz", "", None] + ["".join(rng.choice("ab &-") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    stations = frame([(str(i), n, 1.0, 2.0) for i, n in enumerate(names)], "station_id string, station_name string, lat double, lng double")
    out = place_match.match_places(frame([(a,) for a in asked], "place string"), stations).collect()
    assert len(out) == len(asked)
    for row in out:
        hits = [(len(n), str(i)) for i, n in enumerate(names) if row.cleaned and row.cleaned.lower() in n.lower()]
        assert row.station_id == (min(hits)[1] if hits else None), row


def test_context_scores_are_rounded_by_their_exact_value(frame):
    scores = [0.0135, 0.4175, 0.0005, 0.2665, 0.0625, 0.1875, 0.999999, -0.0004, -0.4175, 0.0, 1.0, 0.123456]
    hits = frame(
        [(i, 1, "s", 0, score, "t") for i, score in enumerate(scores)],
        "query_id int, rank int, source string, chunk_id int, score double, chunk_text string",
    )
    got = [text for _, text in values(vectors.context_block(hits), "query_id", "context")]
    assert got == [f"[source=s, chunk_id=0, score={score:.3f}]\nt" for score in scores]
