"""Centroids, neighbours and hard negatives next to brute force, and their odd rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.llm import covertree, lloyd, permutation
from curbline.llm.queries import QUERIES
from tests.conftest import SMALL
from tests.llm.duck import same

SCHEMA = "vec_id long, embedding array<float>, label int, query string, cell string, x string, uid string"


def rows_of(spark, vectors, labels=None, ids=None):
    labels = labels if labels is not None else [i % 3 for i in range(len(vectors))]
    ids = ids if ids is not None else list(range(len(vectors)))
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], y, "q", "c", "x", "u")
            for i, v, y in zip(ids, vectors, labels, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def random_vectors(n, width=8, seed=0):
    return np.random.default_rng(seed).normal(size=(n, width)).astype(np.float32).astype(float)


ODD = [None, [None] * 8, [float("nan")] + [1.0] * 7, [float("inf")] + [0.0] * 7, []]


@pytest.mark.parametrize("name", ["op11_centroids", "op13_negatives"])
def test_queries_equal_their_sql(spark, name):
    same(spark, name, SMALL)


def brute_clusters(x, ids, k, rounds):
    x = np.floor(256 * x).astype(int)
    first = sorted(range(len(ids)), key=lambda i: hashlib.sha256(f"2:{ids[i]}".encode()).hexdigest())[:k]
    c = x[first]
    for step in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if step < rounds:
            c = np.array([x[own == j].sum(axis=0) // (own == j).sum() if (own == j).any() else c[j] for j in range(len(c))])
    return [(i, int(o), int(d[r, o])) for r, (i, o) in enumerate(zip(ids, own, strict=True))]


@pytest.mark.parametrize("width", [8, 16, 37])
def test_clusters_equal_brute_force(spark, width):
    x = random_vectors(300, width)
    x[50:150] = x[7]  # a third of all rows alike
    got = lloyd.centroid_clusters(rows_of(spark, x).repartition(5), 12, 4, width)
    out = sorted((r.vec_id, r.cluster, r.distance) for r in got.collect())
    assert out == brute_clusters(x, list(range(300)), 12, 4)
    told = got.groupBy("cluster").agg(F.sum("distance").alias("s"), F.max("cluster_inertia").alias("c"), F.max("inertia").alias("t")).collect()
    assert all(r.s == r.c and r.t == sum(o[2] for o in out) for r in told)


def test_clusters_of_odd_rows(spark):
    x = random_vectors(6)
    df = rows_of(spark, [*x, *ODD, [1.0] * 9, x[0], x[0]], ids=[*range(6), *range(100, 106), 0, None], labels=[None] * 14)
    out = lloyd.centroid_clusters(df, 40, 2, 8).collect()
    assert sorted((r.vec_id is None, r.vec_id) for r in out)[:-1] == [(False, i) for i in (0, 0, 1, 2, 3, 4, 5)]
    assert len(out) == 8 and all(r.distance == 0 for r in out)
    assert lloyd.centroid_clusters(df.limit(0), 40, 2, 8).collect() == []
    with pytest.raises(Exception, match="components beyond"):
        lloyd.centroid_clusters(rows_of(spark, [[1e9] * 8]), 2, 1, 8)


def brute_nearest(x, ids, asked, k):
    s = x[asked] @ x.T
    out = {}
    for row, i in enumerate(asked):
        others = [j for j in range(len(ids)) if ids[j] != ids[i]]
        out[ids[i]] = [(ids[j], s[row, j]) for j in sorted(others, key=lambda j: (-s[row, j], ids[j]))[:k]]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_small_tables_are_searched_exactly(spark):
    x = random_vectors(120) * np.float32(np.linspace(0.1, 5, 120))[:, None]  # lengths differ
    x = x.astype(np.float32).astype(float)
    x[20:60] = x[3]  # ties
    got = lists(permutation.nearest(rows_of(spark, x), F.col("id") % 20 == 0, 20))
    want = brute_nearest(x, list(range(120)), list(range(0, 120, 20)), 20)
    assert {q: [v for v, _ in hits] for q, hits in got.items()} == {q: [v for v, _ in hits] for q, hits in want.items()}
    assert all(s == pytest.approx(t, abs=1e-12) for q in want for (_, s), (_, t) in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("folder", [SMALL, "/root/testdata/sf0.1"])
def test_recall_is_over_nine_tenths(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    x, ids = np.array([r.embedding for r in rows], float), [r.vec_id for r in rows]
    got = lists(QUERIES["op12_neighbours"](spark, folder))
    want = brute_nearest(x, ids, [j for j, i in enumerate(ids) if i % 20 == 0], 20)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(len(w) for w in want.values())


def test_blocks_of_rows_and_queries_meet(spark, monkeypatch):
    monkeypatch.setattr(permutation, "BLOCK", 50)
    monkeypatch.setattr(permutation, "ASKED", 7)
    x = random_vectors(400)
    got = lists(permutation.nearest(rows_of(spark, x), F.col("id") % 10 == 0, 5))
    want = brute_nearest(x, list(range(400)), list(range(0, 400, 10)), 5)
    assert {q: [v for v, _ in h] for q, h in got.items()} == {q: [v for v, _ in h] for q, h in want.items()}


def test_neighbours_of_odd_rows(spark):
    x = random_vectors(4)
    df = rows_of(spark, [*x, *ODD, [0.0] * 8, x[1], [2.0]], ids=[20, 1, 2, 40, 60, 80, 100, 120, 140, 160, None, 180])
    got = lists(permutation.nearest(df, F.col("id") % 20 == 0, 20))
    assert set(got) == {20, 40, 180} and {v for v, _ in got[20]} == {1, 2, 40, 180}
    assert dict(got[180])[1] == pytest.approx(2 * x[1][0])
    assert permutation.nearest(df.limit(0), F.col("id") % 20 == 0, 20).collect() == []
    assert permutation.nearest(rows_of(spark, x[:1], ids=[20]), F.col("id") % 20 == 0, 20).collect() == []


def brute_negatives(x, labels, ids, anchors):
    x = np.floor(256 * x).astype(int)
    s = x @ x.T
    out = []
    for a in anchors:
        order = sorted((j for j in range(len(ids)) if j != a), key=lambda j: (-s[a, j], ids[j]))
        for p in [j for j in order if labels[j] == labels[a]][:5]:
            inside = [j for j in order if labels[j] != labels[a] and 30 * s[a, p] <= 100 * s[a, j] <= 90 * s[a, p]]
            out += [(ids[a], ids[p], r + 1, ids[j], int(s[a, p]), int(s[a, j])) for r, j in enumerate(inside[:10])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["random", "clustered", "alike", "lengths"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(covertree, "BLOCK", 60)
    monkeypatch.setattr(covertree, "ASKED", 9)
    monkeypatch.setattr(covertree, "LEAF", 8)
    n = 420
    x = random_vectors(n)
    if kind == "clustered":
        x = (random_vectors(6, seed=1)[np.arange(n) % 6] + 0.05 * x).astype(np.float32).astype(float)
    if kind == "alike":
        x[100:240] = x[5]
    if kind == "lengths":
        x = (x * np.exp(random_vectors(n, 1, seed=2))).astype(np.float32).astype(float)
    labels = list(np.random.default_rng(3).integers(0, 4, n).tolist())
    got = covertree.hard_negatives(rows_of(spark, x, labels).repartition(4), "id % 20 = 0")
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(x, labels, list(range(n)), range(0, n, 20))


def test_tree_holds_every_row_within_its_radii():
    y = random_vectors(500, 6)
    y[:100] = y[0]
    levels, leaf = covertree.build(y)
    node = leaf
    for level, above in zip(levels[::-1], [*levels[-2::-1], None], strict=True):
        gap = np.sqrt(((y - level.centre[node]) ** 2).sum(axis=1))
        assert (gap <= level.radius[node] + 1e-12).all()
        if above is not None:
            node = level.parent[node]
    assert len(levels[0].centre) == 1 and len(levels) > 2


def test_negatives_of_odd_rows(spark):
    x = np.abs(random_vectors(5))
    df = rows_of(
        spark, [*x, *ODD, x[0], x[0], x[1]], labels=[0, 0, 1, 1, None, 0, 0, 0, 0, 0, 0, 0, 1],
        ids=[0, 1, 2, 3, 4, 100, 200, 300, 400, 500, 0, None, 7],
    )
    got = covertree.hard_negatives(df, "id % 100 = 0").collect()
    assert {r.anchor_id for r in got} <= {0, 500} and not {r.negative_id for r in got} & {4, None}
    assert covertree.hard_negatives(df.limit(0), "id % 100 = 0").collect() == []
