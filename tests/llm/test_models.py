"""Quality classifier and domain mixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.llm import mixing, quality
from curbline.llm.queries import domain_labels, held_out, op2_mixing, op3_quality, target_totals

FOLDER = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    out = op3_quality(spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = out.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.93
    assert np.mean([r.predicted for r in rows if r.quality == 1]) > 0.97
    assert out.count() == 1000 and out.where("score NOT BETWEEN 0 AND 1").count() == 0


def test_held_out_labels_are_not_read(spark):
    """Turning round all held-out labels changes no score."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    out = held_out(F.col("doc_id"))
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (quality.train(docs, x, "quality", ~out)[1] for x in (labels, turned))
    assert all((a == b).all() for a, b in zip(one.layers, two.layers, strict=True)) and one.temperature == two.temperature


def test_vectors_do_not_depend_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text")
    assert (quality.word_vectors(docs.repartition(1)) == quality.word_vectors(docs.repartition(7))).all()


def test_pooling_of_a_long_text_ignores_its_neighbours():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(quality.SLOTS, quality.DIM)).astype(np.float32)
    long = " ".join(f"w{i % 999}" for i in range(150_000))
    alone, among = quality.pooled(pa.array([long]), vectors), quality.pooled(pa.array(["a", long, None, "a"]), vectors)
    assert np.allclose(alone[0], among[1], atol=1e-4) and np.allclose(among[0], among[3]) and not among[2].any()


def test_quality_edge_rows(frame):
    docs = frame([(1, None, 5.0), (2, "", 5.0), (None, "a b", 5.0), (3, "w " * 200_000, 5.0), (3, "x", 5.0)], "doc_id long, text string, score double")
    labels = frame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    vectors, net = quality.train(docs, labels, "quality", F.lit(True))
    out = quality.score(docs, vectors, net).collect()
    assert net.layers is None and {round(r.score, 6) for r in out} == {round(2 / 3, 6)} and len(out) == 5
    none = frame([], "doc_id long, text string")
    vectors, net = quality.train(none, labels, "quality", F.lit(True))
    assert net.constant == 0.5 and quality.score(none, vectors, net).count() == 0


def brute_rates(n, p, targets, rounds=2000):
    """Plain projected gradient on all documents at once, in the same metric."""
    square = (p * n[:, None]).T @ p
    metric = np.linalg.inv(square / np.trace(square) + 1e-9 * np.eye(p.shape[1])) / np.trace(square)
    r = np.ones(len(n))
    for _ in range(rounds):
        r = np.maximum(0, r - p @ (metric @ ((r * n) @ p - targets)))
    return r


def test_rates_equal_plain_projected_gradient(frame):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.4, 0.8, 0.3], 400)
    n = rng.integers(0, 500, 400)
    df = frame([(int(a), [float(x) for x in b], "r") for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>, rate string")
    have = n @ p
    for targets in (have, have * [0.5, 1.3, 0.9], have * [0.0, 1.0, 1.0], [0.0, 0.0, float(n.sum())]):
        steps, totals = mixing.fit_rates(df, np.array(targets))
        rows = mixing.add_rates(df, steps, 3).collect()
        rate = np.array([r.rate for r in rows])
        p_read, n_read = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows])
        assert (rate >= 0).all() and np.allclose((rate * n_read) @ p_read, totals)
        want = brute_rates(n_read, p_read, np.array(targets))
        square = (p_read * n_read[:, None]).T @ p_read
        loss = [d @ np.linalg.solve(square, d) / n.sum() for d in (totals - targets, (want * n_read) @ p_read - targets)]
        assert loss[0] <= 1.05 * loss[1] + 1e-5


def test_mixture_meets_its_targets(spark):
    out = op2_mixing(spark, FOLDER)
    rows = out.collect()
    assert len(rows) == 1000
    p, n = np.array([r.posterior for r in rows]), np.array([r.n_tokens for r in rows])
    rate = np.array([r.rate for r in rows])
    domains = sorted(r.domain for r in domain_labels(spark, FOLDER).select("domain").distinct().collect())
    totals, targets = (rate * n) @ p, target_totals(domains, int(n.sum()))
    assert np.abs(totals - targets).max() < 0.02 * n.sum()
    assert all(np.allclose(r.target_tokens, targets) and np.allclose(r.reached_tokens, totals) for r in rows)
    assert np.allclose(p.sum(axis=1), 1) and all(abs(r.copies - r.rate) <= 1 for r in rows)
    words = {r.doc_id: len(r.text.split()) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == words


def test_mixing_edge_rows(frame):
    docs = frame([(1, None, 1), (2, "", 1), (None, "a b", 1), (3, "w " * 100_000, 1), (3, "x y", 1)], "doc_id long, text string, posterior int")
    for labels in ([], [(3, "a"), (3, "b"), (2, None), (None, "c")]):
        domains, weights, bias = mixing.fit_domains(docs, frame(labels, "doc_id long, domain string"))
        out = mixing.add_posteriors(docs, weights, bias)
        assert sorted(r.n_tokens for r in out.collect()) == [0, 0, 2, 2, 100_000] and len(domains) == 1
        steps, _ = mixing.fit_rates(out, np.array([50_002.0]))
        assert {round(r.rate, 4) for r in mixing.add_rates(out, steps, 1).collect()} == {0.5}
    none = mixing.add_posteriors(frame([], "doc_id long, text string"), weights, bias)
    assert mixing.add_rates(none, mixing.fit_rates(none, np.array([0.0]))[0], 1).count() == 0


def test_targets_out_of_reach_are_told(frame):
    df = frame([(10, [0.5, 0.5])] * 4, "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="miss the targets"):
        _, totals = mixing.fit_rates(df, np.array([40.0, 0.0]))
    assert np.isclose(totals[0], totals[1])


def test_copies_are_right_on_average(spark):
    df = spark.range(20_000).select("id", mixing.whole_copies(F.lit(1.3), F.col("id")).alias("n"))
    assert abs(df.agg(F.avg("n")).first()[0] - 1.3) < 0.02
    assert df.where("n NOT IN (1, 2)").count() == 0
