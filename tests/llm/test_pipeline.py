"""Every stage of the pipeline against plain Python on the smallest tables."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from curbline.llm import mixing
from curbline.llm.common import stored
from curbline.llm.queries import CAPACITY, op3_quality
from tests.llm.test_passages import brute as brute_passages
from tests.llm.test_packing import check
from tests.llm.test_parity import brute as brute_groups

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{SMALL}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        done = stored(stage(spark, docs, SMALL))
        out[name] = docs, done
        docs = done
    return out


def test_columns(spark, stages):
    want = spark.read.parquet(f"{SMALL}/documents.parquet").dtypes
    for name, (_, done) in stages.items():
        assert name == "packing" or done.dtypes == want


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    good = {r.doc_id for r in op3_quality(spark, SMALL).where("predicted = 1").collect()}
    rows = stages["quality"][1].collect()
    given = {r.doc_id: r for r in stages["quality"][0].collect()}
    assert {r.doc_id for r in rows} == good and all(r == given[r.doc_id] for r in rows) and len(rows) == len(good)


def test_lines_equal_brute_force(stages):
    given, done = (x.collect() for x in stages["lines"])
    texts = {r.doc_id: r.text for r in given}
    want = {i: t for i, t in brute_passages([(r.doc_id, r.text) for r in given], 50) if t.strip() or t == texts[i]}
    assert {r.doc_id: r.text for r in done} == want and len(want) < len(given)
    assert all(r.n_chars == len(r.text) for r in done if r.text != texts[r.doc_id])


def test_one_document_of_each_group_stays(stages):
    given, done = (x.collect() for x in stages["near_duplicates"])
    groups = brute_groups([(r.doc_id, r.text) for r in given])
    assert sorted(r.doc_id for r in done) == sorted(i for i, (_, c) in groups.items() if i == c)


def test_mixing_repeats_by_rate_and_keeps_clean_documents(spark, stages):
    given, done = stages["mixing"]
    counts = {r.doc_id: r["count"] for r in done.groupBy("doc_id").count().collect()}
    texts = {r.doc_id: r for r in given.collect()}
    assert all(texts[r.doc_id] == r for r in done.collect())
    domains, weights, bias = mixing.fit_domains(given, pipeline.domain_labels(spark, SMALL))
    rows = mixing.add_posteriors(given, weights, bias).collect()
    for r in rows:
        if domains[int(np.argmax(r.posterior))] in pipeline.WANTED and max(r.posterior) > 0.9:
            assert counts.get(r.doc_id, 0) >= 1
    assert sum(counts.values()) > len(counts)


def test_all_documents_are_packed(stages):
    given, done = (x.collect() for x in stages["packing"])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for r in given:
        n = len(plain.encode(r.text or "", add_special_tokens=False).ids) + 1
        want += [min(CAPACITY, n - k) for k in range(0, n, CAPACITY)]
    assert check(done, want, CAPACITY) <= 1.03 * sum(want) / CAPACITY + 1


def test_empty_table_runs_through(spark, frame):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.lit(False))
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL))
        assert docs.count() == 0, name
