"""Near duplicates of the pipeline on tables with repeated and NULL ids."""

import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _text(name):
    return " ".join(f"{name}{i}" for i in range(60))


def _left(spark, frame, docs):
    rows = frame([(d, t, "en", "s", 1) for d, t in docs], SCHEMA).repartition(3)
    done = pipeline.drop_near_duplicates(spark, rows, "")
    assert done.columns == pipeline.COLUMNS
    return sorted(((r.doc_id, r.text) for r in done.collect()), key=str)


def test_repeated_rows_and_null_ids(spark, frame):
    a, b, c = _text("a"), _text("b"), _text("c")
    docs = [(1, a), (1, a), (2, a), (None, b), (None, b), (None, c), (3, c), (4, None), (4, None)]
    assert _left(spark, frame, docs) == sorted([(1, a), (None, b), (None, c), (4, None)], key=str)


def test_one_id_with_several_texts_joins_no_groups(spark, frame):
    a, b, c = _text("a"), _text("b"), _text("c")
    docs = [(1, a), (2, b), (5, a), (5, b), (5, c)]
    assert _left(spark, frame, docs) == sorted([(1, a), (2, b), (5, c)], key=str)
