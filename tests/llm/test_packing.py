import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curbline.llm.packing import pack, sum_of_squares, tokenized_pieces
from curbline.llm.queries import CAPACITY, op7_packing
from curbline.llm.subwords import Encoder

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["a", "B", "é", "é", "́", " ", "  ", "\n", "\t", "'s", "1", "中", "😀", "\xa0", "\x1c", "　", "!", "<|endoftext|>", "<|", "\r", "ΑΣ", "İ", " the"]


@pytest.mark.parametrize("name, blanks", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_remembered_words_give_the_ids_of_whole_texts(name, blanks):
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 9))) for _ in range(1500)] + ["", None, "w" * 500]
    encoder, plain = Encoder(public_tokenizers.path(name), blanks), Tokenizer.from_file(public_tokenizers.path(name))
    for _ in range(2):  # the second time from memory
        ids, offsets = encoder.encode(pa.array(texts, pa.string()), 7)
        for i, t in enumerate(texts):
            want = plain.encode(t or "", add_special_tokens=False).ids + [7]
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want, repr(t)


def check(rows, lengths, capacity):
    """Every piece once, sequences without gap or overlap and not beyond the capacity."""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(r.length for r in rows) == sorted(lengths)
    return len(bins)


def test_query_equals_whole_text_encoding(spark):
    rows = op7_packing(spark, SMALL).collect()
    plain = Tokenizer.from_file(PATH)
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = plain.encode(r.text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), CAPACITY):
            part = np.array(ids[k : k + CAPACITY], "<u4")
            want[r.doc_id, k // CAPACITY] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    used = check(rows, [w[1] for w in want.values()], CAPACITY)
    assert used <= 1.03 * sum(w[1] for w in want.values()) / CAPACITY + 1


def test_few_sequences_over_many_tasks(spark):
    rng = random.Random(2)
    lengths = [rng.randint(1, 1500) for _ in range(4000)] + [2048] * 20
    df = spark.createDataFrame([(i, n, 9) for i, n in enumerate(lengths)], "doc_id long, length long, offset int")
    used = check(pack(df, 2048, group=500).collect(), lengths, 2048)
    assert used <= 1.02 * sum(lengths) / 2048 + 1


def test_equal_rows_are_dealt_to_all_tasks(spark):
    rows = pack(spark.range(3000).selectExpr("7 AS doc_id", "1024L AS length"), 2048, group=500).collect()
    assert check(rows, [1024] * 3000, 2048) <= 1503
    tasks = {}
    for r in rows:
        tasks[r.sequence_id >> 32] = tasks.get(r.sequence_id >> 32, 0) + 1
    assert len(tasks) >= 6 and max(tasks.values()) < 700


def test_edge_rows(frame):
    rows = [(1, None, 0), (2, "", 0), (None, "a b", 0), (3, "word " * 5000, 0), (3, "word " * 5000, 0)]
    pieces = tokenized_pieces(frame(rows, "doc_id long, text string, piece int"), PATH, 2048)
    got = pack(pieces, 2048).collect()
    assert sorted(r.length for r in got) == [1, 1, 3, 905, 905, 2048, 2048, 2048, 2048]
    assert all(len(r.ids) == r.length for r in got)
    check(got, [r.length for r in got], 2048)
    assert pack(tokenized_pieces(frame([], "doc_id long, text string"), PATH, 2048), 2048).count() == 0


def test_placement_follows_the_rule():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 31, 400)
    place, offset, _ = sum_of_squares(lengths, 30)
    gaps = []
    for i, size in enumerate(lengths):
        open_ = [30 - sum(lengths[j] for j in range(i) if place[j] == b) for b in range(len(gaps))]

        def total(now):
            counts = np.bincount([g for g in now if g > 0], minlength=31)
            return int((counts**2).sum())

        options = [total([g - size if k == b else g for k, g in enumerate(open_)]) for b in range(len(open_)) if open_[b] >= size]
        options.append(total([*open_, 30 - size]))
        mine = [g - size if k == place[i] else g for k, g in enumerate(open_)]
        if place[i] == len(gaps):
            gaps.append(30)
            mine = [*open_, 30 - size]
        assert total(mine) == min(options)
