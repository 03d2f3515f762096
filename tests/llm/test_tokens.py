import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from curbline.llm import rangecoder
from curbline.llm.queries import op10_tokens
from curbline.llm.tokenfiles import read_token_files, write_token_files
from curbline.session import scratch_dir

PATH = public_tokenizers.path("byte_bpe_50k.json")
RNG = np.random.default_rng(0)
STREAMS = [
    [], [5], [70_000, 1, 2, 3], RNG.integers(0, 50_257, 4096), RNG.integers(0, 50_257, 4097), np.tile([1, 2, 3], 3000),
    RNG.integers(0, 50, 9000), RNG.integers(0, 2**32, 5000), np.zeros(8192), np.full(5000, 65_535),
]


@pytest.mark.parametrize("ids", STREAMS)
def test_round_trip(ids):
    ids = np.asarray(ids).astype(np.uint32)
    assert (rangecoder.decode(rangecoder.encode(ids)) == ids).all()


def test_what_repeats_gets_small_and_damage_is_found():
    ids = np.tile(RNG.integers(0, 50_000, 40), 300).astype(np.uint32)
    data = rangecoder.encode(ids)
    assert len(data) < len(ids) / 4
    for at in (0, len(data) // 2, 30):
        with pytest.raises(ValueError):
            rangecoder.decode(data[:at] + bytes([data[at] ^ 255]) + data[at + 1 :])


def test_blocks_are_independent():
    """A block's bytes do not depend on the blocks beside it."""
    a, b = RNG.integers(0, 300, 4096), RNG.integers(0, 900, 4096)
    both = rangecoder._encode(np.stack([a, b]).astype(np.uint32), 4096)
    assert both[0] == rangecoder._encode(a[None].astype(np.uint32), 4096)[0]
    assert both[1] == rangecoder._encode(b[None].astype(np.uint32), 4096)[0]


def expected(docs):
    tokenizer, out, start = Tokenizer.from_file(PATH), [], 0
    for doc, text in sorted(docs, key=lambda d: ((d[0] is not None, d[0]), (d[1] is not None, d[1] or ""))):
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_text_encoding(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op10_tokens(spark, folder).orderBy("start").collect()]
    assert got == expected(docs)


def test_edge_rows_and_ids(spark, frame):
    docs = [(5, "b  c\n\n"), (5, "a"), (None, "z"), (1, None), (2, ""), (3, "long " * 30_000), (3, "long " * 30_000)]
    path = scratch_dir(spark, "tokens")
    write_token_files(frame([(*d, 1) for d in docs], "doc_id long, text string, part int").repartition(3), path, PATH, 2)
    rows = read_token_files(spark, path).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows] == expected(docs)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    empty = scratch_dir(spark, "tokens")
    write_token_files(frame([], "doc_id long, text string"), empty, PATH, 2)
    assert read_token_files(spark, empty).count() == 0
