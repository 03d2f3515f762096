import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from curbline.llm.parity import CROWD, facts, hamming_at_most, jaccard_components, meeting_keys, most_differing
from curbline.llm.tokens import chunks, shingles, word_hashes

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id int"


def sets(docs):
    low = str.maketrans({i: i + 32 for i in range(65, 91)})
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    return out


def brute(docs):
    s = sets(docs)
    inside = defaultdict(list)
    for i, x in s.items():
        for g in x:
            inside[g].append(i)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in s.items():
        common = defaultdict(int)
        for g in x:
            for j in inside[g]:
                common[j] += j < i
        for j, n in common.items():
            if n and 100 * n >= 75 * (len(x) + len(s[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(x), find(i)) for i, x in s.items()}


def got(frame, docs):
    out = jaccard_components(frame([(*d, 0) for d in docs], SCHEMA)).collect()
    return {r.id: (r.n_shingles, r.component_id) for r in out}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


def test_copies_near_the_threshold_equal_brute_force(frame):
    rng, docs = random.Random(7), []
    for size in (1, 3, 4, 5, 6, 8, 9, 12, 20, 47, 90, 180, 400):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for n in (0, 0, 1, 1, 2, 3, size // 40 + 1, size // 30 + 1, size // 25 + 1, size // 20 + 2):
            cut = rng.randrange(0, size // 6 + 1)
            docs.append((len(docs), " ".join(changed(rng, base[cut:] or base, n))))
    want = brute(docs)
    assert got(frame, docs) == want
    assert 20 < len({c for _, c in want.values()}) < len(docs)


def test_crowd_of_near_copies_and_shared_passages(frame):
    """More sets in one key than are paired; some in the crowd are linked with each other only."""
    rng = random.Random(3)
    passage, docs = [f"p{i}" for i in range(60)], []
    for _ in range(3 * CROWD):
        docs.append((len(docs), " ".join([*passage, *[f"u{rng.randrange(10**6)}" for _ in range(25)]])))
    for _ in range(6):
        own = [f"v{rng.randrange(10**6)}" for _ in range(25)]
        for n in range(4):
            docs.append((len(docs), " ".join(changed(rng, [*passage, *own], n))))
    base = [f"b{i}" for i in range(150)]
    for n in range(3 * CROWD):
        docs.append((len(docs), " ".join(changed(rng, base, n % 9))))
    assert got(frame, docs) == brute(docs)


def test_real_documents_equal_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    out = {r.id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert out == brute(docs)


def test_edge_rows(frame):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A\tb"), (6, "a b c"), (7, long), (8, long + " end"), (8, long + " end")]
    out = got(frame, docs)
    assert out == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (29_996, 7), 8: (29_997, 7)}
    null = jaccard_components(frame([(None, "a b c d e f", 0), (None, "a b c d e f", 0)], SCHEMA)).collect()
    assert [(r.id, r.n_shingles, r.component_id) for r in null] == [(None, 2, None)] * 2
    assert jaccard_components(frame([], SCHEMA)).count() == 0


def test_linked_sets_share_a_key_and_pass_the_sketch():
    """The two lower bounds, on sets right at the threshold."""
    rng = np.random.default_rng(1)
    for size in (4, 7, 30, 33, 100, 257, 1000, 2050):
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64))
            keep = rng.permutation(a)
            drop = int(rng.integers(0, len(a) // 4 + 1))
            both = keep[drop:]
            b = np.concatenate([both, rng.integers(0, 1 << 63, len(a)).astype(np.uint64)])
            while 100 * len(both) < 75 * (len(a) + len(b) - len(both)):
                b = b[:-1]
            b = np.unique(b)
            n = np.array([len(a), len(b)])
            key, row = meeting_keys(np.concatenate([a, b]), np.repeat([0, 1], n), n)
            if most_differing(*n) and len(set(a) ^ set(b)):
                assert set(key[row == 0]) & set(key[row == 1]), (size, n)


def test_sketch_never_rejects_a_linked_pair(frame):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(changed(rng, base, i % 9))) for i in range(40)]
    known = {r.id: r for r in facts(frame(docs, "id long, text string")).collect()}
    s = sets(docs)
    for i in s:
        for j in s:
            if 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                n = np.array([known[i].n]), np.array([known[j].n])
                assert hamming_at_most(*n, [bytes(known[i].sketch)], [bytes(known[j].sketch)])[0]


def test_shingles_do_not_depend_on_chunks():
    texts = pa.array(["a b c d e f", None, "", "x " * 9, "one"])
    for limit in (1, 8, 1 << 20):
        out = []
        for first, end, data, offsets in chunks(texts, limit):
            h, row = shingles(*word_hashes(data, offsets, lower=True), end - first)
            out += [(int(r) + first, int(v)) for r, v in zip(row, h, strict=True)]
        assert [sum(r == i for r, _ in out) for i in range(5)] == [2, 0, 0, 1, 1]
        assert sorted(out) == sorted(set(out))
