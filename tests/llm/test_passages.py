"""Repeated passages inside lines against plain Python."""

import random
import re

import corpus_pipeline as pipeline
from curbline.llm.lines import remove_repeated_passages
from curbline.llm.queries import op9_lines

PIECE = re.compile(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def brute(docs, least):
    """Every window of words that was seen before goes."""
    seen, out = set(), []
    for doc, text in sorted(docs):
        pieces, gone = PIECE.findall(text), set()
        for i in range(len(pieces) - least + 1):
            window = tuple(p.rstrip(" \t\n\x0b\f\r") for p in pieces[i : i + least])
            if window in seen:
                gone |= set(range(i, i + least))
            seen.add(window)
        lead = re.match(r"[\x20\x09-\x0D]*", text).group()
        out.append((doc, lead + "".join(p for i, p in enumerate(pieces) if i not in gone)))
    return out


def _run(frame, docs, least):
    out = remove_repeated_passages(frame(docs, "doc_id long, text string"), min_words=least).collect()
    return sorted((r.doc_id, r.text) for r in out)


def test_random_texts_equal_brute_force(frame):
    rng = random.Random(5)
    few = [(i, "".join(rng.choice("ab") + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 40)))) for i in range(20)]
    pool = [f"w{i}" for i in range(400)]
    base = [[rng.choice(pool) for _ in range(rng.randint(20, 400))] for _ in range(6)]
    many = []
    for i in range(60):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 2)):
            source, at, n = rng.choice(base), rng.randint(0, 60), rng.choice([30, 49, 50, 51, 70, 200])
            k = rng.randint(0, len(words))
            words[k:k] = source[at : at + n]
        many.append((i, " " * rng.randint(0, 2) + "".join(w + rng.choice([" ", " ", "\n"]) for w in words)))
    twice = few + [(i + 20, f"b {t}a") for i, t in few]
    for docs, least in ((few, 1), (few, 7), (twice, 16), (many, 50), (many, 20)):
        want = brute(docs, least)
        assert want != sorted(docs)
        assert _run(frame, docs, least) == want, least


def test_passages_about_as_long_as_the_least(frame):
    """Passages inside passages, a word shorter or longer than the least, with stretches without chosen words."""
    rng = random.Random(77)
    pool = [f"w{i}" for i in range(400)]
    base = [[rng.choice(pool) for _ in range(rng.randint(20, 400))] for _ in range(6)]
    docs = []
    for i in range(150):
        words = [rng.choice(pool) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 4)):
            source, at, n = rng.choice(base), rng.randint(0, 90), rng.choice([18, 19, 20, 21, 24, 30, 49, 50, 51, 70])
            k = rng.randint(0, len(words))
            words[k:k] = source[at : at + n]
        docs.append((i, " ".join(words)))
    for least in (50, 20):
        want = brute(docs, least)
        assert want != docs and _run(frame, docs, least) == want, least


def test_long_stretches_without_chosen_words(frame):
    same = "one " * 60
    docs = [(1, same), (2, f"x {same}y"), (3, "z"), (4, "")]
    assert _run(frame, docs, 50) == brute(docs, 50)


def _planted():
    passage = " ".join(f"p{i}" for i in range(55))
    docs = [(d, f"the {d} start {d} {passage} {d} the end\nlast line {d}") for d in range(3)]
    docs += [(3, "alone"), (4, " ".join(passage.split()[:49]))]
    want = {d: t if d in (0, 3, 4) else t.replace(passage + " ", "") for d, t in docs}
    return docs, want


def test_planted_in_the_middle_of_lines(spark, frame, tmp_path):
    docs, want = _planted()
    rows = [(d, t, "en", "s", len(t)) for d, t in docs]
    table = frame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.text for r in op9_lines(spark, str(tmp_path)).collect()} == want
    done = table
    for name, stage in pipeline.STAGES:
        if name == "lines":
            done = stage(spark, done, str(tmp_path))
    assert {r.doc_id: (r.text, r.n_chars) for r in done.collect()} == {d: (t, len(t)) for d, t in want.items()}


def test_edge_rows(spark, frame):
    text = " ".join(f"w{i}" for i in range(60))
    docs = [(None, text), (None, text), (1, None), (2, f"a {text}"), (3, text), (5, "")]
    out = {(r.doc_id, r.text, r.n_words_removed) for r in remove_repeated_passages(frame(docs, "doc_id long, text string")).collect()}
    assert out == {(None, text, 0), (1, None, 0), (2, "a ", 60), (3, "", 60), (5, "", 0)}
    assert remove_repeated_passages(frame([], "doc_id long, text string")).count() == 0
    rows = [(1, text, "en", "s", 9), (2, f" {text}", "en", "s", 9)]
    left = pipeline.drop_repeated_lines(spark, frame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert [r.doc_id for r in left.collect()] == [1]


def test_smallest_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text IS NOT NULL").select("doc_id", "text")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((r.doc_id, r.text) for r in remove_repeated_passages(docs).select("doc_id", "text").collect())
    assert got == brute(given, 50) and got != sorted(given)


def test_units_cover_windows_at_any_cut(frame):
    """Near copies, shifted copies, whole copies and passages at the borders of units, with every hash that chooses."""
    rng = random.Random(11)
    source = [f"s{i}" for i in range(300)]
    docs = [(0, " ".join(source))]
    for i in range(1, 40):
        a = rng.randint(0, 240)
        part = source[a : a + rng.choice([49, 50, 51, 55, 120])]
        if i % 3 == 0 and len(part) > 60:
            part[len(part) // 2] = f"new{i}"
        docs.append((i, f"head{i} tail " + " ".join(part) + f" after{i}\nline {i}"))
    docs += [(40, docs[0][1]), (41, docs[0][1] + " more"), (42, docs[1][1])]
    assert _run(frame, docs, 50) == brute(docs, 50)
