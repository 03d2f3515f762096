import random
import re

from curbline.llm.lines import remove_repeated_runs

SCHEMA = "doc_id long, text string, n_lines int"


def brute(docs, least):
    """Longest earlier match from every position, by plain comparison."""
    seq = []
    for i, (_, text) in enumerate(sorted((d, t) for d, t in docs if t is not None)):
        seq += [(x, i) for x in text.split("\n")]
    n_words = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x, _ in seq]
    gone = set()
    for i in range(len(seq)):
        best = 0
        for j in range(i):
            n = 0
            while (
                i + n < len(seq) and j + n < len(seq) and seq[i + n][0] == seq[j + n][0]
                and seq[i + n][1] == seq[i][1] and seq[j + n][1] == seq[j][1]
            ):
                n += 1
            best = max(best, n)
        # the run from i may be extended to the left by runs that start earlier, so each start counts alone
        if best and sum(n_words[i : i + best]) >= least:
            gone |= set(range(i, i + best))
    out, at = [], 0
    for doc, text in sorted((d, t) for d, t in docs if t is not None):
        lines = text.split("\n")
        out.append((doc, "\n".join(x for k, x in enumerate(lines) if at + k not in gone)))
        at += len(lines)
    return out


def _run(frame, docs, least):
    out = remove_repeated_runs(frame([(d, t, 1) for d, t in docs], SCHEMA), min_words=least).collect()
    return sorted((r.doc_id, r.text) for r in out if r.text is not None)


def test_random_texts_equal_brute_force(frame):
    for seed in range(4):
        rng = random.Random(seed)
        pool = ["a", "b b", "c c c", "", "d d d d d", " ", "e"]
        docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(12)]
        docs += [(12, docs[0][1]), (13, docs[1][1] + "\nnew one\n" + docs[2][1])]
        for least in (1, 4, 9):
            assert _run(frame, docs, least) == brute(docs, least), (seed, least)


def test_passage_of_several_lines(frame):
    passage = "\n".join(" ".join(f"w{i}{j}" for j in range(20)) for i in range(3))
    docs = [(1, f"x\n{passage}\ny"), (2, f"{passage}\nz"), (3, "x\ny\nz"), (4, passage.split("\n")[0])]
    assert _run(frame, docs, 50) == [(1, docs[0][1]), (2, "z"), (3, docs[2][1]), (4, docs[3][1])]


def test_edge_rows(frame):
    long = "\n".join(f"line {i} of many" for i in range(3000))
    docs = [(None, "p q r"), (None, "p q r"), (1, None), (2, ""), (3, ""), (4, long), (5, long), (6, "one " * 60)]
    out = {(r.doc_id, r.text): r for r in remove_repeated_runs(frame([(*d, 1) for d in docs], SCHEMA), min_words=3).collect()}
    assert len(out) == 7  # the two equal rows are one document and end alike
    assert out[None, "p q r"].n_removed == 0 and out[1, None].n_lines == 0
    assert out[2, ""].n_lines == out[3, ""].n_lines == 1
    assert out[4, long].n_removed == 0 and out[5, ""].n_removed == 3000
    assert remove_repeated_runs(frame([], SCHEMA)).count() == 0


def test_no_python_in_the_plan(frame, capsys):
    remove_repeated_runs(frame([(1, "a\nb", 1)], SCHEMA)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan
