import re

from curbline.llm.rules import BASE_RULES, RULES, apply_rules, sample_texts
from tests.llm.duck import same

NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(inside),
    )


TEXTS = [
    None, "", " \t\n", "a", "a b c d e", "a b c d e a b c d e", "x " * 40, "one two\none two\n\nthree\x0bfour \xa0five",
    "a b c d e f g a b c d e h i j k a b c d z", "#*$%&|<> ok", "é😀 " * 7, "\n".join(["same line here"] * 9),
    "w " * 50_000, " ".join(str(i) for i in range(60_000)), "UPPER CASE " * 3 + "and more of it goes on",
]


def test_measures_equal_plain_python(frame):
    df = frame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept int")
    for r in apply_rules(df, keep_measures=True).collect():
        assert tuple(r[n] for n in NAMES) == _plain(r.text), r.doc_id


def test_order_changes_no_verdict(frame):
    df = frame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    raw = {r.doc_id: r.kept for r in apply_rules(df).collect()}
    measured = {r.doc_id: r.kept for r in apply_rules(df, rules=RULES[::-1], keep_measures=True).collect()}
    assert raw == measured and any(raw.values()) and not all(raw.values())


def test_measures_outside_the_query_are_taken_inside_the_cascade(frame):
    df = frame([(i, t, "z", 5) for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, n_lines string, n_words int")
    done = apply_rules(df, keep_measures=("n_words", "word_chars"))
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert done.columns == [*df.columns, "word_chars", "failed_rule", "kept"] and " AS n_capitals" not in plan
    rows = done.collect()
    assert {r.n_lines for r in rows} == {"z"} and all(r.n_words == _plain(r.text)[0] for r in rows)
    plain = {r.text: r.kept for r in apply_rules(df).collect()}
    assert len(rows) == 2 * len(TEXTS) and all(r.kept == plain[r.text] for r in rows)


def test_sample_holds_each_text_once(frame):
    df = frame([(t,) for t in TEXTS * 5], "text string")
    assert sorted(map(str, (r[0] for r in sample_texts(df, "text", 400).collect()))) == sorted(map(str, TEXTS))
    some = [r[0] for r in sample_texts(df, "text", 4).collect()]
    assert len(set(some)) == 4 and some.count(some[0]) == 1


def test_empty_table(frame):
    assert apply_rules(frame([], "doc_id long, text string"), rules=BASE_RULES).count() == 0


def test_plan_is_native(frame, capsys):
    apply_rules(frame([(1, "a")], "doc_id long, text string")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_query_equals_sql(spark):
    same(spark, "op8_rules", "/root/testdata/sf0.01")
