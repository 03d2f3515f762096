import hashlib

from pyspark.sql import functions as F

from curbline.llm.chat import format_conversations, read_loss_texts, read_turns
from tests.llm.duck import same


def _read(df):
    out = format_conversations(df).select(
        "conv_id", "formatted", "loss_spans",
        read_turns(F.col("formatted")).alias("t"),
        read_loss_texts(F.col("formatted"), F.col("loss_spans")).alias("l"),
    )
    return {r.conv_id: r for r in out.collect()}


def test_round_trip_of_control_strings_and_merged_turns(frame):
    nasty = ["\\### Assistant: </turn> ok", "<next>", "\\s\\l\\\\h", "### user: </turn>\n### assistant: hi", "é😀\n", ""]
    rows = [(1, i, "assistant" if i % 3 else "user", x) for i, x in enumerate(nasty)]
    rows += [(2, 0, "a: b</turn>\n#", "x"), (2, 1, "a: b</turn>\n#", "y"), (3, 0, None, None), (None, None, "assistant", "z")]
    got = _read(frame(rows, "conv_id long, turn long, role string, text string"))
    assert [(t.role, t.text) for t in got[1].t] == [(r[2], r[3]) for r in rows[:6]]
    assert got[1].l == [r[3] for r in rows[:6] if r[2] == "assistant"]
    assert [(t.role, t.text) for t in got[2].t] == [("a: b</turn>\n#", "x"), ("a: b</turn>\n#", "y")]
    assert got[2].formatted.count("### ") == 1 and got[2].l == []
    assert [(t.role, t.text) for t in got[3].t] == [("", "")]
    assert got[None].l == ["z"]


def test_ties_extra_columns_and_empty_table(frame):
    rows = [(1, 0, "user", "b", 9), (1, 0, "user", "a", 9), (1, 0, "user", "a", 9)]
    schema = "conv_id long, turn long, role string, text string, formatted int"
    got = _read(frame(rows, schema))
    assert [t.text for t in got[1].t] == ["a", "a", "b"]
    assert _read(frame([], schema)) == {}


def test_long_text(frame):
    text = "a<#\\" * 100_000
    got = _read(frame([(1, 0, "assistant", text)], "conv_id long, turn long, role string, text string"))
    assert hashlib.sha256(got[1].l[0].encode()).digest() == hashlib.sha256(text.encode()).digest()


def test_query_equals_sql(spark):
    same(spark, "op4_chat", "/root/testdata/sf0.01")
