"""Chat formatting with a reversible template and a loss mask, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import let

# Template: "### role: text<next>text</turn>\n" per run of turns of one role.
HEAD, SEP, NEXT, END = "### ", ": ", "<next>", "</turn>\n"
# No escaped text holds "#", "<" or ":" of a control string, and a backslash only starts an escape.
TEXT_ESCAPES = (("\\", "\\s"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*TEXT_ESCAPES, (":", "\\c"))


def _escape(text: Column, pairs) -> Column:
    for raw, code in pairs:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def _unescape(text: Column, pairs) -> Column:
    for raw, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def format_conversations(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text, ...).

    Turns are collected per conversation and sorted by (turn, role, text); adjacent turns of one
    role become one block. ``loss_spans`` lists (start, length) in code points of ``formatted`` for
    each text of ``trained_role``; markers are never inside. NULL role or text counts as empty, a
    NULL turn sorts first, rows that repeat stay, NULL ``conv_id`` is a conversation of its own, and
    other columns are ignored. A conversation is one output row, so its turns have to fit into one.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def piece(t: Column):
        """Of turn i: what stands before its text, and its escaped text."""

        def one(x: Column, i: Column) -> Column:
            head = F.concat(F.lit(HEAD), _escape(x["role"], ROLE_ESCAPES), F.lit(SEP))
            before = F.get(t, i - 1)["role"]
            return F.struct(
                F.when(i == 0, head)
                .when(before == x["role"], F.lit(NEXT))
                .otherwise(F.concat(F.lit(END), head))
                .alias("lead"),
                _escape(x["text"], TEXT_ESCAPES).alias("body"),
                (x["role"] == trained_role).alias("loss"),
            )

        return F.transform(t, one)

    zero = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"),
    )

    def advance(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["lead"])
        length = F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    def build(pieces: Column) -> Column:
        text = F.array_join(F.transform(pieces, lambda p: F.concat(p["lead"], p["body"])), "")
        spans = F.aggregate(pieces, zero, advance, lambda acc: acc["spans"])
        return F.struct(F.concat(text, F.lit(END)).alias("formatted"), spans.alias("loss_spans"))

    built = let(F.col("t"), lambda t: let(piece(t), build))
    return sorted_turns.select("conv_id", built.alias("f")).select("conv_id", "f.formatted", "f.loss_spans")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns that ``formatted`` holds."""

    def block(b: Column) -> Column:
        head = F.substring_index(b, SEP, 1)
        role = _unescape(F.substr(head, F.lit(len(HEAD) + 1)), ROLE_ESCAPES)
        body = F.substr(b, F.char_length(head) + len(SEP) + 1)
        return F.transform(
            F.split(body, NEXT),
            lambda x: F.struct(role.alias("role"), _unescape(x, TEXT_ESCAPES).alias("text")),
        )

    blocks = F.filter(F.split(formatted, END), lambda b: b != "")
    return F.flatten(F.transform(blocks, block))


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """array<string>: the unescaped text under each span of the loss mask."""
    return F.transform(
        spans,
        lambda s: _unescape(
            F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), TEXT_ESCAPES
        ),
    )
