"""Quality rules as a short-circuit cascade, in Spark expressions only."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import fresh, let, stored

WINDOW = 5
WHITE = "[ \\t-\\r]+"
SYMBOLS = "[#*$%&|<>]"


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE), "")


def repeated_words(tokens: Column) -> Column:
    """Words inside ``WINDOW``-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hash. Texts whose windows are all distinct stop there; for the
    others the windows are sorted with their places, and each place adds what it covers anew.
    """

    def hashed(h: Column) -> Column:
        return F.transform(
            F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]),
        )

    def covered(places: Column) -> Column:
        steps = F.transform(
            places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW)))
        )
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def among(s: Column) -> Column:
        twice = F.filter(
            s, lambda x, k: (F.get(s, k - 1)["w"] == x["w"]) | (F.get(s, k + 1)["w"] == x["w"])
        )
        return let(F.sort_array(F.transform(twice, lambda x: x["i"])), covered)

    def count(w: Column) -> Column:
        placed = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(placed), among)
        )

    hashes = F.transform(tokens, lambda x: F.xxhash64(x))
    return let(hashes, lambda h: let(hashed(h), count))


def measures(text: Column) -> dict[str, Column]:
    """Expressions over one text; NULL counts as a text without words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return {
        "n_words": F.size(words(text)).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, WHITE, "")).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_repeat_words": repeated_words(words(text)).cast("long"),
        "n_capitals": F.regexp_count(text, F.lit("\\p{Lu}")).cast("long"),
    }


@dataclass(frozen=True)
class Rule:
    """``fails`` maps the measures (by name) to a condition that rejects a text."""

    name: str
    fails: Callable[[dict[str, Column]], Column]


BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 10),
    Rule("repeats", lambda m: m["n_repeat_words"] * 100 > m["n_words"] * 20),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda m: m["n_symbols"] * 100 > m["n_words"] * 30),
    Rule("same_lines", lambda m: m["n_dup_lines"] * 100 > m["n_lines"] * 30),
    Rule("word_length", lambda m: (m["word_chars"] < m["n_words"] * 2) | (m["word_chars"] > m["n_words"] * 15)),
    Rule("capitals", lambda m: m["n_capitals"] * 100 > m["word_chars"] * 40),
)


def sample_texts(df: DataFrame, text: str, rows: int) -> DataFrame:
    """(text): the ``rows`` distinct texts with the smallest hash, NULL being one of them.

    Only hashes are sorted; the texts of the chosen ones are then fetched where they are, once each.
    """
    hashed = df.select(F.col(f"`{text}`").alias("text")).withColumn("h", F.xxhash64("text"))
    least = hashed.select("h").distinct().orderBy("h").limit(rows)
    return hashed.join(F.broadcast(least), "h", "left_semi").dropDuplicates(["h"]).select("text")


def order_rules(df: DataFrame, text: str, rules=RULES, sample_rows: int = 400, known: tuple[str, ...] = ()) -> list[Rule]:
    """``rules`` by rejected texts per second of work, best first, estimated on a sample.

    The sample is the ``sample_rows`` distinct texts with the smallest hash. Each rule runs alone over it;
    the time beyond an empty run is its cost. Measures in ``known`` are there before the cascade and cost
    nothing. Verdicts never depend on the order, only the work does.
    """
    measured = measures(F.col("text"))
    sample = stored(sample_texts(df, text, sample_rows).withColumns({name: measured[name] for name in known}))
    measured |= {name: F.col(name) for name in known}

    def run(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        failed = sample.agg(F.count_if(condition).alias("n")).first()[0]
        return time.perf_counter() - start, failed

    run(F.lit(False))
    idle = run(F.lit(False))[0]
    seen = {r.name: run(r.fails(measured)) for r in rules}
    return sorted(rules, key=lambda r: (-seen[r.name][1] / max(seen[r.name][0] - idle, 1e-3), r.name))


def cascade(rules: list[Rule], measured: dict[str, Column]) -> Column:
    """Name of the first failing rule, NULL if none fails. CASE stops at the first hit, so later
    rules cost nothing for a text that is already rejected."""
    verdict = F.lit(None).cast("string")
    for rule in reversed(rules):
        verdict = F.when(rule.fails(measured), F.lit(rule.name)).otherwise(verdict)
    return verdict


def apply_rules(df: DataFrame, text: str = "text", rules=RULES, keep_measures: bool | tuple[str, ...] = False) -> DataFrame:
    """``df`` with ``failed_rule`` (one failing rule's name or NULL) and ``kept``.

    Each text runs through the ordered cascade and stops at its first failing rule, so a measure is only
    taken of the texts that reach a rule which needs it. Measures named in ``keep_measures`` (True: all) are
    taken of every text and kept as columns, replacing same-named ones; the cascade reads these. NULL and
    empty texts fail ``few_words``; an empty frame stays empty; repeated rows are judged alike; ``failed_rule``
    depends on the order, ``kept`` does not.
    """
    source = fresh(df.columns, "text")[0]
    given = df.withColumn(source, F.col(f"`{text}`"))
    measured = measures(F.col(source))
    known = tuple(measured) if keep_measures is True else tuple(keep_measures or ())
    ordered = order_rules(df, text, rules, known=known)
    given = given.withColumns({name: measured[name] for name in known})
    measured |= {name: F.col(name) for name in known}
    return (
        given.withColumn("failed_rule", cascade(ordered, measured))
        .withColumn("kept", F.col("failed_rule").isNull())
        .drop(source)
    )
