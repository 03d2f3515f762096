"""Removal of repeated runs of lines by suffix ranks of line sequences, in Spark expressions only.

The texts are one long sequence of lines. Prefix doubling ranks every position by its next 1, 2, 4, ...
lines: the rank of 2^(k+1) lines follows from the pair of ranks at p and p + 2^k. Positions of one rank
are one interval of the suffix array with a common prefix of at least 2^k lines; a rank is named by the
first position of its interval, as later steps need that one and not the sorting order. Positions whose
prefix occurs once drop out, so each level only holds what repeats.

Any run of lines is covered by two runs of 2^k lines, so two ranks name the interval of a run of any length.

Passages that repeat inside longer lines are runs of words. There the ranked units are finer than lines: a unit ends at
each word that a hash chooses, wherever it stands, and the suffix ranks run over them. What they leave, passages with
fewer words in whole units and the parts of units at the ends, are windows of exactly ``min_words`` words. A window is
only looked at if the ranks let it be repeated: one with a unit, or with two or four in a row, that occur once cannot be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.llm.common import Tables, fresh, let, numbered, release, stored
from curbline.llm.rules import WHITE, words

UNIT_WORDS = 8  # a unit ends at one of so many words, by hash
LINE_BITS = 27  # lines of one text: a position is its document's number and then the line


def document_key(doc_id: str, text: str) -> tuple[Column, Column]:
    """Documents are rows that differ in id or text; NULL ids come first."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.col(text))


def line_positions(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(documents (d, t, g), lines (p, h1, h2, words)): g numbers the documents in the order of (d, t),
    and p = g * 2^LINE_BITS + line number orders all lines. Lines are named by two 64-bit hashes."""
    d, t = document_key(doc_id, text)
    given = docs.where(F.col(text).isNotNull()).select(d.alias("d"), t.alias("t"), F.col(text).alias("text"))
    order = numbered(given.select("d", "t").distinct(), [F.col("d"), F.col("t")], "g")
    order = stored(order)
    line = F.col("line")
    rows = (
        given.select("d", "t", F.posexplode(F.split("text", "\n")).alias("i", "line"))
        .select(
            "d", "t", "i", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"),
            F.size(words(line)).alias("words"),
        )
        .distinct()
        .join(order, ["d", "t"])
    )
    limit = F.when(F.col("i") >= 1 << (LINE_BITS - 1), F.raise_error(F.lit("a text has too many lines")).cast("long"))
    place = F.coalesce(limit, F.shiftleft("g", LINE_BITS) + F.col("i"))
    return order, stored(rows.select(place.alias("p"), "h1", "h2", "words"))


def _ranked(rows: DataFrame, *key: str) -> DataFrame:
    """(p, f): positions whose key occurs again, with the first position of that key.

    A very common line is reduced in the map tasks. Its rows then meet one row, so Spark may split them over as
    many tasks as they need.
    """
    first = rows.groupBy(*key).agg(F.min("p").alias("f"), F.max("p").alias("last")).where("f < last").drop("last")
    return rows.join(first, [*key]).select("p", "f")


def suffix_ranks(level: DataFrame, longest: int, keep=stored) -> DataFrame:
    """(k, p, f): for each level k with 2^k <= ``longest`` the positions whose next 2^k lines occur at
    another position too, and the first position with these lines; ``level`` is that for one line."""
    ranks, k = [level], 0
    while 2 << k <= longest:
        ahead = level.select((F.col("p") - (1 << k)).alias("p"), F.col("f").alias("f2"))
        level = keep(_ranked(level.withColumnRenamed("f", "f1").join(ahead, "p"), "f1", "f2"))
        if level.isEmpty():
            break
        k += 1
        ranks.append(level)
    out = ranks[0].withColumn("k", F.lit(0))
    for i, level in enumerate(ranks[1:], 1):
        out = out.unionAll(level.withColumn("k", F.lit(i)))
    return out.select("k", "p", "f")


def shortest_runs(repeated: DataFrame, min_words: int, keep=stored, around_windows: bool = False) -> DataFrame:
    """(a, b): runs [a, b) of lines of ``repeated`` (p, words) with ``min_words`` words or more that are
    shortest from their first line on, or up to their last.

    Every repeated run with that many words is a union of such runs. Both ends come from one sorted pass
    over the cumulated words of each unbroken stretch of lines. ``around_windows`` gives the shortest runs around
    each window of ``min_words`` words instead, wherever in a line it starts.
    """
    doc = Window.partitionBy(F.shiftright("p", LINE_BITS)).orderBy("p")
    stretch = repeated.withColumn("s", F.col("p") - F.row_number().over(doc))
    one = Window.partitionBy(F.shiftright("p", LINE_BITS), "s").orderBy("p")
    sums = stretch.withColumn("after", F.sum("words").over(one)).withColumn("n", F.lead("p").over(one))
    sums = sums.select(F.shiftright("p", LINE_BITS).alias("g"), "s", "p", (F.col("after") - F.col("words")).alias("e"), "after", "n")
    ends = sums.where("n IS NULL").select("g", "s", (F.col("p") + 1).alias("p"), F.col("after").alias("e"), F.lit(True).alias("end"))
    edges = keep(sums.select("g", "s", "p", "e", F.lit(False).alias("end")).unionAll(ends))

    def nearest(shift: int, order: list[Column], pick, at: DataFrame = edges) -> DataFrame:
        asked = at.select("g", "s", (F.col("e") + shift).alias("e"), F.lit(None).cast("long").alias("p"), F.col("p").alias("q"))
        given = edges.select("g", "s", "e", "p", F.lit(None).cast("long").alias("q"))
        seen = Window.partitionBy("g", "s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        found = given.unionAll(asked).withColumn("x", pick("p").over(seen))
        return found.where("q IS NOT NULL AND x IS NOT NULL")

    # NULL q, the edges themselves, sort before the questions at the same sum
    right = nearest(min_words, [F.col("e").desc(), F.col("q").asc_nulls_first()], F.min)
    runs = right.select(F.col("q").alias("a"), F.col("x").alias("b"))
    if around_windows:  # a window that ends with the first word of a line takes that line in
        last = nearest(1 - min_words, [F.col("e").asc(), F.col("q").asc_nulls_first()], F.max, edges.where("NOT end"))
        return runs.unionAll(last.select(F.col("x").alias("a"), (F.col("q") + 1).alias("b"))).distinct()
    left = nearest(-min_words, [F.col("e").asc(), F.col("q").asc_nulls_first()], F.max)
    return runs.unionAll(left.select(F.col("x").alias("a"), F.col("q").alias("b"))).distinct()


def later_copies(
    lines: DataFrame, min_words: int, key: tuple[str, ...] = ("h1", "h2"), keep=stored, around_windows: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(runs, ranks): runs [a, b) of lines with ``min_words`` words or more that occur earlier as well, and
    the suffix ranks (k, p, f), of up to four lines at least.

    ``lines`` (p, words and the hashes of ``key``); ``keep`` stores a step; ``around_windows`` as in ``shortest_runs``.
    """
    level = keep(_ranked(lines, *key))
    runs = keep(shortest_runs(lines.select("p", "words").join(level.select("p"), "p"), min_words, keep, around_windows))
    longest = runs.agg(F.max(F.col("b") - F.col("a"))).first()[0] or 0
    ranks = suffix_ranks(level, max(longest, 4), keep)
    m = F.col("b") - F.col("a")
    asked = runs.withColumn("k", F.floor(F.log2(m.cast("double")) + 1e-9).cast("int"))
    head = ranks.select("k", F.col("p").alias("a"), F.col("f").alias("f1"))
    tail = ranks.select("k", F.col("p").alias("z"), F.col("f").alias("f2"))
    named = (
        asked.join(head, ["k", "a"])
        .withColumn("z", F.col("b") - F.expr("shiftleft(bigint(1), k)"))
        .join(tail, ["k", "z"])
        .select("a", "b", m.alias("m"), "f1", "f2")
    )
    named = keep(named)
    first = named.groupBy("m", "f1", "f2").agg(F.min("a").alias("first"))
    return named.join(first, ["m", "f1", "f2"]).where("a > first").select("a", "b"), ranks


def remove_repeated_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50
) -> DataFrame:
    """``docs`` with later copies of line runs cut from ``text``, and ``n_lines``, ``n_removed``.

    A run of whole lines of one text that holds ``min_words`` words or more and equals an earlier run (by
    id, then line; it may overlap it) is removed, so the first copy of everything stays. Words have no
    ASCII white space. Rows with one id and one text are one document and end alike; of several texts
    with one id, and of NULL ids, the order follows the text's hash. NULL texts stay NULL with no lines,
    an empty text has one empty line, an empty table stays empty; other columns stay, and ones named like
    an added one are replaced.
    """
    given = docs.drop("n_lines", "n_removed")
    order, lines = line_positions(given, doc_id, text)
    runs, _ = later_copies(lines, min_words)
    # overlapping runs of a document become one, so each removed line is listed once
    doc = F.shiftright("a", LINE_BITS)
    before = Window.partitionBy(doc).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    clear = runs.withColumn("a", F.greatest("a", F.coalesce(F.max("b").over(before), F.col("a")))).where("a < b")
    base = F.shiftleft(doc, LINE_BITS)
    gone = clear.select(doc.alias("g"), F.sequence((F.col("a") - base).cast("int"), (F.col("b") - base - 1).cast("int")).alias("i"))
    per_doc = gone.groupBy("g").agg(F.flatten(F.collect_list("i")).alias("gone")).join(order, "g")
    d, t, cut, rest = fresh(given.columns, "d", "t", "gone", "lines")
    found = per_doc.select(F.col("d").alias(d), F.col("t").alias(t), F.col("gone").alias(cut))
    key = document_key(doc_id, text)
    split = F.split(F.col(text), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(rest) - 1), cut)
    return (
        given.withColumn(d, key[0])
        .withColumn(t, F.when(F.col(text).isNotNull(), key[1]))
        .join(found, [d, t], "left")
        .withColumn(rest, split)
        .withColumn("n_lines", F.greatest(F.size(rest), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.greatest(F.size(cut), F.lit(0)).cast("long"))
        .withColumn(
            text,
            F.when(F.col(cut).isNull(), F.col(text)).otherwise(
                F.array_join(F.transform(kept, lambda i: F.get(F.col(rest), i)), "\n")
            ),
        )
        .drop(d, t, cut, rest)
        .select(*given.columns, "n_lines", "n_removed")
    )


def text_units(hashes: Column, min_words: int) -> Column:
    """(i, h) per unit of a text: its first word and the hash of its words.

    A unit starts after each word chosen by hash, so equal passages have equal units but for the parts at their
    ends. Where no word is chosen for five sixths of ``min_words`` words, every word is a unit.
    """
    every, widest = (UNIT_WORDS if min_words >= 2 * UNIT_WORDS else 1), min_words - max(1, min_words // 6)

    def placed(w: Column) -> Column:
        n = F.size(w)
        chosen = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.get(w, i), F.lit(every)) == 0)

        def spread(b: Column) -> Column:
            def after(c: Column, k: Column) -> Column:
                end = F.coalesce(F.get(b, k + 1), n - 1)
                return F.when(end - c > widest, F.sequence(c + 1, F.greatest(c + 1, end))).otherwise(F.array(c + 1))

            return F.filter(F.flatten(F.transform(b, after)), lambda i: i < n)

        def unit(starts: Column) -> Column:
            def of(i: Column, k: Column) -> Column:
                own = F.slice(w, i + 1, F.coalesce(F.get(starts, k + 1), n) - i)
                return F.struct(i.alias("i"), F.xxhash64(own).alias("h"))

            return F.transform(starts, of)

        return let(let(F.concat(F.array(F.lit(-1)), chosen), spread), unit)

    return let(hashes, placed)


def _word_hashes(text: str) -> Column:
    return F.transform(words(F.col(text)), lambda w: F.xxhash64(w))


def _disjoint(ranges: DataFrame) -> DataFrame:
    """(g, cut): per document the sorted pieces (a, b) that its ranges [a, b) cover; pieces that touch are one."""
    so_far = Window.partitionBy("g").orderBy("a", "b")
    reach = F.max("b").over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    apart = ranges.withColumn("apart", F.when(F.col("a") > reach, 1).otherwise(0))
    pieces = apart.withColumn("piece", F.sum("apart").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    whole = pieces.groupBy("g", "piece").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("cut"))


def _unit_place(k: Column) -> Column:
    limit = F.when(k >= 1 << (LINE_BITS - 1), F.raise_error(F.lit("a text has too many words")).cast("long"))
    return F.coalesce(limit, F.shiftleft("g", LINE_BITS) + k)


def _covered_by_runs(units: DataFrame, min_words: int, keep) -> tuple[DataFrame, DataFrame]:
    """Starts [a, b) of windows of ``min_words`` words (g, a, b) that lie in runs of whole units which occur earlier;
    and the suffix ranks of the units.

    Units are named by one 64-bit hash: a false run would need several of them to agree side by side by chance.
    """
    each = units.select("g", "n", "i", F.posexplode("h").alias("k", "h"))
    k = F.col("k")
    rows = each.select(_unit_place(k).alias("p"), "h", (F.coalesce(F.get("i", k + 1), F.col("n")) - F.get("i", k)).alias("words"))
    runs, ranks = later_copies(rows, min_words, ("h",), keep, around_windows=True)
    g, low = F.shiftright("a", LINE_BITS), F.lit((1 << LINE_BITS) - 1)
    span = F.struct(F.col("a").bitwiseAND(low).cast("int").alias("a"), (F.col("b") - F.shiftleft(g, LINE_BITS)).cast("int").alias("b"))
    spans = runs.groupBy(g.alias("g")).agg(F.collect_list(span).alias("spans"))
    placed = units.select("g", "n", "i").join(spans, "g").select("g", "n", "i", F.inline("spans"))
    first, end = F.get("i", "a"), F.coalesce(F.get("i", "b"), F.col("n"))
    starts = _disjoint(placed.select("g", first.alias("a"), (end - (min_words - 1)).alias("b")))
    return starts.select("g", F.inline("cut")), ranks


def _single_starts(units: DataFrame, ranks: DataFrame, min_words: int) -> DataFrame:
    """(g, a, b): starts [a, b) of windows that hold a run of one, two or four units which occurs nowhere else.

    Such a run counts with the chosen word in front of it, as the words alone then tell where its units start and
    end. So do units of two words and more that are neither the first nor the last of their text, and these alone
    are asked for.
    """

    def ends(i: Column) -> Column:
        def of(v: Column, k: Column) -> Column:
            def end(m: int) -> Column:
                whole = k >= 1
                for j in range(m):
                    whole = whole & (F.get(i, k + j + 1) - F.get(i, k + j) >= 2)
                return F.when(whole, F.get(i, k + m))

            return F.struct(v.alias("i"), *[end(m).alias(f"e{m}") for m in (1, 2, 4)])

        return F.transform(i, of)

    runs = ["i", "e1", "e2", "e4"]
    rows = units.select("g", F.posexplode(ends(F.col("i"))).alias("k", "u")).where("u.e1 IS NOT NULL")
    rows = rows.select(_unit_place(F.col("k")).alias("p"), *[F.col(f"u.{c}").alias(c) for c in runs], F.lit(None).cast("int").alias("k"))
    levels = ranks.where("k <= 2").select("p", *[F.lit(None).cast("int").alias(c) for c in runs], "k")
    each = rows.unionAll(levels).groupBy("p").agg(*[F.max(c).alias(c) for c in [*runs, "k"]])
    end = F.when(F.col("k").isNull(), F.col("e1")).when(F.col("k") < 1, F.col("e2")).when(F.col("k") < 2, F.col("e4"))
    once = each.select(F.shiftright("p", LINE_BITS).alias("g"), end.alias("end"), F.col("i").alias("b")).where("end IS NOT NULL")
    return once.select("g", F.greatest(F.col("end") - min_words, F.lit(0)).alias("a"), "b").where("a < b")


def _later_windows(texts: DataFrame, units: DataFrame, covered: DataFrame, single: DataFrame, min_words: int, keep) -> DataFrame:
    """(g, a, b): windows of ``min_words`` words that occur earlier and do not start in the covered ranges.

    Covered windows need no look, not even as the earlier copy, as each occurs earlier itself: the first copy of
    a window is never covered. Nor do those of ``single``, which the ranks show to occur once.
    """
    cuts = _disjoint(covered.unionAll(single))
    none = F.array().cast("array<struct<a:int,b:int>>")
    held = units.select("g", "n").join(cuts, "g", "left").select("g", "n", F.coalesce("cut", none).alias("cut"))

    def between(r: Column, k: Column) -> Column:
        return F.struct(r["b"].alias("a"), F.coalesce(F.get("cut", k)["a"], F.col("n") - (min_words - 1)).alias("b"))

    zero = F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    free = F.filter(F.transform(F.concat(zero, "cut"), between), lambda r: r["a"] < r["b"])
    free = held.select("g", free.alias("free")).where("size(free) > 0")

    def windows(w: Column) -> Column:
        def window(s: Column) -> Column:
            part = F.slice(w, s + 1, min_words)
            return F.struct(s.alias("s"), F.xxhash64(part).alias("h1"), F.xxhash64(F.lit(1), part).alias("h2"))

        starts = F.flatten(F.transform("free", lambda r: F.sequence(r["a"], r["b"] - 1)))
        return F.transform(starts, window)

    rows = texts.join(free, "g").select("g", F.inline(let(_word_hashes("text"), windows)))
    rows = keep(rows.select((F.shiftleft("g", LINE_BITS) + F.col("s")).alias("p"), "h1", "h2"))
    later = _ranked(rows, "h1", "h2").where("p > f")
    s = F.col("p").bitwiseAND(F.lit((1 << LINE_BITS) - 1)).cast("int")
    return later.select(F.shiftright("p", LINE_BITS).alias("g"), s.alias("a"), (s + min_words).alias("b"))


def remove_repeated_passages(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = 50
) -> DataFrame:
    """``docs`` with later copies of runs of words cut from ``text``, and ``n_words_removed``.

    A run of ``min_words`` words or more that equals an earlier run (by id, then word; it may overlap it) is
    removed wherever it stands in its lines, with the white space after each of its words; all else stays byte
    for byte. White space between words is not compared. Suffix ranks over the units of all texts find runs of whole
    units; windows that these ranks leave open find shorter ones and the ends. Texts that occur again as a whole
    are only searched once.

    Rows with one id and one text are one document and end alike; of several texts with one id, and of NULL ids, the
    order follows the text's hash. NULL texts stay NULL, texts without words stay as they are, an empty table stays
    empty; other columns stay, and one named like the added one is replaced. ``docs`` is read several times, so
    give a stored frame.
    """
    spark = docs.sparkSession
    given = docs.drop("n_words_removed")
    d, t = document_key(doc_id, text)
    keyed = given.where(F.col(text).isNotNull()).select(d.alias("d"), t.alias("t"), F.col(text).alias("text"))
    order = stored(numbered(keyed.select("d", "t").distinct(), [F.col("d"), F.col("t")], "g"))
    # texts that occur as a whole under several ids are searched under the first
    first = order.groupBy("t").agg(F.min("g").alias("g"))
    chosen = order.join(first, ["t", "g"]).select("d", "t", "g")
    steps = Tables(spark)
    own = let(
        _word_hashes("text"),
        lambda w: F.when(F.size(w) >= min_words, F.struct(F.size(w).alias("n"), text_units(w, min_words).alias("u"))),
    )
    split = keyed.select("d", "t", own.alias("own")).where("own IS NOT NULL").dropDuplicates(["d", "t"])
    lists = [F.col(f"own.u.{c}").alias(c) for c in ("i", "h")]
    units = steps.keep(split.select("d", "t", F.col("own.n").alias("n"), *lists).join(chosen, ["d", "t"]).select("g", "n", "i", "h"))
    release(spark)
    ranking = Tables(spark)  # let go before the windows come
    covered, ranks = _covered_by_runs(units, min_words, ranking.keep)
    covered = steps.keep(covered)
    single = steps.keep(_single_starts(units, ranks, min_words))
    ranking.clear()
    release(spark)
    texts = keyed.dropDuplicates(["d", "t"]).join(chosen, ["d", "t"]).select("g", "text")
    windows = steps.keep(_later_windows(texts, units, covered, single, min_words, steps.keep))
    runs = covered.select("g", "a", (F.col("b") + (min_words - 1)).alias("b"))
    cuts = _disjoint(runs.unionAll(windows))
    d_, t_, g_, cut, whole, rest, kept = fresh(given.columns, "d", "t", "g", "cut", "whole", "words", "kept")
    copies = order.join(first.withColumnRenamed("g", "first"), "t").withColumn("whole", F.col("g") > F.col("first"))
    found = stored(
        copies.join(cuts, "g", "left").where("whole OR cut IS NOT NULL").select(
            F.col("d").alias(d_), F.col("t").alias(t_), F.col("whole").alias(whole), F.col("cut").alias(cut)
        )
    )
    steps.clear()
    white = WHITE.removesuffix("+")
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"{white.replace('[', '[^', 1)}+{white}*"), F.lit(0))
    # a later copy of a whole text loses all its words if it has enough
    all_of = F.array(F.struct(F.lit(0).alias("a"), F.size(rest).alias("b")))
    parts = F.when(F.col(whole), F.when(F.size(rest) >= min_words, all_of)).otherwise(F.col(cut))
    end = F.array(F.struct(F.size(rest).alias("a"), F.size(rest).alias("b")))

    def between(given_parts: Column) -> Column:
        return F.transform(
            F.concat(given_parts, end),
            lambda r, k: F.struct(F.coalesce(F.get(given_parts, k - 1)["b"], F.lit(0)).alias("a"), r["a"].alias("b")),
        )

    joined = F.array_join(
        F.transform(kept, lambda r: F.array_join(F.slice(F.col(rest), r["a"] + 1, F.greatest(r["b"] - r["a"], F.lit(0))), "")), ""
    )
    left = F.aggregate(kept, F.lit(0), lambda n, r: n + r["b"] - r["a"])
    return (
        given.withColumn(d_, d)
        .withColumn(t_, F.when(F.col(text).isNotNull(), t))
        .join(found, [d_, t_], "left")
        .withColumn(rest, F.when(F.col(whole).isNotNull(), pieces))
        .withColumn(kept, let(parts, between))
        .withColumn("n_words_removed", F.coalesce(F.size(rest) - left, F.lit(0)).cast("long"))
        .withColumn(
            text,
            F.when(F.col(kept).isNull(), F.col(text)).otherwise(
                F.concat(F.regexp_extract(F.col(text), f"^{white}*", 0), joined)
            ),
        )
        .drop(d_, t_, g_, cut, whole, rest, kept)
        .select(*given.columns, "n_words_removed")
    )
