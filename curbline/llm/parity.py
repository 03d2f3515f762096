"""Exact Jaccard join of word shingle sets by parity sketches.

A text's shingles are dealt by hash to the words of a sketch, and each shingle XORs its hash into its
word. A shingle that only one of two sets holds changes one word, so the number of differing words is at
most the symmetric difference. Linked sets of sizes a and b differ in at most (a + b) / 7 shingles (for a
similarity of 3/4), so among that many words and one more, one word is equal: the key they meet in.
Sketch sizes are fixed per size band. A second sketch of single bits drops most false meetings by its
Hamming distance, and exact set intersections decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.llm.common import components, release, stored
from curbline.llm.tokens import U, chunks, mix, shingles, word_hashes

SHINGLE = 5
BAND = 2  # sizes of a band are within this factor
CROWD = 16  # sets that meet in one key from which on not all pairs of them are listed
FLUSH = 2_000_000  # keys a task gathers before it hands them on
BUCKET = 1_500_000  # keys a task joins, on average
KEY_BITS = 39


def most_differing(a, b):
    """Largest symmetric difference of linked sets of sizes a and b: u - i <= (a + b) / 7."""
    return (a + b) // 7


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1)):
            rows = end - first
            h, row = shingles(*word_hashes(data, offsets, lower=True), rows, SHINGLE)
            n = np.bincount(row, minlength=rows)
            both = np.zeros((2, rows), np.uint64)
            has = np.flatnonzero(n)
            starts = (np.cumsum(n) - n)[has]
            if len(has):
                both[0, has] = np.bitwise_xor.reduceat(mix(h), starts)
                both[1, has] = np.add.reduceat(mix(h + U(0x632BE59BD9B4E019)), starts)
            # single-bit sketch: a power of two of bits, at least twice the size of the set
            bits = np.where(n > 0, 1 << np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64), 0)
            at = np.cumsum(bits) - bits
            flips = np.zeros(int(bits.sum()), np.uint8)
            np.add.at(flips, at[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64), 1)
            packed = np.packbits(flips & 1, bitorder="little")
            ends = np.concatenate(([0], np.cumsum(bits // 8)))
            sketch = pa.Array.from_buffers(
                pa.binary(), rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(packed)]
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, rows), pa.array(n.astype(np.int64)),
                 pa.array(both[0].view(np.int64)), pa.array(both[1].view(np.int64)), sketch],
                ["id", "n", "s1", "s2", "sketch"],
            )


def facts(docs: DataFrame) -> DataFrame:
    """(id, n, s1, s2, sketch): set size, two 64-bit digests of the set, and the single-bit sketch."""
    return docs.mapInArrow(_facts, "id long, n long, s1 long, s2 long, sketch binary")


def band_of(n: np.ndarray) -> np.ndarray:
    """Band k holds the sizes from BAND^k to below BAND^(k + 1)."""
    return np.floor(np.log2(np.maximum(n, 1)) / np.log2(BAND) + 1e-12).astype(np.int64)


def meeting_keys(h: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the sketch words by which each set meets its possible partners.

    A set takes part in its own band and, as the smaller partner, in the next one if 4/3 of its size reach
    it. There it gives its first non-empty sketch words, one more than the most that can differ from any
    partner. Of two linked sets, the one whose words end first has an equal word among them, and the
    other gives that word too. A set with too few non-empty words also gives its empty ones: two such
    sets may be equal only there.
    """
    found = []
    band = band_of(n)
    for ahead in (0, 1):
        b = band + ahead
        top = BAND ** (b + 1) - 1
        reach = np.minimum(4 * n // 3, top)
        differ = np.where((n > 0) & (reach >= BAND**b), most_differing(n, np.maximum(reach, n * (ahead == 0))), 0)
        parts = np.where(differ > 0, (11 * (most_differing(top, top) + 1)) // 10 + 4, 0)
        base = np.cumsum(parts) - parts
        use = differ[row] > 0
        hh, rr = h[use], row[use]
        if not len(hh):
            continue
        place = base[rr] + (mix(hh) % parts[rr].astype(np.uint64)).astype(np.int64)
        word, filled = np.zeros(int(parts.sum()), np.uint64), np.zeros(int(parts.sum()), bool)
        np.bitwise_xor.at(word, place, mix(hh + U(0xD1B54A32D192ED03)))
        filled[place] = True
        owner = np.repeat(np.arange(len(n)), parts)
        rank = np.cumsum(filled)
        rank -= np.concatenate(([0], rank))[base][owner]
        few = np.zeros(len(n), bool)
        inside = parts > 0
        few[inside] = np.add.reduceat(filled.astype(np.int64), base[inside]) <= differ[inside]
        give = (filled & (rank <= differ[owner] + 1)) | (~filled & few[owner])
        spot = np.flatnonzero(give)
        j = (spot - base[owner[spot]]).astype(np.uint64)
        label = mix((b[owner[spot]].astype(np.uint64) << U(48)) + j * U(2) + filled[spot].astype(np.uint64))
        found.append((mix(word[spot] ^ label), owner[spot]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of the runs of a sorted array."""
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.append(start, len(key)))


def _hand_on(keys: list, owners: list, ids: list, digests: list, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted keys of the gathered sets, one payload per bucket.

    Equal sets are reduced to their first one. Of a crowd in one key the first CROWD go on; each other
    one becomes a member row (kind 1) and a pair with the first (kind 2).
    """
    id_, digest = np.concatenate(ids), np.concatenate(digests)
    key, own = np.concatenate(keys), np.concatenate(owners)
    _, first, same = np.unique(digest, return_index=True, return_inverse=True)
    key, own = key[(keep := first[same[own]] == own)], own[keep]
    bucket = (key % U(buckets)).astype(np.int64)
    short = (key >> U(64 - KEY_BITS)).astype(np.int64)
    order = np.lexsort((own, short, bucket))
    bucket, short, own = bucket[order], short[order], own[order]
    full = (bucket << KEY_BITS) | short
    start, length = _runs(full)
    rank = np.arange(len(full)) - np.repeat(start, length)
    late = rank >= CROWD
    head = own[np.repeat(start, length)]
    rows: list[tuple] = []
    for b, lo, hi in zip(*_slices(bucket), strict=True):
        pick = np.arange(lo, hi)[~late[lo:hi]]
        used, at = np.unique(own[pick], return_inverse=True)
        rows.append((b, 0, ((short[pick] << 24) | at).tobytes(), id_[used].tobytes()))
        if late[lo:hi].any():
            pick = np.arange(lo, hi)[late[lo:hi]]
            rows.append((b, 1, full[pick].tobytes(), id_[own[pick]].tobytes()))
            rows.append((b, 2, id_[head[pick]].tobytes(), id_[own[pick]].tobytes()))
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "kind", "left", "right"]
    )


def _slices(sorted_values: np.ndarray):
    start, length = _runs(sorted_values)
    return sorted_values[start].tolist(), start.tolist(), (start + length).tolist()


def _meet(table: pa.Table) -> pa.Table:
    """Pairs (kind 2: a, b) of sets that meet in a key; members (kind 1: key, id) of crowded keys."""
    entries, ids, members, pairs, total = [], [], [], [], 0
    bucket = table.column("bucket")[0].as_py()
    for kind, left, right in zip(*(table.column(c).to_pylist() for c in ("kind", "left", "right")), strict=True):
        a, b = np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)
        if kind == 0:
            entries.append(((bucket << KEY_BITS) | (a >> 24), (a & ((1 << 24) - 1)) + total))
            ids.append(b)
            total += len(b)
        else:
            (members if kind == 1 else pairs).append((a, b))
    if entries:
        key, own = (np.concatenate([e[i] for e in entries]) for i in (0, 1))
        id_ = np.concatenate(ids)
        order = np.argsort(key, kind="stable")
        key, own = key[order], own[order]
        start, length = _runs(key)
        size = np.repeat(length, length)
        crowd = size >= CROWD
        if crowd.any():
            head = own[np.repeat(start, length)][crowd]
            members.append((key[crowd], id_[own[crowd]]))
            pairs.append((id_[head], id_[own[crowd]]))
        some = (size > 1) & ~crowd
        key, own, found = key[some], own[some], []
        for gap in range(1, CROWD):
            hit = np.flatnonzero(key[gap:] == key[:-gap])
            if not len(hit):
                break
            found.append(np.unique(own[hit] * total + own[hit + gap]))
        if found:
            both = np.unique(np.concatenate(found))
            pairs.append((id_[both // total], id_[both % total]))
    kinds = [np.full(len(a), k) for k, group in ((1, members), (2, pairs)) for a, _ in group]
    lists = [*members, *pairs]
    put = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), t)
    return pa.table({
        "kind": put(kinds, pa.int32()), "a": put([x[0] for x in lists], pa.int64()), "b": put([x[1] for x in lists], pa.int64())
    })


def meetings(docs: DataFrame, buckets: int) -> DataFrame:
    """(kind, a, b) of all sets that meet, see :func:`_meet`."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, owners, ids, digests, sets, count = [], [], [], [], 0, 0
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                rows = end - first
                h, row = shingles(*word_hashes(data, offsets, lower=True), rows, SHINGLE)
                n = np.bincount(row, minlength=rows)
                key, own = meeting_keys(h, row, n)
                digest = np.zeros(rows, np.uint64)
                np.bitwise_xor.at(digest, row, mix(h))
                keys.append(key)
                owners.append(own + sets)
                ids.append(batch.column(0).slice(first, rows).to_numpy())
                digests.append(digest + n.astype(np.uint64))
                sets, count = sets + rows, count + len(key)
                if count >= FLUSH or sets >= 1 << 23:
                    yield from _hand_on(keys, owners, ids, digests, buckets)
                    keys, owners, ids, digests, sets, count = [], [], [], [], 0, 0
        if keys:
            yield from _hand_on(keys, owners, ids, digests, buckets)

    sent = docs.mapInArrow(gather, "bucket int, kind int, left binary, right binary")
    return sent.groupBy("bucket").applyInArrow(_meet, "kind int, a long, b long")


def hamming_at_most(n_a: np.ndarray, n_b: np.ndarray, a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Whether two sets may be linked by their sizes and single-bit sketches.

    The longer sketch is folded onto the length of the shorter: its hash bits are the low ones of both.
    """
    out = 4 * np.minimum(n_a, n_b) >= 3 * np.maximum(n_a, n_b)
    limit = most_differing(n_a, n_b)
    sizes = np.array([(len(x), len(y)) for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    for length_a, length_b in np.unique(sizes[out], axis=0):
        rows = np.flatnonzero(out & (sizes[:, 0] == length_a) & (sizes[:, 1] == length_b))
        m = min(length_a, length_b) // 8
        for at in range(0, len(rows), max(1, (1 << 20) // max(length_a, length_b))):
            part = rows[at : at + max(1, (1 << 20) // max(length_a, length_b))]
            x, y = (
                np.bitwise_xor.reduce(np.frombuffer(b"".join(side[i] for i in part), np.uint64).reshape(len(part), -1, m), axis=1)
                for side in (a, b)
            )
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= limit[part]
    return out


def _may_link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
        good = hamming_at_most(n_a, n_b, batch.column(4).to_pylist(), batch.column(5).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], ["a", "b"])


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that sizes and single-bit sketches leave."""
    left = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    both = pairs.join(left, "a").join(right, "b").where("4 * least(na, nb) >= 3 * greatest(na, nb)")
    return both.select("a", "b", "na", "nb", "ka", "kb").mapInArrow(_may_link, "a long, b long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1)):
            h, row = shingles(*word_hashes(data, offsets, lower=True), end - first, SHINGLE)
            cuts = np.searchsorted(row, np.arange(end - first + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), lists], ["id", "set"])


def compared(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with ``link``: whether their sets have a similarity of 3/4, by exact intersection."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = texts.join(ids, "id", "left_semi").select("id", "text").mapInArrow(_sets, "id long, set array<long>")
    one = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return two.select("a", "b", (100 * common >= 75 * union).alias("link"))


def open_members(members: DataFrame, groups: DataFrame) -> DataFrame:
    """(key, class, component) of the keys whose members are not all in one component."""
    known = members.join(groups.withColumnRenamed("id", "class"), "class", "left").select(
        "key", "class", F.coalesce("component", "class").alias("component")
    )
    ends = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    return known.join(ends.where("lo < hi").select("key"), "key", "left_semi")


def crowded_pairs(open_rows: DataFrame, classes: DataFrame, every: bool, block: int = 512) -> DataFrame:
    """Pairs (class, other) in crowded keys, of different components, as sizes and sketches leave them.

    With ``every`` all of them; otherwise one per class, the one that differs least. The members of a key
    are dealt into blocks, and one task compares two blocks by sketch.
    """
    blocks = open_rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    rows = open_rows.join(blocks, "key").join(classes.select("class", "n", "sketch"), "class")
    dealt = (
        rows.withColumn("own", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("x", F.greatest("own", "other"))
        .withColumn("y", F.least("own", "other"))
        .select("key", "x", "y", "own", "class", "component", "n", "sketch")
    )

    def compare(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        own, id_, comp, n = (table.column(c).to_numpy() for c in ("own", "class", "component", "n"))
        sketch = [np.frombuffer(v, np.uint64) for v in table.column("sketch").to_pylist()]
        m = min(len(v) for v in sketch)
        folded = np.stack([np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in sketch])
        sides = [(np.flatnonzero(own == x), np.flatnonzero(own == y))]
        if x != y and not every:
            sides.append(sides[0][::-1])
        found, step = [], max(1, (1 << 18) // max(1, len(own) * m))
        for whole, right in sides:
            for at in range(0, len(whole), step):  # bounds the table of compared bits
                left = whole[at : at + step]
                small, large = np.minimum.outer(n[left], n[right]), np.maximum.outer(n[left], n[right])
                differ = np.bitwise_count(folded[left][:, None] ^ folded[right]).sum(axis=2, dtype=np.int64)
                good = (comp[left][:, None] != comp[right]) & (4 * small >= 3 * large)
                good &= differ <= most_differing(small, large)
                if every:
                    i, j = np.nonzero(good & (left[:, None] < right) if x == y else good)
                else:
                    # the least difference, then the smallest id
                    rank = np.where(good, differ * len(id_) + np.argsort(np.argsort(id_[right])), 1 << 60)
                    j = rank.argmin(axis=1) if len(right) else np.zeros(0, np.int64)
                    i = np.flatnonzero(good.any(axis=1))
                    j = j[i]
                found.append((id_[left[i]], id_[right[j]], differ[i, j]))
        columns = [np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3)]
        return pa.table({c: pa.array(v.astype(np.int64)) for c, v in zip(("class", "other", "differ"), columns, strict=True)})

    found = dealt.groupBy("key", "x", "y").applyInArrow(compare, "class long, other long, differ long")
    found = found if every else stored(found)
    if every:
        return found.select("class", "other").distinct()
    least = found.groupBy("class").agg(F.min(F.col("differ")).alias("differ"))
    return found.join(least, ["class", "differ"]).groupBy("class").agg(F.min("other").alias("other"))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id): one row per row of ``docs``; other columns are ignored.

    Sets of distinct five-word shingles (words in lower case by A-Z; a shorter text is one shingle) are
    linked from a similarity of 3/4 on; ``component_id`` is the smallest id that links reach. No link is
    lost: all sets that meet in a key are compared unless a path of links already joins them. NULL and
    empty texts have an empty set, linked with nothing. Rows with equal ids are one vertex, rows with a
    NULL id stand alone without component. An empty table gives an empty result.
    """
    given = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    known = stored(facts(given))
    usable = known.where("n > 0 AND id IS NOT NULL")
    # equal sets are one class, named by its smallest id
    classes = stored(
        usable.groupBy("n", "s1", "s2").agg(F.min("id").alias("class"), F.first("sketch").alias("sketch"))
    )
    names = stored(usable.select("id", "n", "s1", "s2").join(classes.drop("sketch"), ["n", "s1", "s2"]).select("id", "class"))
    named = names.where("id <> class").distinct()
    size = classes.agg(F.sum("n")).first()[0] or 0
    met = stored(meetings(given.where("id IS NOT NULL"), max(4, int(size * 0.5 / BUCKET) + 1)))

    def as_class(df: DataFrame, column: str) -> DataFrame:
        to = named.select(F.col("id").alias(column), F.col("class").alias("_class"))
        return df.join(to, column, "left").withColumn(column, F.coalesce("_class", column)).drop("_class")

    pairs = as_class(as_class(met.where("kind = 2").select("a", "b").distinct(), "a"), "b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = stored(possible(pairs, classes))
    members = as_class(met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("class")), "class")
    members = stored(members.distinct())
    del met
    release(docs.sparkSession)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionAll(members.select("class"))
    # one row per id and text; the sets are compared from here
    texts = stored(given.join(ids.distinct(), "id", "left_semi"))
    release(docs.sparkSession)
    # one pair per class settles most components
    first = stored(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    links = stored(compared(first, texts).where("link").select("a", "b"))
    groups = stored(components(links))
    release(docs.sparkSession)

    def across(df: DataFrame) -> DataFrame:
        ends = df
        for side in ("a", "b"):
            to = groups.select(F.col("id").alias(side), F.col("component").alias(f"c{side}"))
            ends = ends.join(to, side, "left")
        return ends.where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    # of what is left across components, all pairs of small keys and the likeliest of each set in a crowd
    rest = across(pairs).join(first, ["a", "b"], "left_anti")
    crowd = stored(open_members(members, groups))
    for every in (False, True):
        tried = crowded_pairs(crowd, classes, every)
        ends = tried.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b"))
        ends = ends if every else ends.unionAll(rest)
        links = stored(links.unionAll(compared(stored(ends.distinct()), texts).where("link").select("a", "b")))
        release(docs.sparkSession)
        if not every:
            # then all that crowds still hold across components
            groups = stored(components(links))
            crowd = stored(open_members(crowd.select("key", "class"), groups))
    same = named.select(F.col("class").alias("a"), F.col("id").alias("b"))
    every = components(links.unionAll(same))
    return (
        known.select("id", "n")
        .join(every, "id", "left")
        .select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )
