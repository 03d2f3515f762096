"""DuckDB SQL for the queries that SQL can express."""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
  SELECT *,
    length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')) AS body,
    length(role) + length(role)
      - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', '')) AS head,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(sum(body + CASE WHEN before = role THEN 6 ELSE 14 + head END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

RULES = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word,
    generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d
),
g AS (
  SELECT r, i, word,
    CASE WHEN lead(i, 4) OVER o IS NOT NULL THEN word || ' ' || lead(word, 1) OVER o || ' ' ||
      lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o END AS gram
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
),
c AS (SELECT r, i, word, gram IS NOT NULL AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g),
x AS (
  SELECT r, word, coalesce(max(CAST(twice AS INT)) OVER
    (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS inside FROM c
),
p AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, sum(inside) AS n_repeat_words FROM x GROUP BY r),
l AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
),
m AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals
  FROM d LEFT JOIN p USING (r) LEFT JOIN l USING (r)
),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 30 * n_words OR 100 * n_dup_lines > 30 * n_lines
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_capitals > 40 * word_chars) AS kept
FROM b
"""


_WHOLE = "list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))"
_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def centroids(k: int, rounds: int, width: int) -> str:
    """k-means with every round as steps of its own: a0 assigns to c0, c1 are the means of a0, ..."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, {_WHOLE} AS v FROM embeddings WHERE len(embedding) = {width} AND {_FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS cluster, v FROM (
  SELECT sha256('2:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h LIMIT {k}))"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
  SELECT k.vec_id, k.v, c.cluster, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
  FROM kept k, c{i} c) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY pos) AS v FROM (
    SELECT cluster, pos, CAST(sum(v[pos]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {width + 1}) r(pos) GROUP BY ALL) GROUP BY cluster
  UNION ALL SELECT cluster, v FROM c{i} WHERE cluster NOT IN (SELECT cluster FROM a{i}))""")
    return "WITH" + ",".join(steps) + f"""
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.cluster = a.cluster"""


NEGATIVES = f"""
WITH given AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l, {_WHOLE} AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.l = b.l AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id
WHERE NOT n.same AND 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) <= 10"""
