"""Page text, chunks, routing and place matching."""

from pyspark.sql import functions as F

from curbline.functions import text
from curbline.operators import chunks, place_match
from curbline.plans.inputs import AGENCY
from curbline.plans.registry import query


@query(
    "page_text",
    "X-1",
    r"""
SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script.*?</script>', ' ', 'gis'),
  '<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages""",
)
def page_text(t):
    return t.table("pages").select("page_id", "url", text.strip_html(F.col("html")).alias("text"))


@query(
    "document_sentences",
    "X-2",
    "SELECT doc_id, pos, s[pos] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS pos FROM sentence_list) q",
)
def document_sentences(t):
    listed = t.documents.select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence"))
    return listed.withColumn("pos", F.col("pos") + 1)


PACKED_CHUNKS = """
WITH RECURSIVE sized AS MATERIALIZED (SELECT doc_id, list_transform(s, lambda x: length(x)) AS n FROM sentence_list WHERE len(s) > 0),
packs(doc_id, i, used, chunk) AS (
  SELECT doc_id, 1, n[1], 0 FROM sized
  UNION ALL
  SELECT p.doc_id, p.i + 1, CASE WHEN p.used + z.n[p.i + 1] > 800 THEN z.n[p.i + 1] ELSE p.used + z.n[p.i + 1] END,
    CASE WHEN p.used + z.n[p.i + 1] > 800 THEN p.chunk + 1 ELSE p.chunk END
  FROM packs p JOIN sized z ON z.doc_id = p.doc_id WHERE p.i < len(z.n))
SELECT p.doc_id, p.chunk AS chunk_id, string_agg(l.s[p.i], ' ' ORDER BY p.i) AS chunk_text
FROM packs p JOIN sentence_list l ON l.doc_id = p.doc_id GROUP BY p.doc_id, p.chunk"""


@query(
    "packed_chunks",
    "X-3",
    PACKED_CHUNKS,
)
def packed_chunks(t):
    return chunks.pack_sentences(t.documents, ["doc_id"])


DOCUMENT_WINDOWS = """
SELECT doc_id, source, k AS chunk_id, substring(text, 1 + 900 * k, 1000) AS chunk_text FROM
 (SELECT doc_id, source, text, unnest(range(0, 1 + CAST(greatest(ceil((length(text) - 1000) / 900.0), 0) AS INT))) AS k FROM documents WHERE length(text) > 0) q"""


@query("overlapping_windows", "X-4", DOCUMENT_WINDOWS)
def overlapping_windows(t):
    return chunks.overlapping_windows(t.documents, ["doc_id", "source"])


@query(
    "chunk_vector_records",
    "X-5",
    f"""
SELECT concat(CAST(doc_id AS VARCHAR), '_chunk_', CAST(chunk_id AS VARCHAR)) AS id, CAST(doc_id AS VARCHAR) AS source, chunk_id, chunk_text
FROM ({DOCUMENT_WINDOWS}) w""",
)
def chunk_vector_records(t):
    return chunks.vector_records(chunks.overlapping_windows(t.documents, ["doc_id"]), "doc_id")


@query(
    "chunks_per_source",
    "X-3 Q-8 S-11",
    f"SELECT d.source, count(*) AS chunks, count(DISTINCT c.doc_id) AS documents FROM ({PACKED_CHUNKS}) c JOIN documents d ON d.doc_id = c.doc_id GROUP BY d.source",
)
def chunks_per_source(t):
    packed = chunks.pack_sentences(t.documents, ["source", "doc_id"])
    first = F.count_if(F.col("chunk_id") == 0)
    return packed.groupBy("source").agg(F.count("*").alias("chunks"), first.alias("documents"))


@query(
    "parts_without_chunks",
    "X-3",
    "SELECT p_partkey AS doc_id FROM part WHERE p_partkey NOT IN (SELECT doc_id FROM sentence_list WHERE len(s) > 0)",
)
def parts_without_chunks(t):
    """Expected sources, here the part numbers, for which no document gave a chunk."""
    packed = chunks.pack_sentences(t.documents, ["doc_id"])
    expected = t.table("part").select(F.col("p_partkey").alias("doc_id"))
    return chunks.missing_sources(expected, packed, "doc_id")


_KEYWORDS = "policy|rule|regulation|allowed|禁止|规定|helmet|liability|fine|罚款|parking|停在哪里|使用条款|terms of use|can i|是不是可以|能不能"


@query(
    "question_routes",
    "P-24",
    f"""
SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{_KEYWORDS}') THEN 'policy' ELSE 'bb' END AS route FROM conversations""",
)
def question_routes(t):
    return t.table("conversations").select(
        "conv_id", "turn", text.question_route(F.col("text")).alias("route")
    )


@query(
    "routed_requests",
    "P-24",
    """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'policy' ELSE 'bb' END AS route FROM events""",
)
def routed_requests(t):
    """Questions made from the event type, two kinds of which ask about rules."""
    asked = t.table("events").selectExpr(
        "event_id",
        """CASE event_type WHEN 'click' THEN 'Can I bring a bike?' WHEN 'view' THEN '这里禁止停车吗'
           WHEN 'error' THEN NULL ELSE concat('trips on Friday ', event_type) END AS question""",
    )
    return asked.select("event_id", text.question_route(F.col("question")).alias("route"))


_PLACES = """
WITH typed AS (SELECT DISTINCT unnest([lower(station_name) || ' station', ' ' || replace(station_name, ' ', ', '), substring(station_name, 10, 9) || ' St.']) AS place FROM transit_stations),
cleaned AS (SELECT place, trim(regexp_replace(replace(replace(replace(replace(place, ',', ''), 'station', ''), 'St.', 'Street'), 'st.', 'street'), '\\s+', ' ', 'g')) AS c FROM typed)
"""


@query(
    "cleaned_places",
    "P-25",
    _PLACES
    + "SELECT place, array_to_string(list_transform(string_split(c, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS cleaned FROM cleaned",
)
def cleaned_places(t):
    return t.places.select("place", text.clean_place(F.col("place")).alias("cleaned"))


@query(
    "place_matches",
    "P-22 P-25",
    _PLACES
    + """
SELECT c.place, m.station_id, m.station_name FROM cleaned c LEFT JOIN transit_stations m ON contains(lower(m.station_name), lower(c.c))
QUALIFY row_number() OVER (PARTITION BY c.place ORDER BY length(m.station_name), m.station_id) = 1""",
)
def place_matches(t):
    return place_match.match_places(t.places, t.transit_stations).select("place", "station_id", "station_name")


@query(
    "station_documents",
    "P-26 A-23 A-9",
    f"""
SELECT 'station_' || station_id AS id, '{AGENCY} station ' || station_name || ' (ID ' || station_id || ') is located at latitude ' || CAST(lat AS VARCHAR) || ' and longitude ' || CAST(lng AS VARCHAR) || '.' AS text,
  'station' AS source_type, station_id AS stop_id, CAST(NULL AS VARCHAR) AS route_id FROM transit_stations""",
)
def station_documents(t):
    return chunks.station_documents(t.transit_stations, AGENCY)
