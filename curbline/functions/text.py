"""Text expressions: keys, labels, page cleaning, sentence and name handling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered keyword groups for station names.
STATION_CATEGORIES = [
    ("outer_city_center", ["Center", "City Hall", "Downtown", "Square", "Sq"]),
    ("seasonal_or_tourism", ["Beach", "Harbor", "Greenbush", "Newburyport", "Gloucester"]),
    ("far_end_or_park_and_ride", ["Route", "Parking Lot", "495", "Park", "Terminal", "End"]),
]
OTHER_CATEGORY = "other"

# A question with any of these goes to the policy branch. Phrases
# that only repeat a shorter entry with more words around it are left out.
POLICY_KEYWORDS = [
    "policy", "rule", "regulation", "allowed", "禁止", "规定", "helmet", "liability",
    "fine", "罚款", "parking", "停在哪里", "使用条款", "terms of use", "can i",
    "是不是可以", "能不能",
]
# All characters that count as white space at the ends of a sentence.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
)

POLICY_ROUTE, RIDE_ROUTE = "policy", "bb"


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions)


def sha1_key(*parts: Column, separator: str = "|") -> Column:
    """SHA-1 over all parts; a NULL part counts as empty text, so positions stay fixed."""
    filled = [F.coalesce(part.cast("string"), F.lit("")) for part in parts]
    return F.sha1(F.concat_ws(separator, *filled))


def fixed_decimal(value: Column, places: int = 6) -> Column:
    """A number as text with fixed decimals, so a key never depends on float printing."""
    return F.when(value.isNotNull(), F.format_string(f"%.{places}f", value))


def normal_label(value: Column) -> Column:
    return F.upper(F.trim(value))


def is_truthy(flag: Column) -> Column:
    return F.coalesce(F.lower(flag.cast("string")).isin("1", "true"), F.lit(False))


def contains_any(text: Column, keywords: list[str], word_boundary: bool = False) -> Column:
    """Case-insensitive literal test. Substrings count unless whole words are asked for."""
    lowered = F.lower(text)
    if word_boundary:
        words = "|".join(rf"\Q{keyword.lower()}\E" for keyword in keywords)
        return lowered.rlike(rf"(?<!\w)(?:{words})(?!\w)")
    return any_of([lowered.contains(keyword.lower()) for keyword in keywords])


def station_category(name: Column, word_boundary: bool = False) -> Column:
    """First keyword group that matches the name; a NULL name is ``other``."""
    filled = F.coalesce(name, F.lit(""))
    label = F.lit(OTHER_CATEGORY)
    for category, keywords in reversed(STATION_CATEGORIES):
        label = F.when(contains_any(filled, keywords, word_boundary), category).otherwise(label)
    return label


def question_route(question: Column, keywords: list[str] = POLICY_KEYWORDS) -> Column:
    return F.when(
        contains_any(F.coalesce(question, F.lit("")), keywords), POLICY_ROUTE
    ).otherwise(RIDE_ROUTE)


def clean_place(place: Column) -> Column:
    """Tidy a place name typed by a rider: no commas, no word 'station', St. spelled out."""
    text = F.replace(place, F.lit(","), F.lit(""))
    text = F.replace(text, F.lit("station"), F.lit(""))
    text = F.replace(text, F.lit("St."), F.lit("Street"))
    text = F.replace(text, F.lit("st."), F.lit("street"))
    return F.initcap(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def strip_html(html: Column) -> Column:
    """Visible text of a page: scripts, styles and tags out, white space collapsed."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sentences(text: Column) -> Column:
    """Split after ``. ? !`` plus white space, or at line breaks; blank pieces are dropped."""
    pieces = F.split(text, r"(?U)(?<=[.?!])\s+|\n+")
    trimmed = F.transform(pieces, lambda piece: F.btrim(piece, F.lit(WHITE_SPACE)))
    return F.filter(trimmed, lambda piece: F.length(piece) > 0)


def station_sentence(
    agency: str, name: Column, station_id: Column, lat: Column, lng: Column
) -> Column:
    """One describing sentence per station, the text that gets indexed for retrieval."""
    return F.concat(
        F.lit(f"{agency} station "), name, F.lit(" (ID "), station_id,
        F.lit(") is located at latitude "), lat.cast("string"),
        F.lit(" and longitude "), lng.cast("string"), F.lit("."),
    )


def reply_json(reply: Column) -> Column:
    """The JSON object inside a model reply.

    Code fences go first; a reply that is not an object by itself is searched
    for its outermost braces. NULL when there is none.
    """
    bare = F.trim(F.replace(F.replace(reply, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    block = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(F.length(block) > 0, block)
