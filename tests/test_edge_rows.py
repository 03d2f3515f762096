"""Hand-made rows for the places where a plain implementation goes wrong."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from curbline.functions import text, times
from curbline.operators import chunks, clusters, demand, keyed, occupancy, quality, schedule
from curbline.sources import tables
from tests.conftest import values

T = dt.datetime


def one(df, expression):
    return df.select(expression.alias("v")).first()["v"]


def test_two_snapshots_count_a_trip_once(frame):
    info = frame(
        [("1", "old", T(2024, 1, 1)), ("1", "new", T(2024, 1, 2))],
        "station_id string, name string, snapshot_ts timestamp_ntz",
    ).withColumns({"lat": F.lit(42.0), "lon": F.lit(-71.0)})
    trips = frame(
        [("1", "1", T(2024, 1, 1, 8, 5), T(2024, 1, 1, 9, 1)), (None, "1", T(2024, 1, 1, 8, 5), T(2024, 1, 1, 8, 9))],
        "start_station_id string, end_station_id string, started_at timestamp_ntz, ended_at timestamp_ntz",
    )
    assert values(demand.hourly_pickups(trips, info), "station_name", "pickups") == [("new", 1)]
    got = values(demand.demand_features(trips, info), "ts_hour", "pickups", "dropoffs")
    assert got == [(T(2024, 1, 1, 8), 1, 1), (T(2024, 1, 1, 9), 0, 1)]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2025-01-01T02:59:00Z", T(2025, 1, 1, 2, 59)),
        ("2025-01-01T00:00:00-05:00", T(2025, 1, 1, 5)),
        ("2025-01-01T00:00:00", T(2025, 1, 1)),
        ("2025-02-30T00:00:00Z", None), ("2025", None), ("", None), ("bogus", None), (None, None),
    ],
)
def test_iso_instants(frame, raw, want):
    assert one(frame([(raw,)], "raw string"), times.iso_utc(F.col("raw"))) == want


def test_service_day_turns_at_three(frame):
    rows = frame([(T(2025, 1, 1, 2, 59),), (T(2025, 1, 1, 3),)], "ts timestamp_ntz")
    got = [r[0] for r in rows.select(times.service_date(F.col("ts"))).collect()]
    assert got == [dt.date(2024, 12, 31), dt.date(2025, 1, 1)]
    local = one(rows.limit(1), times.service_date(F.col("ts"), zone="America/New_York"))
    assert local == dt.date(2024, 12, 31)


def test_clock_past_midnight(frame):
    rows = frame([(dt.date(2024, 1, 1), c) for c in ("25:10:00", " 07:05:30", "x", None)], "d date, c string")
    got = [r[0] for r in rows.select(times.clock_on(F.col("d"), F.col("c"))).collect()]
    assert got == [T(2024, 1, 2, 1, 10), T(2024, 1, 1, 7, 5, 30), None, None]


def test_key_keeps_positions(frame):
    rows = frame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    keys = [r[0] for r in rows.select(text.sha1_key(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert keys[0] != keys[1]
    numbers = frame([(1e-5,), (1e7,)], "n double")
    assert [r[0] for r in numbers.select(text.fixed_decimal(F.col("n"))).collect()] == ["0.000010", "10000000.000000"]


def test_display_suffix_follows_daylight_saving(frame):
    rows = frame([(T(2024, 1, 1, 5),), (T(2024, 7, 1, 4),)], "ts timestamp_ntz")
    got = [r[0] for r in rows.select(times.local_display(F.col("ts"))).collect()]
    assert got == ["2024-01-01 00:00:00 EST", "2024-07-01 00:00:00 EDT"]


def test_contract_and_merge_are_repeatable(frame):
    rows = [("k1", "s", 1), ("k1", "s", 2), ("k2", None, 1), (None, "s", 1)]
    batch = frame(rows, "event_id string, stop_id string, n int")
    valid, bad = quality.split_contract(batch, ["event_id", "stop_id"])
    assert values(bad, "reject_reason") == [("event_id",), ("stop_id",)]
    base = frame([("k0", "s", 0)], "event_id string, stop_id string, n int")
    fresh = tables.new_rows(base, valid, "event_id", ["n"])
    assert values(fresh, "event_id", "n") == [("k1", 1)]
    assert tables.new_rows(base.unionByName(fresh), valid, "event_id", ["n"]).isEmpty()


def test_latest_settles_ties_and_null_times(frame):
    rows = frame(
        [("a", T(2024, 1, 1), 1), ("a", T(2024, 1, 1), 2), ("a", None, 9), ("b", None, 3)],
        "k string, ts timestamp_ntz, v int",
    )
    assert values(keyed.latest_per_key(rows, ["k"], ["ts"]), "k", "v") == [("a", 2), ("b", 3)]


def test_minimum_keeps_ties_and_drops_null(frame):
    schema = "model_name string, rmse double"
    rows = frame([("a", 1.0), ("b", 1.0), ("c", None), ("d", 2.0)], schema)
    assert values(keyed.keep_minimum(rows, "rmse"), "model_name") == [("a",), ("b",)]
    assert keyed.keep_minimum(frame([("a", None)], schema), "rmse").isEmpty()


def test_first_and_last_are_per_column(frame):
    stops = frame(
        [(1, 1, None, "08:00:00"), (1, 2, "B", "08:10:00"), (1, 3, "C", None), (2, 1, "X", "09:00:00")],
        "trip_id long, stop_sequence long, stop_id string, arrival_time string",
    )
    columns = ["trip_id", "first_stop_id", "first_arrival_time", "last_stop_id", "last_arrival_time"]
    loose = schedule.first_and_last_stops(stops, ["trip_id"])
    assert values(loose, *columns) == [
        (1, "B", "08:00:00", "C", "08:10:00"), (2, "X", "09:00:00", "X", "09:00:00"),
    ]
    strict = schedule.first_and_last_stops(stops, ["trip_id"], strict_row=True)
    assert values(strict, *columns)[0] == (1, None, "08:00:00", "C", None)


def test_time_split_bounds(frame):
    as_of = T(2024, 3, 31)
    rows = frame(
        [(as_of - dt.timedelta(days=d) - dt.timedelta(seconds=s), d, s) for d in (7, 67) for s in (0, 1)],
        "ts timestamp_ntz, d int, s int",
    )
    assert values(occupancy.train_rows(rows, "2024-03-31 00:00:00"), "d", "s") == [(7, 1), (67, 0)]
    assert values(occupancy.eval_rows(rows, "2024-03-31 00:00:00"), "d", "s") == [(7, 0)]


def test_label_limits_are_strict(frame):
    cases = [(400.0, 6.0), (399.0, 5.0), (399.0, 5.01), (800.0, 2.0), (800.01, 9.0), (100.0, 1.99)]
    rows = frame(cases, "distance_to_nearest_m double, avg_bikes_morning double")
    got = [r.station_label for r in clusters.label_stations(rows).collect()]
    assert got == [clusters.MODERATE] * 2 + [clusters.SERVED, clusters.MODERATE] + [clusters.DESERT] * 2


def test_dominant_label_tie_order(frame):
    rows = frame(
        [(0, str(i), f"n{i}", label, 1.0, 1.0, 1.0) for i, label in enumerate([clusters.MODERATE, clusters.SERVED])],
        """cluster int, station_id string, station_name string, station_label string, distance_to_nearest_m double,
           avg_bikes_morning double, avg_bikes_evening double""",
    )
    row = clusters.cluster_summary(rows).first()
    assert row.dominant_label == clusters.SERVED and row.example_stations == ["n0", "n1"]


def test_rank_label_of_a_fourth_cluster_is_null(frame):
    rows = frame(
        [(i, float(i), 1.0, 1.0) for i in range(4)],
        "cluster int, distance_to_nearest_m double, avg_bikes_morning double, avg_bikes_evening double",
    )
    got = dict(values(clusters.label_by_rank(rows), "cluster", "rank_label"))
    assert got == {3: clusters.DESERT, 2: clusters.MODERATE, 1: clusters.SERVED, 0: None}


def pack(sentences, limit=800):
    """Plain packing of sentences, for comparison."""
    parts, current, used = [], [], 0
    for sentence in sentences:
        if current and used + len(sentence) > limit:
            parts.append(" ".join(current))
            current, used = [], 0
        current.append(sentence)
        used += len(sentence)
    return parts + ([" ".join(current)] if current else [])


@pytest.mark.parametrize(
    "sentences",
    [
        ["a" * 399 + ".", "b" * 399 + ".", "c."], ["a" * 400 + ".", "b" * 399 + "."],
        ["a" * 900 + ".", "b."], ["b.", "a" * 900 + ".", "c!"], ["no mark at all"], ["é" * 799 + "?", "x."],
    ],
)
def test_packing(frame, sentences):
    docs = frame([(1, " ".join(sentences)), (2, ""), (3, " \n "), (4, None)], "doc_id int, text string")
    got = chunks.pack_sentences(docs, ["doc_id"]).orderBy("doc_id", "chunk_id").collect()
    assert [r.chunk_text for r in got] == pack(sentences)
    assert [r.chunk_id for r in got] == list(range(len(got))) and {r.doc_id for r in got} == {1}


def test_line_breaks_split_sentences(frame):
    docs = frame([("one\n\ntwo. three \n four",)], "text string")
    assert one(docs, text.sentences(F.col("text"))) == ["one", "two.", "three", "four"]


@pytest.mark.parametrize("length", [0, 1, 1000, 1001, 1900, 1901, 5000])
def test_windows(frame, length):
    body = "".join(chr(97 + i % 26) for i in range(length))
    got = chunks.overlapping_windows(frame([(1, body)], "doc_id int, text string"), ["doc_id"])
    windows = [r.chunk_text for r in got.orderBy("chunk_id").collect()]
    rebuilt = "".join(w if i == 0 else w[100:] for i, w in enumerate(windows))
    assert rebuilt == body and all(len(w) <= 1000 for w in windows)
    assert len(windows) == (0 if length == 0 else 1 + max(0, -(-(length - 1000) // 900)))


def test_page_cleaning(frame):
    html = "<SCRIPT>\nx<y</SCRIPT ><style a='b'>p{}\n</STYLE><p>A&amp;B  1 < 2</p>\n<b>end</b>"
    got = one(frame([(html,)], "h string"), text.strip_html(F.col("h")))
    assert got.endswith("end") and "p{}" not in got and "A&amp;B" in got


@pytest.mark.parametrize(
    "name, category",
    [
        ("Union Square", "outer_city_center"), ("Revere Beach", "seasonal_or_tourism"),
        ("Park Street", "far_end_or_park_and_ride"), ("South Bend", "far_end_or_park_and_ride"),
        ("Kendall", "far_end_or_park_and_ride"),  # 'end' inside a word counts, as in the rule it follows
        ("Alewife", "other"), (None, "other"), ("", "other"),
    ],
)
def test_station_categories(frame, name, category):
    row = frame([(name,)], "n string")
    assert one(row, text.station_category(F.col("n"))) == category
    if name == "South Bend":
        assert one(row, text.station_category(F.col("n"), word_boundary=True)) == "other"


@pytest.mark.parametrize(
    "question, route",
    [("Can I bring a bike?", "policy"), ("trips on Friday", "bb"), ("HELMET", "policy"), ("能不能骑车", "policy"), (None, "bb")],
)
def test_question_routes(frame, question, route):
    assert one(frame([(question,)], "q string"), text.question_route(F.col("q"))) == route


@pytest.mark.parametrize(
    "reply, origin",
    [
        ('{"origin": "A"}', "A"), ('```json\n{"origin": "B"}\n```', "B"),
        ('Sure {"origin": "C"} ok', "C"), ("{broken", None), ("no braces", None), (None, None),
    ],
)
def test_replies(frame, reply, origin):
    row = quality.parse_replies(frame([(reply,)], "r string"), "r", "origin string").first()
    assert (row.fields.origin if row.fields else None) == origin


def test_typical_use_defaults(frame):
    stats = frame(
        [("1", 2, 8, 4, 2.0), ("1", 2, 9, 8, 4.0)],
        "start_station_id string, dow int, hour int, trips_count int, avg_trips_per_day_hour double",
    )
    lookup = frame([("main st", "1")], "name_key string, start_station_id string")
    asked = frame(
        [("Main St", 2, 8, None), ("Main St", 2, 8, 9), ("Main St", 3, 8, 9), ("Nowhere", 2, 8, 9)] + [("main st", 2, 8, 9)] * 3,
        "station_name string, day_of_week int, start_hour int, end_hour int",
    )
    got = demand.typical_use(asked, stats, lookup)
    assert got.count() == 7
    rows = values(got, "station_name", "day_of_week", "end_hour", "avg_trips", "has_data")
    assert ("Main St", 2, 8, 2.0, True) in rows and ("Main St", 2, 9, 3.0, True) in rows
    assert ("Main St", 3, 9, 0.0, False) in rows and ("Nowhere", 2, 9, 0.0, False) in rows


def test_clean_place(frame):
    row = frame([("  park st., boston  station",)], "p string")
    assert one(row, text.clean_place(F.col("p"))) == "Park Street Boston"


def test_equal_means_rank_by_cluster_number(frame):
    """Sums in another order differ in their last places; such means tie."""
    rows = frame(
        [(0, 0.19999999999999998, 1.0, 1.0), (1, 0.20000000000000004, 1.0, 1.0), (2, 0.1, 1.0, 1.0)],
        "cluster int, distance_to_nearest_m double, avg_bikes_morning double, avg_bikes_evening double",
    )
    got = dict(values(clusters.label_by_rank(rows), "cluster", "rank_label"))
    assert got == {0: clusters.DESERT, 1: clusters.MODERATE, 2: clusters.SERVED}
