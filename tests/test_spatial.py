"""Grid joins against brute force, edges and crowded places."""

import math
import random

import pytest
from pyspark.sql import functions as F

from curbline.functions import places
from curbline.operators import coverage, spatial
from tests.conftest import values

R = places.EARTH_RADIUS_M


def distance(a, b):
    lat1, lng1, lat2, lng2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def cloud(rng, n, kind):
    if kind == "city":
        return [(42 + rng.random() / 2, -71.5 + rng.random() / 2) for _ in range(n)]
    if kind == "date line":
        return [(rng.uniform(-1, 1), rng.choice([-180, 179]) + rng.random()) for _ in range(n)]
    return [(89 + rng.random(), rng.uniform(-180, 180)) for _ in range(n)]


def points(frame, coordinates):
    return spatial.sites(frame(coordinates, "lat double, lng double"), "lat", "lng")


@pytest.mark.parametrize("kind", ["city", "date line", "pole"])
@pytest.mark.parametrize("radius", [900.0, 9000.0])
def test_radius_pairs_equal_brute_force(frame, kind, radius):
    rng = random.Random(f"{kind}{radius}")
    left, right = cloud(rng, 120, kind), cloud(rng, 150, kind)
    found = spatial.radius_pairs(points(frame, left), points(frame, right), radius)
    got = {tuple(r) for r in found.select("lat", "lng", "near_lat", "near_lng").collect()}
    want = {(*a, *b) for a in left for b in right if distance(a, b) <= radius}
    assert got == want and want


@pytest.mark.parametrize("kind", ["city", "date line", "pole"])
def test_nearest_equals_brute_force(frame, kind):
    rng = random.Random(kind)
    left, right = cloud(rng, 100, kind) + [(-33.9, 151.2)], cloud(rng, 90, kind)
    marked = points(frame, right).withColumn("near_id", F.concat_ws(",", "lat", "lng"))
    found = spatial.nearest_site(points(frame, left), marked).collect()
    assert len(found) == len(set(left))
    for row in found:
        best = min(distance((row.lat, row.lng), b) for b in right)
        assert row.distance == pytest.approx(best, abs=1e-3)


def test_planar_nearest_equals_brute_force(frame):
    rng = random.Random(5)
    left, right = cloud(rng, 80, "city"), cloud(rng, 70, "city")
    marked = points(frame, right).withColumn("near_id", F.concat_ws(",", "lat", "lng"))
    for row in spatial.nearest_site(points(frame, left), marked, spatial.PLANAR).collect():
        best = min(math.dist((row.lat, row.lng), b) for b in right)
        assert row.distance == pytest.approx(best, abs=1e-9)


def test_radius_includes_its_edge(frame):
    home = [(42.0, -71.0)]
    other = (42.01, -71.0)
    exact = distance(home[0], other)
    near = points(frame, [other])
    inside = spatial.radius_pairs(points(frame, home), near, exact + 1e-6).count()
    outside = spatial.radius_pairs(points(frame, home), near, exact - 1e-3).count()
    same = spatial.radius_pairs(points(frame, home), points(frame, home), 1.0).first()
    assert (inside, outside, same.distance_m) == (1, 0, 0.0)


def test_equal_distance_goes_to_the_smaller_id(frame):
    home = points(frame, [(42.0, -71.0)])
    sides = frame([("9", 42.0, -71.01), ("10", 42.0, -70.99)], "station_id string, lat double, lon double")
    found = spatial.nearest_site(home, coverage.bike_sites(sides)).first()
    assert found.near_id == "10"  # ids are text


def test_one_crowded_place_stays_one_site(frame):
    """A third of all stations at one coordinate: counts are whole, pairs stay few."""
    info = [(str(i), "s", 42.0 if i < 300 else 42.0 + i / 1e4, -71.0) for i in range(900)]
    stations = frame(info, "station_id string, name string, lat double, lon double")
    transit = frame(
        [(str(i), "t", 42.0, -71.0) for i in range(300)] + [("far", "t", 43.5, -71.0), ("none", "t", None, None)],
        "station_id string, station_name string, lat double, lng double",
    )
    pairs = spatial.radius_pairs(
        spatial.sites(transit, "lat", "lng"), coverage.bike_sites(stations), 200.0
    )
    assert pairs.count() == 1
    cover = coverage.coverage(transit, stations, 200.0)
    assert cover.filter(F.col("nearby_count") == 300).count() == 300
    assert values(cover.filter(F.col("nearby_count") == 0), "station_id", "meets_last_mile") == [
        ("far", False), ("none", False),
    ]


def test_summary_without_any_distance(frame):
    transit = frame([("a", "t", 42.0, -71.0)], "station_id string, station_name string, lat double, lng double")
    stations = frame([], "station_id string, name string, lat double, lon double")
    row = coverage.distance_summary(coverage.coverage(transit, stations, 100.0)).first()
    assert (row.total_stations, row.stations_failing, row.percent_meeting) == (1, 1, 0.0)
    assert row.median_distance_m is None and row.mean_distance_m is None


@pytest.mark.parametrize("metric", [spatial.SPHERE, spatial.PLANAR])
def test_crowded_cells_are_split_by_their_count(frame, metric):
    """A crowded city and far searchers: few rows of the right side per key, results as by brute force."""
    rng = random.Random(11)
    city = [(42 + rng.random() / 50, -71 + rng.random() / 50) for _ in range(600)]
    left = [(42 + rng.random() * 3, -71 + rng.random() * 3) for _ in range(40)]
    right = points(frame, city).withColumn("near_id", F.concat_ws(",", "lat", "lng"))
    apart = distance if metric is spatial.SPHERE else math.dist
    for cell_rows in (1, 20, 50_000):
        for row in spatial.nearest_site(points(frame, left), right, metric, cell_rows=cell_rows).collect():
            assert row.distance == pytest.approx(min(apart((row.lat, row.lng), b) for b in city), abs=1e-3)
    size = f"{metric.finest}D * pow({spatial.LEVEL_STEP}D, _level)"
    levels = F.explode(F.sequence(F.lit(0), F.lit(metric.levels - 1)))
    layered = spatial._with_cell(right.withColumn("_level", levels), metric, size)
    dealt = spatial._dealt(layered, spatial._cell_counts(layered, metric), metric, 20)
    assert dealt.count() == 600 * metric.levels
    largest = dealt.groupBy("_level", *spatial._names(metric), "_part").count().agg(F.max("count")).first()[0]
    assert largest <= 45  # 20 on average


def test_only_crowded_cells_are_broadcast(frame):
    near = points(frame, [(42.0, -71.0)]).withColumn("near_id", F.lit("a"))
    plan = spatial.nearest_site(points(frame, [(42.5, -71.0)]), near)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("BroadcastHashJoin") == 1
