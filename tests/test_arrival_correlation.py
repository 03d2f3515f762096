"""Correlation of arrivals and pickups: by sums per place, the same as over every hour of every station."""

import datetime

import numpy as np
import pytest

from curbline.operators import station_features
from tests.conftest import values

DAY = datetime.datetime(2024, 1, 1)


def hour(n):
    return DAY + datetime.timedelta(hours=n, minutes=7 * n % 60)


def test_stations_at_one_place_share_its_pickups(frame):
    """Stations a and b lie at one place, c elsewhere with one dock in reach, d far from all; z is in no station list."""
    places = {"a": (42.0, -71.0), "b": (42.0, -71.0), "c": (42.1, -71.0), "d": (45.0, -71.0), "e": (42.0, -71.0)}
    transit = frame([(k, k, *v) for k, v in places.items()], "station_id string, station_name string, lat double, lng double")
    arrived = {"a": [0, 0, 1, 5], "b": [2, 2, 2, 3, 9], "c": [0, 1, 1, 4], "d": [0, 0, 1], "z": [1, 2, 2], None: [3]}
    scheduled = frame(
        [(k, hour(n)) for k, hours in arrived.items() for n in hours] + [("a", None)],
        "end_station_id string, scheduled_end_time timestamp_ntz",
    )
    docks = {(42.001, -71.0): [0, 0, 0, 2, 2, 6, None, None], (42.0, -71.002): [1, 2, 6], (42.1, -71.0): [0, 1, 1, 8]}
    trips = frame(
        [(*k, None if n is None else hour(n)) for k, hours in docks.items() for n in hours] + [(None, -71.0, hour(1))],
        "start_lat double, start_lng double, started_at timestamp_ntz",
    )
    near = {"a": [0, 0, 0, 2, 2, 6, None, None, 1, 2, 6], "c": [0, 1, 1, 8]}
    near["b"] = near["e"] = near["a"]
    expected = {}
    for k in {*arrived, *near}:
        mine, theirs = arrived.get(k, []), near.get(k, [])
        hours = {*mine, *theirs}
        x, y = (np.array([side.count(h) for h in hours]) for side in (mine, theirs))
        varies = len(set(x)) > 1 and len(set(y)) > 1
        expected[k] = len(hours), np.corrcoef(x, y)[0, 1] if varies else None
    found = station_features.arrival_pickup_correlation(transit, scheduled, trips)
    assert {r[0]: (r[1], r[2]) for r in values(found, "station_id", "hours", "correlation")} == {
        k: (n, None if c is None else pytest.approx(c, abs=1e-12)) for k, (n, c) in expected.items()
    }


def test_stations_are_not_crossed_with_the_hours_of_their_place(spark, inputs):
    """The full join has a row per station: hours of pickups meet only hours with arrivals, and trips are grouped once."""
    found = station_features.arrival_pickup_correlation(
        inputs.transit_stations,
        inputs.trips.selectExpr("CAST(trip_id % 10 AS STRING) AS end_station_id", "CAST(service_date AS TIMESTAMP_NTZ) AS scheduled_end_time"),
        inputs.bike_trips,
    )
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    full = [line for line in plan.splitlines() if "Join FullOuter" in line]
    assert len(full) == 1 and "station_id" in full[0] and "ts_hour" not in full[0]
