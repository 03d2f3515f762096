"""Physical plans: no cross products, no row-wise Python, pushdown, one scan of the facts."""

import re

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from curbline.operators import coverage, demand, reviews, schedule, spatial
from curbline.plans.registry import QUERIES
from tests.conftest import SMALL, values

EAGER = {
    "pickup_model_selection", "dropoff_model_selection", "predicted_pickups", "predicted_dropoffs",
    "predicted_demand_keys", "occupancy_model_metrics", "occupancy_probabilities",
    "kmeans_clusters", "kmeans_nearest_centres", "training_run_registry", "occupancy_request_scores",
    "occupancy_rows_scored", "linear_demand_fit", "linear_residuals", "predicted_linear_pickups", "fitted_model_choice",
    "boosted_demand_first_split", "boosted_occupancy_first_split", "boosted_occupancy_probabilities", "compacted_stream_table",
}
FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER and not n.startswith("stream_")])
def test_no_cross_product_and_no_row_wise_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SMALL))
    assert not [node for node in FORBIDDEN if node in plan]


def test_station_hours_scan_the_trips_once(inputs):
    plan = plan_of(demand.station_hours(inputs.bike_trips))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "partial_sum" in plan
    columns = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert "l_comment" not in columns and "l_extendedprice" not in columns


def test_year_filter_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet")
    plan = plan_of(reviews.top_values(orders, "o_orderstatus", "o_orderdate", 1997))
    assert "GreaterThanOrEqual(o_orderdate" in plan and "LessThan(o_orderdate" in plan
    assert "TakeOrderedAndProject" in plan


def test_exploded_sides_are_not_broadcast(inputs):
    sites = spatial.sites(coverage.unique_stations(inputs.transit_stations), "lat", "lng")
    near = coverage.bike_sites(coverage.latest_info(inputs.station_info))
    assert "BroadcastHashJoin" not in plan_of(spatial.radius_pairs(sites, near, 500.0))
    # one broadcast, of the crowded cells alone
    assert plan_of(spatial.nearest_site(sites, near)).count("BroadcastHashJoin") == 1


def test_latest_row_needs_no_window(inputs):
    plan = plan_of(coverage.latest_status(inputs.station_status))
    assert "Window" not in plan and "partial_max_by" in plan and plan.count("Exchange") == 1


def test_top_k_is_limited_before_the_shuffle(spark):
    plan = plan_of(QUERIES["cosine_top_five"](spark, SMALL))
    assert re.search(r"WindowGroupLimit .*Partial", plan) and "FlatMapCoGroupsInArrow" in plan


def test_schedule_reads_the_days_of_its_range(spark, frame, tmp_path):
    """The range reaches a trips table stored by day; late clocks of earlier days count; stops only where used."""
    days = [("a", "1997-12-30", "48:00:00"), ("b", "1997-12-31", "23:59:59"), ("c", "1998-01-01", "00:00:00"),
            ("d", "1998-12-31", "23:59:00"), ("e", "1998-12-31", "24:00:00"), ("f", "1999-01-01", "00:00:00"),
            ("g", "1997-11-21", "999:00:00"), ("h", "1998-05-05", None), ("i", None, "10:00:00"), ("j", "1996-01-01", "10:00:00")]
    frame(days, "trip_id string, day string, clock string").selectExpr(
        "trip_id", "'r' AS route_id", "'s' AS service_id", "0 AS direction_id", "CAST(day AS DATE) AS service_date"
    ).write.partitionBy("service_date").parquet(f"{tmp_path}/trips")
    stop_times = frame([(t, 1, "x", c) for t, _, c in days], "trip_id string, stop_sequence int, stop_id string, arrival_time string")
    stops = frame([("x", "X", 1.0, 2.0)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    trips = spark.read.parquet(f"{tmp_path}/trips")
    args = (trips, stop_times, stops, "2024-01-01 00:00:00")
    year = {"first_day": "1998-01-01", "end_day": "1999-01-01"}
    lean = schedule.scheduled_trips(*args, **year, with_stations=False)
    assert [r[0] for r in values(lean, "trip_id")] == ["a", "c", "d", "g"]
    assert "start_station_name" not in lean.columns and "stop_name" not in plan_of(lean)
    filters = re.search(r"PartitionFilters: \[(.*?)\], ", plan_of(lean)).group(1)
    assert "service_date" in filters and ">= 1997-11-20" in filters and "< 1999-01-01" in filters
    full = schedule.scheduled_trips(*args, **year)
    assert values(full, "trip_id", "start_station_name") == [(t, "X") for t in "acdg"]


def test_names_are_joined_to_the_top_rows_only(spark, inputs):
    for name in ("top_pickup_stations", "stations_busy_both_ways"):
        logical = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "max_by" in logical and "max_by" not in logical[logical.rindex("GlobalLimit"):]


def test_weekday_counts_read_the_trips_once(inputs):
    plan = demand.dow_hour_stats(inputs.bike_trips)
    plan.collect()
    assert "ReusedExchange" in plan_of(plan)
