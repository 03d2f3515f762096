"""Last-mile coverage reports."""

from pyspark.sql import functions as F

from curbline.functions import places, text
from curbline.operators import coverage, spatial
from curbline.operators.station_features import nearest_and_close
from curbline.plans.inputs import AS_OF
from curbline.plans.registry import query
from curbline.session import cut_lineage

MILE = places.miles_to_metres(1.0)


def covered(t):
    return coverage.coverage(t.transit_stations, coverage.latest_info(t.station_info), MILE)


def rounded(df, columns=("nearest_distance_m",), digits=3):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "coverage_one_mile",
    "J-3 A-3 K-1 P-27 W-1",
    "SELECT station_id, station_name, lat, lng, nearby_count, round(nearest_distance_m, 3) AS nearest_distance_m, meets_last_mile FROM covered",
)
def coverage_one_mile(t):
    return rounded(coverage.by_distance(covered(t)))


@query(
    "coverage_active_stations",
    "A-4 A-5 P-7 J-3",
    """
SELECT m.station_id, m.station_name, m.lat, m.lng, count(p.bike_id) AS nearby_count,
  round(min(p.distance_m), 3) AS nearest_distance_m, count(p.bike_id) >= 1 AS meets_last_mile
FROM transit_stations m LEFT JOIN (SELECT b.* FROM bike_pairs b JOIN status_ratio a ON a.station_id = b.bike_id AND a.active_ratio >= 0.3) p
  ON p.station_id = m.station_id AND p.distance_m <= 1609.34
GROUP BY ALL""",
)
def coverage_active_stations(t):
    active = coverage.active_stations(t.station_info, t.station_status, AS_OF)
    return rounded(coverage.coverage(t.transit_stations, active, MILE))


@query("station_active_ratio", "A-5 P-7", "SELECT station_id, round(active_ratio, 6) AS active_ratio FROM status_ratio")
def station_active_ratio(t):
    return rounded(coverage.active_ratio(t.station_status, AS_OF), ["active_ratio"], 6)


@query(
    "reachable_bike_sites",
    "J-3",
    """
SELECT m.station_id, m.station_name, p.bike_lat AS near_lat, p.bike_lon AS near_lng, count(p.bike_id) AS bike_stations, round(min(p.distance_m), 3) AS distance_m
FROM transit_stations m JOIN bike_pairs p ON p.station_id = m.station_id AND p.distance_m <= 1609.34
GROUP BY m.station_id, m.station_name, p.bike_lat, p.bike_lon
UNION ALL
SELECT station_id, station_name, NULL, NULL, 0, NULL FROM covered WHERE nearby_count = 0""",
)
def reachable_bike_sites(t):
    pairs = coverage.reachable_sites(t.transit_stations, coverage.latest_info(t.station_info), MILE)
    return rounded(pairs, ["distance_m"]).withColumn("bike_stations", F.coalesce("bike_stations", F.lit(0)))


@query(
    "nearest_bike_station",
    "J-6",
    """
SELECT station_id, station_name, bike_id AS near_id, bike_name AS near_name, round(distance_m, 3) AS distance_m FROM bike_pairs
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY round(distance_m, 3), bike_id) = 1""",
)
def nearest_bike_station(t):
    found = coverage.nearest_bike_station(t.transit_stations, coverage.latest_info(t.station_info))
    return found.select(
        "station_id", "station_name", "near_id", "near_name", F.round("distance", 3).alias("distance_m")
    )


@query(
    "nearest_by_degrees",
    "J-8",
    """
SELECT station_id, bike_id AS near_id, round(sqrt(pow(lat - bike_lat, 2) + pow(lng - bike_lon, 2)), 9) AS degrees FROM bike_pairs
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY round(sqrt(pow(lat - bike_lat, 2) + pow(lng - bike_lon, 2)), 9), bike_id) = 1""",
)
def nearest_by_degrees(t):
    found = coverage.nearest_bike_station(
        t.transit_stations, coverage.latest_info(t.station_info), spatial.PLANAR
    )
    return found.select("station_id", "near_id", F.round("distance", 9).alias("degrees"))


@query(
    "nearest_and_close_counts",
    "J-6",
    """
SELECT station_id, round(min(distance_m), 3) AS distance_to_nearest_m, count(CASE WHEN distance_m <= 500 THEN 1 END) AS bikes_within_near
FROM bike_pairs GROUP BY station_id""",
)
def nearest_and_close_counts(t):
    per_site = nearest_and_close(t.transit_stations, coverage.latest_info(t.station_info))
    stations = coverage.unique_stations(t.transit_stations).join(per_site, ["lat", "lng"])
    return stations.select(
        "station_id",
        F.round("distance_to_nearest_m", 3).alias("distance_to_nearest_m"),
        F.coalesce("bikes_within_near", F.lit(0)).alias("bikes_within_near"),
    )


@query(
    "nearest_availability",
    "J-7 P-28 W-1",
    """
WITH n AS (SELECT * FROM bike_pairs QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY round(distance_m, 3), bike_id) = 1)
SELECT n.station_id, n.station_name, n.bike_id AS near_id, n.bike_name AS near_name, round(n.distance_m, 3) AS distance_m,
  CAST(coalesce(s.num_bikes_available, 0) AS BIGINT) AS bikes, CAST(coalesce(s.num_docks_available, 0) AS BIGINT) AS docks,
  coalesce(s.is_renting = 1, false) AS renting_ok, coalesce(lower(s.is_returning) = 'true', false) AS returning_ok, s.snapshot_ts AS status_snapshot_ts
FROM n LEFT JOIN latest_status s ON s.station_id = n.bike_id""",
)
def nearest_availability(t):
    found = coverage.nearest_availability(t.transit_stations, t.station_info, t.station_status)
    return found.select(
        "station_id", "station_name", "near_id", "near_name",
        F.round("distance", 3).alias("distance_m"),
        F.coalesce("num_bikes_available", F.lit(0)).alias("bikes"),
        F.coalesce("num_docks_available", F.lit(0)).alias("docks"),
        F.coalesce("renting_ok", F.lit(False)).alias("renting_ok"),
        F.coalesce("returning_ok", F.lit(False)).alias("returning_ok"),
        "status_snapshot_ts",
    )


@query(
    "latest_station_status",
    "W-1 P-28",
    """
SELECT station_id, num_bikes_available, num_docks_available, coalesce(is_renting = 1, false) AS renting_ok,
  coalesce(lower(is_returning) = 'true', false) AS returning_ok, snapshot_ts FROM latest_status""",
)
def latest_station_status(t):
    return coverage.latest_status(t.station_status).select(
        "station_id", "num_bikes_available", "num_docks_available",
        text.is_truthy(F.col("is_renting")).alias("renting_ok"),
        text.is_truthy(F.col("is_returning")).alias("returning_ok"),
        "snapshot_ts",
    )


@query(
    "coverage_summary",
    "A-18",
    """
WITH c AS (SELECT meets_last_mile, nearest_distance_m AS m FROM covered)
SELECT count(*) AS total_stations, count(*) FILTER (WHERE meets_last_mile) AS stations_meeting, count(*) FILTER (WHERE NOT meets_last_mile) AS stations_failing,
  round(count(*) FILTER (WHERE meets_last_mile) * 100.0 / count(*), 6) AS percent_meeting, round(quantile_cont(m, 0.5), 6) AS median_distance_m,
  round(avg(m), 6) AS mean_distance_m, round(quantile_cont(m, 0.9), 6) AS p90_distance_m FROM c""",
)
def coverage_summary(t):
    return rounded(
        coverage.distance_summary(cut_lineage(covered(t))),
        ["percent_meeting", "median_distance_m", "mean_distance_m", "p90_distance_m"], 6,
    )


@query(
    "nearest_ten_stations",
    "K-3",
    "SELECT station_id, station_name, round(nearest_distance_m, 3) AS nearest_distance_m FROM covered ORDER BY covered.nearest_distance_m ASC NULLS LAST, station_id LIMIT 10",
)
def nearest_ten_stations(t):
    return rounded(coverage.nearest_k(covered(t)).select("station_id", "station_name", "nearest_distance_m"))


@query(
    "farthest_ten_stations",
    "K-3",
    "SELECT station_id, station_name, round(nearest_distance_m, 3) AS nearest_distance_m FROM covered ORDER BY covered.nearest_distance_m DESC NULLS LAST, station_id LIMIT 10",
)
def farthest_ten_stations(t):
    return rounded(coverage.farthest_k(covered(t)).select("station_id", "station_name", "nearest_distance_m"))


@query(
    "stations_meeting_rule",
    "U-3",
    "SELECT station_id, station_name, nearby_count, round(nearest_distance_m, 1) AS nearest_distance_m FROM covered WHERE meets_last_mile",
)
def stations_meeting_rule(t):
    meets, _ = coverage.split_by_rule(covered(t))
    return rounded(meets.select("station_id", "station_name", "nearby_count", "nearest_distance_m"), digits=1)


_CATEGORY = """CASE WHEN regexp_matches(lower(station_name), 'center|city hall|downtown|square|sq') THEN 'outer_city_center'
  WHEN regexp_matches(lower(station_name), 'beach|harbor|greenbush|newburyport|gloucester') THEN 'seasonal_or_tourism'
  WHEN regexp_matches(lower(station_name), 'route|parking lot|495|park|terminal|end') THEN 'far_end_or_park_and_ride' ELSE 'other' END"""


@query(
    "failing_station_categories",
    "P-23 U-3",
    f"SELECT {_CATEGORY} AS category, count(*) AS stations FROM covered WHERE NOT meets_last_mile GROUP BY 1",
)
def failing_station_categories(t):
    _, fails = coverage.split_by_rule(covered(t))
    return coverage.category_counts(fails)


@query(
    "station_categories",
    "P-23",
    f"SELECT station_id, station_name, {_CATEGORY} AS category FROM transit_stations",
)
def station_categories(t):
    category = text.station_category(F.col("station_name")).alias("category")
    return t.transit_stations.select("station_id", "station_name", category)


@query(
    "failing_station_centroid",
    "A-31",
    "SELECT round(coalesce(avg(lat), 42.3601), 6) AS lat, round(coalesce(avg(lng), -71.0589), 6) AS lng FROM covered WHERE NOT meets_last_mile",
)
def failing_station_centroid(t):
    _, fails = coverage.split_by_rule(covered(t))
    return rounded(coverage.centroid(fails), ["lat", "lng"], 6)


@query(
    "coverage_heat_grid",
    "A-32",
    """
SELECT CAST(floor(lat / 0.05) AS BIGINT) AS lat_cell, CAST(floor(lng / 0.05) AS BIGINT) AS lng_cell, count(*) AS stations,
  count(*) FILTER (WHERE meets_last_mile) AS stations_meeting, round(min(nearest_distance_m), 3) AS nearest_distance_m
FROM covered GROUP BY 1, 2""",
)
def coverage_heat_grid(t):
    return rounded(coverage.heat_grid(covered(t)))


@query(
    "coverage_histogram",
    "A-26",
    """
SELECT CAST(least(floor(nearest_distance_m / 200.0), 8) AS BIGINT) AS bucket, count(*) AS stations, round(min(nearest_distance_m), 3) AS least_m,
  round(least(floor(nearest_distance_m / 200.0), 8) * 200.0, 1) AS from_m
FROM covered WHERE nearest_distance_m IS NOT NULL GROUP BY bucket, from_m""",
)
def coverage_histogram(t):
    return rounded(coverage.distance_histogram(covered(t), 200.0, 8), ["least_m"])


@query(
    "coverage_by_line",
    "A-25",
    """
SELECT line, count(*) AS stations, count(*) FILTER (WHERE meets_last_mile) AS well_served,
  round(count(*) FILTER (WHERE meets_last_mile) * 100.0 / count(*), 1) AS coverage_pct
FROM covered c JOIN station_lines l ON l.station_id = c.station_id GROUP BY line""",
)
def coverage_by_line(t):
    return coverage.coverage_by_line(covered(t), t.station_lines)


@query(
    "station_search",
    "P-21",
    "SELECT station_id, station_name FROM transit_stations WHERE contains(lower(station_name), lower('SQUARE')) ORDER BY station_name",
)
def station_search(t):
    return coverage.search_stations(t.transit_stations, "SQUARE")
