"""Scheduled trips and yearly reviews."""

from pyspark.sql import functions as F

from curbline.functions import times
from curbline.operators import reviews, schedule
from curbline.plans.inputs import AS_OF
from curbline.plans.registry import query

TRIP_YEAR, RIDE_YEAR = 1998, 1997


def scheduled(t, **options):
    return schedule.scheduled_trips(t.trips, t.stop_times, t.stops, AS_OF, **options)


def scheduled_in_year(t, year=TRIP_YEAR, with_stations=False):
    """Trips that start in ``year``: only its service days are read."""
    return scheduled(t, first_day=f"{year}-01-01", end_day=f"{year + 1}-01-01", with_stations=with_stations)


@query(
    "first_last_stops",
    "W-3",
    """
SELECT trip_id, arg_min(stop_id, stop_sequence) FILTER (WHERE stop_id IS NOT NULL) AS first_stop_id, arg_min(arrival_time, stop_sequence) AS first_arrival_time,
  arg_max(stop_id, stop_sequence) FILTER (WHERE stop_id IS NOT NULL) AS last_stop_id, arg_max(arrival_time, stop_sequence) AS last_arrival_time
FROM stop_times GROUP BY trip_id""",
)
def first_last_stops(t):
    return schedule.first_and_last_stops(t.stop_times, ["trip_id"])


@query(
    "scheduled_trips",
    "J-15 P-31 W-3",
    "SELECT *, CAST('2024-01-31 00:00:00' AS TIMESTAMP) AS collected_at FROM scheduled",
)
def scheduled_trips(t):
    return scheduled(t)


@query(
    "scheduled_trips_in_range",
    "P-31",
    """
SELECT trip_id, route_id, scheduled_start_time, scheduled_end_time FROM scheduled
WHERE scheduled_start_time >= TIMESTAMP '1997-01-01 00:00:00' AND scheduled_start_time < TIMESTAMP '1997-10-01 00:00:00'""",
)
def scheduled_trips_in_range(t):
    rows = scheduled(t, first_day="1997-01-01", end_day="1997-10-01", with_stations=False)
    return rows.select("trip_id", "route_id", "scheduled_start_time", "scheduled_end_time")


@query(
    "route_centres",
    "P-29",
    """
SELECT lower(route_id) AS route_key, round(coalesce(avg((start_lat + end_lat) / 2), 42.3), 6) AS lat, round(coalesce(avg((start_lng + end_lng) / 2), -71.1), 6) AS lng
FROM scheduled GROUP BY 1""",
)
def route_centres(t):
    centres = schedule.route_centres(scheduled(t))
    return centres.select("route_key", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@query(
    "scheduled_total_in_year",
    "A-12 P-6",
    f"SELECT count(*) AS total_trips FROM scheduled WHERE year(scheduled_start_time) = {TRIP_YEAR}",
)
def scheduled_total_in_year(t):
    return reviews.total(scheduled_in_year(t), "scheduled_start_time", TRIP_YEAR, "total_trips")


_TOP = """
SELECT {0}, count(*) AS trips FROM {1} WHERE year({2}) = {3} GROUP BY {0} ORDER BY trips DESC, {0} ASC NULLS LAST LIMIT 10"""


@query("top_routes", "A-12 K-2", _TOP.format("route_id", "scheduled", "scheduled_start_time", TRIP_YEAR))
def top_routes(t):
    return reviews.top_values(scheduled_in_year(t), "route_id", "scheduled_start_time", TRIP_YEAR)


@query(
    "top_transit_start_stations", "A-12",
    _TOP.format("start_station_name", "scheduled", "scheduled_start_time", TRIP_YEAR),
)
def top_transit_start_stations(t):
    return reviews.top_values(scheduled_in_year(t, with_stations=True), "start_station_name", "scheduled_start_time", TRIP_YEAR)


_LOCAL = "({0} AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York')"


@query(
    "scheduled_trips_by_month",
    "A-13 K-7 P-10",
    f"""
SELECT month({_LOCAL.format("scheduled_start_time")}) AS month_number, monthname({_LOCAL.format("scheduled_start_time")}) AS month, count(*) AS trips
FROM scheduled WHERE year(scheduled_start_time) = {TRIP_YEAR} GROUP BY 1, 2""",
)
def scheduled_trips_by_month(t):
    return reviews.by_month(scheduled_in_year(t), "scheduled_start_time", TRIP_YEAR)


_SEASON = """CASE WHEN month({0}) IN (12, 1, 2) THEN 'Winter' WHEN month({0}) IN (3, 4, 5) THEN 'Spring'
  WHEN month({0}) IN (6, 7, 8) THEN 'Summer' ELSE 'Fall' END"""


@query(
    "scheduled_trips_by_season",
    "A-14 P-11",
    f"""
SELECT {_SEASON.format("scheduled_start_time")} AS season, CASE WHEN route_id < '3' THEN 'subway' ELSE 'bus' END AS route_type, count(*) AS trips
FROM scheduled WHERE year(scheduled_start_time) = {TRIP_YEAR} GROUP BY 1, 2""",
)
def scheduled_trips_by_season(t):
    typed = scheduled_in_year(t).join(t.routes, "route_id", "left")
    return reviews.by_season(typed, "scheduled_start_time", TRIP_YEAR, ["route_type"])


@query(
    "rides_by_weekday",
    "A-15 K-7 P-10",
    f"""
SELECT dayofweek({_LOCAL.format("started_at")}) + 1 AS weekday_number, dayname({_LOCAL.format("started_at")}) AS weekday, member_casual, rideable_type, count(*) AS trips
FROM bike_trips WHERE year(started_at) = {RIDE_YEAR} GROUP BY ALL""",
)
def rides_by_weekday(t):
    return reviews.by_weekday(t.bike_trips, "started_at", RIDE_YEAR, ["member_casual", "rideable_type"])


@query(
    "rides_by_season",
    "A-14 P-11 K-7",
    f"""
SELECT {_SEASON.format("started_at")} AS season, rideable_type, count(*) AS trips FROM bike_trips WHERE year(started_at) = {RIDE_YEAR} GROUP BY 1, 2""",
)
def rides_by_season(t):
    return reviews.by_season(t.bike_trips, "started_at", RIDE_YEAR, ["rideable_type"])


@query("rides_total_in_year", "A-12 P-6", f"SELECT count(*) AS total_rides FROM bike_trips WHERE year(started_at) = {RIDE_YEAR}")
def rides_total_in_year(t):
    return reviews.total(t.bike_trips, "started_at", RIDE_YEAR, "total_rides")


@query("top_ride_starts", "A-16", _TOP.format("start_station_name", "bike_trips", "started_at", RIDE_YEAR))
def top_ride_starts(t):
    return reviews.top_values(t.bike_trips, "start_station_name", "started_at", RIDE_YEAR)


@query("top_ride_ends", "A-16", _TOP.format("end_station_name", "bike_trips", "ended_at", RIDE_YEAR))
def top_ride_ends(t):
    return reviews.top_values(t.bike_trips, "end_station_name", "ended_at", RIDE_YEAR)


@query(
    "vehicle_use_by_hour",
    "A-33",
    """
SELECT route_id, hour(observed_at_utc) AS hour, count(DISTINCT vehicle_id) AS vehicles, count(*) AS snapshots FROM vehicle_positions GROUP BY 1, 2""",
)
def vehicle_use_by_hour(t):
    return reviews.vehicle_use(t.vehicle_positions)


_LEVELS = """
SELECT route_id, direction_id, hour(observed_at_utc) AS hour, upper(trim(occupancy_status)) AS level, count(*) AS n
FROM vehicle_positions WHERE occupancy_status IS NOT NULL GROUP BY ALL"""


@query(
    "occupancy_shares",
    "A-34",
    f"""
SELECT route_id, direction_id, hour, level, n, CAST(sum(n) OVER w AS BIGINT) AS total, round(n / sum(n) OVER w, 6) AS share
FROM ({_LEVELS}) q WINDOW w AS (PARTITION BY route_id, direction_id, hour)""",
)
def occupancy_shares(t):
    return reviews.occupancy_shares(t.vehicle_positions).withColumn("share", F.round("share", 6))


@query(
    "less_crowded_routes",
    "K-8",
    f"""
SELECT hour, route_id, CAST(sum(CASE WHEN level = 'FULL' THEN n ELSE 0 END) AS BIGINT) AS crowded_n, CAST(sum(n) AS BIGINT) AS snapshots,
  round(sum(CASE WHEN level = 'FULL' THEN n ELSE 0 END) / sum(n), 6) AS crowded_share,
  row_number() OVER (PARTITION BY hour ORDER BY round(sum(CASE WHEN level = 'FULL' THEN n ELSE 0 END) / sum(n), 6), route_id) AS rank
FROM ({_LEVELS}) q GROUP BY hour, route_id QUALIFY rank <= 3""",
)
def less_crowded_routes(t):
    return reviews.less_crowded(reviews.occupancy_shares(t.vehicle_positions))


@query(
    "ride_minutes",
    "P-14",
    """
SELECT start_station_id, CAST(sum(date_sub('minute', started_at, ended_at)) AS BIGINT) AS minutes, count(*) AS rides FROM bike_trips GROUP BY 1""",
)
def ride_minutes(t):
    minutes = times.minutes_between(F.col("started_at"), F.col("ended_at"))
    return t.bike_trips.groupBy("start_station_id").agg(
        F.sum(minutes).alias("minutes"), F.count("*").alias("rides")
    )
