"""Demand tables and lists."""

from pyspark.sql import functions as F

from curbline.functions import times
from curbline.operators import demand, keyed
from curbline.operators.coverage import latest_info
from curbline.plans.registry import query


def pickup_hours(t):
    return demand.hourly_counts(t.bike_trips, "start_station_id", "started_at", "pickups")


def dropoff_hours(t):
    return demand.hourly_counts(t.bike_trips, "end_station_id", "ended_at", "dropoffs")


@query(
    "station_net_demand",
    "P-4 P-17 J-0 J-1 A-27 K-2 W-1",
    """
SELECT station_id, min(station_name) AS station_name, CAST(sum(pickups) AS BIGINT) AS pickups,
  CAST(sum(dropoffs) AS BIGINT) AS dropoffs, CAST(sum(pickups - dropoffs) AS BIGINT) AS net_demand
FROM demand GROUP BY station_id ORDER BY pickups DESC, station_id LIMIT 10""",
)
def station_net_demand(t):
    totals = demand.station_totals(t.bike_trips, t.station_info)
    return keyed.top_k(totals, 10, F.desc("pickups"), F.asc("station_id"))


@query("hourly_pickups", "A-1 J-0 J-1 P-8 P-9", "SELECT * FROM golden_pickups")
def hourly_pickups(t):
    return demand.hourly_pickups(t.bike_trips, t.station_info)


@query("hourly_dropoffs", "A-2 J-1", "SELECT * FROM golden_dropoffs")
def hourly_dropoffs(t):
    return demand.hourly_dropoffs(t.bike_trips, t.station_info)


@query("station_hour_demand", "M-1 A-27", "SELECT *, pickups - dropoffs AS net_demand FROM demand")
def station_hour_demand(t):
    features = demand.demand_features(t.bike_trips, t.station_info)
    return features.withColumn("net_demand", F.col("pickups") - F.col("dropoffs"))


@query("combined_golden_tables", "J-2 P-18", "SELECT * FROM demand")
def combined_golden_tables(t):
    return demand.combine_hours(pickup_hours(t), dropoff_hours(t), t.station_info)


_TOP = """
SELECT station_id, min(station_name) AS station_name, CAST(sum({0}) AS BIGINT) AS total_{0}
FROM golden_{0} GROUP BY station_id ORDER BY total_{0} DESC, station_id LIMIT {1}"""


@query("top_pickup_stations", "A-17 A-9 K-2", _TOP.format("pickups", 30))
def top_pickup_stations(t):
    return demand.top_by_total(pickup_hours(t), t.station_info, "pickups", 30)


@query("top_dropoff_stations", "A-17 K-2", _TOP.format("dropoffs", 15))
def top_dropoff_stations(t):
    return demand.top_by_total(dropoff_hours(t), t.station_info, "dropoffs", 15)


@query(
    "stations_busy_both_ways",
    "J-14",
    f"""
SELECT p.station_id, p.station_name, total_pickups, total_dropoffs, total_pickups + total_dropoffs AS combined_score
FROM ({_TOP.format("pickups", 30)}) p JOIN ({_TOP.format("dropoffs", 30)}) d ON p.station_id = d.station_id
ORDER BY combined_score DESC, p.station_id LIMIT 20""",
)
def stations_busy_both_ways(t):
    return demand.busy_both_ways(pickup_hours(t), dropoff_hours(t), t.station_info)


@query(
    "rebalancing_priorities",
    "K-8 A-27",
    """
SELECT station_id, min(station_name) AS station_name, CAST(sum(pickups - dropoffs) AS BIGINT) AS net_demand
FROM demand GROUP BY station_id ORDER BY net_demand DESC, station_id LIMIT 20""",
)
def rebalancing_priorities(t):
    totals = demand.station_totals(t.bike_trips, t.station_info)
    return keyed.top_k(
        totals.select("station_id", "station_name", "net_demand"), 20, F.desc("net_demand"), F.asc("station_id")
    )


@query(
    "station_dow_hour_stats",
    "A-24",
    """
SELECT start_station_id, dow, hour, trips_count, round(avg_trips_per_day_hour, 6) AS avg_trips_per_day_hour FROM dow_hour""",
)
def station_dow_hour_stats(t):
    stats = demand.dow_hour_stats(t.bike_trips)
    return stats.withColumn("avg_trips_per_day_hour", F.round("avg_trips_per_day_hour", 6))


@query(
    "typical_station_use",
    "A-22 J-16",
    """
WITH requests AS (SELECT c_custkey AS request_id, CASE WHEN c_custkey % 10 = 9 THEN 'nowhere' ELSE upper(c_name) END AS station_name,
    1 + c_custkey % 7 AS day_of_week, c_custkey % 20 AS start_hour,
    CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 20 ELSE c_custkey % 20 + c_custkey % 4 END AS end_hour FROM customer),
lookup AS (SELECT lower(name) AS name_key, min(station_id) AS sid FROM latest_info GROUP BY 1),
answers AS (SELECT r.request_id, l.sid, avg(h.avg_trips_per_day_hour) AS a, avg(h.trips_count) AS c
  FROM requests r JOIN lookup l ON l.name_key = lower(r.station_name)
  JOIN dow_hour h ON h.start_station_id = l.sid AND h.dow = r.day_of_week AND h.hour BETWEEN r.start_hour AND r.end_hour GROUP BY ALL)
SELECT r.request_id, r.station_name, r.day_of_week, r.start_hour, r.end_hour, a.sid AS station_id,
  round(coalesce(a.a, 0), 6) AS avg_trips, round(coalesce(a.c, 0), 6) AS avg_trips_count, a.a IS NOT NULL AS has_data
FROM requests r LEFT JOIN answers a ON a.request_id = r.request_id""",
)
def typical_station_use(t):
    answers = demand.typical_use(
        t.availability_requests, demand.dow_hour_stats(t.bike_trips), demand.station_lookup(t.station_info)
    )
    return answers.withColumns(
        {c: F.round(c, 6) for c in ("avg_trips", "avg_trips_count")}
    )


@query(
    "latest_station_info",
    "J-0 W-1 U-2",
    "SELECT station_id, name, lat, lon, station_type, snapshot_ts FROM latest_info",
)
def latest_station_info(t):
    return latest_info(t.station_info).select(
        "station_id", "name", "lat", "lon", "station_type", "snapshot_ts"
    )


@query(
    "distinct_stations",
    "U-2",
    "SELECT DISTINCT station_id, lat, lon, station_type FROM station_info WHERE lat IS NOT NULL AND lon IS NOT NULL",
)
def distinct_stations(t):
    located = t.station_info.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return located.select("station_id", "lat", "lon", "station_type").distinct()


@query(
    "members_only_columns",
    "P-20 P-32",
    """
SELECT * EXCLUDE (started_at, ended_at) FROM bike_trips WHERE member_casual IN ('member') AND rideable_type IN ('classic_bike', 'electric_bike')""",
)
def members_only_columns(t):
    chosen = F.col("member_casual").isin("member") & F.col("rideable_type").isin(
        "classic_bike", "electric_bike"
    )
    return t.bike_trips.filter(chosen).drop("started_at", "ended_at")


@query(
    "pickup_share_by_bike_type",
    "P-30",
    """
SELECT rideable_type, count(*) AS rides, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share_pct
FROM bike_trips GROUP BY rideable_type""",
)
def pickup_share_by_bike_type(t):
    counts = t.bike_trips.groupBy("rideable_type").agg(F.count("*").alias("rides"))
    return keyed.with_share(counts, "rides")


@query(
    "recent_status_per_day",
    "P-7 J-18",
    """
SELECT station_id, count(*) AS snapshots FROM station_status
WHERE snapshot_ts >= (SELECT max(snapshot_ts) FROM station_status) - INTERVAL '7' DAY GROUP BY station_id""",
)
def recent_status_per_day(t):
    newest = t.station_status.agg(F.max("snapshot_ts")).scalar()
    recent = t.station_status.filter(times.since(F.col("snapshot_ts"), newest, 7))
    return recent.groupBy("station_id").agg(F.count("*").alias("snapshots"))
