"""Transit and bike inputs derived by fixed formulas from the general test tables.

Each input exists twice: as a DataFrame here, and as DuckDB SQL in ``VIEWS`` so
that a query's reference SQL can name the same input.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-31 00:00:00"
PAGE_ROWS = 100
AGENCY = "Transit"


class Inputs:
    """Lazily built inputs of one table folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def transit_stations(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "CAST(s_suppkey AS STRING) AS station_id",
            """concat(s_name, CASE s_suppkey % 6 WHEN 0 THEN ' Square' WHEN 1 THEN ' Beach'
               WHEN 2 THEN ' Park' WHEN 3 THEN ' City Hall' WHEN 4 THEN ' Terminal' ELSE '' END)
               AS station_name""",
            "42.20D + CAST((s_suppkey * 7919) % 1000 AS DOUBLE) / 2500D AS lat",
            "-71.30D + CAST((s_suppkey * 104729) % 1000 AS DOUBLE) / 2500D AS lng",
        )

    @cached_property
    def station_lines(self) -> DataFrame:
        lines = "CASE s_nationkey % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Green' WHEN 3 THEN 'Blue' ELSE 'Rail' END"
        return self.table("supplier").selectExpr(
            "CAST(s_suppkey AS STRING) AS station_id", f"{lines} AS line"
        )

    @cached_property
    def station_info(self) -> DataFrame:
        """Two snapshots, a day apart, of every bike station."""
        return self.table("customer").selectExpr("*", "explode(array(0, 1)) AS v").selectExpr(
            "CAST(c_custkey AS STRING) AS station_id",
            "c_name AS name",
            "42.00D + CAST((c_custkey * 6007) % 1000 AS DOUBLE) / 1250D + CAST(v AS DOUBLE) / 100000D AS lat",
            "-71.50D + CAST((c_custkey * 7027) % 1000 AS DOUBLE) / 1250D AS lon",
            "10 + c_custkey % 20 AS capacity",
            "c_mktsegment AS station_type",
            "c_nationkey % 5 AS region_id",
            "TIMESTAMP_NTZ '2024-01-01 00:00:00' + v * INTERVAL '1' DAY AS snapshot_ts",
        )

    @cached_property
    def bike_trips(self) -> DataFrame:
        start = "(l_orderkey * 37 + l_linenumber * 3571) % 86400"
        ids = self.table("lineitem").selectExpr(
            "*",
            "CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_partkey % 150 AS STRING) END AS start_station_id",
            "CAST((l_partkey * 7 + l_linenumber) % 150 AS STRING) AS end_station_id",
        )
        return ids.selectExpr(
            f"l_shipdate + ({start}) * INTERVAL '1' SECOND AS started_at",
            f"l_shipdate + ({start} + 60 + (l_partkey * 13) % 3600) * INTERVAL '1' SECOND AS ended_at",
            "start_station_id",
            "end_station_id",
            "concat('Dock ', start_station_id) AS start_station_name",
            "concat('Dock ', end_station_id) AS end_station_name",
            "42.00D + CAST(((l_partkey % 150) * 6007) % 1000 AS DOUBLE) / 1250D AS start_lat",
            "-71.50D + CAST(((l_partkey % 150) * 7027) % 1000 AS DOUBLE) / 1250D AS start_lng",
            "CASE WHEN l_returnflag = 'N' THEN 'member' ELSE 'casual' END AS member_casual",
            "CASE WHEN l_linestatus = 'O' THEN 'electric_bike' ELSE 'classic_bike' END AS rideable_type",
        )

    @cached_property
    def station_status(self) -> DataFrame:
        return self.table("events").selectExpr(
            "CAST(user_id % 150 AS STRING) AS station_id",
            "ts AS snapshot_ts",
            "CAST(floor(value) AS BIGINT) % 20 AS num_bikes_available",
            "20 - CAST(floor(value) AS BIGINT) % 20 AS num_docks_available",
            "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS is_renting",
            "CASE WHEN event_type = 'view' THEN 'true' ELSE 'False' END AS is_returning",
            "unix_seconds(CAST(ts AS TIMESTAMP)) AS last_reported",
            "event_id",
        )

    @cached_property
    def vehicle_positions(self) -> DataFrame:
        return self.table("events").selectExpr(
            "event_id",
            "ts AS observed_at_utc",
            "concat('y', CAST(user_id AS STRING)) AS vehicle_id",
            "CASE user_id % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Blue' WHEN 3 THEN '1' ELSE '47' END AS route_id",
            "event_id % 2 AS direction_id",
            "CASE event_type WHEN 'click' THEN 'STOPPED_AT' WHEN 'view' THEN 'INCOMING_AT' ELSE 'IN_TRANSIT_TO' END AS current_status",
            """CASE WHEN event_type = 'error' THEN NULL WHEN value < 20 THEN ' many_seats_available'
               WHEN value < 60 THEN 'FEW_SEATS_AVAILABLE' ELSE 'FULL' END AS occupancy_status""",
            "42.20D + CAST((event_id * 7919) % 1000 AS DOUBLE) / 1250D AS latitude",
            "-71.30D + CAST((event_id * 104729) % 1000 AS DOUBLE) / 1250D AS longitude",
        )

    @cached_property
    def stop_times(self) -> DataFrame:
        grouped = self.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
            F.min("l_suppkey").alias("s"), F.min("l_partkey").alias("p")
        )
        return grouped.selectExpr(
            "l_orderkey AS trip_id",
            "l_linenumber AS stop_sequence",
            "CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE CAST(s AS STRING) END AS stop_id",
            """concat(lpad(CAST(5 + l_orderkey % 18 + l_linenumber AS STRING), 2, '0'), ':',
               lpad(CAST(p % 60 AS STRING), 2, '0'), ':00') AS arrival_time""",
        )

    @cached_property
    def trips(self) -> DataFrame:
        return self.table("orders").selectExpr(
            "o_orderkey AS trip_id",
            "o_orderpriority AS route_id",
            "concat('svc', CAST(o_custkey % 7 AS STRING)) AS service_id",
            "o_orderkey % 2 AS direction_id",
            "CAST(o_orderdate AS DATE) AS service_date",
        )

    @cached_property
    def stops(self) -> DataFrame:
        return self.transit_stations.selectExpr(
            "station_id AS stop_id", "station_name AS stop_name", "lat AS stop_lat", "lng AS stop_lon"
        )

    @cached_property
    def routes(self) -> DataFrame:
        return self.trips.select("route_id").distinct().selectExpr(
            "route_id", "CASE WHEN route_id < '3' THEN 'subway' ELSE 'bus' END AS route_type"
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents").select("doc_id", "source", "text")

    @cached_property
    def prediction_items(self) -> DataFrame:
        """One prediction per event; one in thirteen has no stop, one in seven no departure."""
        return self.table("events").selectExpr(
            "event_id",
            "concat('t', CAST(user_id AS STRING)) AS trip_id",
            "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 100 AS STRING) END AS stop_id",
            "CASE user_id % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'Orange' ELSE 'Blue' END AS route_id",
            "event_id % 2 AS direction_id",
            "event_type AS status",
            "date_trunc('SECOND', ts) AS updated_at",
            "ts",
        )

    def prediction_pages(self, repeat_every: int | None = None) -> DataFrame:
        """Page texts of at most ``PAGE_ROWS`` predictions (twice that with repeats).

        With ``repeat_every`` each n-th prediction occurs twice in its page.
        """
        seconds = "yyyy-MM-dd'T'HH:mm:ss"
        link = "named_struct('data', CASE WHEN {0} IS NULL THEN NULL ELSE named_struct('id', {0}) END)"
        items = self.prediction_items
        if repeat_every is not None:
            copies = F.when(F.col("event_id") % repeat_every == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
            items = items.withColumn("_copy", F.explode(copies)).drop("_copy")
        item = items.selectExpr(
            "event_id",
            f"""named_struct(
              'id', concat('p', CAST(event_id AS STRING)),
              'attributes', named_struct(
                'arrival_time', concat(date_format(updated_at, "{seconds}"), '-05:00'),
                'departure_time', CASE WHEN event_id % 7 = 0 THEN NULL
                                  ELSE concat(date_format(updated_at + INTERVAL '60' SECOND, "{seconds}"), 'Z') END,
                'updated_at', concat(date_format(updated_at, "{seconds}"), 'Z'),
                'direction_id', direction_id, 'status', status),
              'relationships', named_struct(
                'trip', {link.format("trip_id")}, 'stop', {link.format("stop_id")},
                'route', {link.format("route_id")})) AS item""",
        )
        return self._pages(item, "'links', named_struct('next', CAST(NULL AS STRING))")

    @property
    def vehicle_pages(self) -> DataFrame:
        item = self.vehicle_positions.selectExpr(
            "event_id",
            """named_struct(
              'id', vehicle_id,
              'attributes', named_struct(
                'latitude', latitude, 'longitude', longitude, 'bearing', 90.0D, 'speed', CAST(NULL AS DOUBLE),
                'label', concat('v-', vehicle_id), 'direction_id', direction_id,
                'current_status', current_status, 'occupancy_status', occupancy_status,
                'occupancy_percentage', event_id % 101,
                'updated_at', concat(date_format(observed_at_utc, "yyyy-MM-dd'T'HH:mm:ss"), 'Z')),
              'relationships', named_struct(
                'trip', named_struct('data', named_struct('id', concat('t', CAST(event_id AS STRING)))),
                'stop', CAST(NULL AS STRUCT<data: STRUCT<id: STRING>>),
                'route', named_struct('data', named_struct('id', route_id)))) AS item""",
        )
        return self._pages(item, "'links', named_struct('next', CAST(NULL AS STRING))")

    @property
    def status_pages(self) -> DataFrame:
        """Bike feed pages; the page time is that of its newest snapshot, missing on each ninth page."""
        grouped = (
            self.station_status.withColumn("page", F.expr(f"event_id div {PAGE_ROWS}"))
            .groupBy("page")
            .agg(
                F.max("last_reported").alias("updated"),
                F.expr(
                    """collect_list(named_struct('station_id', station_id,
                       'num_bikes_available', num_bikes_available, 'num_docks_available', num_docks_available,
                       'is_installed', '1', 'is_renting', CAST(is_renting AS STRING),
                       'is_returning', is_returning, 'last_reported', last_reported))"""
                ).alias("stations"),
            )
        )
        return grouped.selectExpr(
            "page",
            """to_json(named_struct('last_updated', CASE WHEN page % 9 = 0 THEN NULL ELSE updated END,
               'data', named_struct('stations', stations))) AS body""",
        )

    @staticmethod
    def _pages(items: DataFrame, tail: str) -> DataFrame:
        return (
            items.groupBy(F.expr(f"event_id div {PAGE_ROWS}").alias("page"))
            .agg(F.collect_list("item").alias("data"))
            .selectExpr("page", f"to_json(named_struct('data', data, {tail})) AS body")
        )

    @cached_property
    def places(self) -> DataFrame:
        """Place names as riders type them, three forms per transit station."""
        return self.transit_stations.selectExpr(
            "explode(array(concat(lower(station_name), ' station'), concat(' ', replace(station_name, ' ', ', ')), "
            "concat(substring(station_name, 10, 9), ' St.'))) AS place"
        ).distinct()

    @cached_property
    def availability_requests(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS request_id",
            "CASE WHEN c_custkey % 10 = 9 THEN 'nowhere' ELSE upper(c_name) END AS station_name",
            "CAST(1 + c_custkey % 7 AS INT) AS day_of_week",
            "CAST(c_custkey % 20 AS INT) AS start_hour",
            "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 20 + c_custkey % 4 AS INT) END AS end_hour",
        )

    @cached_property
    def replies(self) -> DataFrame:
        """Model replies made from the JSON column: bare, fenced, inside prose, and broken."""
        return self.table("events").selectExpr(
            "event_id",
            """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('```json\n', props, '\n```')
               WHEN 2 THEN concat('Sure: ', props, ' hope it helps') ELSE substring(props, 1, 3) END AS reply""",
        )


# DuckDB forms of the inputs, and of intermediate tables that reference SQL builds on.
VIEWS: dict[str, str] = {
    "transit_stations": """
SELECT CAST(s_suppkey AS VARCHAR) AS station_id,
  concat(s_name, CASE s_suppkey % 6 WHEN 0 THEN ' Square' WHEN 1 THEN ' Beach' WHEN 2 THEN ' Park' WHEN 3 THEN ' City Hall' WHEN 4 THEN ' Terminal' ELSE '' END) AS station_name,
  42.20e0 + CAST((s_suppkey * 7919) % 1000 AS DOUBLE) / 2500e0 AS lat,
  -71.30e0 + CAST((s_suppkey * 104729) % 1000 AS DOUBLE) / 2500e0 AS lng
FROM supplier""",
    "station_lines": """
SELECT CAST(s_suppkey AS VARCHAR) AS station_id,
  CASE s_nationkey % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Green' WHEN 3 THEN 'Blue' ELSE 'Rail' END AS line
FROM supplier""",
    "station_info": """
SELECT CAST(c_custkey AS VARCHAR) AS station_id, c_name AS name,
  42.00e0 + CAST((c_custkey * 6007) % 1000 AS DOUBLE) / 1250e0 + CAST(v AS DOUBLE) / 100000e0 AS lat,
  -71.50e0 + CAST((c_custkey * 7027) % 1000 AS DOUBLE) / 1250e0 AS lon,
  10 + c_custkey % 20 AS capacity, c_mktsegment AS station_type, c_nationkey % 5 AS region_id,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) + v * INTERVAL '1' DAY AS snapshot_ts
FROM customer CROSS JOIN (SELECT 0 AS v UNION ALL SELECT 1) vv""",
    "bike_trips": """
SELECT l_shipdate + ((l_orderkey * 37 + l_linenumber * 3571) % 86400) * INTERVAL '1' SECOND AS started_at,
  l_shipdate + ((l_orderkey * 37 + l_linenumber * 3571) % 86400 + 60 + (l_partkey * 13) % 3600) * INTERVAL '1' SECOND AS ended_at,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE CAST(l_partkey % 150 AS VARCHAR) END AS start_station_id,
  CAST((l_partkey * 7 + l_linenumber) % 150 AS VARCHAR) AS end_station_id,
  CASE WHEN l_partkey % 97 = 0 THEN NULL ELSE 'Dock ' || CAST(l_partkey % 150 AS VARCHAR) END AS start_station_name,
  'Dock ' || CAST((l_partkey * 7 + l_linenumber) % 150 AS VARCHAR) AS end_station_name,
  42.00e0 + CAST(((l_partkey % 150) * 6007) % 1000 AS DOUBLE) / 1250e0 AS start_lat,
  -71.50e0 + CAST(((l_partkey % 150) * 7027) % 1000 AS DOUBLE) / 1250e0 AS start_lng,
  CASE WHEN l_returnflag = 'N' THEN 'member' ELSE 'casual' END AS member_casual,
  CASE WHEN l_linestatus = 'O' THEN 'electric_bike' ELSE 'classic_bike' END AS rideable_type
FROM lineitem""",
    "station_status": """
SELECT CAST(user_id % 150 AS VARCHAR) AS station_id, ts AS snapshot_ts,
  CAST(floor(value) AS BIGINT) % 20 AS num_bikes_available, 20 - CAST(floor(value) AS BIGINT) % 20 AS num_docks_available,
  CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS is_renting,
  CASE WHEN event_type = 'view' THEN 'true' ELSE 'False' END AS is_returning,
  CAST(floor(epoch(ts)) AS BIGINT) AS last_reported, event_id
FROM events""",
    "vehicle_positions": """
SELECT event_id, ts AS observed_at_utc, concat('y', CAST(user_id AS VARCHAR)) AS vehicle_id,
  CASE user_id % 5 WHEN 0 THEN 'Red' WHEN 1 THEN 'Orange' WHEN 2 THEN 'Blue' WHEN 3 THEN '1' ELSE '47' END AS route_id,
  event_id % 2 AS direction_id,
  CASE event_type WHEN 'click' THEN 'STOPPED_AT' WHEN 'view' THEN 'INCOMING_AT' ELSE 'IN_TRANSIT_TO' END AS current_status,
  CASE WHEN event_type = 'error' THEN NULL WHEN value < 20 THEN ' many_seats_available' WHEN value < 60 THEN 'FEW_SEATS_AVAILABLE' ELSE 'FULL' END AS occupancy_status,
  42.20e0 + CAST((event_id * 7919) % 1000 AS DOUBLE) / 1250e0 AS latitude,
  -71.30e0 + CAST((event_id * 104729) % 1000 AS DOUBLE) / 1250e0 AS longitude
FROM events""",
    "stop_times": """
SELECT l_orderkey AS trip_id, l_linenumber AS stop_sequence,
  CASE WHEN (l_orderkey + l_linenumber) % 11 = 0 THEN NULL ELSE CAST(min(l_suppkey) AS VARCHAR) END AS stop_id,
  concat(lpad(CAST(5 + l_orderkey % 18 + l_linenumber AS VARCHAR), 2, '0'), ':', lpad(CAST(min(l_partkey) % 60 AS VARCHAR), 2, '0'), ':00') AS arrival_time
FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "trips": """
SELECT o_orderkey AS trip_id, o_orderpriority AS route_id, concat('svc', CAST(o_custkey % 7 AS VARCHAR)) AS service_id,
  o_orderkey % 2 AS direction_id, CAST(o_orderdate AS DATE) AS service_date FROM orders""",
    "prediction_items": """
SELECT event_id, 't' || CAST(user_id AS VARCHAR) AS trip_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(event_id % 100 AS VARCHAR) END AS stop_id,
  CASE user_id % 3 WHEN 0 THEN 'Red' WHEN 1 THEN 'Orange' ELSE 'Blue' END AS route_id,
  event_id % 2 AS direction_id, event_type AS status, date_trunc('second', ts) AS updated_at, ts
FROM events""",
    "flat_predictions": """
SELECT sha1(concat_ws('|', coalesce(trip_id, ''), coalesce(stop_id, ''),
    strftime(updated_at + INTERVAL '5' HOUR, '%Y-%m-%d %H:%M:%S'),
    CASE WHEN event_id % 7 = 0 THEN '' ELSE strftime(updated_at + INTERVAL '60' SECOND, '%Y-%m-%d %H:%M:%S') END,
    strftime(updated_at, '%Y-%m-%d %H:%M:%S'))) AS event_id,
  CAST('2024-01-31 02:30:00' AS TIMESTAMP) AS observed_at_utc, updated_at AS feed_timestamp_utc,
  route_id, direction_id, trip_id, stop_id, '2024-01-30' AS service_date,
  updated_at + INTERVAL '5' HOUR AS pred_arrival_utc,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE updated_at + INTERVAL '60' SECOND END AS pred_departure_utc,
  status AS current_status, event_id AS source_event
FROM prediction_items""",
    "flat_vehicles": """
SELECT sha1(concat_ws('|', vehicle_id, printf('%.6f', latitude), printf('%.6f', longitude),
    strftime(observed_at_utc, '%Y-%m-%d %H:%M:%S'))) AS snapshot_id,
  CAST('2024-01-31 02:30:00' AS TIMESTAMP) AS observed_at_utc, date_trunc('second', observed_at_utc) AS vehicle_timestamp_utc,
  vehicle_id, 'v-' || vehicle_id AS vehicle_label, route_id, direction_id, 't' || CAST(event_id AS VARCHAR) AS trip_id,
  latitude, longitude, 90.0e0 AS bearing, current_status, occupancy_status, event_id % 101 AS occupancy_percent
FROM vehicle_positions""",
    "latest_info": """
SELECT * FROM station_info QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY snapshot_ts DESC) = 1""",
    "latest_status": """
SELECT * FROM station_status
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY snapshot_ts DESC, event_id DESC) = 1""",
    "golden_pickups": """
SELECT h.station_id, i.name AS station_name, h.ts_hour, dayofweek(h.ts_hour) + 1 AS day_of_week, hour(h.ts_hour) AS hour,
  CASE WHEN dayofweek(h.ts_hour) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, h.pickups
FROM (SELECT start_station_id AS station_id, date_trunc('hour', started_at) AS ts_hour, count(*) AS pickups
      FROM bike_trips WHERE start_station_id IS NOT NULL GROUP BY ALL) h
LEFT JOIN latest_info i ON h.station_id = i.station_id""",
    "golden_dropoffs": """
SELECT h.station_id, i.name AS station_name, h.ts_hour, dayofweek(h.ts_hour) + 1 AS day_of_week, hour(h.ts_hour) AS hour,
  CASE WHEN dayofweek(h.ts_hour) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend, h.dropoffs
FROM (SELECT end_station_id AS station_id, date_trunc('hour', ended_at) AS ts_hour, count(*) AS dropoffs
      FROM bike_trips WHERE end_station_id IS NOT NULL GROUP BY ALL) h
LEFT JOIN latest_info i ON h.station_id = i.station_id""",
    "demand": """
SELECT coalesce(p.station_id, d.station_id) AS station_id, coalesce(p.station_name, d.station_name) AS station_name,
  coalesce(p.ts_hour, d.ts_hour) AS ts_hour, coalesce(p.day_of_week, d.day_of_week) AS day_of_week,
  coalesce(p.hour, d.hour) AS hour, coalesce(p.is_weekend, d.is_weekend) AS is_weekend,
  coalesce(p.pickups, 0) AS pickups, coalesce(d.dropoffs, 0) AS dropoffs
FROM golden_pickups p FULL JOIN golden_dropoffs d ON p.station_id = d.station_id AND p.ts_hour = d.ts_hour""",
    "bike_pairs": """
SELECT m.station_id, m.station_name, m.lat, m.lng, b.station_id AS bike_id, b.name AS bike_name, b.lat AS bike_lat, b.lon AS bike_lon,
  2 * 6371010.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians(b.lat - m.lat) / 2), 2)
    + cos(radians(m.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - m.lng) / 2), 2)))) AS distance_m
FROM transit_stations m CROSS JOIN latest_info b""",
    "covered": """
SELECT m.station_id, min(m.station_name) AS station_name, min(m.lat) AS lat, min(m.lng) AS lng,
  count(DISTINCT p.bike_id) AS nearby_count, min(p.distance_m) AS nearest_distance_m, count(DISTINCT p.bike_id) >= 1 AS meets_last_mile
FROM transit_stations m LEFT JOIN bike_pairs p ON p.station_id = m.station_id AND p.distance_m <= 1609.34
GROUP BY m.station_id""",
    "status_ratio": """
SELECT station_id, avg(CASE WHEN coalesce(num_bikes_available, 0) > 0 THEN 1.0e0 ELSE 0.0e0 END) AS active_ratio
FROM station_status WHERE snapshot_ts >= CAST('2024-01-31 00:00:00' AS TIMESTAMP) - INTERVAL '14' DAY GROUP BY station_id""",
    "scheduled": """
WITH ends AS (SELECT trip_id,
    arg_min(stop_id, stop_sequence) FILTER (WHERE stop_id IS NOT NULL) AS s0, arg_max(stop_id, stop_sequence) FILTER (WHERE stop_id IS NOT NULL) AS s1,
    arg_min(arrival_time, stop_sequence) AS t0, arg_max(arrival_time, stop_sequence) AS t1 FROM stop_times GROUP BY trip_id)
SELECT t.trip_id, t.route_id, t.service_id, a.station_name AS start_station_name, e.s0 AS start_station_id,
  b.station_name AS end_station_name, e.s1 AS end_station_id, a.lat AS start_lat, a.lng AS start_lng, b.lat AS end_lat, b.lng AS end_lng,
  CAST(t.service_date AS TIMESTAMP) + (CAST(split_part(e.t0, ':', 1) AS INT) * 60 + CAST(split_part(e.t0, ':', 2) AS INT)) * INTERVAL '1' MINUTE AS scheduled_start_time,
  CAST(t.service_date AS TIMESTAMP) + (CAST(split_part(e.t1, ':', 1) AS INT) * 60 + CAST(split_part(e.t1, ':', 2) AS INT)) * INTERVAL '1' MINUTE AS scheduled_end_time,
  t.direction_id
FROM trips t LEFT JOIN ends e ON t.trip_id = e.trip_id
LEFT JOIN transit_stations a ON a.station_id = e.s0 LEFT JOIN transit_stations b ON b.station_id = e.s1
WHERE t.trip_id IS NOT NULL AND t.route_id IS NOT NULL""",
    "features": """
WITH near AS (SELECT station_id, min(distance_m) AS distance_to_nearest_m, count(CASE WHEN distance_m <= 500 THEN 1 END) AS bikes_within_near
              FROM bike_pairs GROUP BY station_id),
timed AS (SELECT *, hour(to_timestamp(last_reported) AT TIME ZONE 'America/New_York') AS h FROM station_status),
rush AS (SELECT p.station_id,
    count(DISTINCT CASE WHEN h BETWEEN 7 AND 9 THEN s.station_id END) AS nearby_morning,
    avg(CASE WHEN h BETWEEN 7 AND 9 THEN num_bikes_available END) AS avg_bikes_morning,
    avg(CASE WHEN h BETWEEN 7 AND 9 THEN num_docks_available END) AS avg_docks_morning,
    min(CASE WHEN h BETWEEN 7 AND 9 THEN num_bikes_available END) AS least_bikes_morning,
    count(DISTINCT CASE WHEN h BETWEEN 17 AND 19 THEN s.station_id END) AS nearby_evening,
    avg(CASE WHEN h BETWEEN 17 AND 19 THEN num_bikes_available END) AS avg_bikes_evening,
    avg(CASE WHEN h BETWEEN 17 AND 19 THEN num_docks_available END) AS avg_docks_evening,
    min(CASE WHEN h BETWEEN 17 AND 19 THEN num_bikes_available END) AS least_bikes_evening
  FROM bike_pairs p JOIN timed s ON s.station_id = p.bike_id WHERE p.distance_m <= 800 GROUP BY p.station_id),
starts AS (SELECT start_lat, start_lng, count(*) AS n, count(CASE WHEN member_casual = 'member' THEN 1 END) AS members,
    sum(date_sub('minute', started_at, ended_at)) AS minutes FROM bike_trips GROUP BY ALL),
vol AS (SELECT m.station_id, sum(n) AS bike_trip_volume, sum(members) AS commuter_trip_volume, sum(minutes) / sum(n) AS avg_trip_duration_min
  FROM transit_stations m JOIN starts s ON 2 * 6371010.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians(s.start_lat - m.lat) / 2), 2)
    + cos(radians(m.lat)) * cos(radians(s.start_lat)) * pow(sin(radians(s.start_lng - m.lng) / 2), 2)))) <= 800 GROUP BY m.station_id),
ride AS (SELECT start_station_id AS station_id, count(*) AS transit_ridership, count(DISTINCT route_id) AS route_diversity
  FROM scheduled WHERE start_station_id IS NOT NULL GROUP BY 1)
SELECT m.station_id, m.station_name, m.lat, m.lng,
  coalesce(near.distance_to_nearest_m, 9999) AS distance_to_nearest_m, coalesce(bikes_within_near, 0) AS bikes_within_near,
  coalesce(nearby_morning, 0) AS nearby_morning, coalesce(avg_bikes_morning, 0) AS avg_bikes_morning, coalesce(avg_docks_morning, 0) AS avg_docks_morning,
  coalesce(nearby_evening, 0) AS nearby_evening, coalesce(avg_bikes_evening, 0) AS avg_bikes_evening, coalesce(avg_docks_evening, 0) AS avg_docks_evening,
  CAST(coalesce(bike_trip_volume, 0) AS BIGINT) AS bike_trip_volume, CAST(coalesce(commuter_trip_volume, 0) AS BIGINT) AS commuter_trip_volume,
  coalesce(avg_trip_duration_min, 0) AS avg_trip_duration_min,
  coalesce(transit_ridership, 0) AS transit_ridership, coalesce(route_diversity, 0) AS route_diversity,
  CASE WHEN coalesce(near.distance_to_nearest_m, 9999) > 800 THEN 1 ELSE 0 END AS is_isolated,
  CASE WHEN coalesce(avg_bikes_morning, 0) < 2 THEN 1 ELSE 0 END AS has_low_morning_availability, 'train' AS split
FROM transit_stations m LEFT JOIN near ON near.station_id = m.station_id LEFT JOIN rush ON rush.station_id = m.station_id
LEFT JOIN vol ON vol.station_id = m.station_id LEFT JOIN ride ON ride.station_id = m.station_id""",
    "clustered": """
SELECT *, CAST(station_id AS BIGINT) % 3 AS cluster,
  CASE WHEN distance_to_nearest_m > 800 OR avg_bikes_morning < 2 THEN 'Transit Desert'
       WHEN distance_to_nearest_m < 400 AND avg_bikes_morning > 5 THEN 'Well-Served' ELSE 'Moderate Coverage' END AS station_label
FROM features""",
    "cluster_stats": """
SELECT cluster, avg(distance_to_nearest_m) AS d, avg(avg_bikes_morning) AS b FROM clustered GROUP BY cluster""",
    "ranked": """
SELECT c.*, CASE r.rk WHEN 1 THEN 'Transit Desert' WHEN 2 THEN 'Moderate Coverage' WHEN 3 THEN 'Well-Served' END AS rank_label
FROM clustered c JOIN (SELECT cluster, row_number() OVER (ORDER BY d DESC, cluster) AS rk FROM cluster_stats) r ON c.cluster = r.cluster""",
    "occupancy": """
SELECT upper(trim(occupancy_status)) AS label, route_id, current_status, hour(observed_at_utc) AS hour_of_day,
  dayofweek(observed_at_utc) + 1 AS day_of_week, CASE WHEN dayofweek(observed_at_utc) IN (0, 6) THEN 1 ELSE 0 END AS is_weekend,
  round(latitude, 3) AS lat_bin, round(longitude, 3) AS lon_bin, observed_at_utc AS ts
FROM vehicle_positions WHERE occupancy_status IS NOT NULL AND latitude BETWEEN 41.5 AND 42.9 AND longitude BETWEEN -71.9 AND -70.5""",
    "dow_hour": """
WITH daily AS (SELECT start_station_id, CAST(started_at AS DATE) AS day, hour(started_at) AS hour, count(*) AS n
  FROM bike_trips WHERE start_station_id IS NOT NULL GROUP BY ALL),
weekdays AS (SELECT dayofweek(day) + 1 AS dow, count(*) AS days FROM (SELECT DISTINCT day FROM daily) q GROUP BY 1)
SELECT start_station_id, w.dow, hour, CAST(sum(n) AS BIGINT) AS trips_count, sum(n) / any_value(w.days) AS avg_trips_per_day_hour
FROM daily d JOIN weekdays w ON w.dow = dayofweek(d.day) + 1 GROUP BY start_station_id, w.dow, hour""",
    "sentence_list": r"""
SELECT doc_id, source, list_filter(list_transform(regexp_split_to_array(
    regexp_replace(text, '([.?!])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g'), chr(1) || '|\n+'),
    lambda s: regexp_replace(s, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')), lambda s: length(s) > 0) AS s
FROM documents""",
    "label_centroids": """
SELECT label AS query_id, list(x ORDER BY pos) AS embedding FROM (
  SELECT label, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(pos) GROUP BY label, pos) q GROUP BY label""",
    "vector_scores": """
SELECT q.query_id, v.vec_id, v.label, round(list_sum(list_transform(list_zip(v.u, q.u), lambda p: p[1] * p[2])), 6) AS score
FROM (SELECT query_id, list_transform(embedding, lambda x: x / (sqrt(list_sum(list_transform(embedding, lambda y: y * y))) + 1e-9)) AS u FROM label_centroids) q
CROSS JOIN (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) + 1e-9)) AS u FROM embeddings) v""",
    "vector_hits": """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM vector_scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
    "unit_rows": """
SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / (sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE)))) + 1e-9)) AS u FROM embeddings""",
    "row_hits": """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_sum(list_transform(list_zip(v.u, q.u), lambda p: p[1] * p[2])), 6) AS score
  FROM unit_rows q CROSS JOIN unit_rows v WHERE q.vec_id % 20 = 0) s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
}

_WORD = {name: re.compile(rf"\b{name}\b") for name in VIEWS}


def reference_sql(body: str) -> str:
    """``body`` behind a WITH clause that defines every view it names, directly or not."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name, pattern in _WORD.items():
            if name not in ordered and pattern.search(text) and text is not VIEWS[name]:
                visit(VIEWS[name])
                if name not in ordered:
                    ordered.append(name)

    body = body.strip()
    visit(body)
    if not ordered:
        return body
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in ordered)
    own = re.match(r"WITH( RECURSIVE)? ", body)
    if own is None:
        return f"WITH {views}\n{body}"
    return f"{own.group().strip()} {views},\n{body[own.end():]}"
