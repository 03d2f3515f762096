"""Declared schemas of the landed feeds and of the tables made from them."""

from __future__ import annotations

CORRUPT = "_corrupt"

_LINK = "struct<data: struct<id: string>>"
_LINKS = f"struct<trip: {_LINK}, stop: {_LINK}, route: {_LINK}>"

PREDICTION_PAGE = f"""
data array<struct<
  id: string,
  attributes: struct<arrival_time: string, departure_time: string, updated_at: string,
                     direction_id: bigint, status: string>,
  relationships: {_LINKS}>>,
links struct<next: string>
"""

VEHICLE_PAGE = f"""
data array<struct<
  id: string,
  attributes: struct<latitude: double, longitude: double, bearing: double, speed: double,
                     label: string, direction_id: bigint, current_status: string,
                     occupancy_status: string, occupancy_percentage: bigint, updated_at: string>,
  relationships: {_LINKS}>>,
links struct<next: string>
"""

STATUS_PAGE = """
last_updated bigint,
data struct<stations: array<struct<
  station_id: string, num_bikes_available: bigint, num_docks_available: bigint,
  is_installed: string, is_renting: string, is_returning: string, last_reported: bigint>>>
"""

INFO_PAGE = """
last_updated bigint,
data struct<stations: array<struct<
  station_id: string, legacy_id: string, name: string, lat: double, lon: double,
  capacity: bigint, station_type: string, region_id: string, rental_methods: array<string>>>>
"""

REGION_PAGE = "last_updated bigint, data struct<regions: array<struct<region_id: string, name: string>>>"

# Columns that must be present, in table order, with their types.
PREDICTIONS = """
event_id string, observed_at_utc timestamp_ntz, feed_timestamp_utc timestamp_ntz,
route_id string, direction_id bigint, trip_id string, stop_id string, parent_station string,
service_date date, sched_arrival_utc timestamp_ntz, sched_departure_utc timestamp_ntz,
pred_arrival_utc timestamp_ntz, pred_departure_utc timestamp_ntz, delay_sec bigint,
current_status string, headway_branch_sec bigint, headway_trunk_sec bigint
"""
PREDICTIONS_REQUIRED = ["event_id", "observed_at_utc", "route_id"]

VEHICLES = """
snapshot_id string, observed_at_utc timestamp_ntz, vehicle_timestamp_utc timestamp_ntz,
vehicle_id string, vehicle_label string, route_id string, direction_id bigint, trip_id string,
stop_id string, latitude double, longitude double, bearing double, speed_mps double,
current_status string, occupancy_status string, occupancy_percent bigint
"""
VEHICLES_REQUIRED = ["snapshot_id", "observed_at_utc", "vehicle_id"]

# Schedule files: the columns that are read, in the type they get.
SCHEDULE_FILES = {
    "stops": {"stop_id": "string", "stop_name": "string", "stop_lat": "double", "stop_lon": "double"},
    "trips": {
        "route_id": "string", "service_id": "string", "trip_id": "string", "direction_id": "bigint",
    },
    "stop_times": {
        "trip_id": "string", "stop_id": "string", "stop_sequence": "bigint",
        "arrival_time": "string",
    },
}
