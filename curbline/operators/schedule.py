"""Scheduled trips from stop sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import places, times


def first_and_last_stops(
    stop_times: DataFrame, trip: list[str], strict_row: bool = False
) -> DataFrame:
    """First and last stop and time of every trip, by stop sequence.

    Each value is the first (last) one that is not NULL, so a stop and its time
    may come from different rows; ``strict_row`` takes both from one row.
    """
    columns = ["stop_id", "arrival_time"]
    if strict_row:
        row = F.struct(*columns)
        ends = stop_times.groupBy(*trip).agg(
            F.min_by(row, "stop_sequence").alias("first"),
            F.max_by(row, "stop_sequence").alias("last"),
        )
        return ends.select(
            *trip,
            *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in columns],
        )

    def end(choose, column: str) -> Column:
        return choose(column, F.when(F.col(column).isNotNull(), F.col("stop_sequence")))

    return stop_times.groupBy(*trip).agg(
        *[end(F.min_by, c).alias(f"first_{c}") for c in columns],
        *[end(F.max_by, c).alias(f"last_{c}") for c in columns],
    )


def scheduled_trips(
    trips: DataFrame,
    stop_times: DataFrame,
    stops: DataFrame,
    loaded_at: str | Column,
    first_day: str | None = None,
    end_day: str | None = None,
    strict_row: bool = False,
    with_stations: bool = True,
) -> DataFrame:
    """One row per trip with its end stations and times.

    ``trips`` needs ``service_date``: clock times are placed on that day, so
    times of 24 hours and more are kept. With ``first_day`` / ``end_day`` only
    trips that start in that half-open range stay: of a trips table stored by
    service day only these days are read and the ``MAX_CLOCK_DAYS`` before, as a
    clock time may be that late. Without ``with_stations`` names and places
    are left out and the stops are not read.
    """
    trip = ["archive", "trip_id"] if "archive" in stop_times.columns else ["trip_id"]
    scope = trip[:-1]
    kept = trips.filter(F.col("trip_id").isNotNull() & F.col("route_id").isNotNull())
    # the start decides below; the day bounds it, so that it prunes at the scan
    if first_day is not None:
        kept = kept.filter(F.col("service_date") >= F.date_sub(F.lit(first_day).cast("date"), times.MAX_CLOCK_DAYS))
    if end_day is not None:
        kept = kept.filter(F.col("service_date") < F.lit(end_day).cast("date"))
    ends = first_and_last_stops(stop_times, trip, strict_row)

    def place(end: str) -> DataFrame:
        return stops.select(
            *scope,
            F.col("stop_id").alias(f"{end}_station_id"),
            F.col("stop_name").alias(f"{end}_station_name"),
            F.col("stop_lat").alias(f"{end}_lat"),
            F.col("stop_lon").alias(f"{end}_lng"),
        )

    joined = (
        kept.join(ends, trip, "left")
        .withColumnRenamed("first_stop_id", "start_station_id")
        .withColumnRenamed("last_stop_id", "end_station_id")
    )
    stations = ["start_station_id", "end_station_id"]
    if with_stations:
        joined = joined.join(place("start"), [*scope, "start_station_id"], "left").join(
            place("end"), [*scope, "end_station_id"], "left"
        )
        stations = [
            "start_station_name", "start_station_id", "end_station_name", "end_station_id",
            "start_lat", "start_lng", "end_lat", "end_lng",
        ]
    rows = joined.select(
        "trip_id", "route_id", "service_id", *stations,
        times.clock_on(F.col("service_date"), F.col("first_arrival_time")).alias("scheduled_start_time"),
        times.clock_on(F.col("service_date"), F.col("last_arrival_time")).alias("scheduled_end_time"),
        "direction_id",
        times.as_instant(loaded_at).alias("collected_at"),
    )
    if first_day is not None:
        rows = rows.filter(F.col("scheduled_start_time") >= times.as_instant(f"{first_day} 00:00:00"))
    if end_day is not None:
        rows = rows.filter(F.col("scheduled_start_time") < times.as_instant(f"{end_day} 00:00:00"))
    return rows


def route_centres(scheduled: DataFrame) -> DataFrame:
    """Mean trip midpoint per route id in lower case; the default bin without coordinates."""
    lat, lng = places.DEFAULT_BIN
    middle = {axis: (F.col(f"start_{axis}") + F.col(f"end_{axis}")) / 2 for axis in ("lat", "lng")}
    return scheduled.groupBy(F.lower("route_id").alias("route_key")).agg(
        F.coalesce(F.avg(middle["lat"]), F.lit(lat)).alias("lat"),
        F.coalesce(F.avg(middle["lng"]), F.lit(lng)).alias("lng"),
    )
