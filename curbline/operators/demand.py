"""Hourly demand per bike station and the rollups built on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import times
from curbline.operators import keyed
from curbline.operators.coverage import latest_info


def hourly_counts(trips: DataFrame, station: str, ts: str, name: str) -> DataFrame:
    """Trips per station and hour; trips without a station are left out."""
    return (
        trips.filter(F.col(station).isNotNull())
        .groupBy(
            F.col(station).cast("string").alias("station_id"),
            times.hour_floor(F.col(ts)).alias("ts_hour"),
        )
        .agg(F.count("*").alias(name))
    )


def station_names(info: DataFrame) -> DataFrame:
    return latest_info(info).select("station_id", F.col("name").alias("station_name"))


def golden_hours(counts: DataFrame, info: DataFrame) -> DataFrame:
    """Hourly counts with station name and calendar columns.

    Names come from the newest snapshot only: the info table keeps many per
    station, and joining them all would multiply the counts.
    """
    return times.with_calendar(counts.join(station_names(info), "station_id", "left"), "ts_hour")


def hourly_pickups(trips: DataFrame, info: DataFrame) -> DataFrame:
    return golden_hours(hourly_counts(trips, "start_station_id", "started_at", "pickups"), info)


def hourly_dropoffs(trips: DataFrame, info: DataFrame) -> DataFrame:
    return golden_hours(hourly_counts(trips, "end_station_id", "ended_at", "dropoffs"), info)


def combine_hours(pickups: DataFrame, dropoffs: DataFrame, info: DataFrame) -> DataFrame:
    """Full join of hourly pickups and dropoffs; names and calendar go on its rows, once."""
    both = pickups.join(dropoffs, ["station_id", "ts_hour"], "full").select(
        "station_id", "ts_hour", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("pickups", "dropoffs")]
    )
    return golden_hours(both, info)


def trip_ends(trips: DataFrame) -> DataFrame:
    """Both ends of every trip as rows ``station_id, ts, pickup``; ends without a station are left out."""
    ends = F.array(
        *[
            F.struct(
                F.col(station).cast("string").alias("station_id"),
                F.col(ts).alias("ts"),
                F.lit(pickup).alias("pickup"),
            )
            for station, ts, pickup in (
                ("start_station_id", "started_at", 1),
                ("end_station_id", "ended_at", 0),
            )
        ]
    )
    return trips.select(F.inline(ends)).filter(F.col("station_id").isNotNull())


def _both_ways() -> list[Column]:
    return [F.sum("pickup").alias("pickups"), F.sum(1 - F.col("pickup")).alias("dropoffs")]


def station_hours(trips: DataFrame) -> DataFrame:
    """Pickups and dropoffs per station and hour from one scan and one shuffle.

    Every trip becomes two rows, which the map-side aggregate reduces at once;
    that replaces two aggregates and a full join.
    """
    hour = times.hour_floor(F.col("ts")).alias("ts_hour")
    return trip_ends(trips).groupBy("station_id", hour).agg(*_both_ways())


def demand_features(trips: DataFrame, info: DataFrame) -> DataFrame:
    """The feature table of the demand models."""
    return golden_hours(station_hours(trips), info).select(
        "station_id", "station_name", "ts_hour", "day_of_week", "hour", "is_weekend",
        "pickups", "dropoffs",
    )


def station_totals(trips: DataFrame, info: DataFrame) -> DataFrame:
    """Total and net demand per station; net is what leaves minus what arrives.

    Totals need no hourly step, and names are joined to one row per station.
    """
    totals = trip_ends(trips).groupBy("station_id").agg(*_both_ways())
    return (
        totals.join(station_names(info), "station_id", "left")
        .select("station_id", "station_name", "pickups", "dropoffs")
        .withColumn("net_demand", F.col("pickups") - F.col("dropoffs"))
    )


def _largest(hours: DataFrame, value: str, k: int) -> DataFrame:
    total = f"total_{value}"
    totals = hours.groupBy("station_id").agg(F.sum(value).alias(total))
    return keyed.top_k(totals, k, F.desc(total), F.asc("station_id"))


def _named(top: DataFrame, info: DataFrame, total: str, k: int) -> DataFrame:
    """``top`` (at most ``k`` rows, so broadcast) with the station's name after its id, in order."""
    names = station_names(info).join(F.broadcast(top.select("station_id")), "station_id", "left_semi")
    rest = [c for c in top.columns if c != "station_id"]
    named = top.join(names, "station_id", "left").select("station_id", "station_name", *rest)
    return keyed.top_k(named, k, F.desc(total), F.asc("station_id"))


def top_by_total(hours: DataFrame, info: DataFrame, value: str, k: int) -> DataFrame:
    """The ``k`` stations with the greatest sum of ``value``; names are joined to these rows alone."""
    return _named(_largest(hours, value, k), info, f"total_{value}", k)


def busy_both_ways(
    pickups: DataFrame, dropoffs: DataFrame, info: DataFrame, pool: int = 30, k: int = 20
) -> DataFrame:
    """Stations in the top ``pool`` of both lists, ranked by their combined total."""
    both = _largest(pickups, "pickups", pool).join(_largest(dropoffs, "dropoffs", pool), "station_id")
    both = both.withColumn("combined_score", F.col("total_pickups") + F.col("total_dropoffs"))
    return _named(keyed.top_k(both, k, F.desc("combined_score"), F.asc("station_id")), info, "combined_score", k)


def dow_hour_stats(trips: DataFrame) -> DataFrame:
    """Trips per station, weekday and hour, and their average per calendar day of that weekday.

    The divisor counts the days of each weekday that occur anywhere in the trips.
    """
    daily = (
        trips.filter(F.col("start_station_id").isNotNull())
        .groupBy(
            F.col("start_station_id").cast("string").alias("start_station_id"),
            F.to_date("started_at").alias("day"),
            F.hour("started_at").alias("hour"),
        )
        .agg(F.count("*").alias("n"))
    )
    # Seven rows at most. The sum keeps the counts in use, so both branches share one shuffle of the trips.
    days = daily.groupBy("day").agg(F.sum("n").alias("n")).filter("n > 0")
    weekdays = days.groupBy(F.dayofweek("day").alias("dow")).agg(F.count("*").alias("days"))
    return (
        daily.groupBy("start_station_id", F.dayofweek("day").alias("dow"), "hour")
        .agg(F.sum("n").alias("trips_count"))
        .join(F.broadcast(weekdays), "dow")
        .withColumn("avg_trips_per_day_hour", F.col("trips_count") / F.col("days"))
        .drop("days")
    )


def station_lookup(info: DataFrame) -> DataFrame:
    """Station id per lower-case name; the smallest id where names repeat."""
    return (
        station_names(info)
        .groupBy(F.lower("station_name").alias("name_key"))
        .agg(F.min("station_id").alias("start_station_id"))
    )


def typical_use(requests: DataFrame, stats: DataFrame, lookup: DataFrame) -> DataFrame:
    """Mean use at a named station on a weekday between two hours, for every request.

    Requests have ``station_name, day_of_week, start_hour, end_hour``; no end hour
    means the start hour alone. Unknown stations and empty ranges give zeros and
    ``has_data = false``. Equal questions are answered once: the distinct ones
    meet at most 24 hour rows each, and the answers are joined back.
    """
    asked = requests.withColumns(
        {
            "end_hour": F.coalesce("end_hour", "start_hour"),
            "name_key": F.lower("station_name"),
        }
    )
    question = ["name_key", "day_of_week", "start_hour", "end_hour"]
    hours = stats.withColumnRenamed("dow", "day_of_week")
    answers = (
        asked.select(*question)
        .distinct()
        .join(lookup, "name_key")
        .join(hours, ["start_station_id", "day_of_week"])
        .filter(F.col("hour").between(F.col("start_hour"), F.col("end_hour")))
        .groupBy(*question, "start_station_id")
        .agg(
            F.avg("avg_trips_per_day_hour").alias("avg_trips"),
            F.avg("trips_count").alias("avg_trips_count"),
        )
    )
    return asked.join(answers, question, "left").select(
        *requests.columns,
        F.col("start_station_id").alias("station_id"),
        F.coalesce("avg_trips", F.lit(0.0)).alias("avg_trips"),
        F.coalesce("avg_trips_count", F.lit(0.0)).alias("avg_trips_count"),
        F.col("avg_trips").isNotNull().alias("has_data"),
    )
