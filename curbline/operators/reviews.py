"""Yearly reviews of scheduled trips, rides and vehicles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbline.functions import times
from curbline.operators import keyed


def total(df: DataFrame, ts: str, year: int, name: str) -> DataFrame:
    return df.filter(times.in_year(F.col(ts), year)).agg(F.count("*").alias(name))


def top_values(df: DataFrame, column: str, ts: str, year: int, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values of a column in a year."""
    counts = (
        df.filter(times.in_year(F.col(ts), year)).groupBy(column).agg(F.count("*").alias("trips"))
    )
    return keyed.top_k(counts, k, F.desc("trips"), F.asc_nulls_last(column))


def by_month(df: DataFrame, ts: str, year: int, zone: str | None = times.LOCAL_ZONE) -> DataFrame:
    """Trips per month of the zone's calendar, in calendar order.

    The year itself is cut in UTC, as the reports it replaces do.
    """
    local = times.to_local(F.col(ts), zone)
    return (
        df.filter(times.in_year(F.col(ts), year))
        .groupBy(F.month(local).alias("month_number"), times.month_name(F.col(ts), zone).alias("month"))
        .agg(F.count("*").alias("trips"))
        .orderBy("month_number")
    )


def by_weekday(
    df: DataFrame, ts: str, year: int, extra: list[str], zone: str | None = times.LOCAL_ZONE
) -> DataFrame:
    """Trips per weekday of the zone's calendar and ``extra`` columns, Sunday first."""
    local = times.to_local(F.col(ts), zone)
    return (
        df.filter(times.in_year(F.col(ts), year))
        .groupBy(
            F.dayofweek(local).alias("weekday_number"),
            times.weekday_name(F.col(ts), zone).alias("weekday"),
            *extra,
        )
        .agg(F.count("*").alias("trips"))
        .orderBy("weekday_number", *extra)
    )


def by_season(df: DataFrame, ts: str, year: int, extra: list[str]) -> DataFrame:
    """Trips per season and ``extra`` columns, Fall first."""
    order = F.array_position(F.array(*map(F.lit, ["Fall", "Winter", "Spring", "Summer"])), F.col("season"))
    return (
        df.filter(times.in_year(F.col(ts), year))
        .groupBy(times.season(F.col(ts)).alias("season"), *extra)
        .agg(F.count("*").alias("trips"))
        .orderBy(order, *extra)
    )


def vehicle_use(positions: DataFrame) -> DataFrame:
    """Distinct vehicles and snapshots per route and hour of day."""
    return positions.groupBy("route_id", F.hour("observed_at_utc").alias("hour")).agg(
        F.countDistinct("vehicle_id").alias("vehicles"), F.count("*").alias("snapshots")
    )


def occupancy_shares(positions: DataFrame) -> DataFrame:
    """Share of each occupancy level within route, hour and direction."""
    group = ["route_id", "direction_id", "hour"]
    levels = (
        positions.filter(F.col("occupancy_status").isNotNull())
        .groupBy(
            "route_id",
            "direction_id",
            F.hour("observed_at_utc").alias("hour"),
            F.upper(F.trim("occupancy_status")).alias("level"),
        )
        .agg(F.count("*").alias("n"))
    )
    totals = levels.groupBy(*group).agg(F.sum("n").alias("total"))
    return levels.join(totals, group).withColumn("share", F.col("n") / F.col("total"))


def less_crowded(shares: DataFrame, crowded: str = "FULL", k: int = 3) -> DataFrame:
    """The ``k`` routes with the least share of crowded snapshots, per hour."""
    crowded_n = F.sum(F.when(F.col("level") == crowded, F.col("n")).otherwise(0))
    per_route = shares.groupBy("hour", "route_id").agg(
        crowded_n.alias("crowded_n"), F.sum("n").alias("snapshots")
    ).withColumn("crowded_share", F.round(F.col("crowded_n") / F.col("snapshots"), 6))
    return keyed.top_k_per_group(per_route, ["hour"], k, F.asc("crowded_share"), F.asc("route_id"))
