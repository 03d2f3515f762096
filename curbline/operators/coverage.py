"""Last-mile coverage: which transit stations have bikes within reach."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import places, text, times
from curbline.operators import keyed, percentiles, spatial

ACTIVE_DAYS = 14  # fixed value
ACTIVE_RATIO = 0.3  # fixed value
PERCENTILE_STEP_M = 1.0  # distances are counted per metre on the way to exact percentiles


def unique_stations(transit: DataFrame) -> DataFrame:
    """One row per transit station id, with a usable coordinate pair where it has one."""
    typed = transit.filter(F.col("station_id").isNotNull()).select(
        "station_id",
        "station_name",
        F.col("lat").cast("double").alias("lat"),
        F.col("lng").cast("double").alias("lng"),
    )
    unlocated = F.col("lat").isNull() | F.col("lng").isNull()
    return keyed.earliest_per_key(
        typed.withColumn("_unlocated", unlocated), ["station_id"], ["_unlocated"]
    ).drop("_unlocated")


def latest_info(info: DataFrame) -> DataFrame:
    """The newest snapshot of every bike station."""
    return keyed.latest_per_key(info, ["station_id"], ["snapshot_ts"])


def active_ratio(status: DataFrame, as_of: str | Column, days: int = ACTIVE_DAYS) -> DataFrame:
    """Share of a station's recent snapshots that had a bike."""
    has_bike = (F.coalesce("num_bikes_available", F.lit(0)) > 0).cast("int")
    recent = status.filter(times.since(F.col("snapshot_ts"), as_of, days) & times.until(F.col("snapshot_ts"), as_of))
    return recent.groupBy("station_id").agg(F.avg(has_bike).alias("active_ratio"))


def active_stations(
    info: DataFrame, status: DataFrame, as_of: str | Column, min_ratio: float = ACTIVE_RATIO
) -> DataFrame:
    ratios = active_ratio(status, as_of).filter(F.col("active_ratio") >= min_ratio)
    return latest_info(info).join(ratios, "station_id")


def bike_sites(stations: DataFrame) -> DataFrame:
    return spatial.sites(
        stations, "lat", "lon",
        F.count("*").alias("stations"), F.min("station_id").alias("near_id"),
    )


def coverage(transit: DataFrame, stations: DataFrame, radius_m: float) -> DataFrame:
    """Bike stations in reach of every transit station; stations without any stay, with 0.

    ``stations`` has one row per bike station: ``latest_info`` or ``active_stations``.
    """
    stops = unique_stations(transit)
    reach = spatial.radius_summary(
        spatial.sites(stops, "lat", "lng"),
        bike_sites(stations),
        radius_m,
        F.sum("stations").alias("nearby_count"),
        F.min("distance_m").alias("nearest_distance_m"),
    )
    nearby = F.coalesce("nearby_count", F.lit(0))
    return stops.join(reach, ["lat", "lng"], "left").select(
        "station_id", "station_name", "lat", "lng",
        nearby.alias("nearby_count"),
        "nearest_distance_m",
        (nearby >= 1).alias("meets_last_mile"),
    )


def reachable_sites(transit: DataFrame, stations: DataFrame, radius_m: float) -> DataFrame:
    """Transit station x bike site pairs in reach; stations without a site stay with NULLs."""
    stops = unique_stations(transit)
    pairs = spatial.radius_pairs(
        spatial.sites(stops, "lat", "lng").select("lat", "lng"), bike_sites(stations), radius_m
    )
    return stops.join(pairs, ["lat", "lng"], "left").select(
        "station_id", "station_name", "near_lat", "near_lng",
        F.col("stations").alias("bike_stations"), "distance_m",
    )


def nearest_bike_station(
    transit: DataFrame, stations: DataFrame, metric: spatial.Metric = spatial.SPHERE
) -> DataFrame:
    """Every transit station with its nearest bike station, however far."""
    stops = unique_stations(transit)
    named = spatial.sites(
        stations, "lat", "lon",
        F.min("station_id").alias("near_id"),
        F.min_by("name", "station_id").alias("near_name"),
    )
    found = spatial.nearest_site(spatial.sites(stops, "lat", "lng"), named, metric)
    return stops.join(found, ["lat", "lng"], "left")


def latest_status(status: DataFrame) -> DataFrame:
    return keyed.latest_per_key(status, ["station_id"], ["snapshot_ts"])


def nearest_availability(transit: DataFrame, info: DataFrame, status: DataFrame) -> DataFrame:
    """Nearest bike station of every transit station with that station's newest status."""
    newest = latest_status(status).select(
        F.col("station_id").alias("near_id"),
        "num_bikes_available",
        "num_docks_available",
        text.is_truthy(F.col("is_renting")).alias("renting_ok"),
        text.is_truthy(F.col("is_returning")).alias("returning_ok"),
        F.col("snapshot_ts").alias("status_snapshot_ts"),
    )
    return nearest_bike_station(transit, latest_info(info)).join(newest, "near_id", "left")


def split_by_rule(cover: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations that meet the last-mile rule, and those that do not."""
    return cover.filter("meets_last_mile"), cover.filter(~F.col("meets_last_mile"))


def by_distance(cover: DataFrame) -> DataFrame:
    return cover.orderBy(
        F.desc("meets_last_mile"), F.asc_nulls_last("nearest_distance_m"), "station_id"
    )


def nearest_k(cover: DataFrame, k: int = 10) -> DataFrame:
    return keyed.top_k(cover, k, F.asc_nulls_last("nearest_distance_m"), F.asc("station_id"))


def farthest_k(cover: DataFrame, k: int = 10) -> DataFrame:
    return keyed.top_k(cover, k, F.desc_nulls_last("nearest_distance_m"), F.asc("station_id"))


def distance_summary(cover: DataFrame) -> DataFrame:
    """Counts, compliance and the distribution of nearest distances, in one row.

    ``cover`` is read several times: pass a stored table.
    """
    met = F.count_if("meets_last_mile")
    total = F.count("*")
    cuts = percentiles.exact_percentiles(cover, "nearest_distance_m", [0.5, 0.9], PERCENTILE_STEP_M).scalar()
    return cover.agg(
        total.alias("total_stations"),
        met.alias("stations_meeting"),
        (total - met).alias("stations_failing"),
        F.coalesce(F.try_divide(met * 100.0, total), F.lit(0.0)).alias("percent_meeting"),
        F.avg("nearest_distance_m").alias("mean_distance_m"),
    ).select(
        "total_stations", "stations_meeting", "stations_failing", "percent_meeting",
        F.get(cuts, F.lit(0)).alias("median_distance_m"), "mean_distance_m",
        F.get(cuts, F.lit(1)).alias("p90_distance_m"),
    )


def distance_histogram(cover: DataFrame, width_m: float, buckets: int) -> DataFrame:
    """Stations per distance bucket; bucket 0 is the first, the last is open-ended."""
    number = F.least(F.floor(F.col("nearest_distance_m") / width_m), F.lit(buckets))
    return (
        cover.filter(F.col("nearest_distance_m").isNotNull())
        .groupBy(number.cast("long").alias("bucket"))
        .agg(F.count("*").alias("stations"), F.min("nearest_distance_m").alias("least_m"))
        .withColumn("from_m", F.col("bucket") * width_m)
    )


def category_counts(failing: DataFrame) -> DataFrame:
    return failing.groupBy(text.station_category(F.col("station_name")).alias("category")).agg(
        F.count("*").alias("stations")
    )


def centroid(stations: DataFrame) -> DataFrame:
    """Mean position of a station set; the default map centre when nothing has one."""
    lat, lng = places.DEFAULT_CENTRE
    return stations.agg(
        F.coalesce(F.avg("lat"), F.lit(lat)).alias("lat"),
        F.coalesce(F.avg("lng"), F.lit(lng)).alias("lng"),
    )


def heat_grid(cover: DataFrame, cell_degrees: float = 0.05) -> DataFrame:
    """Stations and the least nearest-distance per latitude / longitude cell."""
    cell = [
        F.floor(F.col(axis) / cell_degrees).cast("long").alias(f"{axis}_cell")
        for axis in ("lat", "lng")
    ]
    return cover.groupBy(*cell).agg(
        F.count("*").alias("stations"),
        F.count_if("meets_last_mile").alias("stations_meeting"),
        F.min("nearest_distance_m").alias("nearest_distance_m"),
    )


def coverage_by_line(cover: DataFrame, station_lines: DataFrame) -> DataFrame:
    """Stations and served share per line. ``station_lines`` has ``station_id, line``."""
    pairs = station_lines.select("station_id", "line").distinct()
    served = F.count_if("meets_last_mile")
    return (
        pairs.join(cover, "station_id")
        .groupBy("line")
        .agg(F.count("*").alias("stations"), served.alias("well_served"))
        .withColumn("coverage_pct", F.round(F.col("well_served") * 100.0 / F.col("stations"), 1))
    )


def search_stations(transit: DataFrame, keyword: str | Column) -> DataFrame:
    """Stations whose name contains the keyword, in any case, ordered by name."""
    needle = F.lower(F.lit(keyword) if isinstance(keyword, str) else keyword)
    hits = transit.filter(F.contains(F.lower("station_name"), needle))
    return hits.select("station_id", "station_name").orderBy("station_name", "station_id")
