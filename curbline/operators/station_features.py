"""Feature table of the transit stations: bikes in reach, rush hours, trips and ridership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import text, times
from curbline.operators import coverage, keyed, spatial
from curbline.session import cut_lineage

NEAR_M = 500.0  # fixed value: stations counted as close
WALK_M = 800.0  # fixed value: walking distance
FAR_AWAY_M = 9999.0  # fixed value: distance of a station without any bike station
FEW_BIKES = 2  # fixed value: fewer bikes than this in the morning is low
RUSH_HOURS = {"morning": (7, 9), "evening": (17, 19)}  # fixed values, both ends included
FEATURE_COLUMNS = [
    "distance_to_nearest_m", "bikes_within_near", "nearby_morning", "avg_bikes_morning",
    "avg_docks_morning", "nearby_evening", "avg_bikes_evening", "avg_docks_evening",
    "bike_trip_volume", "commuter_trip_volume", "avg_trip_duration_min", "transit_ridership",
    "route_diversity", "is_isolated", "has_low_morning_availability",
]


def transit_sites(transit: DataFrame) -> DataFrame:
    return spatial.sites(coverage.unique_stations(transit), "lat", "lng").select("lat", "lng")


def station_rush_sums(status: DataFrame, zone: str | None = times.LOCAL_ZONE) -> DataFrame:
    """Rush-hour sums per bike station, both rush hours from one scan of the snapshots."""
    hour = F.hour(times.to_local(times.from_epoch(F.col("last_reported")), zone))
    in_rush = {name: hour.between(*limits) for name, limits in RUSH_HOURS.items()}
    aggregates = []
    for name, test in in_rush.items():
        aggregates.append(F.count_if(test).alias(f"rows_{name}"))
        for measure in ("bikes", "docks"):
            value = F.when(test, F.col(f"num_{measure}_available"))
            aggregates.append(F.sum(value).alias(f"{measure}_{name}"))
            aggregates.append(F.count(value).alias(f"{measure}_n_{name}"))
        aggregates.append(
            F.min(F.when(test, F.col("num_bikes_available"))).alias(f"least_bikes_{name}")
        )
    return status.filter(text.any_of(list(in_rush.values()))).groupBy("station_id").agg(*aggregates)


def rush_availability(
    transit: DataFrame,
    stations: DataFrame,
    status: DataFrame,
    radius_m: float = WALK_M,
    zone: str | None = times.LOCAL_ZONE,
) -> DataFrame:
    """Bike stations with rush-hour snapshots in reach of each transit site, and the mean
    bikes and docks over those snapshots.

    Snapshots are summed per bike station first. A mean over all joined snapshots
    is then the ratio of two sums, and no snapshot takes part in the distance join.
    """
    sums = station_rush_sums(status, zone)
    counts = [c for c in sums.columns if c.startswith(("rows_", "bikes_", "docks_"))]
    located = stations.select("station_id", "lat", "lon").join(sums, "station_id")
    payload, totals, outputs = [], [], []
    for name in RUSH_HOURS:
        payload += [
            F.count_if(F.col(f"rows_{name}") > 0).alias(f"stations_{name}"),
            F.min(f"least_bikes_{name}").alias(f"least_bikes_{name}"),
        ]
        totals += [
            F.sum(f"stations_{name}").alias(f"nearby_{name}"),
            F.min(f"least_bikes_{name}").alias(f"least_bikes_{name}"),
        ]
        outputs += [f"nearby_{name}", f"least_bikes_{name}"]
    payload += [F.sum(c).alias(c) for c in counts]
    totals += [F.sum(c).alias(c) for c in counts]
    reach = spatial.radius_summary(
        transit_sites(transit), spatial.sites(located, "lat", "lon", *payload), radius_m, *totals
    )
    means = [
        F.try_divide(f"{measure}_{name}", f"{measure}_n_{name}").alias(f"avg_{measure}_{name}")
        for name in RUSH_HOURS
        for measure in ("bikes", "docks")
    ]
    return reach.select("lat", "lng", *outputs, *means)


def nearby_trips(transit: DataFrame, trips: DataFrame, radius_m: float = WALK_M) -> DataFrame:
    """Bike trips that start in reach of each transit site: all, by members, mean minutes.

    Trips are reduced to one row per start coordinate before the distance join.
    """
    minutes = times.minutes_between(F.col("started_at"), F.col("ended_at"))
    starts = spatial.sites(
        trips, "start_lat", "start_lng",
        F.count("*").alias("n"),
        F.count_if(F.col("member_casual") == "member").alias("members"),
        F.sum(minutes).alias("minutes"),
        F.count(minutes).alias("timed"),
    )
    return spatial.radius_summary(
        transit_sites(transit), starts, radius_m,
        F.sum("n").alias("bike_trip_volume"),
        F.sum("members").alias("commuter_trip_volume"),
        F.try_divide(F.sum("minutes"), F.sum("timed")).alias("avg_trip_duration_min"),
    )


def nearest_and_close(transit: DataFrame, stations: DataFrame, near_m: float = NEAR_M) -> DataFrame:
    """Distance to the nearest bike station and the number within ``near_m``, per site."""
    home = transit_sites(transit)
    bikes = coverage.bike_sites(stations)
    nearest = spatial.nearest_site(home, bikes).select(
        "lat", "lng", F.col("distance").alias("distance_to_nearest_m")
    )
    close = spatial.radius_summary(home, bikes, near_m, F.sum("stations").alias("bikes_within_near"))
    return nearest.join(close, ["lat", "lng"], "left")


def ridership(scheduled: DataFrame) -> DataFrame:
    """Scheduled trips and distinct routes per start station."""
    return (
        scheduled.filter(F.col("start_station_id").isNotNull())
        .groupBy(F.col("start_station_id").alias("station_id"))
        .agg(
            F.count("*").alias("transit_ridership"),
            F.countDistinct("route_id").alias("route_diversity"),
        )
    )


def station_features(
    transit: DataFrame,
    info: DataFrame,
    status: DataFrame,
    trips: DataFrame,
    scheduled: DataFrame,
    zone: str | None = times.LOCAL_ZONE,
) -> DataFrame:
    """One row per located transit station: identity, 15 features and a split tag.

    Stations of both kinds are reduced once and stored, as all blocks of features read them.
    """
    located = transit.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    stops = cut_lineage(coverage.unique_stations(located))
    stations = cut_lineage(coverage.latest_info(info))
    blocks = [
        nearest_and_close(stops, stations),
        rush_availability(stops, stations, status, WALK_M, zone),
        nearby_trips(stops, trips, WALK_M),
    ]
    per_site = reduce(lambda left, block: left.join(block, ["lat", "lng"], "left"), blocks, stops)
    joined = per_site.join(ridership(scheduled), "station_id", "left")
    defaults = {c: 0 for c in FEATURE_COLUMNS[:-2]} | {"distance_to_nearest_m": FAR_AWAY_M}
    filled = {c: F.coalesce(c, F.lit(value)) for c, value in defaults.items()}
    return (
        joined.withColumns(filled)
        .withColumns(
            {
                "is_isolated": flag(F.col("distance_to_nearest_m") > WALK_M),
                "has_low_morning_availability": flag(F.col("avg_bikes_morning") < FEW_BIKES),
                "split": F.lit("train"),
            }
        )
        .select("station_id", "station_name", "lat", "lng", *FEATURE_COLUMNS, "split")
    )


def flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0)


def dataset_profile(features: DataFrame) -> DataFrame:
    """Rows, distinct stations and number of features, as the dataset registry records them."""
    present = [c for c in FEATURE_COLUMNS if c in features.columns]
    return features.agg(
        F.count("*").alias("row_count"),
        F.countDistinct("station_id").alias("unique_stations"),
        F.lit(len(present)).alias("feature_count"),
    )


def arrival_pickup_correlation(
    transit: DataFrame, scheduled: DataFrame, trips: DataFrame, radius_m: float = WALK_M
) -> DataFrame:
    """Correlation of hourly transit arrivals with bike pickups in reach, per station.

    Hours in which at least one of the two happens take part. NULL where either is constant. Stations at one place
    share its pickups, whose hours are summed once per place: only hours with arrivals are joined to them, so the
    work grows with the rows of both sides and not with stations x hours.
    """
    stops = coverage.unique_stations(transit).select("station_id", "lat", "lng")
    arrivals = (
        scheduled.filter(F.col("scheduled_end_time").isNotNull())
        .groupBy(
            F.col("end_station_id").alias("station_id"),
            times.hour_floor(F.col("scheduled_end_time")).alias("ts_hour"),
        )
        .agg(F.count("*").alias("arrivals"))
    )
    starts = (
        trips.filter(F.col("start_lat").isNotNull() & F.col("start_lng").isNotNull())
        .groupBy(
            F.col("start_lat").alias("near_lat"),
            F.col("start_lng").alias("near_lng"),
            times.hour_floor(F.col("started_at")).alias("ts_hour"),
        )
        .agg(F.count("*").alias("n"))
    )
    pairs = spatial.radius_pairs(
        transit_sites(transit),
        spatial.sites(trips, "start_lat", "start_lng").drop("n"),
        radius_m,
    )
    pickups = (
        pairs.join(starts, ["near_lat", "near_lng"])
        .groupBy("lat", "lng", "ts_hour")
        .agg(F.sum("n").alias("pickups"))
    )
    by_place = pickups.groupBy("lat", "lng").agg(*_sums("pickups")).join(stops, ["lat", "lng"]).drop("lat", "lng")
    # null-safe, as an hour of pickups may be NULL: a plain join would filter it and compute the pickups once more
    there = pickups.select(F.col("lat").alias("at_lat"), F.col("lng").alias("at_lng"), F.col("ts_hour").alias("at_hour"), "pickups")
    same = (F.col("lat") == F.col("at_lat")) & (F.col("lng") == F.col("at_lng")) & F.col("ts_hour").eqNullSafe(F.col("at_hour"))
    by_station = (
        arrivals.join(stops, "station_id", "left")
        .join(there, same, "left")
        .groupBy("station_id")
        .agg(
            *_sums("arrivals"),
            F.count("pickups").alias("shared"),
            F.sum(F.col("arrivals") * F.col("pickups")).alias("products"),
        )
    )
    both = by_station.join(by_place, "station_id", "full")
    both = both.na.fill(0, [c for c in both.columns if c != "station_id"])
    both = both.withColumn("hours", F.col("hours_arrivals") + F.col("hours_pickups") - F.col("shared"))
    spread = F.sqrt(_centred("squares_arrivals", "sum_arrivals", "sum_arrivals")) * F.sqrt(
        _centred("squares_pickups", "sum_pickups", "sum_pickups")
    )
    return both.select(
        "station_id",
        "hours",
        F.try_divide(_centred("products", "sum_arrivals", "sum_pickups"), spread).alias("correlation"),
    )


def _sums(column: str) -> list[Column]:
    """Hours, sum and sum of squares of a count per hour."""
    return [
        F.count("*").alias(f"hours_{column}"),
        F.sum(column).alias(f"sum_{column}"),
        F.sum(F.col(column) * F.col(column)).alias(f"squares_{column}"),
    ]


def _centred(products: str, left: str, right: str) -> Column:
    """``hours * products - left * right`` of whole numbers, exact until the end."""

    def product(a: str, b: str) -> Column:
        return F.col(a).cast("decimal(18,0)") * F.col(b).cast("decimal(19,0)")

    return (product("hours", products) - product(left, right)).cast("double")


CONNECTIVITY_SIGNS = {
    "distance_to_nearest_m": -1,
    "bikes_within_near": 1,
    "avg_bikes_morning": 1,
    "avg_bikes_evening": 1,
    "bike_trip_volume": 1,
    "route_diversity": 1,
}


def connectivity_score(features: DataFrame, signs: dict[str, int] | None = None) -> DataFrame:
    """Mean of signed z-scores per station; a constant feature adds nothing."""
    signs = signs or CONNECTIVITY_SIGNS
    moments = features.agg(
        F.struct(
            *[F.avg(c).alias(f"mean_{c}") for c in signs],
            *[F.stddev_pop(c).alias(f"sd_{c}") for c in signs],
        )
    ).scalar()
    staged = features.withColumn("_m", moments)
    scores = [
        F.when(F.col(f"_m.sd_{c}") > 0, sign * (F.col(c) - F.col(f"_m.mean_{c}")) / F.col(f"_m.sd_{c}"))
        .otherwise(0.0)
        for c, sign in signs.items()
    ]
    total = reduce(lambda a, b: a + b, scores)
    return staged.select("station_id", "station_name", (total / len(signs)).alias("connectivity_score"))


def dock_priorities(features: DataFrame, k: int) -> DataFrame:
    """Isolated stations ranked by ridership: where new docks would serve most riders."""
    isolated = features.filter(F.col("is_isolated") == 1).select(
        "station_id", "station_name", "transit_ridership", "distance_to_nearest_m"
    )
    return keyed.top_k(
        isolated, k, F.desc("transit_ridership"), F.desc("distance_to_nearest_m"), F.asc("station_id")
    )
