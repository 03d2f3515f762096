"""Station features, clusters, labels and registry rows."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from curbline.operators import clusters, keyed, registry, station_features
from curbline.operators.coverage import latest_info, unique_stations
from curbline.plans.inputs import AS_OF
from curbline.plans.registry import query
from curbline.plans.schedule import scheduled
from curbline.session import cut_lineage, scratch_dir
from curbline.sources import tables

RUN_ID = "run_2024a"
MODEL = {
    "model_id": "station-clusters",
    "name": "Station clusters",
    "business_problem": "Which stations lack a last mile",
    "ticket_number": "1",
    "owner": "analytics",
}


def features(t):
    return station_features.station_features(
        t.transit_stations, t.station_info, t.station_status, t.bike_trips, scheduled(t)
    )


def stored_features(t):
    """The feature table as later jobs read it: computed once, then kept in the shared folder."""
    return cut_lineage(features(t))


def clustered(t):
    """Features with a cluster number that follows from the id, so that labels can be checked exactly."""
    numbered = stored_features(t).withColumn("cluster", F.col("station_id").cast("bigint") % 3)
    return clusters.label_stations(numbered)


_ROUNDED = {
    "distance_to_nearest_m": 3, "avg_bikes_morning": 6, "avg_docks_morning": 6, "avg_bikes_evening": 6,
    "avg_docks_evening": 6, "avg_trip_duration_min": 6,
}


def rounded(df, places=_ROUNDED):
    return df.withColumns({c: F.round(c, n) for c, n in places.items() if c in df.columns})


@query(
    "station_features",
    "M-16 J-4 J-5 J-6 J-9 A-6 A-7 A-8 P-14 P-18 P-19",
    """
SELECT * REPLACE (round(distance_to_nearest_m, 3) AS distance_to_nearest_m, round(avg_bikes_morning, 6) AS avg_bikes_morning, round(avg_docks_morning, 6) AS avg_docks_morning,
  round(avg_bikes_evening, 6) AS avg_bikes_evening, round(avg_docks_evening, 6) AS avg_docks_evening, round(avg_trip_duration_min, 6) AS avg_trip_duration_min) FROM features""",
)
def all_station_features(t):
    return rounded(features(t))


_NEAR_STATUS = """
WITH timed AS (SELECT *, hour(to_timestamp(last_reported) AT TIME ZONE {0}) AS h FROM station_status)
SELECT p.station_id, count(DISTINCT CASE WHEN h BETWEEN 7 AND 9 THEN s.station_id END) AS nearby_morning,
  round(coalesce(avg(CASE WHEN h BETWEEN 7 AND 9 THEN num_bikes_available END), 0), 6) AS avg_bikes_morning,
  CAST(coalesce(min(CASE WHEN h BETWEEN 7 AND 9 THEN num_bikes_available END), -1) AS BIGINT) AS least_bikes_morning,
  CAST(coalesce(min(CASE WHEN h BETWEEN 17 AND 19 THEN num_bikes_available END), -1) AS BIGINT) AS least_bikes_evening
FROM bike_pairs p JOIN timed s ON s.station_id = p.bike_id
WHERE p.distance_m <= 3000 AND (h BETWEEN 7 AND 9 OR h BETWEEN 17 AND 19) GROUP BY p.station_id"""


@query("rush_availability_utc", "A-6 A-29 J-5", _NEAR_STATUS.format("'UTC'"))
def rush_availability_utc(t):
    reach = station_features.rush_availability(
        t.transit_stations, latest_info(t.station_info), t.station_status, 3000.0, "UTC"
    )
    stations = unique_stations(t.transit_stations).join(reach, ["lat", "lng"])
    return stations.select(
        "station_id", "nearby_morning",
        F.round(F.coalesce("avg_bikes_morning", F.lit(0.0)), 6).alias("avg_bikes_morning"),
        F.coalesce("least_bikes_morning", F.lit(-1)).alias("least_bikes_morning"),
        F.coalesce("least_bikes_evening", F.lit(-1)).alias("least_bikes_evening"),
    )


@query(
    "trips_near_stations",
    "A-7 J-4 P-14",
    """
SELECT station_id, bike_trip_volume, commuter_trip_volume, round(avg_trip_duration_min, 6) AS avg_trip_duration_min FROM features WHERE bike_trip_volume > 0""",
)
def trips_near_stations(t):
    near = station_features.nearby_trips(t.transit_stations, t.bike_trips)
    return rounded(unique_stations(t.transit_stations).join(near, ["lat", "lng"])).select(
        "station_id", "bike_trip_volume", "commuter_trip_volume", "avg_trip_duration_min"
    )


@query(
    "transit_ridership",
    "A-8",
    """
SELECT start_station_id AS station_id, count(*) AS transit_ridership, count(DISTINCT route_id) AS route_diversity
FROM scheduled WHERE start_station_id IS NOT NULL GROUP BY 1""",
)
def transit_ridership(t):
    return station_features.ridership(scheduled(t))


@query(
    "feature_profile",
    "A-21 M-22",
    "SELECT count(*) AS row_count, count(DISTINCT station_id) AS unique_stations, 15 AS feature_count FROM features",
)
def feature_profile(t):
    return station_features.dataset_profile(features(t))


@query(
    "arrival_pickup_correlation",
    "A-28",
    """
WITH arrivals AS (SELECT end_station_id AS station_id, date_trunc('hour', scheduled_end_time) AS ts_hour, count(*) AS arrivals FROM scheduled
  WHERE scheduled_end_time IS NOT NULL GROUP BY ALL),
starts AS (SELECT start_lat, start_lng, date_trunc('hour', started_at) AS ts_hour, count(*) AS n FROM bike_trips GROUP BY ALL),
spots AS (SELECT DISTINCT start_lat, start_lng FROM starts),
near AS (SELECT m.station_id, s.start_lat, s.start_lng FROM transit_stations m JOIN spots s ON 2 * 6371010.0e0 * asin(sqrt(least(1.0e0, pow(sin(radians(s.start_lat - m.lat) / 2), 2)
    + cos(radians(m.lat)) * cos(radians(s.start_lat)) * pow(sin(radians(s.start_lng - m.lng) / 2), 2)))) <= 800),
pickups AS (SELECT near.station_id, s.ts_hour, sum(n) AS pickups FROM near JOIN starts s ON s.start_lat = near.start_lat AND s.start_lng = near.start_lng GROUP BY ALL),
both_ AS (SELECT coalesce(a.station_id, p.station_id) AS station_id, coalesce(arrivals, 0) AS a, coalesce(pickups, 0) AS p
  FROM arrivals a FULL JOIN pickups p ON a.station_id = p.station_id AND a.ts_hour = p.ts_hour)
SELECT station_id, count(*) AS hours, round(coalesce(corr(a, p), 0), 6) AS correlation FROM both_
WHERE station_id IN (SELECT station_id FROM transit_stations) GROUP BY station_id HAVING count(DISTINCT a) > 1 AND count(DISTINCT p) > 1""",
)
def arrival_pickup_correlation(t):
    found = station_features.arrival_pickup_correlation(t.transit_stations, scheduled(t), t.bike_trips)
    known = found.join(t.transit_stations.select("station_id"), "station_id", "left_semi")
    varying = known.filter(F.col("correlation").isNotNull())
    return varying.withColumn("correlation", F.round("correlation", 6))


@query("station_rule_labels", "M-18", "SELECT station_id, station_label FROM clustered")
def station_rule_labels(t):
    return clusters.label_stations(features(t)).select("station_id", "station_label")


@query(
    "cluster_rule_labels",
    "M-19",
    """
SELECT c.station_id, c.cluster, CASE WHEN s.d > 800 OR s.b < 2 THEN 'Transit Desert' WHEN s.d < 400 AND s.b > 5 THEN 'Well-Served' ELSE 'Moderate Coverage' END AS cluster_label
FROM clustered c JOIN cluster_stats s ON s.cluster = c.cluster""",
)
def cluster_rule_labels(t):
    return clusters.label_clusters(clustered(t)).select("station_id", "cluster", "cluster_label")


@query("cluster_rank_labels", "M-20", "SELECT station_id, cluster, rank_label FROM ranked")
def cluster_rank_labels(t):
    return clusters.label_by_rank(clustered(t)).select("station_id", "cluster", "rank_label")


@query(
    "cluster_profile",
    "A-19 P-30",
    """
SELECT rank_label, count(*) AS stations, round(avg(distance_to_nearest_m), 1) AS mean_distance_m, round(avg(avg_bikes_morning), 1) AS mean_bikes_morning,
  round(avg(avg_bikes_evening), 1) AS mean_bikes_evening, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share_pct FROM ranked GROUP BY rank_label""",
)
def cluster_profile(t):
    return clusters.cluster_profile(clusters.label_by_rank(clustered(t)))


@query(
    "cluster_summary",
    "A-20",
    """
WITH s AS (SELECT cluster, count(*) AS station_count, count(*) FILTER (WHERE station_label = 'Transit Desert') AS desert_count,
    count(*) FILTER (WHERE station_label = 'Well-Served') AS served_count, count(*) FILTER (WHERE station_label = 'Moderate Coverage') AS moderate_count,
    round(avg(distance_to_nearest_m), 3) AS mean_distance_m, round(avg(avg_bikes_morning), 6) AS mean_bikes_morning, round(avg(avg_bikes_evening), 6) AS mean_bikes_evening
  FROM clustered GROUP BY cluster),
n AS (SELECT cluster, string_agg(station_name, ', ' ORDER BY rk) AS example_stations FROM
  (SELECT cluster, station_name, row_number() OVER (PARTITION BY cluster ORDER BY station_id) AS rk FROM clustered) q WHERE rk <= 5 GROUP BY cluster)
SELECT s.*, CASE WHEN desert_count >= served_count AND desert_count >= moderate_count THEN 'Transit Desert' WHEN served_count >= moderate_count THEN 'Well-Served' ELSE 'Moderate Coverage' END AS dominant_label,
  n.example_stations FROM s JOIN n ON n.cluster = s.cluster""",
)
def cluster_summary(t):
    summary = clusters.cluster_summary(clustered(t))
    return rounded(
        summary.withColumn("example_stations", F.concat_ws(", ", "example_stations")),
        {"mean_distance_m": 3, "mean_bikes_morning": 6, "mean_bikes_evening": 6},
    )


@query(
    "most_isolated_stations",
    "K-4",
    """
SELECT station_id, station_name, rank_label, round(distance_to_nearest_m, 3) AS distance_to_nearest_m,
  row_number() OVER (PARTITION BY rank_label ORDER BY distance_to_nearest_m DESC, station_id) AS rank FROM ranked QUALIFY rank <= 10""",
)
def most_isolated_stations(t):
    isolated = clusters.most_isolated(clusters.label_by_rank(clustered(t)), "rank_label")
    return rounded(isolated.select("station_id", "station_name", "rank_label", "distance_to_nearest_m", "rank"))


@query(
    "chosen_cluster_types",
    "P-32",
    "SELECT station_id, rank_label FROM ranked WHERE rank_label IN ('Transit Desert', 'Well-Served')",
)
def chosen_cluster_types(t):
    chosen = clusters.of_types(clusters.label_by_rank(clustered(t)), [clusters.DESERT, clusters.SERVED])
    return chosen.select("station_id", "rank_label")


@query(
    "percentile_labels",
    "A-30",
    """
WITH q AS (SELECT quantile_cont(distance_to_nearest_m, 0.25) AS d0, quantile_cont(distance_to_nearest_m, 0.75) AS d1,
  quantile_cont(avg_bikes_morning, 0.25) AS b0, quantile_cont(avg_bikes_morning, 0.75) AS b1 FROM features)
SELECT station_id, CASE WHEN distance_to_nearest_m > d1 OR avg_bikes_morning < b0 THEN 'Transit Desert'
  WHEN distance_to_nearest_m < d0 AND avg_bikes_morning > b1 THEN 'Well-Served' ELSE 'Moderate Coverage' END AS percentile_label FROM features CROSS JOIN q""",
)
def percentile_labels(t):
    return clusters.classify_by_percentile(stored_features(t)).select("station_id", "percentile_label")


@query(
    "latest_cluster_run",
    "J-13 U-2 M-21 S-9",
    "SELECT station_id, cluster, round(distance_to_nearest_m, 3) AS distance_to_nearest_m FROM clustered",
)
def latest_cluster_run(t):
    """Two runs appended, the second one twice, and one that crashed: the later complete one is read."""
    return rounded(keyed.latest_run(tables.read_runs(t.spark, _run_tables(t)[0]))).select(
        "station_id", "cluster", "distance_to_nearest_m"
    )


def _run_tables(t):
    """Paths of the run table and of its registry."""
    runs, registry = scratch_dir(t.spark, "runs"), scratch_dir(t.spark, "registry")
    labelled = cut_lineage(clusters.label_clusters(clustered(t)))
    profile = station_features.dataset_profile(labelled)
    for run_id, shift in (("run_2023z", 1), (RUN_ID, 0), (RUN_ID, 5)):
        rows = labelled.withColumn("cluster", F.col("cluster") + shift)
        if tables.append_run(rows, runs, run_id):
            tables.append_run(profile.withColumn("clusters", F.lit(shift)), registry, run_id)
    # a run without its end mark
    crashed = labelled.withColumn("cluster", F.lit(-1)).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    crashed.parquet(f"{runs}/run_id=run_9999z")
    return runs, registry


@query(
    "runs_with_registry",
    "M-21 M-22 S-9",
    """
SELECT r.run_id, count(*) AS stations, CAST(min(f.cluster) + r.shift AS BIGINT) AS least, (SELECT count(*) FROM clustered) AS row_count, (SELECT count(DISTINCT station_id) FROM clustered) AS unique_stations
FROM clustered f, (SELECT unnest(['run_2023z', 'RUN']) AS run_id, unnest([1, 0]) AS shift) r GROUP BY r.run_id, r.shift""".replace("'RUN'", f"'{RUN_ID}'"),
)
def runs_with_registry(t):
    """Every complete run with its registry row; repeated and crashed appends leave no trace."""
    runs, registry = _run_tables(t)
    rows = tables.read_runs(t.spark, runs).groupBy("run_id").agg(
        F.count("*").alias("stations"), F.min("cluster").cast("long").alias("least")
    )
    known = tables.read_runs(t.spark, registry).select("run_id", "row_count", "unique_stations")
    return rows.join(known, "run_id")


@query(
    "connectivity_scores",
    "M-24",
    """
WITH m AS (SELECT avg(distance_to_nearest_m) m1, stddev_pop(distance_to_nearest_m) s1, avg(bikes_within_near) m2, stddev_pop(bikes_within_near) s2, avg(avg_bikes_morning) m3, stddev_pop(avg_bikes_morning) s3,
  avg(avg_bikes_evening) m4, stddev_pop(avg_bikes_evening) s4, avg(bike_trip_volume) m5, stddev_pop(bike_trip_volume) s5, avg(route_diversity) m6, stddev_pop(route_diversity) s6 FROM features)
SELECT station_id, station_name, round((CASE WHEN s1 > 0 THEN -(distance_to_nearest_m - m1) / s1 ELSE 0 END + CASE WHEN s2 > 0 THEN (bikes_within_near - m2) / s2 ELSE 0 END
  + CASE WHEN s3 > 0 THEN (avg_bikes_morning - m3) / s3 ELSE 0 END + CASE WHEN s4 > 0 THEN (avg_bikes_evening - m4) / s4 ELSE 0 END
  + CASE WHEN s5 > 0 THEN (bike_trip_volume - m5) / s5 ELSE 0 END + CASE WHEN s6 > 0 THEN (route_diversity - m6) / s6 ELSE 0 END) / 6, 5) AS connectivity_score FROM features, m""",
)
def connectivity_scores(t):
    return rounded(station_features.connectivity_score(stored_features(t)), {"connectivity_score": 5})


@query(
    "dock_priorities",
    "K-8",
    """
SELECT station_id, station_name, transit_ridership, round(distance_to_nearest_m, 3) AS distance_to_nearest_m FROM features WHERE is_isolated = 1
ORDER BY transit_ridership DESC, features.distance_to_nearest_m DESC, station_id LIMIT 20""",
)
def dock_priorities(t):
    return rounded(station_features.dock_priorities(features(t), 20))


@query(
    "cluster_feature_importance",
    "M-23",
    """
WITH long AS (UNPIVOT (SELECT cluster, CAST(distance_to_nearest_m AS DOUBLE) AS distance_to_nearest_m, CAST(bikes_within_near AS DOUBLE) AS bikes_within_near, CAST(nearby_morning AS DOUBLE) AS nearby_morning,
    CAST(avg_bikes_morning AS DOUBLE) AS avg_bikes_morning, CAST(nearby_evening AS DOUBLE) AS nearby_evening, CAST(avg_bikes_evening AS DOUBLE) AS avg_bikes_evening, CAST(bike_trip_volume AS DOUBLE) AS bike_trip_volume,
    CAST(transit_ridership AS DOUBLE) AS transit_ridership, CAST(is_isolated AS DOUBLE) AS is_isolated, CAST(has_low_morning_availability AS DOUBLE) AS has_low_morning_availability FROM clustered)
  ON COLUMNS(* EXCLUDE cluster) INTO NAME feature VALUE v),
per AS (SELECT feature, cluster, count(*) AS n, avg(v) AS mean FROM long GROUP BY ALL),
whole AS (SELECT feature, avg(v) AS mean, var_pop(v) * count(*) AS total FROM long GROUP BY feature)
SELECT w.feature, round(coalesce(sum(p.n * pow(p.mean - w.mean, 2)) / nullif(any_value(w.total), 0), 0), 5) AS importance
FROM whole w JOIN per p ON p.feature = w.feature GROUP BY w.feature""",
)
def cluster_feature_importance(t):
    return rounded(clusters.feature_importance(clustered(t)), {"importance": 5})


@query("kmeans_clusters", "M-17 M-19 M-21")
def kmeans_clusters(t):
    stored = stored_features(t)
    model, _ = clusters.kmeans(stored)
    return rounded(clusters.run_table(clusters.label_clusters(clusters.assign(model, stored)), RUN_ID))


@query(
    "kmeans_nearest_centres",
    "M-17",
    "SELECT count(*) AS stations, count(*) AS at_nearest_centre FROM features",
)
def kmeans_nearest_centres(t):
    """Stations whose cluster is the one with the nearest centre: all of them."""
    stored = stored_features(t)
    model, _ = clusters.kmeans(stored)
    scaled = model.transform(stored.fillna(0, clusters.CLUSTER_FEATURES)).withColumn("x", vector_to_array("_scaled"))
    gaps = [
        F.aggregate(
            F.zip_with("x", F.array(*[F.lit(float(v)) for v in centre]), lambda a, b: (a - b) * (a - b)),
            F.lit(0.0), lambda total, d: total + d,
        )
        for centre in model.stages[-1].clusterCenters()
    ]
    own = F.get(F.array(*gaps), F.col("cluster"))
    return scaled.agg(
        F.count("*").alias("stations"), F.count_if(own <= F.least(*gaps) + 1e-9).alias("at_nearest_centre")
    )


@query("training_run_registry", "M-21 M-22")
def training_run_registry(t):
    """The registry row of a clustering run, with parameters and metrics as JSON text."""
    stored = stored_features(t)
    model, inertia = clusters.kmeans(stored)
    labelled = clusters.label_stations(clusters.assign(model, stored))
    return registry.training_run_row(
        clusters.cluster_summary(labelled), RUN_ID, MODEL["model_id"], "stations-2024a",
        {"algorithm": "kmeans", "n_clusters": "3", "model_type": "unsupervised_clustering"},
        inertia, "station_clusters", AS_OF,
    )


@query(
    "dataset_registry",
    "M-22 A-21",
    """
SELECT 'stations-2024a' AS dataset_id, 'station-clusters' AS model_id, '2024a' AS data_version, 'station_features' AS path, count(*) AS row_count, 15 AS feature_count,
  TIMESTAMP '2024-01-31 00:00:00' AS created_at FROM features""",
)
def dataset_registry(t):
    profile = station_features.dataset_profile(features(t))
    return registry.dataset_row(
        profile, "stations-2024a", MODEL["model_id"], "2024a", "station_features", AS_OF
    )


@query(
    "model_registry",
    "M-22",
    """
SELECT 'station-clusters' AS model_id, 'Station clusters' AS name, 'Which stations lack a last mile' AS business_problem, '1' AS ticket_number, 'analytics' AS owner,
  max(snapshot_ts) AS created_at FROM station_info""",
)
def model_registry(t):
    newest = t.station_info.agg(F.max("snapshot_ts").alias("newest"))
    return registry.model_row(newest, MODEL, F.col("newest"))
