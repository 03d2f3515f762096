"""Station clusters: standardised K-means, the three label rules and their reports."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curbline.operators import keyed, percentiles
from curbline.session import side_by_side

DESERT, MODERATE, SERVED = "Transit Desert", "Moderate Coverage", "Well-Served"
LABELS = [DESERT, SERVED, MODERATE]  # order in which a tied count is settled

# Fixed values of the label rules.
FAR_M, CLOSE_M = 800, 400
FEW_BIKES, MANY_BIKES = 2, 5
MEAN_PLACES = 6  # means that agree to this many places tie

CLUSTER_FEATURES = [
    "distance_to_nearest_m", "bikes_within_near", "nearby_morning", "avg_bikes_morning",
    "nearby_evening", "avg_bikes_evening", "bike_trip_volume", "transit_ridership",
    "is_isolated", "has_low_morning_availability",
]


def kmeans(
    features: DataFrame, k: int = 3, seed: int = 42, starts: int = 10
) -> tuple[PipelineModel, float]:
    """The best of ``starts`` fits on standardised features, and its inertia.

    ``features`` is read many times: pass a stored or checkpointed table. The
    inertia is given for scaling by the population deviation.
    """
    prepare = Pipeline(
        stages=[
            VectorAssembler(inputCols=CLUSTER_FEATURES, outputCol="_raw"),
            StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True),
        ]
    )
    filled = features.fillna(0, CLUSTER_FEATURES)
    scaling = prepare.fit(filled)
    scaled = scaling.transform(filled).select("_scaled").persist()
    try:
        seeds = range(seed, seed + starts)
        jobs = {
            str(number): partial(
                KMeans(k=k, seed=number, featuresCol="_scaled", predictionCol="cluster").fit, scaled
            )
            for number in seeds
        }
        fits = side_by_side(features.sparkSession, jobs)
        best = min((fits[str(number)] for number in seeds), key=lambda fit: fit.summary.trainingCost)
        rows = scaled.count()
    finally:
        scaled.unpersist()
    inertia = best.summary.trainingCost * rows / max(rows - 1, 1)
    return PipelineModel(stages=[*scaling.stages, best]), inertia


def assign(model: PipelineModel, features: DataFrame) -> DataFrame:
    return model.transform(features.fillna(0, CLUSTER_FEATURES)).drop("_raw", "_scaled")


def _rule(distance: Column, bikes: Column) -> Column:
    return (
        F.when((distance > FAR_M) | (bikes < FEW_BIKES), DESERT)
        .when((distance < CLOSE_M) & (bikes > MANY_BIKES), SERVED)
        .otherwise(MODERATE)
    )


def label_stations(df: DataFrame, label: str = "station_label") -> DataFrame:
    """Label every station by its own distance and morning bikes."""
    return df.withColumn(label, _rule(F.col("distance_to_nearest_m"), F.col("avg_bikes_morning")))


def cluster_means(df: DataFrame) -> DataFrame:
    return df.groupBy("cluster").agg(
        F.count("*").alias("stations"),
        F.avg("distance_to_nearest_m").alias("mean_distance_m"),
        F.avg("avg_bikes_morning").alias("mean_bikes_morning"),
        F.avg("avg_bikes_evening").alias("mean_bikes_evening"),
    )


def label_clusters(df: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Label every station by the means of its cluster."""
    labels = cluster_means(df).select(
        "cluster", _rule(F.col("mean_distance_m"), F.col("mean_bikes_morning")).alias(label)
    )
    return df.join(F.broadcast(labels), "cluster", "left")  # k rows


def label_by_rank(df: DataFrame, label: str = "rank_label") -> DataFrame:
    """Label clusters by mean distance, farthest first; from the fourth on there is no label.

    The ranking sees one row per cluster. Means that agree to ``MEAN_PLACES`` places tie and the smaller number comes
    first, so the order in which distances are added up does not matter.
    """
    order = Window.orderBy(F.desc(F.round("mean_distance_m", MEAN_PLACES)), F.asc("cluster"))
    rank = F.row_number().over(order)
    labels = cluster_means(df).select(
        "cluster", F.when(rank == 1, DESERT).when(rank == 2, MODERATE).when(rank == 3, SERVED).alias(label)
    )
    return df.join(F.broadcast(labels), "cluster", "left")  # k rows


def cluster_profile(df: DataFrame, label: str = "rank_label") -> DataFrame:
    """Stations, means to one decimal and share of all stations, per label."""
    profile = df.groupBy(label).agg(
        F.count("*").alias("stations"),
        F.round(F.avg("distance_to_nearest_m"), 1).alias("mean_distance_m"),
        F.round(F.avg("avg_bikes_morning"), 1).alias("mean_bikes_morning"),
        F.round(F.avg("avg_bikes_evening"), 1).alias("mean_bikes_evening"),
    )
    return keyed.with_share(profile, "stations")


def cluster_summary(df: DataFrame, label: str = "station_label", examples: int = 5) -> DataFrame:
    """Per cluster: label counts, the dominant label, means and the first few station names."""
    counts = {
        name: F.count_if(F.col(label) == value).alias(name)
        for name, value in (("desert_count", DESERT), ("served_count", SERVED), ("moderate_count", MODERATE))
    }
    stats = df.groupBy("cluster").agg(
        F.count("*").alias("station_count"),
        *counts.values(),
        F.avg("distance_to_nearest_m").alias("mean_distance_m"),
        F.avg("avg_bikes_morning").alias("mean_bikes_morning"),
        F.avg("avg_bikes_evening").alias("mean_bikes_evening"),
    )
    most = F.greatest(*counts)
    dominant = reduce(
        lambda otherwise, pair: F.when(F.col(pair[0]) == most, pair[1]).otherwise(otherwise),
        reversed(list(zip(counts, LABELS))),
        F.lit(None).cast("string"),
    )
    first = keyed.top_k_per_group(
        df.select("cluster", "station_id", "station_name"), ["cluster"], examples, F.asc("station_id")
    )
    names = first.groupBy("cluster").agg(
        F.sort_array(F.collect_list(F.struct("rank", "station_name"))).alias("_names")
    )
    return (
        stats.withColumn("dominant_label", dominant)
        .join(names, "cluster")
        .withColumn("example_stations", F.col("_names.station_name"))
        .drop("_names")
    )


def most_isolated(df: DataFrame, label: str, k: int = 10) -> DataFrame:
    """The ``k`` farthest stations of every label."""
    return keyed.top_k_per_group(
        df, [label], k, F.desc("distance_to_nearest_m"), F.asc("station_id")
    )


def of_types(df: DataFrame, chosen: list[str], label: str = "rank_label") -> DataFrame:
    return df.filter(F.col(label).isin(*chosen))


def classify_by_percentile(df: DataFrame, low: float = 0.25, high: float = 0.75) -> DataFrame:
    """Labels from the data's own quartiles instead of fixed thresholds. ``df`` should be a stored table."""

    def cuts(column: str, width: float) -> Column:
        return percentiles.exact_percentiles(df, column, [low, high], width).scalar()

    staged = df.withColumns({"_d": cuts("distance_to_nearest_m", 1.0), "_b": cuts("avg_bikes_morning", 0.1)})
    distance, bikes = F.col("distance_to_nearest_m"), F.col("avg_bikes_morning")
    label = (
        F.when((distance > F.col("_d")[1]) | (bikes < F.col("_b")[0]), DESERT)
        .when((distance < F.col("_d")[0]) & (bikes > F.col("_b")[1]), SERVED)
        .otherwise(MODERATE)
    )
    return staged.withColumn("percentile_label", label).drop("_d", "_b")


def feature_importance(df: DataFrame, columns: list[str] = CLUSTER_FEATURES) -> DataFrame:
    """Share of each feature's variance that lies between the clusters."""
    per_cluster = df.groupBy("cluster").agg(
        F.count("*").alias("n"),
        *[F.sum(c).cast("double").alias(f"s_{c}") for c in columns],
        *[F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q_{c}") for c in columns],
    )
    long = per_cluster.select(
        "n",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("feature"), F.col(f"s_{c}").alias("s"), F.col(f"q_{c}").alias("q"))
                    for c in columns
                ]
            )
        ),
    )
    centre = F.sum("s") * F.sum("s") / F.sum("n")
    between = F.sum(F.col("s") * F.col("s") / F.col("n")) - centre
    return long.groupBy("feature").agg(
        F.coalesce(F.try_divide(between, F.sum("q") - centre), F.lit(0.0)).alias("importance")
    )


def run_table(df: DataFrame, run_id: str) -> DataFrame:
    """The columns that are appended to the cluster table for a run."""
    return df.select(
        "station_id", "station_name", "lat", "lng", "cluster", "cluster_label",
        "distance_to_nearest_m", "avg_bikes_morning", "avg_bikes_evening",
        F.lit(run_id).alias("run_id"),
    )
