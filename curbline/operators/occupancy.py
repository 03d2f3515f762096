"""Vehicle occupancy: features, time split, classifiers, evaluation and scoring."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, IndexToString, StandardScaler, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import places, text, times
from curbline.operators.boosting import BoostedClassifier, fit_boosted
from curbline.operators.network import fit_network
from curbline.session import side_by_side, spread_out

# Split days, iterations, depth, parallel trees and layer sizes.
EVAL_DAYS, TRAIN_DAYS = 7, 67
MAX_ITERATIONS = 50
TREE_DEPTH, PARALLEL_TREES = 6, 4
HIDDEN_LAYERS = [64, 32]

BOOST_ROUNDS, FOREST_TREES = 20, 20  # defaults of this library
FOREST_SHARES = 8  # equal rows are drawn one by one up to this number, and in so many equal shares above it

INPUTS = ["route_id", "current_status", "hour_of_day", "day_of_week", "is_weekend", "lat_bin", "lon_bin"]
HASH_SLOTS = 128
SEED = 42


def feature_columns(
    status: Column, route: Column, ts: Column, lat: Column, lon: Column
) -> list[Column]:
    """The model inputs. Training and serving both use this, so they cannot drift apart."""
    weekday = F.dayofweek(ts)
    return [
        route.alias("route_id"),
        status.alias("current_status"),
        F.hour(ts).alias("hour_of_day"),
        weekday.alias("day_of_week"),
        F.when(weekday.isin(1, 7), 1).otherwise(0).alias("is_weekend"),
        places.coordinate_bin(lat).alias("lat_bin"),
        places.coordinate_bin(lon).alias("lon_bin"),
    ]


def occupancy_features(positions: DataFrame) -> DataFrame:
    """Labelled feature rows of vehicles inside the service area."""
    ts = F.col("observed_at_utc")
    lat, lon = F.col("latitude"), F.col("longitude")
    return positions.filter(F.col("occupancy_status").isNotNull() & places.in_box(lat, lon)).select(
        text.normal_label(F.col("occupancy_status")).alias("label"),
        *feature_columns(F.col("current_status"), F.col("route_id"), ts, lat, lon),
        ts.alias("ts"),
    )


def serving_features(requests: DataFrame, route_centres: DataFrame) -> DataFrame:
    """Model inputs for ``route_id, current_status, ts`` requests, placed at the route's centre."""
    lat, lon = places.DEFAULT_BIN
    placed = requests.withColumn("route_key", F.lower("route_id")).join(route_centres, "route_key", "left")
    return placed.select(
        *feature_columns(
            F.col("current_status"),
            F.col("route_id"),
            F.col("ts"),
            F.coalesce("lat", F.lit(lat)),
            F.coalesce("lng", F.lit(lon)),
        )
    )


def train_rows(features: DataFrame, as_of: str | Column) -> DataFrame:
    """From 67 days before ``as_of``, included, to 7 days before, excluded."""
    ts = F.col("ts")
    return features.filter(times.since(ts, as_of, TRAIN_DAYS) & times.before(ts, as_of, EVAL_DAYS)).drop("ts")


def eval_rows(features: DataFrame, as_of: str | Column) -> DataFrame:
    """The last 7 days before ``as_of``; later rows are not known then."""
    ts = F.col("ts")
    return features.filter(times.since(ts, as_of, EVAL_DAYS) & times.until(ts, as_of)).drop("ts")


def with_class_weights(rows: DataFrame, weight: str = "weight") -> DataFrame:
    """Weight rows so that every label counts the same: N / (labels * rows of the label)."""
    counts = rows.groupBy("label").agg(F.count("*").alias("_n"))
    totals = counts.agg(F.struct(F.sum("_n").alias("rows"), F.count("*").alias("labels"))).scalar()
    weights = counts.withColumn("_t", totals).select(
        "label", (F.col("_t.rows") / (F.col("_t.labels") * F.col("_n"))).alias(weight)
    )
    # One row per label, and labels are a short fixed list of seat levels.
    return rows.join(F.broadcast(weights), "label")


def _prepare() -> list:
    return [
        StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="error"),
        FeatureHasher(
            inputCols=INPUTS,
            numFeatures=HASH_SLOTS,
            outputCol="_hashed",
        ),
        StandardScaler(inputCol="_hashed", outputCol="features"),
    ]


def counted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values of ``columns`` with their number of rows ``n``: all that a model can tell apart."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def fit_classifiers(
    rows: DataFrame, names: list[str] | None = None, rounds: int = BOOST_ROUNDS, trees: int = PARALLEL_TREES,
    forest: int = FOREST_TREES,
) -> dict[str, PipelineModel | BoostedClassifier]:
    """Fit the classifier families on weighted rows; ``rows`` should be a stored table.

    ``lr`` logistic regression, ``bt`` boosted trees over all labels (``rounds`` rounds of ``trees`` parallel trees per
    label), ``rf`` a forest of ``forest`` trees, ``dnn`` a neural network. All give a probability per label. Boosting
    bins its inputs; for the others route and status are hashed into slots, and the other inputs are numbers. Every
    family is fitted on distinct rows and their numbers, so its many passes do not grow with equal rows.
    """
    wanted = names or ["lr", "bt", "rf", "dnn"]
    out: dict[str, PipelineModel | BoostedClassifier] = {}
    if "bt" in wanted:
        out["bt"] = fit_boosted(rows, INPUTS, rounds, trees, TREE_DEPTH)
    others = [n for n in wanted if n != "bt"]
    if not others:
        return out
    prepared = Pipeline(stages=_prepare()).fit(rows)
    labels = prepared.stages[0].labels
    common = {"labelCol": "label_index", "featuresCol": "features"}
    families = {
        "lr": lambda: LogisticRegression(
            family="multinomial", maxIter=MAX_ITERATIONS, weightCol="weight", **common
        ).fit(ready.withColumn("weight", F.col("weight") * F.col("n"))),
        "rf": lambda: RandomForestClassifier(
            numTrees=forest, maxDepth=TREE_DEPTH, weightCol="weight", seed=SEED, **common
        ).fit(
            ready.withColumn("weight", F.col("weight") * F.col("n") / shares).withColumn("_share", F.explode(F.sequence(F.lit(1), shares)))
        ),
        "dnn": lambda: fit_network(ready, HIDDEN_LAYERS, len(labels), MAX_ITERATIONS, SEED),
    }
    shares = F.least(F.col("n"), F.lit(FOREST_SHARES)).cast("int")
    cells = counted(rows, [*INPUTS, "label", "weight"])
    ready = spread_out(prepared.transform(cells).drop("_hashed")).persist()
    back = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=labels)
    try:
        fitted = side_by_side(rows.sparkSession, {name: families[name] for name in others})
    finally:
        ready.unpersist()
    # Labels are indexed for the fit only: scoring neither needs them nor drops rows with unseen ones.
    out |= {name: PipelineModel(stages=[*prepared.stages[1:], fit, back]) for name, fit in fitted.items()}
    return {name: out[name] for name in wanted}


def predict(model: PipelineModel | BoostedClassifier, rows: DataFrame) -> DataFrame:
    """Predicted label and ``probability`` (an array, one number per label) per row, whatever its own label is."""
    kept = [c for c in rows.columns]
    if isinstance(model, BoostedClassifier):
        scored = model.predict(rows)
    else:
        scored = model.transform(rows).withColumn("probability", vector_to_array("probability"))
    return scored.select(*kept, "predicted_label", "probability")


def labels_of(model: PipelineModel | BoostedClassifier) -> list[str]:
    return model.labels if isinstance(model, BoostedClassifier) else model.stages[-1].getLabels()


def label_probabilities(model: PipelineModel | BoostedClassifier, scored: DataFrame) -> DataFrame:
    """One row per input row and label with its probability."""
    labels = F.array(*[F.lit(label) for label in labels_of(model)])
    pairs = F.arrays_zip(labels.alias("label"), F.col("probability").alias("prob"))
    kept = [c for c in scored.columns if c not in ("probability", "label")]
    return scored.select(*kept, F.inline(pairs).alias("class_label", "prob"))


def confusion(predictions: DataFrame) -> DataFrame:
    """Rows per model, true and predicted label; a row with a number ``n`` counts so often."""
    number = F.sum("n") if "n" in predictions.columns else F.count("*")
    return predictions.groupBy("model", "label", "predicted_label").agg(number.alias("n"))


def classification_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy and label-averaged precision, recall and F1 per model, from confusion counts."""
    hit = F.when(F.col("label") == F.col("predicted_label"), F.col("n")).otherwise(0)
    by_true = counts.groupBy("model", "label").agg(F.sum("n").alias("actual"), F.sum(hit).alias("hits"))
    by_guess = counts.groupBy("model", F.col("predicted_label").alias("label")).agg(
        F.sum("n").alias("guessed")
    )
    per_label = by_true.join(by_guess, ["model", "label"], "full").fillna(0, ["actual", "hits", "guessed"])
    precision = F.coalesce(F.try_divide("hits", "guessed"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("hits", "actual"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return per_label.groupBy("model").agg(
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
        F.avg(precision).alias("precision"),
        F.avg(recall).alias("recall"),
        F.avg(f1).alias("f1_score"),
        F.sum("actual").alias("rows"),
    )


def evaluate(models: dict[str, PipelineModel | BoostedClassifier], rows: DataFrame) -> DataFrame:
    """One metrics row per model over the same rows; equal rows are scored once."""
    cells = counted(rows, [*INPUTS, "label"])
    parts = [
        predict(model, cells).select(F.lit(name).alias("model"), "label", "predicted_label", "n")
        for name, model in models.items()
    ]
    return classification_metrics(confusion(reduce(DataFrame.unionByName, parts)))
