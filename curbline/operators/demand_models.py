"""Demand regression: training, scoring, selection and the predicted tables."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import times
from curbline.operators import forecast, keyed
from curbline.operators.boosting import BoostedRegressor, fit_boosted_regression
from curbline.operators.linear import LinearFit, fit_linear
from curbline.session import cut_lineage, side_by_side, spread_out

BOOSTING_ROUNDS = 30  # fixed value
FOREST_TREES, FOREST_DEPTH, BOOSTED_DEPTH = 20, 6, 4  # defaults of this library
FOREST_SHARES = 8
CALENDAR = ["day_of_week", "hour", "is_weekend"]
NUMERIC = ["station_mean", "station_hour_mean", *CALENDAR]
SCORED_KEY = ["station_id", *CALENDAR]
SMOOTHING = 5.0
SEED = 42
LINEAR, FOREST, BOOSTED, SERIES = "linreg", "random_forest", "boosted_tree", "seasonal_ar"


def split_by_time(features: DataFrame, holdout_days: int) -> tuple[DataFrame, DataFrame]:
    """Rows before the last ``holdout_days`` days, and the rows in them."""
    cut = F.timestamp_add("DAY", F.lit(-holdout_days), features.agg(F.max("ts_hour")).scalar())
    return features.filter(F.col("ts_hour") < cut), features.filter(F.col("ts_hour") >= cut)


def station_means(train: DataFrame, label: str, prior: float = SMOOTHING) -> DataFrame:
    """Mean label per station and hour of day, pulled towards the station's and the overall mean.

    A numeric stand-in for the station id that works for any number of stations.
    """
    cells = train.groupBy("station_id", "hour").agg(F.sum(label).alias("s"), F.count("*").alias("n"))
    overall = cells.agg(F.sum("s") / F.sum("n")).scalar()
    stations = (
        cells.groupBy("station_id")
        .agg(F.sum("s").alias("ss"), F.sum("n").alias("sn"))
        .withColumn("overall", overall)
        .select(
            "station_id",
            ((F.col("ss") + prior * F.col("overall")) / (F.col("sn") + prior)).alias("station_mean"),
        )
    )
    return cells.join(stations, "station_id").select(
        "station_id",
        "hour",
        "station_mean",
        ((F.col("s") + prior * F.col("station_mean")) / (F.col("n") + prior)).alias("station_hour_mean"),
    )


def model_frame(rows: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """Model inputs: calendar columns plus the station means of the training rows.

    A pair of station and hour without training rows falls back to the station, then to the overall mean.
    """
    means = station_means(train, label)
    stations = means.select("station_id", F.col("station_mean").alias("_station")).distinct()
    overall = train.agg(F.avg(label)).scalar()
    return (
        rows.join(means.drop("station_mean"), ["station_id", "hour"], "left")
        .join(stations, "station_id", "left")
        .withColumn("station_mean", F.coalesce("_station", overall, F.lit(0.0)))
        .withColumn("station_hour_mean", F.coalesce("station_hour_mean", "station_mean"))
        .withColumn("y_true", F.col(label).cast("double"))
        .drop("_station")
    )


Model = PipelineModel | LinearFit | BoostedRegressor


def fit_families(
    frame: DataFrame, names: list[str] | None = None, trees: int = FOREST_TREES, forest_depth: int = FOREST_DEPTH,
    rounds: int = BOOSTING_ROUNDS, boosted_depth: int = BOOSTED_DEPTH,
) -> dict[str, Model]:
    """Fit the regression families side by side. ``frame`` is read many times: pass a persisted one.

    The linear model has one exact coefficient per station and input. Trees see a station by its means, so no list of
    ids is built. The forest is fitted on distinct rows of its inputs and the number, which it draws one by one up to
    ``FOREST_SHARES`` equal ones, and in so many equal shares above.
    """
    shares = F.least(F.col("n"), F.lit(FOREST_SHARES)).cast("int")
    cells = frame.groupBy(*NUMERIC, "y_true").agg(F.count(F.lit(1)).alias("n"))
    drawn = cells.select(
        *NUMERIC, "y_true", (F.col("n") / shares).alias("_weight"), F.explode(F.sequence(F.lit(1), shares)).alias("_share")
    )
    forest = Pipeline(stages=[
        VectorAssembler(inputCols=NUMERIC, outputCol="_numeric"),
        RandomForestRegressor(
            predictionCol=FOREST, numTrees=trees, maxDepth=forest_depth, featuresCol="_numeric", labelCol="y_true", seed=SEED,
            weightCol="_weight",
        ),
    ])
    jobs = {
        LINEAR: partial(fit_linear, frame, "station_id", CALENDAR, "y_true", LINEAR),
        FOREST: lambda: forest.fit(spread_out(drawn)),
        BOOSTED: partial(fit_boosted_regression, frame, NUMERIC, "y_true", rounds, depth=boosted_depth),
    }
    return side_by_side(frame.sparkSession, {name: jobs[name] for name in (names or list(jobs))})


def score(models: dict[str, Model], frame: DataFrame) -> DataFrame:
    """One prediction column per family."""
    for name, model in models.items():
        if isinstance(model, BoostedRegressor):
            frame = model.predict(frame, name)
        else:
            frame = model.transform(frame).drop("_numeric")
    return frame


def score_keys(models: dict[str, Model], rows: DataFrame, train: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``y_true`` and one prediction column per family, which know a row by its station and calendar only:
    each such key is scored once, and rows take their key's predictions."""
    keys = rows.select(*SCORED_KEY).distinct().withColumn(label, F.lit(None).cast("double"))
    asked = spread_out(model_frame(keys, train, label))
    scored = cut_lineage(score(models, asked).select(*SCORED_KEY, *models))
    same = reduce(lambda a, b: a & b, [rows[c].eqNullSafe(scored[c]) for c in SCORED_KEY])
    found = rows.join(scored, same, "left").select(rows["*"], *[scored[n] for n in models])
    return found.withColumn("y_true", F.col(label).cast("double"))


def long_predictions(scored: DataFrame, names: list[str], extra: list[str]) -> DataFrame:
    """One row per model and scored row: ``model_name, y_true, y_pred``."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias("model_name"), F.col(n).cast("double").alias("y_pred")) for n in names]
    )
    return scored.select(*extra, "y_true", F.inline(pairs))


def root_mean_square(y_true: Column, y_pred: Column) -> Column:
    return F.sqrt(F.avg(F.pow(y_true - y_pred, F.lit(2))))


def model_rmse(predictions: DataFrame) -> DataFrame:
    """Root mean square error per model over its rows."""
    return predictions.groupBy("model_name").agg(
        root_mean_square(F.col("y_true"), F.col("y_pred")).alias("rmse")
    )


def group_weighted_rmse(predictions: DataFrame, group: list[str]) -> DataFrame:
    """The error after joining predictions back on a key that repeats.

    A group of n rows then gives n * n pairs. With the same prediction for all
    rows of a group the result is ``sqrt(sum(n * sse) / sum(n * n))``, which
    needs no join.
    """
    error = F.pow(F.col("y_true") - F.col("y_pred"), F.lit(2))
    sizes = predictions.groupBy("model_name", *group).agg(
        F.count("*").alias("n"), F.sum(error).alias("sse")
    )
    n = F.col("n").cast("double")
    return sizes.groupBy("model_name").agg(F.sqrt(F.sum(n * F.col("sse")) / F.sum(n * n)).alias("rmse"))


def union_metrics(tables: dict[str, DataFrame], tag: str = "model_name") -> DataFrame:
    """Metric tables one below the other, each with its model's name."""
    tagged = [table.select(F.lit(name).alias(tag), "*") for name, table in tables.items()]
    result = tagged[0]
    for table in tagged[1:]:
        result = result.unionByName(table, allowMissingColumns=True)
    return result


def select_best(metrics: DataFrame) -> DataFrame:
    """The model or models with the least error.

    The errors are stored first: the least of them and the rows it is compared with are two readings, and sums that
    are added up anew may differ in their last places, which would leave no model.
    """
    return keyed.keep_minimum(cut_lineage(metrics), "rmse")


def mean_predictor(rows: DataFrame, train: DataFrame, label: str, keys: list[str], output: str) -> DataFrame:
    """Baseline: the training mean per key, 0 for an unseen key."""
    means = train.groupBy(*keys).agg(F.avg(label).alias(output))
    return rows.join(means, keys, "left").withColumn(output, F.coalesce(output, F.lit(0.0)))


def predicted_table(scored: DataFrame, prediction: str, output: str) -> DataFrame:
    """Mean prediction per station, weekday, hour and weekend flag."""
    return scored.groupBy("station_id", "day_of_week", "hour", "is_weekend").agg(
        F.min("station_name").alias("station_name"), F.avg(prediction).alias(output)
    )


def next_hours(as_of: str | Column, horizon: int) -> Column:
    """The weekday and hour of each of the next ``horizon`` hours."""
    start = times.hour_floor(times.as_instant(as_of))
    return F.transform(
        F.sequence(F.lit(1), F.lit(horizon)),
        lambda step: F.struct(
            step.alias("step"),
            F.dayofweek(F.timestamp_add("HOUR", step, start)).alias("day_of_week"),
            F.hour(F.timestamp_add("HOUR", step, start)).alias("hour"),
        ),
    )


def top_predicted(
    predicted: DataFrame, value: str, as_of: str | Column, horizons: tuple[int, ...] = (1, 4, 24), k: int = 10
) -> DataFrame:
    """Stations with the most predicted demand over the next hours, for each horizon.

    The next hours form an array of at most a day, in which each predicted row
    finds its own steps; no join is needed.
    """
    longest = max(horizons)
    matching = F.filter(
        next_hours(as_of, longest),
        lambda slot: (slot["day_of_week"] == F.col("day_of_week")) & (slot["hour"] == F.col("hour")),
    )
    stepped = predicted.select("station_id", "station_name", value, F.inline(matching)).select(
        "station_id", "station_name", value, "step",
        F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon_hours"),
    )
    totals = (
        stepped.filter(F.col("step") <= F.col("horizon_hours"))
        .groupBy("horizon_hours", "station_id")
        .agg(F.min("station_name").alias("station_name"), F.round(F.sum(value), 6).alias("demand"))
    )
    return keyed.top_k_per_group(totals, ["horizon_hours"], k, F.desc("demand"), F.asc("station_id"))


def compare_families(
    features: DataFrame, label: str, holdout_days: int = 28
) -> tuple[dict[str, Model], DataFrame]:
    """Fit all families on the earlier rows and score all rows, the series model included.

    Returns the fitted models and the scored rows; ``holdout`` marks the later ones, on which errors
    are to be compared. ``features`` should be a stored table.
    """
    train, holdout = split_by_time(features, holdout_days)
    frame = spread_out(cut_lineage(model_frame(train, train, label))).persist()
    try:
        models = fit_families(frame)
    finally:
        frame.unpersist()
    params = forecast.fit_seasonal_ar(train, label)
    flagged = train.withColumn("holdout", F.lit(False)).unionByName(holdout.withColumn("holdout", F.lit(True)))
    scored = score_keys(models, flagged, train, label)
    return models, forecast.one_step_forecast(scored, features, params, label, SERIES)
