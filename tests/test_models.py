"""Fitted models: shapes, ranges, and better than a constant; the sparse series fit equals the dense one."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from curbline.operators import clusters, demand_models, forecast, occupancy
from curbline.session import cut_lineage
from tests.conftest import values


@pytest.fixture(scope="module")
def rides(spark):
    """Two stations with a clear daily and weekly pattern, eight weeks long."""
    start = dt.datetime(2024, 1, 1)
    rows = []
    for h in range(24 * 56):
        ts = start + dt.timedelta(hours=h)
        for station, base in (("1", 2), ("2", 9)):
            level = base + (6 if ts.hour in (8, 17) else 0) - (1 if ts.weekday() >= 5 else 0)
            if (h + int(station)) % 5:
                rows.append((station, f"s{station}", ts, (ts.weekday() + 1) % 7 + 1, ts.hour, int(ts.weekday() >= 5), level, 1))
    df = spark.createDataFrame(
        rows,
        """station_id string, station_name string, ts_hour timestamp_ntz, day_of_week int, hour int, is_weekend int,
           pickups long, dropoffs long""",
    )
    return cut_lineage(df)


def test_families_beat_the_mean(rides):
    models, scored = demand_models.compare_families(rides, "pickups", holdout_days=7)
    names = [demand_models.LINEAR, demand_models.FOREST, demand_models.BOOSTED, demand_models.SERIES]
    errors = dict(values(demand_models.model_rmse(demand_models.long_predictions(scored, names, [])), "model_name", "rmse"))
    spread = scored.agg(F.stddev_pop("y_true")).first()[0]
    assert set(errors) == set(names) and set(models) == set(names[:3])
    for name in (demand_models.LINEAR, demand_models.FOREST, demand_models.BOOSTED):
        assert errors[name] < spread
    assert scored.where("holdout").count() == demand_models.split_by_time(rides, 7)[1].count()
    assert scored.count() == rides.count()
    table = demand_models.predicted_table(scored, demand_models.BOOSTED, "predicted")
    assert table.filter(F.col("predicted") < 0).isEmpty()


def test_sparse_series_fit_equals_dense_regression(rides):
    dense = forecast.with_lags(forecast.dense_hours(rides, "pickups"), "pickups", (1, 168, 169))
    y = F.col("pickups") - F.col("lag_168")
    x = F.col("lag_1") - F.col("lag_169")
    known = dense.filter(F.col("lag_169").isNotNull())
    want = known.groupBy("station_id").agg(
        F.count("*").alias("hours"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )
    got = {r.station_id: r for r in forecast.fit_seasonal_ar(rides, "pickups").collect()}
    for row in want.collect():
        assert got[row.station_id].hours == row.hours
        assert got[row.station_id].slope == pytest.approx(row.slope, abs=1e-9)
        assert got[row.station_id].intercept == pytest.approx(row.intercept, abs=1e-9)


def test_short_series_has_a_flat_fit(frame):
    one = frame([("1", dt.datetime(2024, 1, 1), 3)], "station_id string, ts_hour timestamp_ntz, n int")
    row = forecast.fit_seasonal_ar(one, "n").first()
    assert (row.hours, row.slope, row.intercept, row.residual_variance) == (0, 0.0, 0.0, None)


def test_join_back_weighting_equals_the_join(frame):
    rows = [("m", k, float(y), p) for k, p, ys in (("a", 1.0, [0, 1, 4]), ("b", 2.0, [3])) for y in ys]
    df = frame(rows, "model_name string, k string, y_true double, y_pred double")
    joined = df.select("model_name", "k", "y_true").join(df.select("k", "y_pred"), "k")
    want = demand_models.model_rmse(joined).first().rmse
    assert demand_models.group_weighted_rmse(df, ["k"]).first().rmse == pytest.approx(want)


def test_metric_union_keeps_all_columns(frame):
    a = frame([(1.0,)], "rmse double")
    b = frame([(2.0, 0.5)], "rmse double, r2 double")
    got = demand_models.union_metrics({"a": a, "b": b})
    assert values(got, "model_name", "rmse", "r2") == [("a", 1.0, None), ("b", 2.0, 0.5)]


@pytest.fixture(scope="module")
def vehicles(spark):
    rows = []
    for i in range(900):
        route = ("Red", "Blue", "47")[i % 3]
        label = {"Red": "FULL", "Blue": "FEW_SEATS_AVAILABLE", "47": "MANY_SEATS_AVAILABLE"}[route]
        if i % 20 == 0:
            label = "FULL"
        rows.append((label, route, "STOPPED_AT", i % 24, 1 + i % 7, int(i % 7 in (0, 6)), 42.0 + (i % 9) / 1000, -71.0))
    df = spark.createDataFrame(
        rows,
        """label string, route_id string, current_status string, hour_of_day int, day_of_week int, is_weekend int,
           lat_bin double, lon_bin double""",
    )
    return cut_lineage(occupancy.with_class_weights(df))


def test_classifiers(vehicles):
    models = occupancy.fit_classifiers(vehicles)
    metrics = {r.model: r for r in occupancy.evaluate(models, vehicles).collect()}
    assert set(metrics) == {"lr", "bt", "rf", "dnn"}
    for name in ("lr", "bt", "rf"):
        assert metrics[name].accuracy > 0.8 and 0 < metrics[name].f1_score <= 1
    assert all(r.rows == 900 for r in metrics.values())
    long = occupancy.label_probabilities(models["lr"], occupancy.predict(models["lr"], vehicles.limit(7)))
    assert long.count() == 21 and long.agg(F.round(F.sum("prob"), 6)).first()[0] == 7.0
    serving = vehicles.drop("label", "weight").limit(5)
    assert occupancy.predict(models["rf"], serving).count() == 5


def test_serving_uses_the_training_features(frame):
    requests = frame(
        [("Red", "STOPPED_AT", dt.datetime(2024, 1, 7, 8)), ("none", "STOPPED_AT", dt.datetime(2024, 1, 8, 8))],
        "route_id string, current_status string, ts timestamp_ntz",
    )
    centres = frame([("red", 42.12345, -71.0)], "route_key string, lat double, lng double")
    got = values(occupancy.serving_features(requests, centres), "route_id", "day_of_week", "is_weekend", "lat_bin", "lon_bin")
    assert got == [("Red", 1, 1, 42.123, -71.0), ("none", 2, 0, 42.3, -71.1)]


def test_kmeans_separates_and_reports_inertia(frame):
    rows = [
        (str(i), f"n{i}", float(g * 1000 + i), 5 - g, 1, float(9 - 4 * g), 1, 1.0, 10, 5, int(g > 0), int(g > 1))
        for g in range(3) for i in range(8)
    ]
    df = frame(
        rows,
        """station_id string, station_name string, distance_to_nearest_m double, bikes_within_near int, nearby_morning int,
           avg_bikes_morning double, nearby_evening int, avg_bikes_evening double, bike_trip_volume int, transit_ridership int,
           is_isolated int, has_low_morning_availability int""",
    )
    model, inertia = clusters.kmeans(df, starts=3)
    assigned = clusters.assign(model, df)
    sizes = sorted(r["count"] for r in assigned.groupBy("cluster").count().collect())
    assert sizes == [8, 8, 8] and 0 < inertia < 24 * 10
    importance = dict(values(clusters.feature_importance(assigned), "feature", "importance"))
    assert importance["is_isolated"] == pytest.approx(1.0) and importance["bike_trip_volume"] == 0.0


def test_best_model_survives_errors_that_vary(spark):
    """Errors are read once: sums in another order would leave no model with the least one."""
    vary = F.udf(lambda: int.from_bytes(os.urandom(6)) / 2.0**48, "double").asNondeterministic()
    metrics = spark.range(4).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model_name")).withColumn("rmse", vary())
    assert demand_models.select_best(metrics).count() == 1
