"""Models are fitted on and scored for distinct rows with their numbers: the same as every row on its own."""

import numpy as np
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from curbline.operators import boosting, demand_models, network, occupancy
from tests.conftest import values


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(1)
    layers, x, y, n = [3, 4, 2, 3], rng.normal(size=(9, 3)), rng.integers(0, 3, 9), rng.integers(1, 5, 9).astype(float)
    w = rng.normal(size=3 * 4 + 4 + 4 * 2 + 2 + 2 * 3 + 3)
    _, gradient = network.loss_and_gradient(w, layers, x, y, n)
    for i in range(len(w)):
        step = np.zeros(len(w))
        step[i] = 1e-6
        up, down = (network.loss_and_gradient(w + s, layers, x, y, n)[0] for s in (step, -step))
        assert gradient[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_network_of_counted_rows_equals_that_of_repeated_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(Vectors.dense(v), float((v[0] + v[1] > 0) + (v[1] > 0.5)), int(1 + i % 4)) for i, v in enumerate(rng.normal(size=(60, 3)))]
    counted = spark.createDataFrame(rows, ["features", "label_index", "n"])
    repeated = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    few, many = (network.fit_network(df, [5], 3, 10, 42) for df in (counted, repeated.withColumn("n", F.lit(1))))
    assert few.weights.toArray() == pytest.approx(many.weights.toArray(), abs=1e-6)
    plain = MultilayerPerceptronClassifier(labelCol="label_index", layers=[3, 5, 3], maxIter=100, seed=42).fit(repeated)
    mine = network.fit_network(counted, [5], 3, 100, 42)
    right = [m.transform(repeated).where("prediction = label_index").count() / repeated.count() for m in (plain, mine)]
    assert right[1] > right[0] - 0.05 and right[1] > 0.85


def test_equal_rows_are_scored_once_and_counted(frame):
    schema = """label string, route_id string, current_status string, hour_of_day int, day_of_week int, is_weekend int,
                lat_bin double, lon_bin double, weight double"""
    rows = [(("A", "B")[h % 2], "r", "s", h, 1, 0, 42.0, -71.0, 1.0) for h in range(12)]
    model = occupancy.fit_classifiers(frame(rows, schema), ["bt"], rounds=3)
    asked = frame(rows[:1] * 5 + rows[1:2] * 3 + [("B", *rows[0][1:])] * 2, schema)
    assert occupancy.counted(asked, [*occupancy.INPUTS, "label"]).count() == 3
    plain = occupancy.predict(model["bt"], asked).select(F.lit("bt").alias("model"), "label", "predicted_label")
    want = occupancy.classification_metrics(occupancy.confusion(plain))
    assert values(occupancy.evaluate(model, asked), *want.columns) == values(want, *want.columns)
    assert occupancy.evaluate(model, asked).first().rows == 10


def test_cells_of_boosting_are_dealt_over_the_cores(frame, monkeypatch):
    stored, keep = [], boosting.cut_lineage

    def noted(df):
        stored.append(keep(df))
        return stored[-1]

    monkeypatch.setattr(boosting, "cut_lineage", noted)
    rows = frame([("ab"[i % 2], 1.0, i) for i in range(400)], "label string, weight double, hour int")
    boosting.fit_boosted(rows, ["hour"], rounds=1, bins=400)
    assert len(stored[0].inputFiles()) > 1


def test_each_station_and_calendar_key_is_scored_once(frame, monkeypatch):
    schema = "station_id string, station_name string, day_of_week int, hour int, is_weekend int, pickups long"
    rows = [(str(i % 2), "s", 1 + h // 12 % 7, h % 12, 0, h % 12 + 3 * (i % 2)) for i in range(6) for h in range(48)]
    train = frame(rows, schema)
    models = demand_models.fit_families(demand_models.model_frame(train, train, "pickups"), trees=3, rounds=3)
    asked = frame([*rows, ("new", None, 2, 5, 0, 4)], schema)
    want = demand_models.score(models, demand_models.model_frame(asked, train, "pickups"))
    seen, plain = [], demand_models.score

    def noted(given, keys):
        seen.append(keys.count())
        return plain(given, keys)

    monkeypatch.setattr(demand_models, "score", noted)
    got = demand_models.score_keys(models, asked, train, "pickups")
    columns = [*demand_models.SCORED_KEY, "y_true", *[F.round(m, 9).alias(m) for m in models]]
    assert values(got, *columns) == values(want, *columns)
    assert seen == [2 * 48 + 1] and got.count() == 289
