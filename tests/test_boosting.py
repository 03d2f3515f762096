"""Boosting next to a plain single-process version, its losses and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from curbline.operators import boosting, occupancy
from tests.conftest import values

SCHEMA = "label string, weight double, hour int, route string, lat double"


def table(frame, n=400, seed=5):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hour, route, lat = int(rng.integers(0, 6)), f"r{rng.integers(0, 5)}", float(rng.integers(0, 40)) / 10
        lean = (hour > 2) + (route in ("r1", "r4")) + (lat > 2.5)
        label = "abc"[int(np.clip(lean + rng.integers(-1, 2), 0, 2))]
        rows.append((label, 0.5 + (i % 3), None if i % 29 == 0 else hour, None if i % 31 == 0 else route, lat))
    return frame(rows, SCHEMA), rows


def plain_round(rows, scores, depth, rate, names=("hour", "route", "lat")):
    """One tree per label over all rows: the sets of rows in its leaves with their values."""
    y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = boosting.softmax(scores)
    moved = scores.copy()

    def best_cut(at, g, h):
        top = (1e-12, None)
        for f in range(3):
            column = [rows[i][2 + f] for i in at]
            known = [i for i, v in zip(at, column, strict=True) if v is not None]
            missing = [i for i, v in zip(at, column, strict=True) if v is None]
            groups = {}
            for i in known:
                groups.setdefault(rows[i][2 + f], []).append(i)
            if f == 1:
                parts = [missing] * bool(missing) + list(groups.values())
                parts.sort(key=lambda part: round(g[part].sum() / h[part].sum(), 12))
            else:
                parts = [missing] * bool(missing) + [groups[v] for v in sorted(groups)]
            for cut in range(1, len(parts)):
                left, right = [i for part in parts[:cut] for i in part], [i for part in parts[cut:] for i in part]
                if h[left].sum() < 1 or h[right].sum() < 1:
                    continue
                score = lambda s: g[s].sum() ** 2 / (h[s].sum() + 1)
                gain = round(score(left) + score(right) - score(at), 9)
                if gain > top[0]:
                    top = (gain, (left, right))
        return top[1]

    for k, label in enumerate("abc"):
        g, h = w * (p[:, k] - (y == label)), w * p[:, k] * (1 - p[:, k])
        parts = [list(range(len(rows)))]
        for _ in range(depth):
            parts = [q for part in parts for q in (best_cut(part, g, h) or (part,))]
        for part in parts:
            moved[part, k] += -rate * g[part].sum() / (h[part].sum() + 1)
    return moved


def test_rounds_equal_a_plain_version(frame):
    df, rows = table(frame)
    model = boosting.fit_boosted(df.repartition(5), ["hour", "route", "lat"], rounds=3, trees=1, depth=2)
    scores = np.zeros((len(rows), 3))
    for _ in range(3):
        scores = plain_round(rows, scores, 2, 0.3)
    want = boosting.softmax(scores)
    got = model.predict(df.withColumn("n", F.monotonically_increasing_id()).coalesce(1)).orderBy("n").collect()
    assert model.labels == ["a", "b", "c"]
    assert np.abs(np.array([r.probability for r in got]) - want).max() < 1e-9


def test_losses_fall_and_parallel_trees_differ(frame):
    df, rows = table(frame)
    model = boosting.fit_boosted(df, ["hour", "route", "lat"], rounds=5, trees=3, depth=3)
    assert model.losses[0] == pytest.approx(np.log(3)) and len(model.losses) == 6
    assert all(a > b for a, b in zip(model.losses, model.losses[1:], strict=False))
    first = model.rounds[0]
    assert len(first) == 9 and len({tuple(t.value) for t in first if t.output == 0}) == 3
    hits = model.predict(df).where("label = predicted_label").count()
    assert hits > 0.6 * len(rows)


def test_odd_rows(frame):
    df, _ = table(frame, 60)
    model = boosting.fit_boosted(df, ["hour", "route", "lat"], rounds=1, trees=1, depth=2)
    odd = frame([(None, None, None, None, None), ("zzz", 1.0, 99, "new", -5.0)], SCHEMA)
    scored = model.predict(odd.withColumn("probability", F.lit(1))).collect()
    assert len(scored) == 2 and all(sum(r.probability) == pytest.approx(1) and r.predicted_label in "abc" for r in scored)
    assert model.predict(df.limit(0)).collect() == []
    one = boosting.fit_boosted(df.where("label = 'a'"), ["hour", "route", "lat"], rounds=1)
    assert values(one.predict(odd), "predicted_label") == [("a",), ("a",)]
    none = boosting.fit_boosted(df.limit(0), ["hour"], rounds=2)
    assert none.labels == [] and none.rounds == []


def test_many_values_are_quantiles(frame):
    rows = [("ab"[i % 2], 1.0, i, f"r{i % 90}", i / 7) for i in range(500)]
    inputs = boosting.fit_inputs(frame(rows, SCHEMA), ["hour", "route", "lat"], 16)
    assert len(inputs.edges["lat"]) == 16 and len(inputs.texts["route"]) == 16 and inputs.width() == 18
    placed = frame(rows, SCHEMA).select(inputs.bins().alias("b")).agg(F.min(F.array_min("b")), F.max(F.array_max("b"))).first()
    assert tuple(placed) == (1, 17)
    assert occupancy.PARALLEL_TREES == 4


def test_regression_equals_plain_means(frame):
    rows = [("x", 1.0, i % 5, f"r{i % 3}", float((i % 5) * 2 + (i % 3 == 1) * 7 + i % 2)) for i in range(300)]
    df = frame(rows, SCHEMA).repartition(4)
    model = boosting.fit_boosted_regression(df, ["hour", "route"], "lat", rounds=1, depth=3, rate=1.0, penalty=0.0)
    got = model.predict(df, "p").groupBy("hour", "route").agg(F.avg("lat").alias("m"), F.max("p").alias("p"), F.min("p").alias("q")).collect()
    # with depth to spare for the strongest splits, leaves are means: residuals add up to 0
    assert sum(r.m - r.p for r in got) == pytest.approx(0, abs=1e-9) and all(r.p == pytest.approx(r.q) for r in got)
    more = boosting.fit_boosted_regression(df, ["hour", "route"], "lat", rounds=10)
    assert more.losses[-1] < 0.3 < more.losses[0] and all(a >= b for a, b in zip(more.losses, more.losses[1:], strict=False))
    empty = boosting.fit_boosted_regression(df.limit(0), ["hour"], "lat", rounds=2)
    assert values(empty.predict(df.limit(1), "p"), "p") == [(0.0,)]
