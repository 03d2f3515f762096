"""Exact least squares per category."""

import numpy as np
import pytest

from curbline.operators.linear import fit_linear
from tests.conftest import values

SCHEMA = "station_id string, a double, b int, y double"


def test_equals_dense_least_squares(frame):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 7}", float(rng.normal()), int(rng.integers(0, 5)), float(rng.normal() + i % 7)) for i in range(200)]
    fit = fit_linear(frame(rows, SCHEMA).repartition(3), "station_id", ["a", "b"], "y")
    x = np.array([[r[1], r[2], *[r[0] == f"s{k}" for k in range(7)]] for r in rows], float)
    want = np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0]
    assert [fit.slopes["a"], fit.slopes["b"]] == pytest.approx(want[:2].tolist())
    assert [v for _, v in values(fit.intercepts, "station_id", "intercept")] == pytest.approx(want[2:].tolist())


def test_odd_rows(frame):
    rows = [("s", 1.0, 1, 2.0), ("s", 2.0, 2, 4.0), ("s", None, 1, 9.0), (None, 1.0, 1, 5.0), ("t", 5.0, 5, None)]
    fit = fit_linear(frame(rows, SCHEMA), "station_id", ["a", "b"], "y")  # a and b are equal: least length
    assert fit.slopes == {"a": pytest.approx(1.0), "b": pytest.approx(1.0)}
    new = fit.transform(frame([("new", 1.0, 1, None), ("s", None, 1, None)], SCHEMA))
    assert [r.prediction for r in new.orderBy("station_id").collect()] == [pytest.approx(fit.overall + 2), None]
    empty = fit_linear(frame([], SCHEMA), "station_id", ["a", "b"], "y")
    assert empty.slopes == {"a": 0.0, "b": 0.0} and empty.transform(frame(rows[:1], SCHEMA)).first().prediction == 0.0
