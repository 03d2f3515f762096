"""Exact percentiles against numpy."""

import numpy as np
import pytest

from curbline.operators.percentiles import exact_percentiles


@pytest.mark.parametrize("n", [1, 2, 5, 1000])
def test_equals_numpy(frame, n):
    rng = np.random.default_rng(n)
    values = [float(v) for v in np.where(rng.random(n) < 0.3, 7.25, rng.normal(0, 40, n))]
    df = frame([(v,) for v in values] + [(None,)], "x double")
    for width in (0.1, 5.0, 1000.0):
        got = exact_percentiles(df, "x", [0.0, 0.25, 0.5, 0.9, 1.0], width).first()[0]
        assert got == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.9, 1]))


def test_values_of_one_step_are_cut_into_parts(spark):
    """A few rows per part reach the last step, although one step holds everything."""
    n = 200_000
    df = spark.range(n).selectExpr("500 + (id * 7919 % 200000) * 1e-9 AS x")
    out = exact_percentiles(df, "x", [0.5, 0.9], 1000.0)
    values = 500 + np.arange(n) * 1e-9
    assert out.first()[0] == pytest.approx(np.quantile(values, [0.5, 0.9]), abs=1e-15, rel=1e-13)
    assert exact_percentiles(df.limit(0), "x", [0.5], 1.0).first()[0] is None


def test_odd_values(frame):
    rows = [(v,) for v in (float("nan"), None, -1e308, 1e308, -0.0, 0.0, 5e-324, 3.0, 3.0, 3.0)]
    clean = sorted(v for (v,) in rows if v is not None and v == v)
    for width in (1e-3, 1e300):
        got = exact_percentiles(frame(rows, "x double"), "x", [0.125, 0.5, 0.75], width).first()[0]
        assert got == pytest.approx(np.quantile(clean, [0.125, 0.5, 0.75]))


def test_no_value(frame):
    assert exact_percentiles(frame([(None,)], "x double"), "x", [0.5], 1.0).first()[0] is None
