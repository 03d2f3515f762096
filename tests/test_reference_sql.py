"""Every registered query against its DuckDB reference on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from tools.compare import compare, connect

# These fit models; tests/test_models.py looks at their results.
FITTED = {
    "pickup_model_selection", "dropoff_model_selection", "predicted_pickups", "predicted_dropoffs", "occupancy_model_metrics",
}
# Reports that have no rows on the smallest tables, by their reference SQL as well.
NO_ROWS = {"rush_availability_utc", "trips_near_stations", "arrival_pickup_correlation", "parts_without_chunks"}
QUERIES = entry.QUERIES


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    return connect(SMALL)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in FITTED])
def test_query(spark, con, name):
    status, _, _ = compare(spark, con, SMALL, name, QUERIES[name])
    assert status in (("EMPTY",) if name in NO_ROWS else ("ok", "rows only")), status


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_contract_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())
