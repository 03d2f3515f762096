"""Named queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from curbline.plans.inputs import Inputs, reference_sql
from curbline.session import configure


@dataclass(frozen=True)
class Query:
    """``covers`` lists the inventory ids the query exercises; ``sql`` is DuckDB text or ``None``."""

    build: Callable[[Inputs], DataFrame]
    covers: tuple[str, ...]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Inputs(configure(spark), folder))


QUERIES: dict[str, Query] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register the decorated ``Inputs -> DataFrame`` function."""

    def register(build: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(build, tuple(covers.split()), reference_sql(sql) if sql else None)
        return build

    return register
