"""Registry rows for models, datasets and training runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import times


def model_row(source: DataFrame, model: dict[str, str], created_at: str | Column) -> DataFrame:
    """One model entry; ``source`` is any one-row frame of the job."""
    return source.select(
        *[F.lit(model[c]).alias(c) for c in ("model_id", "name", "business_problem", "ticket_number", "owner")],
        times.as_instant(created_at).alias("created_at"),
    )


def dataset_row(
    profile: DataFrame, dataset_id: str, model_id: str, version: str, path: str, created_at: str | Column
) -> DataFrame:
    """One dataset version from its computed profile."""
    return profile.select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(model_id).alias("model_id"),
        F.lit(version).alias("data_version"),
        F.lit(path).alias("path"),
        "row_count",
        "feature_count",
        times.as_instant(created_at).alias("created_at"),
    )


def training_run_row(
    summary: DataFrame,
    run_id: str,
    model_id: str,
    dataset_id: str,
    params: dict[str, str],
    inertia: float,
    artifact: str,
    created_at: str | Column,
) -> DataFrame:
    """One finished run; parameters and metrics as JSON text.

    ``summary`` has one row per cluster, so the collected list is as long as k.
    """
    clusters = F.sort_array(F.collect_list(F.struct("cluster", *[c for c in summary.columns if c != "cluster"])))
    metrics = F.to_json(
        F.struct(
            F.lit(inertia).alias("inertia"),
            F.sum("station_count").alias("total_stations"),
            clusters.alias("cluster_summary"),
        )
    )
    text_params = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in params.items()]))
    return summary.agg(text_params.alias("params"), metrics.alias("metrics")).select(
        F.lit(run_id).alias("run_id"),
        F.lit(model_id).alias("model_id"),
        F.lit(dataset_id).alias("dataset_id"),
        "params",
        "metrics",
        F.lit(artifact).alias("artifact"),
        F.lit("completed").alias("status"),
        times.as_instant(created_at).alias("created_at"),
    )
