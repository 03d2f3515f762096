"""Incremental rollups: hourly demand, newest status and the sliding active ratio."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbline.operators import keyed
from curbline.sources.tables import replace


def as_event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a zoned timestamp; the session zone is UTC."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def hourly_stream(stream: DataFrame, station: str, ts: str, name: str, delay: str = "1 hour") -> DataFrame:
    """Rows per station and hour as a tumbling window; hours close ``delay`` after their end."""
    return (
        as_event_time(stream.filter(F.col(station).isNotNull()), ts)
        .withWatermark(ts, delay)
        .groupBy(F.window(ts, "1 hour"), F.col(station).cast("string").alias("station_id"))
        .agg(F.count("*").alias(name))
        .select("station_id", F.col("window.start").cast("timestamp_ntz").alias("ts_hour"), name)
    )


def active_ratio_stream(
    stream: DataFrame, days: int = 14, slide: str = "1 day", delay: str = "1 day"
) -> DataFrame:
    """Share of snapshots with a bike per station over sliding windows of ``days`` days.

    Rows are first counted per station and slide, so the sliding step repeats
    counts and not rows.
    """
    has_bike = (F.coalesce("num_bikes_available", F.lit(0)) > 0).cast("int")
    daily = (
        as_event_time(stream, "snapshot_ts")
        .withWatermark("snapshot_ts", delay)
        .groupBy(F.window("snapshot_ts", slide).alias("day"), "station_id")
        .agg(F.sum(has_bike).alias("with_bike"), F.count("*").alias("n"))
    )
    windows = daily.groupBy(F.window(F.window_time("day"), f"{days} days", slide), "station_id")
    return _ratio(windows.agg(F.sum("with_bike").alias("with_bike"), F.sum("n").alias("n")))


def _open_state(spark: SparkSession, checkpoint: str, operator: int, key: str, values: str) -> DataFrame:
    """What a finished stream still holds: the aggregates of windows that its watermark has not closed."""
    state = spark.read.format("statestore").option("operatorId", operator).load(checkpoint)
    window = "window: struct<start: timestamp, end: timestamp>"
    key_type = f"struct<{window}, {key}: string>"
    return state.select(F.col("key").cast(key_type).alias("k"), F.col("value").cast(f"struct<{values}>").alias("v")).select(
        "k.*", "v.*"
    )


def open_hours(spark: SparkSession, checkpoint: str, name: str) -> DataFrame:
    """Hours of :func:`hourly_stream` that are not closed at the end of the input, with their counts so far.

    They come from the state the query has committed, so no row is read again. The stream itself is not changed: when
    it goes on, these hours grow and close as always, so keep them apart from the closed ones and replace them.
    """
    state = _open_state(spark, checkpoint, 0, "station_id", f"{name}: bigint")
    return state.select("station_id", F.col("window.start").cast("timestamp_ntz").alias("ts_hour"), name)


def _ratio(windows: DataFrame) -> DataFrame:
    return windows.select(
        "station_id",
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        (F.col("with_bike") / F.col("n")).alias("active_ratio"),
    )


def open_ratios(spark: SparkSession, checkpoint: str, days: int = 14, slide: str = "1 day") -> DataFrame:
    """Windows of :func:`active_ratio_stream` that are not closed at the end of the input.

    One operator of the stream holds days, the other sliding windows that closed days have reached. The days that are
    still open are added to their windows, which completes them.
    """
    sums = "with_bike: bigint, n: bigint"
    both = [_open_state(spark, checkpoint, i, "station_id", sums) for i in (0, 1)]
    held = both[0].unionByName(both[1])
    length = F.col("window.end") - F.col("window.start")
    long = length > F.expr(f"INTERVAL '{slide}'")
    late_days = held.where(~long).select(
        F.window(F.col("window.start"), f"{days} days", slide).alias("window"), "station_id", "with_bike", "n"
    )
    windows = held.where(long).select("window", "station_id", "with_bike", "n").unionByName(late_days)
    return _ratio(windows.groupBy("window", "station_id").agg(F.sum("with_bike").alias("with_bike"), F.sum("n").alias("n")))


def append_to(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed windows to a Parquet table until the input is used up."""
    return (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def keep_latest(path: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step that maintains the newest row per key.

    Versions alternate between two folders by batch number, so a batch never
    overwrites the version it reads, and a repeated batch rebuilds the same one.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = keyed.latest_per_key(batch, keys, order)
        if batch_id > 0:
            known = batch.sparkSession.read.parquet(version_path(path, batch_id - 1))
            newest = keyed.latest_per_key(newest.unionByName(known), keys, order)
        replace(newest, version_path(path, batch_id))

    return write


def version_path(path: str, batch_id: int) -> str:
    return f"{path}/version={batch_id % 2}"


def latest_status_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Newest status per station, maintained batch by batch."""
    return (
        stream.writeStream.foreachBatch(keep_latest(path, ["station_id"], ["snapshot_ts"]))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, path: str, query: StreamingQuery) -> DataFrame:
    """The version written by the last batch of a finished query."""
    last = query.lastProgress
    if last is None:
        raise ValueError("the stream has processed no batch")
    return spark.read.parquet(version_path(path, last["batchId"]))
