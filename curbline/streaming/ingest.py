"""Continuous ingest of landed pages into a base table that holds every key once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from curbline.operators import keyed
from curbline.sources import landed, schemas
from curbline.streaming.upkeep import KEY_DAY, current

NO_DAY = "1970-01-01"
FILE_ROWS = 1_000_000  # rows of a day and batch that share a file


def stream_lines(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """New JSON-lines files below ``path`` as a stream."""
    reader = (
        spark.readStream.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("recursiveFileLookup", True)
    )
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def stream_table(spark: SparkSession, folder: str, file: str, schema) -> DataFrame:
    """One Parquet file name within a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)


def _with_key_day(df: DataFrame, event_time: str) -> DataFrame:
    """The day of a time that is part of the key: equal keys always share it."""
    day = F.coalesce(F.date_format(event_time, "yyyy-MM-dd"), F.lit(NO_DAY))
    return df.withColumn(KEY_DAY, day)


def read_base(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame | None:
    """The base table, or only its rows of some key days; ``None`` if there are none yet.

    Days that :func:`curbline.streaming.upkeep.compact_days` has rewritten are read from their new files.
    """
    return current(spark, path, days)


def distinct_within(stream: DataFrame, key: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay`` of its first row; the first to arrive stays.

    The watermark is on the arrival, the time of the micro-batch, which never runs backwards. So no row is ever too
    late, whatever its own times are, NULL included, and state lasts for ``delay`` only. A repeated batch has
    the time it had at first. Repeats that arrive later pass; the merge catches them.
    """
    arrival = "_arrived"
    timed = stream.withColumn(arrival, F.current_timestamp()).withWatermark(arrival, delay)
    return timed.dropDuplicatesWithinWatermark([key]).drop(arrival)


def _by_day(rows: DataFrame, key: str, counts: dict[str, int]) -> DataFrame:
    """Rows dealt so that a day comes to one task, or to one per ``FILE_ROWS`` of its rows, which go by their key.

    Only days with more rows than that are named in the plan. A streaming batch runs without adaptive execution, so a
    rebalance hint does nothing in it, and every task would write a file for each day.
    """
    parts = [F.when(F.col(KEY_DAY) == day, -(-n // FILE_ROWS)) for day, n in sorted(counts.items()) if n > FILE_ROWS]
    return rows.repartition(KEY_DAY, F.pmod(F.xxhash64(key), F.coalesce(*parts, F.lit(1))))


def merge_batches(
    path: str, source: str, key: str, order: list[str], event_time: str, require: list[str]
) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` step: insert rows whose key the base table lacks.

    Equal keys share their key day, so only the day folders of the batch are
    listed and read. Every batch owns the folders ``source=/batch=`` below its
    days and overwrites them, so a repeated batch leaves the table as it was.
    ``source`` should name the stream run, because a new checkpoint counts
    batches from 0 again. Rows with a NULL in ``require`` are left out. Late
    rows are kept: the merge has no time limit.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        complete = batch.dropna(subset=require) if require else batch
        fresh = keyed.earliest_per_key(_with_key_day(complete, event_time), [key], order).persist()
        try:
            # days, not rows; an iterator would start a job for each shuffle partition
            counts = {row[KEY_DAY]: row["count"] for row in fresh.groupBy(KEY_DAY).count().collect()}
            base = read_base(batch.sparkSession, path, list(counts)) if counts else None
            if base is not None:
                own = (F.col("source").cast("string") == source) & (F.col("batch") == batch_id)
                unseen = fresh.join(base.filter(~own).select(key), key, "left_anti")
            else:
                unseen = fresh
            (
                _by_day(unseen, key, counts)
                .withColumns({"source": F.lit(source), "batch": F.lit(batch_id)})
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .partitionBy(KEY_DAY, "source", "batch")
                .parquet(path)
            )
        finally:
            fresh.unpersist()

    return write


def ingest_predictions(
    pages: DataFrame, observed_at, base_path: str, checkpoint: str, source: str = "predictions", repeats: str = "1 day"
) -> StreamingQuery:
    """Landed prediction pages to the base table; each key once, stop id required.

    Repeats that arrive within ``repeats`` are dropped before the merge, all others by it.
    """
    rows = distinct_within(landed.flatten_predictions(pages, observed_at), "event_id", repeats)
    merge = merge_batches(
        base_path, source, "event_id", ["observed_at_utc"], "feed_timestamp_utc",
        [*schemas.PREDICTIONS_REQUIRED, "stop_id"],
    )
    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_vehicles(
    pages: DataFrame, observed_at, base_path: str, checkpoint: str, source: str = "vehicles", repeats: str = "1 day"
) -> StreamingQuery:
    rows = distinct_within(landed.flatten_vehicles(pages, observed_at), "snapshot_id", repeats)
    merge = merge_batches(
        base_path, source, "snapshot_id", ["observed_at_utc"], "vehicle_timestamp_utc",
        schemas.VEHICLES_REQUIRED,
    )
    return (
        rows.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
