"""Streams run to the end of their input and compared with batch results."""

from pyspark.sql import functions as F

from curbline.plans.inputs import Inputs
from curbline.plans.ingest import OBSERVED_AT
from curbline.plans.registry import query
from curbline.session import scratch_dir
from curbline.sources import schemas
from curbline.streaming import ingest, rollups, upkeep


class StreamInputs(Inputs):
    """The same inputs over a streaming read of each table."""

    def table(self, name):
        file = f"{name}.parquet"
        schema = self.spark.read.parquet(f"{self.folder}/{file}").schema
        return ingest.stream_table(self.spark, self.folder, file, schema)


def streaming(t):
    return StreamInputs(t.spark, t.folder)


@query(
    "stream_ingest_predictions",
    "R-1 R-4 Q-2 Q-3 S-8",
    "SELECT DISTINCT event_id, route_id, trip_id, stop_id, feed_timestamp_utc FROM flat_predictions WHERE stop_id IS NOT NULL",
)
def stream_ingest_predictions(t):
    """Pages with repeats are landed, streamed twice under two checkpoints, and merged."""
    pages_path, base = scratch_dir(t.spark, "pages"), scratch_dir(t.spark, "base")
    t.prediction_pages(repeat_every=10).select("body").write.text(pages_path)
    for run in ("first", "again"):
        lines = ingest.stream_lines(t.spark, pages_path, schemas.PREDICTION_PAGE, files_per_batch=4)
        running = ingest.ingest_predictions(
            lines, F.lit(OBSERVED_AT), base, scratch_dir(t.spark, "offsets"), source=run
        )
        running.awaitTermination()
    return ingest.read_base(t.spark, base).select(
        "event_id", "route_id", "trip_id", "stop_id", "feed_timestamp_utc"
    )


@query(
    "stream_ingest_vehicles",
    "R-1 S-2",
    "SELECT DISTINCT snapshot_id, vehicle_id, route_id, vehicle_timestamp_utc FROM flat_vehicles",
)
def stream_ingest_vehicles(t):
    pages_path, base = scratch_dir(t.spark, "pages"), scratch_dir(t.spark, "base")
    t.vehicle_pages.select("body").write.text(pages_path)
    lines = ingest.stream_lines(t.spark, pages_path, schemas.VEHICLE_PAGE)
    ingest.ingest_vehicles(
        lines, F.lit(OBSERVED_AT), base, scratch_dir(t.spark, "offsets")
    ).awaitTermination()
    return ingest.read_base(t.spark, base).select(
        "snapshot_id", "vehicle_id", "route_id", "vehicle_timestamp_utc"
    )


_ARRIVALS = """
SELECT event_id AS nth, CAST(event_id AS VARCHAR) AS event_id, event_id % 6 AS part,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 10 = 3 THEN updated_at - INTERVAL '400' DAY ELSE updated_at END AS feed_timestamp_utc, stop_id
FROM prediction_items"""


def landed_arrivals(t):
    """Predictions as six parts that arrive one after the other.

    One in ten is 400 days late, one in seventeen has no time, and every fourth comes again three parts later.
    """
    rows = t.prediction_items.selectExpr(
        "event_id AS nth", "CAST(event_id AS STRING) AS event_id", "event_id % 6 AS part",
        """CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 10 = 3 THEN updated_at - INTERVAL '400' DAY
           ELSE updated_at END AS feed_timestamp_utc""",
        "stop_id",
    ).withColumn("observed_at_utc", F.lit(OBSERVED_AT).cast("timestamp_ntz"))
    folder = scratch_dir(t.spark, "arrivals")
    for part in range(6):
        again = rows.where((F.col("part") == part - 3) & (F.col("nth") % 4 == 0))
        whole = rows.where(F.col("part") == part).unionByName(again).drop("nth", "part")
        # few files by size, as a batch is a number of files: the table's own files would give each a few rows
        whole.hint("rebalance").write.mode("append").parquet(folder)
    return t.spark.readStream.schema(t.spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 2).parquet(folder)


def merged_arrivals(t, repeats="1 hour"):
    base = scratch_dir(t.spark, "base")
    merge = ingest.merge_batches(base, "run", "event_id", ["observed_at_utc"], "feed_timestamp_utc", ["stop_id"])
    rows = ingest.distinct_within(landed_arrivals(t), "event_id", repeats)
    offsets = scratch_dir(t.spark, "offsets")
    running = rows.writeStream.foreachBatch(merge).option("checkpointLocation", offsets).trigger(availableNow=True).start()
    running.awaitTermination()
    return base


@query(
    "stream_late_and_repeated_rows",
    "R-1 R-4 Q-3",
    f"SELECT event_id, feed_timestamp_utc, stop_id FROM ({_ARRIVALS}) WHERE stop_id IS NOT NULL",
)
def stream_late_and_repeated_rows(t):
    """Each key once, none lost: repeats go by state first, late rows and rows without time stay."""
    return ingest.read_base(t.spark, merged_arrivals(t)).select("event_id", "feed_timestamp_utc", "stop_id")


@query(
    "compacted_stream_table",
    "R-1 S-12 Q-3",
    f"SELECT event_id, feed_timestamp_utc, strftime(coalesce(feed_timestamp_utc, '1970-01-01'), '%Y-%m-%d') AS key_day FROM ({_ARRIVALS}) WHERE stop_id IS NOT NULL",
)
def compacted_stream_table(t):
    """The same table after its closed days have been rewritten and their old folders deleted."""
    base = merged_arrivals(t)
    upkeep.compact_days(t.spark, base, "2024-01-20", "event_id")
    upkeep.vacuum(t.spark, base)
    return ingest.read_base(t.spark, base).select("event_id", "feed_timestamp_utc", "key_day")


@query(
    "stream_hourly_snapshots",
    "R-2",
    """
SELECT station_id, date_trunc('hour', snapshot_ts) AS ts_hour, count(*) AS snapshots FROM station_status GROUP BY ALL""",
)
def stream_hourly_snapshots(t):
    """Hours that the watermark has closed, and those still open at the end of the input."""
    out, offsets = scratch_dir(t.spark, "hours"), scratch_dir(t.spark, "offsets")
    hours = rollups.hourly_stream(streaming(t).station_status, "station_id", "snapshot_ts", "snapshots")
    rollups.append_to(hours, out, offsets).awaitTermination()
    return t.spark.read.parquet(out).unionByName(rollups.open_hours(t.spark, offsets, "snapshots"))


@query(
    "stream_latest_status",
    "R-3 W-1",
    "SELECT station_id, num_bikes_available, num_docks_available, snapshot_ts FROM latest_status",
)
def stream_latest_status(t):
    out = scratch_dir(t.spark, "latest")
    running = rollups.latest_status_stream(streaming(t).station_status, out, scratch_dir(t.spark, "offsets"))
    running.awaitTermination()
    return rollups.read_latest(t.spark, out, running).select(
        "station_id", "num_bikes_available", "num_docks_available", "snapshot_ts"
    )


@query(
    "stream_active_ratio",
    "R-5 A-5",
    """
WITH days AS (SELECT station_id, date_trunc('day', snapshot_ts) AS d, sum(CASE WHEN coalesce(num_bikes_available, 0) > 0 THEN 1 ELSE 0 END) AS b, count(*) AS n FROM station_status GROUP BY ALL),
ends AS (SELECT unnest(generate_series((SELECT min(d) FROM days) + INTERVAL '1' DAY, (SELECT max(d) FROM days) + INTERVAL '14' DAY, INTERVAL '1' DAY)) AS window_end)
SELECT station_id, CAST(window_end - INTERVAL '14' DAY AS TIMESTAMP) AS window_start, CAST(window_end AS TIMESTAMP) AS window_end, round(sum(b) / sum(n), 6) AS active_ratio
FROM ends JOIN days ON d < window_end AND d >= window_end - INTERVAL '14' DAY GROUP BY ALL""",
)
def stream_active_ratio(t):
    """Every window that holds a snapshot, closed by the watermark or still open at the end of the input."""
    out, offsets = scratch_dir(t.spark, "ratios"), scratch_dir(t.spark, "offsets")
    ratios = rollups.active_ratio_stream(streaming(t).station_status)
    rollups.append_to(ratios, out, offsets).awaitTermination()
    every = t.spark.read.parquet(out).unionByName(rollups.open_ratios(t.spark, offsets))
    return every.withColumn("active_ratio", F.round("active_ratio", 6))
