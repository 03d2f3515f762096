"""Streams: repeated batches, late rows, several micro-batches, batch equality."""

import datetime as dt

from pyspark.sql import functions as F

from curbline.operators import keyed
from curbline.session import scratch_dir
from curbline.streaming import ingest, rollups, upkeep
from tests.conftest import values

T = dt.datetime
SCHEMA = "event_id string, observed_at_utc timestamp_ntz, feed timestamp_ntz, stop_id string"


def batch(frame, *rows):
    return frame([(k, T(2024, 1, 2), feed, stop) for k, feed, stop in rows], SCHEMA)


def test_merge_is_idempotent_and_keeps_late_rows(spark, frame):
    path = scratch_dir(spark, "merge")
    step = ingest.merge_batches(path, "run", "event_id", ["observed_at_utc"], "feed", ["stop_id"])
    day = T(2024, 1, 1, 12)
    first = batch(frame, ("a", day, "s"), ("a", day, "s"), ("b", day, None), ("n", None, "s"))
    step(first, 0)
    step(first, 0)
    # A key of the first batch again, a new one, and one that is months late.
    step(batch(frame, ("a", day, "s"), ("c", day, "s"), ("late", T(2023, 6, 1), "s"), ("n", None, "s")), 1)
    again = ingest.merge_batches(path, "other", "event_id", ["observed_at_utc"], "feed", ["stop_id"])
    again(first, 0)
    assert values(ingest.read_base(spark, path), "event_id") == [("a",), ("c",), ("late",), ("n",)]


def landed_status(spark, inputs):
    folder = scratch_dir(spark, "status")
    rows = inputs.station_status.withColumn("part", F.col("event_id") % 3)
    for part in range(3):
        rows.filter(F.col("part") == part).coalesce(1).write.mode("append").parquet(folder)
    return folder, rows.schema


def test_latest_status_over_several_batches(spark, inputs):
    folder, schema = landed_status(spark, inputs)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = scratch_dir(spark, "latest")
    running = rollups.latest_status_stream(stream, out, scratch_dir(spark, "offsets"))
    running.awaitTermination()
    want = keyed.latest_per_key(inputs.station_status, ["station_id"], ["snapshot_ts"])
    columns = ["station_id", "snapshot_ts", "num_bikes_available"]
    assert values(rollups.read_latest(spark, out, running), *columns) == values(want, *columns)


def arrivals(spark, *parts):
    """A stream of one file per part, in order."""
    folder, schema = scratch_dir(spark, "arrivals"), "event_id string, observed_at_utc timestamp_ntz, feed timestamp_ntz, stop_id string"
    for rows in parts:
        batch(lambda r, s: spark.createDataFrame(r, s), *rows).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_late_rows_and_rows_without_time_pass_repeats_do_not(spark):
    day, old = T(2024, 1, 10), T(2020, 1, 1)
    stream = arrivals(
        spark, [("a", day, "s"), ("b", day, "s"), ("a", day, "s")], [("a", day, "s"), ("late", old, "s"), ("n", None, "s")],
        [("n", None, "s"), ("late", old, "s"), ("c", T(2023, 1, 1), "s")],
    )
    out = scratch_dir(spark, "out")
    once = ingest.distinct_within(stream, "event_id", "1 hour")
    rollups.append_to(once, out, scratch_dir(spark, "offsets")).awaitTermination()
    assert values(spark.read.parquet(out), "event_id") == [(k,) for k in ("a", "b", "c", "late", "n")]


def test_repeats_after_the_delay_are_left_to_the_merge(spark):
    day = T(2024, 1, 10)
    stream = ingest.distinct_within(arrivals(spark, [("a", day, "s")], [("b", day, "s")], [("a", day, "s")]), "event_id", "0 seconds")
    base = scratch_dir(spark, "base")
    merge = ingest.merge_batches(base, "run", "event_id", ["observed_at_utc"], "feed", ["stop_id"])
    running = stream.writeStream.foreachBatch(merge).option("checkpointLocation", scratch_dir(spark, "offsets"))
    running.trigger(availableNow=True).start().awaitTermination()
    assert values(ingest.read_base(spark, base), "event_id") == [("a",), ("b",)]


def test_open_windows_complete_the_closed_ones(spark, frame):
    folder = scratch_dir(spark, "status")
    schema = "station_id string, snapshot_ts timestamp_ntz, num_bikes_available long"
    rows = [("s", T(2024, 1, 1, h), h % 2) for h in range(20)] + [("t", T(2024, 1, 3, 1), 1), ("s", T(2024, 1, 3, 2, 30), None)]
    frame(rows, schema).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(schema).parquet(folder)
    out, offsets = scratch_dir(spark, "hours"), scratch_dir(spark, "offsets")
    rollups.append_to(rollups.hourly_stream(stream, "station_id", "snapshot_ts", "n"), out, offsets).awaitTermination()
    closed, open_ = spark.read.parquet(out), rollups.open_hours(spark, offsets, "n")
    assert values(open_, "station_id", "ts_hour", "n") == [("s", T(2024, 1, 3, 2), 1), ("t", T(2024, 1, 3, 1), 1)]
    assert closed.count() + open_.count() == 22
    out, offsets = scratch_dir(spark, "ratios"), scratch_dir(spark, "offsets")
    rollups.append_to(rollups.active_ratio_stream(stream), out, offsets).awaitTermination()
    every = spark.read.parquet(out).unionByName(rollups.open_ratios(spark, offsets))
    whole = every.where("window_end = TIMESTAMP_NTZ '2024-01-10 00:00:00'")
    assert values(whole, "station_id", "active_ratio") == [("s", 10 / 21), ("t", 1.0)]
    assert every.count() == every.select("station_id", "window_end").distinct().count() == 16 + 14


def files_below(path):
    import pathlib

    return [p for p in pathlib.Path(path).rglob("*.parquet") if "manifest" not in p.parts]


def filled(spark, frame, batches=12):
    path = scratch_dir(spark, "table")
    step = ingest.merge_batches(path, "run", "event_id", ["observed_at_utc"], "feed", ["stop_id"])
    for i in range(batches):
        rows = [(f"k{i}-{j}", T(2024, 1, 1 + j % 2, 5), "s") for j in range(4)]
        step(batch(frame, *rows, ("twice", T(2024, 1, 1), "s"), (f"n{i}", None, "s")), i)
    return path, step


def test_compaction_keeps_rows_and_leaves_few_files(spark, frame):
    path, step = filled(spark, frame)
    before = values(ingest.read_base(spark, path), "event_id", "key_day")
    assert len(before) == len(set(before)) == 12 * 5 + 1
    assert upkeep.compact_days(spark, path, "2024-01-02", "event_id") == ["1970-01-01", "2024-01-01"]
    assert values(ingest.read_base(spark, path), "event_id", "key_day") == before
    assert values(ingest.read_base(spark, path, ["2024-01-01"]), "event_id", "key_day") == [v for v in before if v[1] == "2024-01-01"]
    assert upkeep.vacuum(spark, path) > 0
    assert values(ingest.read_base(spark, path), "event_id", "key_day") == before
    assert len([f for f in files_below(path) if "2024-01-02" not in str(f)]) <= 4
    # a late row, a known key and a repeat of the last batch after the compaction
    step(batch(frame, ("late", T(2024, 1, 1), "s"), ("k3-0", T(2024, 1, 1, 5), "s")), 12)
    rows = [(f"k11-{j}", T(2024, 1, 1 + j % 2, 5), "s") for j in range(4)]
    step(batch(frame, *rows, ("twice", T(2024, 1, 1), "s"), ("n11", None, "s")), 11)
    after = values(ingest.read_base(spark, path), "event_id", "key_day")
    assert after == sorted([*before, ("late", "2024-01-01")])
    assert upkeep.compact_days(spark, path, "2024-01-03", "event_id") == ["2024-01-02"]
    assert upkeep.compact_days(spark, path, "2024-01-03", "event_id", min_batches=1) == ["2024-01-01"]
    upkeep.vacuum(spark, path)
    assert values(ingest.read_base(spark, path), "event_id", "key_day") == after
    assert upkeep.compact_days(spark, path, "2024-01-03", "event_id") == []


def test_a_crashed_compaction_changes_nothing(spark, frame, monkeypatch):
    path, _ = filled(spark, frame, 3)
    before = values(ingest.read_base(spark, path), "event_id", "key_day")

    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # new files are written, the manifest is not
        m.setattr(upkeep, "_commit", crash)
        try:
            upkeep.compact_days(spark, path, "2025-01-01", "event_id")
            raise AssertionError("the crash did not happen")
        except RuntimeError:
            pass
    assert files_below(f"{path}/compacted")
    # a manifest that was not written to its end does not count either
    spark.createDataFrame([("2024-01-01", "none", "run", 0)], upkeep.MANIFEST).write.parquet(f"{path}/manifest/1")
    import pathlib

    pathlib.Path(f"{path}/manifest/1/_SUCCESS").unlink()
    assert values(ingest.read_base(spark, path), "event_id", "key_day") == before
    assert len(upkeep.compact_days(spark, path, "2025-01-01", "event_id")) == 3
    upkeep.vacuum(spark, path)
    assert values(ingest.read_base(spark, path), "event_id", "key_day") == before


def test_no_table_yet(spark):
    path = scratch_dir(spark, "none")
    assert ingest.read_base(spark, path) is None and upkeep.compact_days(spark, path, "2024-01-01", "x") == []
    assert upkeep.vacuum(spark, path) == 0


def test_a_batch_writes_few_files_per_day(spark, frame, monkeypatch):
    """Each day of a batch is one file, or one per ``FILE_ROWS`` rows, however many tasks a streaming batch has."""
    folder, out = scratch_dir(spark, "arrivals"), scratch_dir(spark, "base")
    rows = [(f"k{i}", T(2024, 1, 1 + i % 3), "s") for i in range(600)]
    batch(frame, *rows).repartition(4).write.parquet(folder)
    for name, limit in (("wide", 1_000_000), ("narrow", 150)):
        monkeypatch.setattr(ingest, "FILE_ROWS", limit, raising=False)
        stream = ingest.distinct_within(spark.readStream.schema(SCHEMA).parquet(folder), "event_id", "1 hour")
        step = ingest.merge_batches(f"{out}/{name}", "run", "event_id", ["observed_at_utc"], "feed", ["stop_id"])
        running = stream.writeStream.foreachBatch(step).option("checkpointLocation", scratch_dir(spark, "offsets"))
        running.trigger(availableNow=True).start().awaitTermination()
        table = ingest.read_base(spark, f"{out}/{name}")
        files = table.withColumn("file", F.input_file_name()).groupBy("key_day").agg(F.countDistinct("file").alias("files"), F.count("*").alias("n"))
        assert [n for _, n in values(files, "key_day", "n")] == [200, 200, 200]
        most = 1 if name == "wide" else 2
        assert all(f <= most for _, f in values(files, "key_day", "files"))
