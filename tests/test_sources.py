"""Landed files: pages, newest object, archives, table layouts and broken input."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from curbline.operators import quality, schedule
from curbline.session import cut_lineage, scratch_dir, shared_folder
from curbline.sources import landed, schemas, tables
from tests.conftest import values

T = dt.datetime


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        file.write(text)


def page(*items):
    return json.dumps({"data": list(items), "links": {"next": None}}, indent=1)


def test_prediction_pages_over_many_lines(spark, tmp_path):
    full = {
        "id": "p1",
        "attributes": {
            "arrival_time": "2025-01-01T00:00:00-05:00", "departure_time": None,
            "updated_at": "2025-01-01T04:59:00Z", "direction_id": 1, "status": "On time",
        },
        "relationships": {
            "trip": {"data": {"id": "t1"}}, "stop": {"data": None}, "route": {"data": {"id": "Red"}},
        },
    }
    bare = {"id": "p2", "attributes": {}}
    write(f"{tmp_path}/dt=2025-01-01/a.json", page(full, bare))
    write(f"{tmp_path}/dt=2025-01-01/b.json", "{ not json")
    pages = landed.read_pages(spark, str(tmp_path), schemas.PREDICTION_PAGE)
    good, bad = quality.split_readable(pages.cache())
    assert bad.count() == 1
    rows = landed.flatten_predictions(good, F.lit("2025-01-01 05:00:00")).orderBy("trip_id").collect()
    assert rows[0].trip_id is None and rows[0].route_id is None
    row = rows[1]
    assert (row.trip_id, row.stop_id, row.route_id) == ("t1", None, "Red")
    assert row.pred_arrival_utc == T(2025, 1, 1, 5) and row.pred_departure_utc is None
    assert row.service_date == dt.date(2025, 1, 1) and row.delay_sec is None
    assert len(row) == 17


def test_latest_object_by_name_and_empty_folder(spark, tmp_path):
    body = {"last_updated": 1704067200, "data": {"stations": [{"station_id": "1", "num_bikes_available": 3}]}}
    for run, bikes in (("20240102T000000Z", 5), ("20240103T000000Z", 7), ("20240101T000000Z", 1)):
        body["data"]["stations"][0]["num_bikes_available"] = bikes
        write(f"{tmp_path}/dt=2024-01-01/run_{run}.json", json.dumps(body))
    pages = landed.read_latest(spark, str(tmp_path), schemas.STATUS_PAGE)
    row = landed.path_lineage(landed.flatten_feed(pages, "stations", F.lit("2024-01-31 00:00:00"))).first()
    assert row.num_bikes_available == 7 and row.run_id == "20240103T000000Z" and row.dt == "2024-01-01"
    assert row.snapshot_ts == T(2024, 1, 1)
    os.makedirs(f"{tmp_path}/empty")
    with pytest.raises(FileNotFoundError):
        landed.read_latest(spark, f"{tmp_path}/empty", schemas.STATUS_PAGE)


def test_archives_with_missing_files_and_other_column_orders(spark, tmp_path):
    for archive, header, line in (
        ("a", "stop_id,stop_name,stop_lat,stop_lon,zone", "S1,First,42.0,-71.0,z"),
        ("b", "zone,stop_lon,stop_lat,stop_name,stop_id", "z,-71.5,42.5,Second,S1"),
        ("c", "stop_id,stop_name,stop_lat,stop_lon", "S1,Third,42.0,-71.0"),
    ):
        write(f"{tmp_path}/{archive}/stops.txt", f"{header}\n{line}\n")
        write(f"{tmp_path}/{archive}/trips.txt", "route_id,service_id,trip_id,direction_id\nR,s,T1,0\n,s,T2,1\n")
        if archive != "c":
            write(
                f"{tmp_path}/{archive}/stop_times.txt",
                "trip_id,arrival_time,stop_id,stop_sequence\nT1,25:10:00,S1,2\nT1,23:50:00,S1,1\n",
            )
    files = landed.read_schedules(spark, str(tmp_path))
    assert values(files["stops"], "archive", "stop_name", "stop_lat") == [("a", "First", 42.0), ("b", "Second", 42.5)]
    trips = files["trips"].withColumn("service_date", F.lit("2025-03-01").cast("date"))
    rows = schedule.scheduled_trips(
        trips, files["stop_times"], files["stops"], "2025-03-02 00:00:00", "2025-03-01", "2025-03-02"
    )
    got = values(rows, "trip_id", "start_station_name", "scheduled_start_time", "scheduled_end_time")
    ends = (T(2025, 3, 1, 23, 50), T(2025, 3, 2, 1, 10))
    assert got == [("T1", "First", *ends), ("T1", "Second", *ends)]


def test_day_layout_prunes_and_keeps_rows(spark, frame, tmp_path):
    rows = frame(
        [(T(2024, 1, 1 + i % 3, 5), f"r{i % 2}", i) for i in range(30)],
        "observed_at_utc timestamp_ntz, route_id string, n int",
    )
    path = f"{tmp_path}/days"
    tables.write_by_day(rows, path, "observed_at_utc", "observed_date", "route_id")
    day = spark.read.parquet(path).filter(F.col("observed_date") == "2024-01-02")
    assert day.count() == 10 and spark.read.parquet(path).count() == 30
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(observed_date" in plan


def test_replace_append_and_guards(spark, frame, tmp_path):
    path = f"{tmp_path}/t"
    rows = frame([(1,), (2,)], "n int")
    with pytest.raises(FileNotFoundError):
        tables.require_table(spark, path)
    tables.replace(rows, path)
    tables.replace(rows, path)
    tables.append(rows, path)
    assert tables.require_table(spark, path).count() == 4
    with pytest.raises(ValueError):
        tables.require_rows(rows.limit(0), "rows")


def test_new_rows_reads_only_the_days_of_the_batch(spark, frame, tmp_path):
    base_rows = frame([(f"k{i}", f"2024-01-{1 + i % 5:02d}", i) for i in range(50)], "k string, day string, n int")
    base_rows.write.partitionBy("day").parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base").withColumn("day", F.col("day").cast("string"))
    batch = frame([("k1", "2024-01-02", 1), ("x", "2024-01-02", 2), ("x", "2024-01-02", 1)], "k string, day string, n int")
    assert values(tables.new_rows(base, batch, "k", ["n"], "day"), "k", "n") == [("x", 1)]


def test_station_dimension(frame):
    info = frame(
        [("1", "old", "A", "9", ["KEY", "APP"]), ("2", "old", "B", None, [])],
        "station_id string, legacy_id string, name string, region_id string, rental_methods array<string>",
    )
    got = landed.station_dimension(info, frame([("9", "North")], "region_id string, name string"))
    assert "legacy_id" not in got.columns
    assert values(got, "station_id", "region_name", "rental_methods") == [("1", "North", "KEY,APP"), ("2", None, "")]


def test_shared_folder_follows_the_session(spark, tmp_path):
    own = shared_folder(spark)
    assert own and scratch_dir(spark, "x") != scratch_dir(spark, "x")
    spark.conf.set("spark.checkpoint.dir", str(tmp_path)) if _settable(spark) else None
    if _settable(spark):
        assert shared_folder(spark) == str(tmp_path)
        spark.conf.unset("spark.checkpoint.dir")
    assert cut_lineage(spark.range(5)).count() == 5


def _settable(spark):
    return spark.conf.isModifiable("spark.checkpoint.dir")


def test_archives_are_read_in_one_scan_whatever_their_column_order(spark, tmp_path):
    def land(n):
        root = tmp_path / f"root{n}"
        for i in range(n):
            folder = root / f"a{i:02}"
            folder.mkdir(parents=True)
            (folder / "stops.txt").write_text(f"\ufeffstop_lat,stop_id,stop_name,stop_lon\n4{i % 10}.5,s{i},\"A, B\",-71\n\n")
            (folder / "trips.txt").write_text(f"trip_id,note,route_id,service_id,direction_id\nt{i},x,r,v,{i % 2}\n")
            (folder / "stop_times.txt").write_text(f"stop_sequence,stop_id,trip_id,arrival_time\n1,s{i},t{i},08:00:00\nbad,s{i},t{i},09:00:00\n")
        (root / "zz").mkdir()
        (root / "zz" / "stops.txt").write_text("stop_id,stop_name,stop_lat,stop_lon\nlost,x,1,1\n")
        return landed.read_schedules(spark, str(root))

    few, many = land(2), land(14)
    assert values(few["stops"], "archive", "stop_id", "stop_name", "stop_lat") == [("a00", "s0", "A, B", 40.5), ("a01", "s1", "A, B", 41.5)]
    assert many["stops"].count() == 14 and many["stop_times"].count() == 28
    assert many["stop_times"].where("stop_sequence IS NULL").count() == 14
    plans = [f["trips"]._jdf.queryExecution().executedPlan().toString().count("FileScan text") for f in (few, many)]
    assert plans[0] == plans[1]


def test_archive_lines_are_parsed_once(spark, tmp_path):
    """Headers are stored and broadcast; no line is searched for its archive or parsed once per column."""
    write(f"{tmp_path}/a/stops.txt", "stop_id,stop_name,stop_lat,stop_lon\r\nS1,First,42.0,-71.0\r\n")
    write(f"{tmp_path}/a/trips.txt", "route_id,service_id,trip_id,direction_id\nR,s,T1,0\n")
    write(f"{tmp_path}/a/stop_times.txt", "trip_id,arrival_time,stop_id,stop_sequence\nT1,08:00:00,S1,1\n")
    files = landed.read_schedules(spark, str(tmp_path))
    plan = files["trips"].where("trip_id IS NOT NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("text") == 1 and plan.count("from_csv") <= 2 and "regexp" not in plan
    assert values(files["stops"], "archive", "stop_id", "stop_lon") == [("a", "S1", -71.0)]


def test_runs_count_once_complete(spark, tmp_path):
    from curbline.sources import tables

    path = f"{tmp_path}/runs"
    with pytest.raises(FileNotFoundError):
        tables.read_runs(spark, path)
    assert tables.append_run(spark.range(3), path, "r1") and tables.append_run(spark.range(2), path, "7")
    assert not tables.append_run(spark.range(9), path, "r1")
    spark.range(5).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/run_id=r9")
    assert values(tables.read_runs(spark, path).groupBy("run_id").count(), "run_id", "count") == [("7", 2), ("r1", 3)]
    assert tables.append_run(spark.range(4), path, "r9")
    assert values(tables.read_runs(spark, path).where("run_id = 'r9'"), "id") == [(0,), (1,), (2,), (3,)]


def test_latest_of_equal_names_is_the_one_modified_last(spark):
    times = [f"2024-01-30 23:59:25.{n}" for n in (100, 900, 500)]
    for order in (times, times[::-1]):
        rows = spark.createDataFrame([("/dt=2024-01-30/run_20240130T235925Z.json", ts) for ts in order], "path string, ts string")
        newest = landed.latest_object(rows.select("path", rows.ts.cast("timestamp_ntz").alias("modified_at")).coalesce(1)).first()
        assert newest.modified_at.microsecond == 900_000
