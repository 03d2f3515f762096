"""Landed feeds, row quality and the insert-only merge."""

from pyspark.sql import functions as F

from curbline.functions import text, times
from curbline.operators import quality, schedule
from curbline.operators.coverage import latest_info
from curbline.plans.inputs import AS_OF
from curbline.plans.registry import query
from curbline.session import scratch_dir
from curbline.sources import landed, schemas, tables

OBSERVED_AT = "2024-01-31 02:30:00"

_FLAT = """
SELECT event_id, observed_at_utc, feed_timestamp_utc, route_id, direction_id, trip_id, stop_id, CAST(NULL AS VARCHAR) AS parent_station, service_date,
  CAST(NULL AS TIMESTAMP) AS sched_arrival_utc, CAST(NULL AS TIMESTAMP) AS sched_departure_utc, pred_arrival_utc, pred_departure_utc,
  CAST(NULL AS BIGINT) AS delay_sec, current_status, CAST(NULL AS BIGINT) AS headway_branch_sec, CAST(NULL AS BIGINT) AS headway_trunk_sec
FROM flat_predictions"""


def predictions(t, repeat_every=None):
    pages = landed.parse_pages(t.prediction_pages(repeat_every), "body", schemas.PREDICTION_PAGE)
    return landed.flatten_predictions(pages, F.lit(OBSERVED_AT))


def dates_as_text(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


@query("flat_predictions", "S-1 P-1 P-2 P-3", _FLAT)
def flat_predictions(t):
    return dates_as_text(predictions(t), "service_date")


@query("landed_predictions", "S-1 S-5", _FLAT)
def landed_predictions(t):
    """The same through real files: pages are landed as JSON and read back by schema."""
    path = scratch_dir(t.spark, "landed-predictions")
    t.prediction_pages().select("body").write.text(path)
    pages = landed.read_lines(t.spark, path, schemas.PREDICTION_PAGE)
    return dates_as_text(landed.flatten_predictions(pages, F.lit(OBSERVED_AT)), "service_date")


@query(
    "flat_vehicles",
    "S-2 P-1 P-3",
    """
SELECT snapshot_id, observed_at_utc, vehicle_timestamp_utc, vehicle_id, vehicle_label, route_id, direction_id, trip_id, CAST(NULL AS VARCHAR) AS stop_id,
  latitude, longitude, bearing, CAST(NULL AS DOUBLE) AS speed_mps, current_status, occupancy_status, occupancy_percent FROM flat_vehicles""",
)
def flat_vehicles(t):
    pages = landed.parse_pages(t.vehicle_pages, "body", schemas.VEHICLE_PAGE)
    return landed.flatten_vehicles(pages, F.lit(OBSERVED_AT))


_STATUS = """
WITH page_times AS (SELECT event_id // 100 AS page, max(last_reported) AS updated FROM station_status GROUP BY 1),
rows_ AS (SELECT s.station_id, s.num_bikes_available, s.num_docks_available, s.last_reported,
    CASE WHEN p.page % 9 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE make_timestamp(p.updated * 1000000) END AS snapshot_ts
  FROM station_status s JOIN page_times p ON p.page = s.event_id // 100)
"""


@query(
    "flat_station_status",
    "S-3 P-12",
    _STATUS + "SELECT *, hour(make_timestamp(last_reported * 1000000)) AS reported_hour FROM rows_",
)
def flat_station_status(t):
    pages = landed.parse_pages(t.status_pages, "body", schemas.STATUS_PAGE)
    rows = landed.flatten_feed(pages, "stations", F.lit(AS_OF))
    return rows.select(
        "station_id", "num_bikes_available", "num_docks_available", "last_reported", "snapshot_ts",
        F.hour(times.from_epoch(F.col("last_reported"))).alias("reported_hour"),
    )


@query(
    "local_display_times",
    "P-13",
    """
SELECT o_orderkey, strftime(o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S') ||
  CASE WHEN (o_orderdate AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') = o_orderdate - INTERVAL '5' HOUR THEN ' EST' ELSE ' EDT' END AS shown
FROM orders""",
)
def local_display_times(t):
    return t.table("orders").select("o_orderkey", times.local_display(F.col("o_orderdate")).alias("shown"))


_ISO = """concat(strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S'), {0})"""


@query(
    "normalised_instants",
    "P-1",
    """
SELECT event_id, CASE event_id % 7 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts) + INTERVAL '5' HOUR
  WHEN 2 THEN date_trunc('second', ts) - INTERVAL '330' MINUTE WHEN 3 THEN date_trunc('second', ts) END AS instant FROM events""",
)
def normalised_instants(t):
    shown = "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")"
    raw = t.table("events").selectExpr(
        "event_id",
        f"""CASE event_id % 7 WHEN 0 THEN concat({shown}, 'Z') WHEN 1 THEN concat({shown}, '-05:00')
            WHEN 2 THEN concat({shown}, '+05:30') WHEN 3 THEN {shown} WHEN 4 THEN '2024' WHEN 5 THEN '' ELSE 'bogus' END AS raw""",
    )
    return raw.select("event_id", times.iso_utc(F.col("raw")).alias("instant"))


@query(
    "service_dates",
    "P-2",
    """
SELECT event_id, strftime(ts - INTERVAL '3' HOUR, '%Y-%m-%d') AS service_date,
  strftime((ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') - INTERVAL '3' HOUR, '%Y-%m-%d') AS local_service_date FROM events""",
)
def service_dates(t):
    ts = F.col("ts")
    return t.table("events").select(
        "event_id",
        times.service_date(ts).cast("string").alias("service_date"),
        times.service_date(ts, zone=times.LOCAL_ZONE).cast("string").alias("local_service_date"),
    )


@query(
    "composite_keys",
    "P-3",
    """
SELECT o_orderkey, sha1(concat_ws('|', CAST(o_orderkey AS VARCHAR), CASE WHEN o_custkey % 3 = 0 THEN '' ELSE CAST(o_custkey AS VARCHAR) END,
  printf('%.6f', o_totalprice), o_orderpriority)) AS key FROM orders""",
)
def composite_keys(t):
    customer = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))
    key = text.sha1_key(
        F.col("o_orderkey"), customer, text.fixed_decimal(F.col("o_totalprice")), F.col("o_orderpriority")
    )
    return t.table("orders").select("o_orderkey", key.alias("key"))


def _objects(t):
    """Object names as a feed lands them; one in ten lacks a run time in its name."""
    return t.table("events").selectExpr(
        """concat('/landing/status/dt=', date_format(ts, 'yyyy-MM-dd'), CASE WHEN event_id % 10 = 0 THEN concat('/page_', CAST(event_id AS STRING), '.json')
           ELSE concat('/run_', date_format(ts, "yyyyMMdd'T'HHmmss"), 'Z.json') END) AS path""",
        "ts AS modified_at",
    )


_OBJECTS = """
WITH objects AS (SELECT concat('/landing/status/dt=', strftime(ts, '%Y-%m-%d'), CASE WHEN event_id % 10 = 0 THEN concat('/page_', CAST(event_id AS VARCHAR), '.json')
  ELSE concat('/run_', strftime(ts, '%Y%m%dT%H%M%S'), 'Z.json') END) AS path, ts AS modified_at FROM events)
"""


@query(
    "latest_object",
    "S-4",
    _OBJECTS + """
SELECT path, modified_at FROM objects
ORDER BY CASE WHEN contains(path, '/run_') THEN regexp_extract(path, 'run_(.*)\\.json$', 1) ELSE strftime(modified_at, '%Y-%m-%dT%H:%M:%S.%f') END DESC, path DESC LIMIT 1""",
)
def latest_object(t):
    return landed.latest_object(_objects(t))


@query(
    "path_lineage",
    "S-5",
    _OBJECTS + """
SELECT path, modified_at, nullif(regexp_extract(path, 'dt=(\\d{4}-\\d{2}-\\d{2})/', 1), '') AS dt, nullif(regexp_extract(path, 'run_(\\d{8}T\\d{6}Z)\\.json$', 1), '') AS run_id FROM objects""",
)
def path_lineage(t):
    return landed.path_lineage(_objects(t), "path")


@query(
    "schedule_archive_scan",
    "S-6 J-15",
    """
SELECT trip_id, route_id, service_id, start_station_name, start_station_id, end_station_name, end_station_id FROM
 (SELECT CAST(s.trip_id AS VARCHAR) AS trip_id, s.* EXCLUDE (trip_id) FROM scheduled s) q""",
)
def schedule_archive_scan(t):
    """Schedules through CSV archives whose columns differ in order; an archive without stop times is skipped."""
    root = scratch_dir(t.spark, "schedules")
    for frame, file, key in ((t.stops, "stops", None), (t.trips, "trips", "trip_id"), (t.stop_times, "stop_times", "trip_id")):
        noted = frame.withColumn("note", F.lit("not, used"))
        for archive, rest in (("2024a", 0), ("2024c", 1)):
            own = noted if key is None else noted.where(F.col(key) % 2 == rest)
            columns = own.columns if rest == 0 else own.columns[::-1]
            own.select(*columns).write.option("header", True).csv(f"{root}/{archive}/{file}.txt")
    t.stops.write.option("header", True).csv(f"{root}/2024b/stops.txt")
    files = landed.read_schedules(t.spark, root)
    trips = files["trips"].withColumn("service_date", F.lit("2024-01-01").cast("date"))
    rows = schedule.scheduled_trips(trips, files["stop_times"], files["stops"], AS_OF)
    return rows.select(
        "trip_id", "route_id", "service_id", "start_station_name", "start_station_id",
        "end_station_name", "end_station_id",
    )


@query(
    "newest_landed_run",
    "S-4 S-5",
    """
SELECT station_id, num_bikes_available, date_trunc('second', snapshot_ts) AS snapshot_ts, '2024-01-30' AS dt FROM station_status WHERE event_id % 3 = 2""",
)
def newest_landed_run(t):
    """Three runs landed as files; the one with the latest time in its name is read, written first or not."""
    root = scratch_dir(t.spark, "runs")
    second = F.date_trunc("SECOND", "snapshot_ts").cast("timestamp_ntz").alias("snapshot_ts")
    rows = t.station_status.select("station_id", "num_bikes_available", second, "event_id")
    for part, run in ((2, "20240130T120000Z"), (0, "20240129T120000Z"), (1, "20240130T090000Z")):
        own = rows.where(F.col("event_id") % 3 == part).drop("event_id")
        own.write.json(f"{root}/dt={run[:4]}-{run[4:6]}-{run[6:8]}/run_{run}.json")
    newest = landed.read_newest_run(t.spark, root, "station_id string, num_bikes_available bigint, snapshot_ts timestamp_ntz")
    return landed.path_lineage(newest).select("station_id", "num_bikes_available", "snapshot_ts", "dt")


@query(
    "archive_index",
    "S-7",
    """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS feed_start_date, 'archive-' || CAST(o_orderkey AS VARCHAR) AS archive_url FROM orders
WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0 AND o_orderdate >= TIMESTAMP '1997-01-01 00:00:00' AND o_orderdate <= TIMESTAMP '1997-09-30 00:00:00'""",
)
def archive_index(t):
    index = t.table("orders").selectExpr(
        "o_orderkey",
        "CASE WHEN o_orderkey % 5 = 0 THEN 'soon' ELSE date_format(o_orderdate, 'yyyyMMdd') END AS feed_start_date",
        "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE concat(' archive-', CAST(o_orderkey AS STRING), ' ') END AS archive_url",
    )
    return dates_as_text(landed.select_archives(index, "1997-01-01", "1997-09-30"), "feed_start_date")


@query(
    "landing_folders",
    "S-8",
    """
SELECT strftime(ts, '%Y-%m-%d') AS dt, CASE WHEN hour(ts) < 12 THEN '00' ELSE '12' END AS hh, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS id_sum FROM events GROUP BY 1, 2""",
)
def landing_folders(t):
    """A feed landed twice a day, read back with its folder keys as columns."""
    path = scratch_dir(t.spark, "landing")
    half_day = F.timestamp_add("HOUR", F.floor(F.hour("ts") / 12) * 12, F.date_trunc("DAY", "ts"))
    rows = t.table("events").select("event_id", half_day.alias("ts"))
    tables.land_partitioned(rows, path, "ts")
    back = landed.read_lines(t.spark, path, "event_id bigint, dt string, HH string, mm string")
    return back.groupBy("dt", F.col("HH").alias("hh")).agg(
        F.count("*").alias("n"), F.sum("event_id").alias("id_sum")
    )


@query(
    "day_partitioned_table",
    "S-12 S-13 P-6",
    """
SELECT strftime(observed_at_utc, '%Y-%m-%d') AS observed_date, route_id, count(*) AS n FROM vehicle_positions
WHERE observed_at_utc >= TIMESTAMP '2024-01-10 00:00:00' AND observed_at_utc < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2""",
)
def day_partitioned_table(t):
    path = scratch_dir(t.spark, "vehicle-days")
    tables.write_by_day(t.vehicle_positions, path, "observed_at_utc", "observed_date", "route_id")
    days = t.spark.read.parquet(path).filter(F.col("observed_date").between("2024-01-10", "2024-01-19"))
    return dates_as_text(
        days.groupBy("observed_date", "route_id").agg(F.count("*").alias("n")), "observed_date"
    )


@query(
    "replace_and_append",
    "S-9 S-10 S-11 S-14 Q-4",
    """
SELECT o_orderstatus, 2 * count(*) AS n FROM orders GROUP BY 1""",
)
def replace_and_append(t):
    """A table written three times: first version, replacement, then an append."""
    path = scratch_dir(t.spark, "orders")
    source = tables.require_table(t.spark, f"{t.folder}/orders.parquet").select("o_orderkey", "o_orderstatus")
    tables.append(source.limit(0), path)
    tables.replace(source, path)
    tables.append(source, path)
    stored = tables.require_rows(tables.require_table(t.spark, path), "orders")
    return stored.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(
    "station_dimension",
    "S-15",
    """
SELECT i.station_id, i.name, i.region_id, r.r_name AS region_name,
  CASE CAST(i.station_id AS BIGINT) % 3 WHEN 0 THEN '' WHEN 1 THEN 'KEY' ELSE 'KEY,CREDITCARD' END AS rental_methods
FROM latest_info i LEFT JOIN region r ON r.r_regionkey = i.region_id""",
)
def station_dimension(t):
    info = latest_info(t.station_info).selectExpr(
        "station_id", "name", "region_id", "concat('old', station_id) AS legacy_id",
        """CASE CAST(station_id AS BIGINT) % 3 WHEN 0 THEN array() WHEN 1 THEN array('KEY')
           ELSE array('KEY', 'CREDITCARD') END AS rental_methods""",
    )
    regions = t.table("region").selectExpr("r_regionkey AS region_id", "r_name AS name")
    return landed.station_dimension(info, regions)


@query(
    "vehicle_dimension",
    "S-16",
    """
SELECT vehicle_id, arg_max(route_id, observed_at_utc) AS route_id, arg_max(current_status, observed_at_utc) AS current_status,
  arg_max(occupancy_status, observed_at_utc) FILTER (WHERE occupancy_status IS NOT NULL) AS occupancy_status
FROM vehicle_positions GROUP BY vehicle_id""",
)
def vehicle_dimension(t):
    return landed.latest_attributes(
        t.vehicle_positions, "vehicle_id", "observed_at_utc", ["route_id", "current_status", "occupancy_status"]
    )


def _newest_sql(key, ts, columns, view):
    """Newest value that is not NULL of each column; equal times go to the greater value."""
    picks = ", ".join(f"(max({{'t': {ts}, 'v': {c}}}) FILTER (WHERE {c} IS NOT NULL)).v AS {c}" for c in columns)
    return f"SELECT {key}, {picks} FROM {view} WHERE {key} IS NOT NULL GROUP BY {key}"


TRIP_FIELDS, STOP_FIELDS = ["route_id", "direction_id", "status"], ["route_id", "status"]
ROUTE_FIELDS = ["direction_id", "current_status", "occupancy_status"]


@query("trip_dimension", "S-16", _newest_sql("trip_id", "ts", TRIP_FIELDS, "prediction_items"))
def trip_dimension(t):
    return landed.latest_attributes(t.prediction_items, "trip_id", "ts", TRIP_FIELDS)


@query("route_dimension", "S-16", _newest_sql("route_id", "observed_at_utc", ROUTE_FIELDS, "vehicle_positions"))
def route_dimension(t):
    return landed.latest_attributes(t.vehicle_positions, "route_id", "observed_at_utc", ROUTE_FIELDS)


@query(
    "stop_dimension",
    "S-16",
    f"""
SELECT d.*, s.station_name AS stop_name, s.lat AS stop_lat, s.lng AS stop_lon
FROM ({_newest_sql("stop_id", "ts", STOP_FIELDS, "prediction_items")}) d LEFT JOIN transit_stations s ON s.station_id = d.stop_id""",
)
def stop_dimension(t):
    """Stops of the feed with their newest attributes; names and places are joined to one row per stop."""
    newest = landed.latest_attributes(t.prediction_items, "stop_id", "ts", STOP_FIELDS)
    return newest.join(t.stops, "stop_id", "left")


@query(
    "rejected_predictions",
    "Q-1 P-4",
    "SELECT 'stop_id' AS reject_reason, trip_id, pred_arrival_utc, count(*) AS n FROM flat_predictions WHERE stop_id IS NULL GROUP BY ALL",
)
def rejected_predictions(t):
    _, rejected = quality.split_contract(predictions(t), [*schemas.PREDICTIONS_REQUIRED, "stop_id"])
    return rejected.groupBy(quality.REASON, "trip_id", "pred_arrival_utc").agg(F.count("*").alias("n"))


@query(
    "accepted_predictions",
    "Q-1 Q-2",
    "SELECT DISTINCT event_id, route_id, trip_id, stop_id FROM flat_predictions WHERE stop_id IS NOT NULL",
)
def accepted_predictions(t):
    """Every tenth prediction arrives twice; each key is kept once."""
    valid, _ = quality.split_contract(predictions(t, repeat_every=10), [*schemas.PREDICTIONS_REQUIRED, "stop_id"])
    unique = quality.first_seen(valid, "event_id", ["observed_at_utc"])
    return unique.select("event_id", "route_id", "trip_id", "stop_id")


@query(
    "insert_only_merge",
    "Q-3 J-17",
    """
SELECT event_id, ts, user_id FROM events WHERE event_id % 10 <> 0 AND event_id % 4 = 1""",
)
def insert_only_merge(t):
    """New rows of a batch that repeats a tenth of its keys, against a base with three quarters of them."""
    events = t.table("events").select("event_id", "ts", "user_id").withColumn("day", F.to_date("ts"))
    base = events.filter((F.col("event_id") % 4 != 1) | (F.col("event_id") % 10 == 0))
    batch = events.unionByName(events.filter(F.col("event_id") % 10 == 0))
    return tables.new_rows(base, batch, "event_id", ["ts"], "day").drop("day")


@query(
    "duplicate_stations",
    "Q-5 A-21",
    "SELECT count(*) AS row_count, count(DISTINCT station_id) AS unique_keys, count(*) - count(DISTINCT station_id) AS surplus_rows FROM station_info",
)
def duplicate_stations(t):
    return quality.duplicate_profile(t.station_info, "station_id")


@query(
    "feed_freshness",
    "Q-6",
    """
SELECT event_type, max(ts) AS newest, date_sub('minute', max(ts), TIMESTAMP '2024-01-31 00:00:00') AS age_minutes,
  date_sub('minute', max(ts), TIMESTAMP '2024-01-31 00:00:00') > 15 AS is_stale FROM events GROUP BY event_type""",
)
def feed_freshness(t):
    return quality.freshness(t.table("events"), "event_type", "ts", AS_OF, 15)


@query(
    "parsed_replies",
    "Q-7",
    """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_id % 4 <> 3 AS parsed FROM events""",
)
def parsed_replies(t):
    parsed = quality.parse_replies(t.replies, "reply", "k string")
    return parsed.select("event_id", F.col("fields.k").alias("k"), F.col("fields.k").isNotNull().alias("parsed"))


@query(
    "load_audit",
    "Q-8 Q-9",
    """
SELECT lang, count(*) AS row_count, count(CASE WHEN doc_id % 11 = 0 THEN 1 END) AS rejected FROM documents GROUP BY lang""",
)
def load_audit(t):
    rows = t.table("documents").select(
        "lang", F.when(F.col("doc_id") % 11 != 0, F.col("doc_id")).alias("doc_id")
    )
    return quality.load_audit(rows, "lang", ["doc_id"])


@query(
    "unreadable_pages",
    "Q-9",
    "SELECT event_id, substring(props, 1, 5) AS body FROM events WHERE event_id % 6 = 0",
)
def unreadable_pages(t):
    """Pages that do not parse are set aside with their text; the others go on."""
    pages = t.table("events").selectExpr(
        "event_id", "CASE WHEN event_id % 6 = 0 THEN substring(props, 1, 5) ELSE props END AS body"
    )
    _, bad = quality.split_readable(landed.parse_pages(pages, "body", "k bigint"))
    return bad.select("event_id", F.col(schemas.CORRUPT).alias("body"))
