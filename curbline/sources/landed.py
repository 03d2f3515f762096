"""Landed JSON pages and schedule archives as flat rows."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.functions import text, times
from curbline.session import cut_lineage, side_by_side
from curbline.sources import schemas

RUN_PATTERN = r"run_(\d{8}T\d{6}Z)\.json$"
RUN_PARTS = r"run_(\d{8}T\d{6}Z)\.json(/part-[^/]*)?$"  # a run may be one object or a folder of parts
DAY_PATTERN = r"dt=(\d{4}-\d{2}-\d{2})/"


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files with a declared schema. Every file may hold one page over many lines;
    an unreadable page gives a row with only the corrupt text, for ``quality.split_readable``."""
    return (
        spark.read.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .option("recursiveFileLookup", True)
        .json(path)
        .withColumn("source_object", F.col("_metadata.file_path"))
    )


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON with one document per line; ``key=value`` folders become columns."""
    return (
        spark.read.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(path)
    )


def parse_pages(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """Pages held as text in a column instead of files."""
    parsed = F.from_json(
        column,
        f"{schema}, {schemas.CORRUPT} string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": schemas.CORRUPT},
    )
    return lines.withColumn("_page", parsed).select(
        *[c for c in lines.columns if c != column], "_page.*"
    )


def _related(name: str) -> Column:
    return F.col(f"item.relationships.{name}.data.id")


def _items(pages: DataFrame, observed_at: Column) -> DataFrame:
    return pages.select(
        F.explode("data").alias("item"), times.as_instant(observed_at).alias("observed_at_utc")
    )


def flatten_predictions(pages: DataFrame, observed_at: Column) -> DataFrame:
    """Prediction pages to the 17-column record; a missing relationship is NULL."""
    attributes = "item.attributes"
    rows = _items(pages, observed_at).select(
        "observed_at_utc",
        times.iso_utc(F.col(f"{attributes}.updated_at")).alias("feed_timestamp_utc"),
        _related("route").alias("route_id"),
        F.col(f"{attributes}.direction_id").alias("direction_id"),
        _related("trip").alias("trip_id"),
        _related("stop").alias("stop_id"),
        times.iso_utc(F.col(f"{attributes}.arrival_time")).alias("pred_arrival_utc"),
        times.iso_utc(F.col(f"{attributes}.departure_time")).alias("pred_departure_utc"),
        F.col(f"{attributes}.status").alias("current_status"),
    )
    key = text.sha1_key(
        F.col("trip_id"), F.col("stop_id"), F.col("pred_arrival_utc"),
        F.col("pred_departure_utc"), F.col("feed_timestamp_utc"),
    )
    keyed_rows = rows.withColumns(
        {"event_id": key, "service_date": times.service_date(F.col("observed_at_utc"))}
    )
    return conform(keyed_rows, schemas.PREDICTIONS)


def flatten_vehicles(pages: DataFrame, observed_at: Column) -> DataFrame:
    """Vehicle pages to the 16-column record. Repeated snapshots are kept."""
    attributes = "item.attributes"
    rows = _items(pages, observed_at).select(
        "observed_at_utc",
        times.iso_utc(F.col(f"{attributes}.updated_at")).alias("vehicle_timestamp_utc"),
        F.col("item.id").alias("vehicle_id"),
        F.col(f"{attributes}.label").alias("vehicle_label"),
        _related("route").alias("route_id"),
        F.col(f"{attributes}.direction_id").alias("direction_id"),
        _related("trip").alias("trip_id"),
        _related("stop").alias("stop_id"),
        F.col(f"{attributes}.latitude").alias("latitude"),
        F.col(f"{attributes}.longitude").alias("longitude"),
        F.col(f"{attributes}.bearing").alias("bearing"),
        F.col(f"{attributes}.speed").alias("speed_mps"),
        F.col(f"{attributes}.current_status").alias("current_status"),
        F.col(f"{attributes}.occupancy_status").alias("occupancy_status"),
        F.col(f"{attributes}.occupancy_percentage").alias("occupancy_percent"),
    )
    key = text.sha1_key(
        F.col("vehicle_id"),
        text.fixed_decimal(F.col("latitude")),
        text.fixed_decimal(F.col("longitude")),
        F.col("vehicle_timestamp_utc"),
    )
    return conform(rows.withColumn("snapshot_id", key), schemas.VEHICLES)


def conform(df: DataFrame, schema: str) -> DataFrame:
    """Project to a declared schema; columns the frame lacks come out as NULL."""
    names_types = [part.strip().split(" ", 1) for part in schema.replace("\n", " ").split(",")]
    present = set(df.columns)
    return df.select(
        *[
            (F.col(name) if name in present else F.lit(None)).cast(kind.strip()).alias(name)
            for name, kind in names_types
        ]
    )


def flatten_feed(pages: DataFrame, items: str, loaded_at: Column) -> DataFrame:
    """Rows of a bike feed page, each stamped with the page's time.

    ``items`` names the list below ``data``. A page without a time gets ``loaded_at``.
    """
    stamp = F.coalesce(times.from_epoch(F.col("last_updated")), times.as_instant(loaded_at))
    carried = [c for c in ("source_object",) if c in pages.columns]
    return pages.select(
        F.explode(f"data.{items}").alias("_row"), stamp.alias("snapshot_ts"), *carried
    ).select("_row.*", "snapshot_ts", *carried)


def path_lineage(df: DataFrame, path: str = "source_object") -> DataFrame:
    """Day and run id from the object path; NULL where the path has none."""
    source = F.col(path)
    return df.withColumns(
        {
            "dt": F.nullif(F.regexp_extract(source, DAY_PATTERN, 1), F.lit("")),
            "run_id": F.nullif(F.regexp_extract(source, RUN_PATTERN, 1), F.lit("")),
        }
    )


def list_objects(spark: SparkSession, path: str) -> DataFrame:
    """Path and modification time of every object below ``path``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"))
    )


def latest_object(objects: DataFrame) -> DataFrame:
    """The newest object: greatest run time in the name, or modification time without one; of equal names the one
    that was modified last."""
    run = F.nullif(F.regexp_extract("path", RUN_PATTERN, 1), F.lit(""))
    order = F.coalesce(run, F.date_format("modified_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    newest = objects.withColumn("_order", order)
    return newest.agg(F.max_by(F.struct(*objects.columns), F.struct("_order", "path", "modified_at")).alias("o")).select(
        "o.*"
    )


def read_latest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pages of the newest object only. One path string comes to the driver."""
    newest = latest_object(list_objects(spark, path)).first()
    if newest is None or newest["path"] is None:
        raise FileNotFoundError(f"nothing landed below {path}")
    return read_pages(spark, newest["path"], schema)


def read_newest_run(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of the newest run below ``path``, with ``source_object``; only its objects are opened.

    Names and times come from listing; one run id comes to the driver and becomes the pattern of the scan.
    """
    run = F.nullif(F.regexp_extract("path", RUN_PARTS, 1), F.lit(""))
    newest = list_objects(spark, path).agg(F.max(run)).first()[0]
    if newest is None:
        raise FileNotFoundError(f"no run landed below {path}")
    lines = (
        spark.read.schema(f"{schema}, {schemas.CORRUPT} string")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", schemas.CORRUPT)
        .json(f"{path}/dt=*/run_{newest}.json")
    )
    return lines.withColumn("source_object", F.col("_metadata.file_path"))


def _schedule_lines(spark: SparkSession, root: str, file: str) -> DataFrame | None:
    """(path, line) of one kind of file in all archives; a file may also be a folder of parts."""
    try:
        lines = spark.read.text(f"{root}/*/{file}.txt")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    path = F.col("_metadata.file_path")
    return lines.select(path.alias("path"), F.ltrim(F.rtrim("value", F.lit("\r")), F.lit("\ufeff")).alias("line"))


def read_schedules(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Stops, trips and stop times of all complete archives, only the needed columns.

    One scan per kind of file reads all archives, however many there are. Column order may differ between them: each
    file's header, the line that names all needed columns, is joined to its lines by path and says where a column
    stands. Archives that lack a file or a needed column are left out.
    """
    lines = {file: _schedule_lines(spark, root, file) for file in schemas.SCHEDULE_FILES}
    if any(v is None for v in lines.values()):
        raise FileNotFoundError(f"no complete schedule archive below {root}")

    def fields(line: Column) -> Column:
        return F.transform(F.split(line, ","), lambda x: F.trim(F.regexp_replace(x, '^"|"$', "")))

    def headers(file: str) -> DataFrame:
        names = schemas.SCHEDULE_FILES[file]
        # hardly a line holds all names as text, so only headers are split
        likely = lines[file].where(reduce(lambda a, b: a & b, [F.contains("line", F.lit(name)) for name in names]))
        every = [F.array_contains(fields(F.col("line")), name) for name in names]
        named = likely.where(reduce(lambda a, b: a & b, every))
        archive = F.regexp_extract("path", r"([^/]+)/[^/]+\.txt(/part-[^/]*)?$", 1)
        return named.select(archive.alias("archive"), "path", "line", fields(F.col("line")).alias("header"))

    # a row per file, stored: they are read three times, and their true size lets the planner broadcast them
    found = side_by_side(spark, {file: partial(cut_lineage, headers(file)) for file in lines})
    kinds = [h.select("archive", F.lit(file).alias("file"), F.size("header").alias("width")) for file, h in found.items()]
    seen = reduce(DataFrame.unionByName, kinds).groupBy("archive").agg(F.countDistinct("file").alias("n"), F.max("width").alias("width"))
    complete = seen.where(F.col("n") == len(lines))
    width = complete.agg(F.max("width")).first()[0]
    if width is None:
        raise FileNotFoundError(f"no complete schedule archive below {root}")
    slots = [f"c{i}" for i in range(width)]

    def read(file: str) -> DataFrame:
        columns = schemas.SCHEDULE_FILES[file]
        # the archive is found per header: taken from every line's path it costs more than the parsing
        header = found[file].join(complete.select("archive"), "archive", "left_semi")
        header = header.select("archive", "path", "header", F.col("line").alias("first"))
        rows = lines[file].join(header, "path").where((F.col("line") != F.col("first")) & (F.length("line") > 0))
        # a lambda reads the parsed line: filters pushed down to here would parse it once per slot
        parse = F.from_csv("line", ", ".join(f"{c} string" for c in slots))
        parsed = rows.withColumn("cells", F.transform(F.array(parse), lambda r: F.array(*[r[c] for c in slots]))[0])
        cells = F.col("cells")
        place = lambda name: F.array_position("header", name).cast("int") - 1
        return parsed.select(
            "archive", *[F.get(cells, place(name)).try_cast(kind).alias(name) for name, kind in columns.items()]
        )

    return {file: read(file) for file in lines}


def select_archives(index: DataFrame, first_day: str, last_day: str) -> DataFrame:
    """Index rows that start within the days given and have an address."""
    start = F.try_to_timestamp("feed_start_date", F.lit("yyyyMMdd")).cast("date")
    return (
        index.withColumn("feed_start_date", start)
        .filter(F.col("feed_start_date").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date")))
        .filter(F.col("archive_url").isNotNull())
        .withColumn("archive_url", F.trim("archive_url"))
    )


def station_dimension(info: DataFrame, regions: DataFrame) -> DataFrame:
    """Station info with region names, without the legacy id, rental methods as one text."""
    named = regions.select("region_id", F.col("name").alias("region_name"))
    return (
        info.drop("legacy_id")
        .join(named, "region_id", "left")
        .withColumn("rental_methods", F.concat_ws(",", "rental_methods"))
    )


def latest_attributes(df: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """A dimension: per id the newest non-NULL value of every attribute."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            *[
                F.max_by(
                    F.when(F.col(c).isNotNull(), F.col(c)),
                    F.when(F.col(c).isNotNull(), F.struct(F.col(ts), F.col(c))),
                ).alias(c)
                for c in columns
            ]
        )
    )
