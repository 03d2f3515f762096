"""Table writers: landing, append, replace, partitioned layouts and the insert-only merge."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.operators import keyed


def land_partitioned(df: DataFrame, path: str, ts: str) -> None:
    """Rows as JSON lines below ``dt=/HH=/mm=`` folders of their time, few files per folder."""
    (
        df.withColumns(
            {
                "dt": F.date_format(ts, "yyyy-MM-dd"),
                "HH": F.date_format(ts, "HH"),
                "mm": F.date_format(ts, "mm"),
            }
        )
        .hint("rebalance", "dt", "HH", "mm")
        .write.mode("append")
        .partitionBy("dt", "HH", "mm")
        .json(path)
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _run_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the runs that were written to their end, which Spark marks."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    folders = [s.getPath() for s in system.listStatus(root) if s.isDirectory()]
    return sorted(f.toString() for f in folders if system.exists(f.suffix("/_SUCCESS")))


def append_run(df: DataFrame, path: str, run_id: str) -> bool:
    """Add the rows of one run as a folder of its own; its end mark is the commit record.

    A run that is complete is never written again, so a repeated append changes nothing and returns ``False``; what a
    crashed append has left is overwritten.
    """
    folder = f"{path}/run_id={run_id}"
    if any(known.endswith(f"/run_id={run_id}") for known in _run_folders(df.sparkSession, path)):
        return False
    df.drop("run_id").write.mode("overwrite").parquet(folder)
    return True


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Rows of all complete runs with their ``run_id``; runs that are being written or have crashed do not show."""
    folders = _run_folders(spark, path)
    if not folders:
        raise FileNotFoundError(f"no complete run below {path}")
    runs = spark.read.option("basePath", path).option("mergeSchema", True).parquet(*folders)
    return runs.withColumn("run_id", F.col("run_id").cast("string"))


def replace(df: DataFrame, path: str) -> None:
    """Write a table anew; also the form of truncate-then-insert."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_by_day(df: DataFrame, path: str, ts: str, day: str, cluster: str | None = None) -> None:
    """A table with one folder per day, sorted by ``cluster`` within its files.

    Days that the rows do not touch stay as they are. The rebalance step gathers
    a day into few files and still splits a day that holds far more rows than
    others over several tasks.
    """
    daily = df.withColumn(day, F.to_date(ts)).hint("rebalance", day)
    if cluster is not None:
        daily = daily.sortWithinPartitions(day, cluster)
    writer = daily.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(day).parquet(path)


def require_table(spark: SparkSession, path: str) -> DataFrame:
    """Open a table, or fail the job with a clear message when it is missing."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        raise FileNotFoundError(f"missing source table: {path}") from error


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail on an empty input; reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def new_rows(
    base: DataFrame, batch: DataFrame, key: str, order: list[str], day: str | None = None
) -> DataFrame:
    """Rows of ``batch`` whose key ``base`` has not seen, the first copy of each.

    ``day`` names a column that follows from the key. Equal keys then share a
    day, so only the days of the batch are read from ``base``. A NULL day is a day of its own.
    """
    fresh = keyed.earliest_per_key(batch, [key], order)
    if day is None:
        return fresh.join(base.select(key), key, "left_anti").select(*batch.columns)
    # of the batch itself, so the first copies are picked once
    days = batch.select(F.col(day).alias("_day")).distinct()
    seen = base.select(day, key).join(days, F.col(day).eqNullSafe(F.col("_day")), "left_semi").select(key)
    return fresh.join(seen, key, "left_anti").select(*batch.columns)
