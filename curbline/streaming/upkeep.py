"""Upkeep of a base table that streams write batch by batch: few files per closed key day.

Batches own the folders ``key_day=/source=/batch=``. Compaction rewrites a day into ``compacted/version=/key_day=`` and
then commits a new manifest, a table of (key_day, version, source, batch) that says which batches the new files hold.
Readers take the newest manifest that was written to its end: files of a version it does not name do not exist for
them, and neither do the folders of batches it covers. A crash at any point leaves either the old or the new state.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_DAY = "key_day"
MANIFEST = f"{KEY_DAY} string, version string, source string, batch long"


def _files(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _newest(spark: SparkSession, path: str) -> int:
    """Number of the newest complete manifest, 0 if there is none. Spark marks a table it has written to its end."""
    system, folder = _files(spark, f"{path}/manifest")
    if not system.exists(folder):
        return 0
    numbers = [0]
    for status in system.listStatus(folder):
        found = status.getPath()
        if system.exists(found.suffix("/_SUCCESS")):
            numbers.append(int(found.getName()))
    return max(numbers)


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(key_day, version, source, batch) of the compacted batches; ``None`` before the first compaction."""
    number = _newest(spark, path)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/{number}") if number else None


def _folders(spark: SparkSession, base: str, pattern: str) -> DataFrame | None:
    try:
        rows = spark.read.option("basePath", base).parquet(f"{base}/{pattern}")
    except AnalysisException as error:
        # no such folder, or only folders that have been emptied
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    kinds = {KEY_DAY: "string", "source": "string", "batch": "long", "version": "string"}
    return rows.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items() if c in rows.columns})


def current(spark: SparkSession, path: str, days: list[str] | None = None) -> DataFrame | None:
    """All rows of the table, or those of some key days, each once; ``None`` if there are none yet."""
    chosen = "*" if days is None else "{" + ",".join(days) + "}"
    rows = _folders(spark, path, f"{KEY_DAY}={chosen}")
    done = manifest(spark, path)
    if done is None:
        return rows
    versions = done.select(KEY_DAY, "version").distinct()
    whole = _folders(spark, f"{path}/compacted", f"version=*/{KEY_DAY}={chosen}")
    parts = []
    if whole is not None:
        parts.append(whole.join(versions, [KEY_DAY, "version"], "left_semi").drop("version"))
    if rows is not None:
        parts.append(rows.join(done, [KEY_DAY, "source", "batch"], "left_anti"))
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def compact_days(spark: SparkSession, path: str, before: str, sort_by: str, min_batches: int = 2) -> list[str]:
    """Rewrite the key days before ``before`` into few sorted files; returns the days.

    A day is taken once ``min_batches`` of its batches are not compacted yet; late rows of a day that was
    compacted before thus wait for the next time. Run one compaction at a time; streams may go on writing, as a
    batch that arrives meanwhile is in no manifest. Old files stay until :func:`vacuum`.
    """
    rows = _folders(spark, path, f"{KEY_DAY}=*")
    if rows is None:
        return []
    done = manifest(spark, path)
    keys = [KEY_DAY, "source", "batch"]
    batches = rows.where(F.col(KEY_DAY) < before).select(*keys).distinct()
    if done is not None:
        batches = batches.join(done, keys, "left_anti")
    full = batches.groupBy(KEY_DAY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_batches)
    days = sorted(r[KEY_DAY] for r in full.select(KEY_DAY).collect())  # folders, not rows
    if not days:
        return []
    version, number = uuid.uuid4().hex, _newest(spark, path) + 1
    # the batches as they are now: what streams add during the rewrite is not covered
    covered = batches.where(F.col(KEY_DAY).isin(days)).collect()
    new = spark.createDataFrame([(r[KEY_DAY], version, r["source"], r["batch"]) for r in covered], MANIFEST)
    raw = rows.join(F.broadcast(new), keys, "left_semi")
    target = raw
    if done is not None:
        old = _folders(spark, f"{path}/compacted", f"version=*/{KEY_DAY}=*")
        if old is not None:
            versions = done.where(F.col(KEY_DAY).isin(days)).select(KEY_DAY, "version").distinct()
            target = raw.unionByName(old.join(F.broadcast(versions), [KEY_DAY, "version"], "left_semi").drop("version"))
    (
        target.hint("rebalance", KEY_DAY)
        .sortWithinPartitions(KEY_DAY, sort_by)
        .write.partitionBy(KEY_DAY)
        .parquet(f"{path}/compacted/version={version}")
    )
    if done is not None:
        again = F.when(F.col(KEY_DAY).isin(days), F.lit(version)).otherwise(F.col("version"))
        new = done.withColumn("version", again).unionByName(new)
    _commit(new, f"{path}/manifest/{number}")
    return days


def _commit(rows: DataFrame, path: str) -> None:
    """Write a manifest; it counts from the moment its end is marked."""
    rows.coalesce(1).write.mode("overwrite").parquet(path)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete what the newest manifest replaces: folders of covered batches, versions and manifests of older
    or crashed compactions. Returns the number of folders. Run it when no reader uses an older state."""
    done = manifest(spark, path)
    if done is None:
        return 0
    gone = 0
    for r in done.toLocalIterator():
        system, folder = _files(spark, f"{path}/{KEY_DAY}={r[KEY_DAY]}/source={r['source']}/batch={r['batch']}")
        gone += bool(system.delete(folder, True))
    known = {(r["version"], r[KEY_DAY]) for r in done.select("version", KEY_DAY).distinct().toLocalIterator()}
    system, folder = _files(spark, f"{path}/compacted")
    for version in system.listStatus(folder) if system.exists(folder) else []:
        for day in system.listStatus(version.getPath()):
            name = day.getPath().getName()
            if name.startswith(f"{KEY_DAY}="):
                pair = version.getPath().getName().split("=", 1)[1], name.split("=", 1)[1]
                gone += pair not in known and bool(system.delete(day.getPath(), True))
    number = _newest(spark, path)
    system, folder = _files(spark, f"{path}/manifest")
    for status in system.listStatus(folder):
        if int(status.getPath().getName()) != number:
            gone += bool(system.delete(status.getPath(), True))
    return gone
