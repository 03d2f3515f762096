"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job relies on. Timestamps are kept as UTC wall-clock
# values (timestamp_ntz), so the session zone has to be UTC.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

_local_base: dict[str, str] = {}
_scratch: dict[str, list[str]] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a folder of its own:
    on a cluster a machine-local folder would be lost with its machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_base:
        _local_base[context.applicationId] = tempfile.mkdtemp(prefix="curbline-")
    return _local_base[context.applicationId]


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder; :func:`drop_scratch` deletes it."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete the tables this application has stored below the shared folder.

    Call it when no frame built on them is needed any more, for example after a query's result is written.
    """
    context = spark.sparkContext
    for name in _scratch.pop(context.applicationId, []):
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder and go on from the stored table.

    Later steps never recompute it, a lost executor takes nothing with it, and
    the planner knows its true size.
    """
    path = scratch_dir(df.sparkSession, "tables")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """One partition per core and more, dealt by the hash of the rows, for a frame that a fit reads many times.

    The same rows share a partition however they were stored, so a fit does not depend on the files.
    """
    context = df.sparkSession.sparkContext
    parts = max(context.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    plain = [c for c, kind in df.dtypes if kind != "vector"]
    return df.repartition(parts, F.xxhash64(*plain))


def side_by_side(spark: SparkSession, jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Run independent jobs at the same time, so that one's small steps fill the other's gaps."""
    with ThreadPool(max(1, len(jobs))) as pool:
        started = {
            name: pool.apply_async(inheritable_thread_target(spark)(job)) for name, job in jobs.items()
        }
        return {name: result.get() for name, result in started.items()}
