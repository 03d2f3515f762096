"""Helpers of the operators in this folder: stored frames, global row numbers, components."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.session import scratch_dir, shared_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder, its lineage cut.

    Checkpoint files go as soon as the frame is no longer used (where the session
    sets ``spark.cleaner.referenceTracking.cleanCheckpoints``), and a lost executor
    takes nothing with it.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of frames that are no longer used.

    Its cleaner only learns of them when the driver collects garbage, which may be long after the disk is full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Tables:
    """Parquet tables in the shared folder that end with the operator that keeps them: compressed, unlike
    checkpoints, and deleted by name."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame) -> DataFrame:
        path = scratch_dir(self.spark, "step")
        df.write.parquet(path)
        self.paths.append(path)
        release(self.spark)  # the shuffles of this step
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete all tables; frames that read them must not be used any more."""
        context = self.spark.sparkContext
        for name in self.paths:
            path = context._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []
        release(self.spark)


def fresh(columns: list[str], *wanted: str) -> list[str]:
    """Names for helper columns that clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    tag = ""
    while any(f"_{w}{tag}".lower() in taken for w in wanted):
        tag = f"_{uuid.uuid4().hex[:6]}"
    return [f"_{w}{tag}" for w in wanted]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda variable is evaluated once, while an expression that a lambda refers to
    would be evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, order: list[Column], number: str) -> DataFrame:
    """Rows with a gapless number from 0 in the order of ``order``.

    One range shuffle sorts the rows, which are stored; the rows per partition then give
    each partition its first number. What is broadcast has one row per partition. Rows that
    are equal in ``order`` are told apart by their place, so give columns that leave only
    interchangeable rows equal.
    """
    part, place, first = fresh(df.columns, "part", "place", "first")
    row = F.monotonically_increasing_id()
    # the place also deals out rows that are equal in every column
    tie = fresh([*df.columns, part, place], "tie")[0]
    spread = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(*order, F.col(tie))
    ranked = stored(
        spread.sortWithinPartitions(*order, F.col(tie))
        .drop(tie)
        .withColumn(part, F.shiftright(row, 33).cast("int"))
        .withColumn(place, row.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    counts = ranked.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()
    total, firsts = 0, []
    for p, n in sorted((r[0], r[1]) for r in counts):
        firsts.append((p, total))
        total += n
    starts = df.sparkSession.createDataFrame(firsts, f"{part} int, {first} long")
    return (
        ranked.join(F.broadcast(starts), part)
        .withColumn(number, F.col(first) + F.col(place))
        .drop(part, place, first)
    )


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): each vertex of ``edges`` (a, b) with the smallest id it reaches.

    Alternates the two star steps: every vertex ties its larger neighbours to its smallest
    one, then its smaller ones. Each step is a minimum per vertex (combined in the map tasks)
    and a join, so a hub is never gathered. Every round is stored. The number of rounds grows
    with the logarithm of the longest path. Edges with a NULL end or two equal ends are ignored.
    """
    e = (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a < b")
        .distinct()
    )
    e, before = stored(e), None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("v"), F.least("a", "m").alias("m")
        )
        # large star: larger neighbours go to the smallest id in the neighbourhood
        e = (
            e.join(least, e.a == least.v)
            .select(F.col("m").alias("a"), "b")
            .distinct()
        )
        # small star: a vertex and its smaller neighbours go to the smallest of these
        down = e.groupBy("b").agg(F.min("a").alias("m"))
        pairs = e.join(down, "b")
        e = (
            pairs.select(F.col("m").alias("a"), F.col("a").alias("b"))
            .unionAll(down.select(F.col("m").alias("a"), "b"))
            .where("a < b")
            .distinct()
        )
        e = stored(e)
        now = e.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s"),
        ).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    leaves = e.groupBy("b").agg(F.min("a").alias("component")).select(F.col("b").alias("id"), "component")
    roots = leaves.select(F.col("component").alias("id"), "component").distinct()
    return leaves.unionAll(roots)
