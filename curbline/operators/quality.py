"""Row contracts, readable and unreadable input, audits and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import text, times
from curbline.operators import keyed
from curbline.sources import schemas

REASON = "reject_reason"


def with_reject_reason(df: DataFrame, required: list[str]) -> DataFrame:
    """Name the required columns that are NULL; a complete row has an empty reason."""
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in required]
    return df.withColumn(REASON, F.concat_ws(",", *missing))


def split_contract(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet the not-NULL contract, and the rejected ones with their reason."""
    marked = with_reject_reason(df, required)
    valid = marked.filter(F.col(REASON) == "").drop(REASON)
    return valid, marked.filter(F.col(REASON) != "")


def split_readable(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed pages, and pages that did not parse with their text."""
    bad = F.col(schemas.CORRUPT).isNotNull()
    return pages.filter(~bad).drop(schemas.CORRUPT), pages.filter(bad)


def first_seen(batch: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the earliest by ``order``."""
    return keyed.earliest_per_key(batch, [key], order)


def duplicate_profile(df: DataFrame, key: str) -> DataFrame:
    """Rows, distinct keys and surplus rows, in one row."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(
        F.sum("n").alias("row_count"),
        F.count("*").alias("unique_keys"),
        F.sum(F.col("n") - 1).alias("surplus_rows"),
    )


def freshness(df: DataFrame, feed: str, ts: str, as_of: str | Column, max_age_minutes: int) -> DataFrame:
    """Newest time per feed and whether it is too old."""
    newest = df.groupBy(feed).agg(F.max(ts).alias("newest"))
    age = F.timestamp_diff("MINUTE", F.col("newest"), times.as_instant(as_of))
    return newest.withColumn("age_minutes", age).withColumn(
        "is_stale", F.coalesce(F.col("age_minutes") > max_age_minutes, F.lit(True))
    )


def load_audit(df: DataFrame, source: str, required: list[str]) -> DataFrame:
    """Rows loaded and rejected per source; a bad source shows here and stops no other."""
    return (
        with_reject_reason(df, required)
        .groupBy(source)
        .agg(
            F.count("*").alias("row_count"),
            F.count_if(F.col(REASON) != "").alias("rejected"),
        )
    )


def parse_replies(replies: DataFrame, reply: str, schema: str) -> DataFrame:
    """Fields of the JSON object in each reply, NULL where none can be read."""
    fields = F.from_json(text.reply_json(F.col(reply)), schema, {"mode": "PERMISSIVE"})
    return replies.withColumn("fields", fields)
