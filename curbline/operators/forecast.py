"""Per-station time series: hour spine, lags and a seasonal first-order model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK_HOURS = 168
HOUR_SECONDS = 3600


def dense_hours(counts: DataFrame, value: str) -> DataFrame:
    """Every hour from a station's first to its last, absent hours as 0."""
    spans = counts.groupBy("station_id").agg(F.min("ts_hour").alias("a"), F.max("ts_hour").alias("b"))
    hours = spans.select(
        "station_id", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts_hour")
    )
    return hours.join(counts, ["station_id", "ts_hour"], "left").fillna(0, [value])


def with_lags(dense: DataFrame, value: str, lags: tuple[int, ...] = (24, WEEK_HOURS)) -> DataFrame:
    """Values of earlier hours. A window holds one station's hours, one row each."""
    order = Window.partitionBy("station_id").orderBy("ts_hour")
    return dense.withColumns({f"lag_{n}": F.lag(value, n).over(order) for n in lags})


def hour_index(ts: Column) -> Column:
    return F.floor(F.unix_seconds(ts.cast("timestamp")) / HOUR_SECONDS).cast("long")


def seasonal_differences(counts: DataFrame, value: str, season: int = WEEK_HOURS) -> DataFrame:
    """``y(t) - y(t - season)`` per station at the hours where it is not zero.

    Only hours with trips are stored, and an absent hour is a zero. A difference
    is non-zero only at such an hour or one season after it, so two rows per
    stored hour give the whole difference series without any hour spine.
    """
    steps = F.array(
        F.struct(F.lit(0).alias("shift"), F.lit(1).alias("sign")),
        F.struct(F.lit(season).alias("shift"), F.lit(-1).alias("sign")),
    )
    return (
        counts.select("station_id", hour_index(F.col("ts_hour")).alias("h"), F.col(value).alias("y"), F.inline(steps))
        .groupBy("station_id", (F.col("h") + F.col("shift")).alias("h"))
        .agg(F.sum(F.col("y") * F.col("sign")).alias("d"))
    )


def fit_seasonal_ar(counts: DataFrame, value: str, season: int = WEEK_HOURS) -> DataFrame:
    """Per station: intercept and slope of ``d(t)`` on ``d(t - 1)``, and the residual variance.

    ``d`` is the seasonal difference over the hours from first + season + 1 to
    last. All sums of the regression skip zero terms, so the cost follows the
    stored hours, not the length of the calendar.
    """
    spans = counts.groupBy("station_id").agg(
        F.min(hour_index(F.col("ts_hour"))).alias("a"), F.max(hour_index(F.col("ts_hour"))).alias("b")
    )
    roles = F.array(
        F.struct(F.lit(0).alias("shift"), F.col("d").alias("y"), F.lit(0).cast("long").alias("x")),
        F.struct(F.lit(1).alias("shift"), F.lit(0).cast("long").alias("y"), F.col("d").alias("x")),
    )
    pairs = (
        seasonal_differences(counts, value, season)
        .select("station_id", "h", F.inline(roles))
        .groupBy("station_id", (F.col("h") + F.col("shift")).alias("h"))
        .agg(F.sum("y").alias("y"), F.sum("x").alias("x"))
    )
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    sums = (
        pairs.join(spans, "station_id")
        .filter((F.col("h") > F.col("a") + season) & (F.col("h") <= F.col("b")))
        .groupBy("station_id")
        .agg(
            F.sum(x).alias("sx"), F.sum(y).alias("sy"),
            F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"),
        )
    )
    n = F.greatest(F.col("b") - F.col("a") - season, F.lit(0)).cast("double")
    fitted = spans.join(sums, "station_id", "left").fillna(0.0, ["sx", "sy", "sxy", "sxx", "syy"])
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    residual = (
        F.col("syy") - F.col("intercept") * F.col("sy") - F.col("slope") * F.col("sxy")
    ) / F.col("n")
    return (
        fitted.withColumn("n", n)
        .withColumn("slope", F.coalesce(slope, F.lit(0.0)))
        .withColumn(
            "intercept",
            F.coalesce(F.try_divide(F.col("sy") - F.col("slope") * F.col("sx"), F.col("n")), F.lit(0.0)),
        )
        .withColumn("residual_variance", F.when(F.col("n") > 0, F.greatest(residual, F.lit(0.0))))
        .select(
            "station_id", F.col("n").cast("long").alias("hours"), "slope", "intercept", "residual_variance"
        )
    )


def one_step_forecast(
    rows: DataFrame, counts: DataFrame, params: DataFrame, value: str, output: str,
    season: int = WEEK_HOURS,
) -> DataFrame:
    """Forecast of every row's hour from the hours before it.

    ``y(t - season) + intercept + slope * d(t - 1)``, never below zero. The
    needed past values are looked up by station and hour in the stored counts.
    """
    past = counts.select(
        "station_id", hour_index(F.col("ts_hour")).alias("h"), F.col(value).alias("_y")
    )
    needed = rows.select("station_id", hour_index(F.col("ts_hour")).alias("t")).distinct()
    terms = F.array(
        *[
            F.struct(F.lit(back).alias("back"), F.lit(name).alias("term"))
            for back, name in ((season, "base"), (1, "last"), (season + 1, "before"))
        ]
    )
    lookups = needed.select("station_id", "t", F.inline(terms)).withColumn(
        "h", F.col("t") - F.col("back")
    )
    sums = lookups.join(past, ["station_id", "h"]).groupBy("station_id", "t").agg(
        *[
            F.sum(F.when(F.col("term") == name, F.col("_y"))).alias(f"_{name}")
            for name in ("base", "last", "before")
        ]
    )
    zero = F.lit(0)
    forecast = (
        F.coalesce("_base", zero)
        + F.coalesce("intercept", F.lit(0.0))
        + F.coalesce("slope", F.lit(0.0)) * (F.coalesce("_last", zero) - F.coalesce("_before", zero))
    )
    return (
        rows.withColumn("t", hour_index(F.col("ts_hour")))
        .join(sums, ["station_id", "t"], "left")
        .join(params.select("station_id", "slope", "intercept"), "station_id", "left")
        .withColumn(output, F.greatest(forecast, F.lit(0.0)))
        .drop("t", "_base", "_last", "_before", "slope", "intercept")
    )
