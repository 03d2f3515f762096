"""Distance joins on grid cells, without a cross join.

All joins here run between *sites*: distinct coordinates that carry aggregated
payload. Rows that share a place (every trip that starts at one dock, say) are
reduced before any join, so a place with a third of all rows is one site.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curbline.functions import places

CELL_MARGIN = 1.001  # cells a little wider than the radius, so rounding loses no edge pair
LEVEL_STEP = 4
TIE_PLACES = 3
HALF_DIAGONAL = 0.8661  # of a unit cube, rounded up
CELL_ROWS = 50_000  # sites of a cell that one task of a nearest search compares with


@dataclass(frozen=True)
class Metric:
    """A distance with the grid axes that bound it.

    ``finest`` cells grow by ``LEVEL_STEP`` up to ``levels``; the last level has
    to be wider than anything on its axes. Axes, and the test whether a cell can
    hold a point at all, are SQL text: a cell has 27 neighbours, and building
    those column by column takes seconds on the driver.
    """

    distance: Callable[[Column, Column, Column, Column], Column]
    axes: Callable[[str, str], list[str]]
    dimensions: int
    finest: float
    levels: int
    tie_places: int
    occupiable: Callable[[list[str], str], str] | None = None


def _touches_surface(cell: list[str], size: str) -> str:
    """Whether a cube of the grid can hold a point of the sphere; most neighbours cannot."""
    squares = " + ".join(f"(({axis} + 0.5D) * ({size})) * (({axis} + 0.5D) * ({size}))" for axis in cell)
    return f"abs(sqrt({squares}) - {places.EARTH_RADIUS_M}D) <= ({size}) * {HALF_DIAGONAL}D + 1.0D"


SPHERE = Metric(
    places.haversine_m, places.earth_axes, 3, 250.0, 10, TIE_PLACES, _touches_surface
)
PLANAR = Metric(places.planar_degrees, places.degree_axes, 2, 0.0025, 11, 9)


def sites(df: DataFrame, lat: str, lng: str, *payload: Column) -> DataFrame:
    """Distinct coordinates of ``df`` as ``lat, lng`` with aggregated ``payload``."""
    located = df.filter(F.col(lat).isNotNull() & F.col(lng).isNotNull())
    grouped = located.groupBy(
        F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng")
    )
    return grouped.agg(*payload) if payload else grouped.agg(F.count("*").alias("n"))


def _names(metric: Metric) -> list[str]:
    return [f"_g{axis}" for axis in range(metric.dimensions)]


def _with_cell(df: DataFrame, metric: Metric, size: str) -> DataFrame:
    cells = zip(metric.axes("lat", "lng"), _names(metric))
    return df.selectExpr("*", *[f"CAST(floor(({axis}) / ({size})) AS BIGINT) AS {n}" for axis, n in cells])


def _neighbourhood(df: DataFrame, metric: Metric, size: str) -> DataFrame:
    """Repeat every row for its own cell and all adjacent ones.

    The result must not be broadcast: the planner takes it for as small as its
    input. Joins on it ask for a merge join, which spills and splits skewed cells.
    """
    names = _names(metric)
    cells = ", ".join(
        "named_struct(" + ", ".join(f"'{n}', {n} + {s}" for n, s in zip(names, step)) + ")"
        for step in product((-1, 0, 1), repeat=metric.dimensions)
    )
    kept = [c for c in df.columns if c not in names]
    around = df.selectExpr(*[f"`{c}`" for c in kept], f"inline(array({cells}))")
    if metric.occupiable is not None:
        around = around.filter(metric.occupiable(names, size))
    return around.hint("merge")


def _spread(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("_part", F.pmod(F.xxhash64("lat", "lng"), F.lit(parts)).cast("long"))


def _replicate(df: DataFrame, parts: int) -> DataFrame:
    return df.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")))


def radius_pairs(
    left: DataFrame, right: DataFrame, radius_m: float, spread: int = 4
) -> DataFrame:
    """Pairs of sites at most ``radius_m`` apart, with ``distance_m``.

    ``left`` should be the side with fewer sites: it is repeated for adjacent
    cells and for ``spread`` parts, into which the sites of each cell of
    ``right`` are split. Right coordinates come out as ``near_lat, near_lng``.
    """
    size = f"{radius_m * CELL_MARGIN}D"
    names = _names(SPHERE)
    near = (
        _spread(_with_cell(right, SPHERE, size), spread)
        .withColumnRenamed("lat", "near_lat")
        .withColumnRenamed("lng", "near_lng")
    )
    probe = _neighbourhood(_with_cell(_replicate(left, spread), SPHERE, size), SPHERE, size)
    distance = places.haversine_m(
        F.col("lat"), F.col("lng"), F.col("near_lat"), F.col("near_lng")
    )
    return (
        probe.join(near, [*names, "_part"])
        .withColumn("distance_m", distance)
        .filter(F.col("distance_m") <= radius_m)
        .drop(*names, "_part")
    )


def radius_summary(
    left: DataFrame, right: DataFrame, radius_m: float, *aggregates: Column, spread: int = 4
) -> DataFrame:
    """Aggregates over all right sites within the radius, one row per left site with any."""
    lean = left.select("lat", "lng")
    return radius_pairs(lean, right, radius_m, spread).groupBy("lat", "lng").agg(*aggregates)


def _cell_counts(layered: DataFrame, metric: Metric) -> DataFrame:
    """Occupied cells of every level: the number of sites ``_n`` and the southernmost one, ``_at_lat, _at_lng``."""
    return layered.groupBy("_level", *_names(metric)).agg(
        F.count(F.lit(1)).alias("_n"), F.min("lat").alias("_at_lat"), F.min_by("lng", "lat").alias("_at_lng")
    )


def _parts(cell_rows: int) -> Column:
    """Parts of a cell with ``_n`` sites, so that a part holds about ``cell_rows`` of them at most."""
    return F.ceil(F.col("_n") / cell_rows).cast("long")


def _dealt(layered: DataFrame, counts: DataFrame, metric: Metric, cell_rows: int) -> DataFrame:
    """Sites with the part of their cell that holds them.

    Only crowded cells have several parts. Of each level there are at most sites / ``cell_rows`` of these, so
    they are broadcast: 200,000 short rows for a thousand million sites.
    """
    crowded = counts.filter(F.col("_n") > cell_rows).select("_level", *_names(metric), _parts(cell_rows).alias("_split"))
    split = F.coalesce("_split", F.lit(1))
    return (
        layered.join(F.broadcast(crowded), ["_level", *_names(metric)], "left")
        .withColumn("_part", F.pmod(F.xxhash64("lat", "lng"), split))
        .drop("_split")
    )


def nearest_site(
    left: DataFrame, right: DataFrame, metric: Metric = SPHERE, identity: str = "near_id", cell_rows: int = CELL_ROWS
) -> DataFrame:
    """The nearest right site for every left site: ``near_*`` columns and ``distance``.

    Exact for any distance, in one lazy plan. Right sites are counted per cell of every grid level, with one
    site of each cell for a sample. The samples in the cells around a left site, of all levels, bound the
    distance of its nearest site; the cells around it at the finest level that is as wide as this bound hold
    that site. A cell is split by its count, so no task compares with more than about ``cell_rows`` sites of a
    cell, however crowded a city is. Distances that round to the same value tie and the smaller ``identity``
    wins.
    """
    names = _names(metric)
    cell = ["_level", *names]
    scales = F.explode(F.sequence(F.lit(0), F.lit(metric.levels - 1)))
    size = f"{metric.finest}D * pow({LEVEL_STEP}D, _level)"

    lean = left.select("lat", "lng").distinct()
    layered = _with_cell(right.withColumn("_level", scales), metric, size)
    counts = _cell_counts(layered, metric)
    probe = _neighbourhood(_with_cell(lean.withColumn("_level", scales), metric, size), metric, size)
    sample = metric.distance(F.col("lat"), F.col("lng"), F.col("_at_lat"), F.col("_at_lng"))
    # no distance on the axes is longer than the metric's own
    wide = F.ceil(F.log(float(LEVEL_STEP), F.greatest(F.min(sample) * CELL_MARGIN / metric.finest, F.lit(1.0))))
    reach = (
        probe.join(counts, cell)
        .groupBy("lat", "lng")
        .agg(F.least(wide.cast("int"), F.lit(metric.levels - 1)).alias("_level"))
    )
    around = _neighbourhood(_with_cell(reach, metric, size), metric, size).join(counts, cell)
    part = F.explode(F.sequence(F.lit(0).cast("long"), _parts(cell_rows) - 1))
    search = around.select("lat", "lng", *cell, part.alias("_part")).hint("merge")
    near = _dealt(layered, counts, metric, cell_rows)
    near = near.withColumnRenamed("lat", "near_lat").withColumnRenamed("lng", "near_lng")
    payload = [c for c in near.columns if c not in ("_part", *cell)]
    distance = metric.distance(
        F.col("lat"), F.col("lng"), F.col("near_lat"), F.col("near_lng")
    )
    tie = F.struct(F.round("distance", metric.tie_places), F.col(identity))
    return (
        search.join(near, [*cell, "_part"])
        .withColumn("distance", distance)
        .groupBy("lat", "lng")
        .agg(F.min_by(F.struct(*payload, "distance"), tie).alias("_near"))
        .select("lat", "lng", "_near.*")
    )
