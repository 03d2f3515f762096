"""Distances, grid cells and bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_010.0
METRES_PER_MILE = 1609.34  # fixed value
DEFAULT_CENTRE = (42.3601, -71.0589)  # fixed value: map centre when nothing has coordinates
DEFAULT_BIN = (42.3, -71.1)  # fixed value: grid bin of a route without coordinates
SERVICE_AREA = (41.5, 42.9, -71.9, -70.5)  # fixed values: lat and lng limits


def miles_to_metres(miles: Column | float) -> Column | float:
    return miles * METRES_PER_MILE


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres on a sphere."""
    half_lat = F.radians(lat2 - lat1) / 2
    half_lng = F.radians(lng2 - lng1) / 2
    h = F.pow(F.sin(half_lat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(half_lng), F.lit(2))
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def planar_degrees(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.sqrt(F.pow(lat1 - lat2, F.lit(2)) + F.pow(lng1 - lng2, F.lit(2)))


def earth_axes(lat: str, lng: str) -> list[str]:
    """Earth-centred coordinates in metres, as SQL text.

    A straight-line distance never exceeds the distance over ground, so a grid
    on these axes is a safe filter everywhere, the date line and poles included.
    """
    phi, lam = f"radians({lat})", f"radians({lng})"
    return [
        f"cos({phi}) * cos({lam}) * {EARTH_RADIUS_M}D",
        f"cos({phi}) * sin({lam}) * {EARTH_RADIUS_M}D",
        f"sin({phi}) * {EARTH_RADIUS_M}D",
    ]


def degree_axes(lat: str, lng: str) -> list[str]:
    return [lat, lng]


def in_box(lat: Column, lng: Column, box: tuple[float, float, float, float] = SERVICE_AREA) -> Column:
    south, north, west, east = box
    return lat.between(south, north) & lng.between(west, east)


def coordinate_bin(value: Column, places: int = 3) -> Column:
    return F.round(value, places)
