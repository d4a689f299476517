"""Distances, nearest points, polygons and proximity classes as Column builders."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, EARTH_M = 6371.0, 6_371_000.0
#: Latitude at which flat-earth ranking scales longitudes.
FLAT_LATITUDE = 21.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    half = lambda a: F.pow(F.sin(a / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(half(p2 - p1) + F.cos(p1) * F.cos(p2) * half(F.radians(lon2 - lon1))))


def metres(lat1: float, lon1: float, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """Equirectangular distances of one point, exact enough at some hundred metres."""
    x = np.radians(lon2 - lon1) * np.cos(np.radians((lat1 + lat2) / 2))
    return EARTH_M * np.hypot(x, np.radians(lat2 - lat1))


def nearest(lat: Column, lon: Column, points: list[tuple[str, float, float]]) -> Column:
    """struct<name, km> of the nearest of a few fixed points: ranked on a flat earth, reported by haversine.

    The points are literals, so there is neither a join nor a shuffle.
    """
    scale = math.cos(math.radians(FLAT_LATITUDE))
    ranked = [
        F.struct((F.pow(lat - y, F.lit(2.0)) + F.pow((lon - x) * scale, F.lit(2.0))).alias("d2"), F.lit(k).alias("k"), F.lit(name).alias("name"), haversine_km(lat, lon, F.lit(y), F.lit(x)).alias("km"))
        for k, (name, y, x) in enumerate(points)
    ]
    best = F.array_min(F.array(*ranked))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(best["name"].alias("name"), best["km"].alias("km")))


def nearest_within(lat: Column, lon: Column, group: Column, places: list[tuple[str, str, float, float]]) -> Column:
    """struct<name, km> of the nearest of the fixed places (name, group, lat, lon) of the row's own group.

    A group without places, or none, has all of them; a missing coordinate, or one
    outside the city's box, has no nearest place. Ties go to the place named first.
    """
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("name"), F.lit(g).alias("group"), F.lit(float(y)).alias("y"), F.lit(float(x)).alias("x")) for k, (n, g, y, x) in enumerate(places)])
    own = F.filter(every, lambda p: p["group"] == group)
    chosen = F.when(F.size(own) > 0, own).otherwise(every)
    best = F.array_min(F.transform(chosen, lambda p: F.struct(haversine_km(lat, lon, p["y"], p["x"]).alias("km"), p["k"].alias("k"), p["name"].alias("name"))))
    return F.when(coordinate_issue(lat, lon).isNull(), F.struct(best["name"].alias("name"), best["km"].alias("km")))


def min_km(lat: Column, lon: Column, points: list[tuple[str, float, float]], containing: str) -> Column:
    """Distance to the nearest point whose name contains a text; an error if none does."""
    own = [p for p in points if containing.lower() in p[0].lower()]
    if not own:
        raise ValueError(f"no point is named like {containing!r}")
    return F.array_min(F.array(*[haversine_km(lat, lon, F.lit(y), F.lit(x)) for _, y, x in own]))


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Ray casting over a closed ring of (lon, lat), behind its bounding box."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    box = lon.between(min(xs), max(xs)) & lat.between(min(ys), max(ys))
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 == y2:
            continue
        low, high = sorted((y1, y2))
        at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when((lat > low) & (lat <= high) & (lon < at), 1).otherwise(0)
    return box & (crossings % 2 == 1)


def containing(lat: Column, lon: Column, rings: list[tuple[str, list[tuple[float, float]]]]) -> Column:
    """The name of the first ring that contains the point."""
    out = F.when(F.lit(False), F.lit(""))
    for name, ring in rings:
        out = out.when(in_ring(lat, lon, ring), F.lit(name))
    return out


# Bounds of the city's box, and the labels of proximity.
CITY_LAT, CITY_LON = (20.50, 21.45), (105.25, 106.05)
TIERS = ((0.5, "walk"), (1.0, "short"), (2.0, "ride"))


def coordinate_issue(lat: Column, lon: Column) -> Column:
    """missing, outside, or null for a usable coordinate."""
    inside = lat.between(*CITY_LAT) & lon.between(*CITY_LON)
    return F.when(lat.isNull() | lon.isNull(), "missing").when(~inside, "outside")


def tier(km: Column, far: str = "far") -> Column:
    """Proximity class; upper bounds belong to the class."""
    out = F.when(km.isNull(), None)
    for most, label in TIERS:
        out = out.when(km <= most, label)
    return out.otherwise(far)


def grid_cell(lat: Column, lon: Column, size: float = 0.0005) -> Column:
    """Identifier of the cell of about 50 m; null without coordinates. Halves round to even."""
    part = lambda c: F.rint(c / size).cast("long").cast("string")
    return F.concat(F.lit("geo:"), part(lat), F.lit(":"), part(lon))
