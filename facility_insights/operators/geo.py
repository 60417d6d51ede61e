"""Radius counts and nearest distance without an N x N matrix.

Plan
----
1. Co-located entities collapse to one *place* with a weight ``w`` (coordinates come from city or
   county centroids, so places << entities, and a hot location holding a third of all rows is
   one row). Others at the same place count at 0 miles: ``w - 1``.
2. Places are bucketed into cells of ``delta = r / 69`` degrees (one degree is ~69.09 miles, so
   a cell is a little wider than ``r``); longitude cells wrap cleanly at +-180. Each place is
   exploded only to the cells a circle of radius ``r`` around it can touch (the longitude span
   widens with latitude; near a pole all longitude cells are used).
3. Equi-join on (lat_cell, lng_cell) — a shuffle on the cell id, AQE splits skewed cells — exact
   haversine filter, then one aggregate: weighted counts per radius and the minimum distance.
4. Places with no other place within ``r`` get their nearest neighbour by doubling ``r`` on that
   (small) remainder until the cap covers the sphere; one place alone keeps NULL.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import haversine_miles
from ..session import cut_lineage

_R_MILES = S.EARTH_RADIUS_KM * S.KM_TO_MILES
_MILES_PER_DEGREE = 69.0
_HALF_CIRCUMFERENCE = math.pi * _R_MILES


def _cells(r: float):
    delta = r / _MILES_PER_DEGREE
    n_lng = max(1, int(math.floor(360.0 / delta)))
    width = 360.0 / n_lng
    return delta, n_lng, width


def _home_cell(r: float, lat: str = "lat", lng: str = "lng"):
    delta, n_lng, width = _cells(r)
    lat_cell = F.floor(F.col(lat) / F.lit(delta)).cast("int")
    lng_cell = F.pmod(F.floor((F.col(lng) + F.lit(180.0)) / F.lit(width)).cast("int"), F.lit(n_lng))
    return lat_cell, lng_cell


def _probe_cells(r: float, lat: str = "lat", lng: str = "lng"):
    """(lat_cell, lng_cell) of every cell the circle of radius r around the point can touch."""
    delta, n_lng, width = _cells(r)
    ang_deg = math.degrees(min(math.pi, r / _R_MILES))
    phi = F.col(lat)
    lat_cells = F.sequence(F.floor((phi - F.lit(delta)) / F.lit(delta)).cast("int"), F.floor((phi + F.lit(delta)) / F.lit(delta)).cast("int"))
    near_pole = (F.abs(phi) + F.lit(ang_deg)) >= F.lit(90.0)
    ratio = F.least(F.lit(1.0), F.lit(math.sin(min(math.pi / 2, r / _R_MILES))) / F.cos(F.radians(phi)))
    dlng = F.degrees(F.asin(ratio))
    lo = F.floor((F.col(lng) - dlng + F.lit(180.0)) / F.lit(width)).cast("int")
    hi = F.floor((F.col(lng) + dlng + F.lit(180.0)) / F.lit(width)).cast("int")
    all_lng = near_pole | ((hi - lo + 1) >= F.lit(n_lng))
    lng_seq = F.when(all_lng, F.sequence(F.lit(0), F.lit(n_lng - 1))).otherwise(
        F.transform(F.sequence(lo, hi), lambda c: F.pmod(c, F.lit(n_lng)))
    )
    return lat_cells, F.array_distinct(lng_seq)


def _candidate_pairs(left: DataFrame, right: DataFrame, r: float) -> DataFrame:
    """Pairs (left place, right place) within distance < r, other places only, with distance."""
    lat_cells, lng_cells = _probe_cells(r)
    probes = left.select(
        F.col("lat").alias("a_lat"),
        F.col("lng").alias("a_lng"),
        F.explode(lat_cells).alias("lat_cell"),
        lng_cells.alias("_lngs"),
    ).select("a_lat", "a_lng", "lat_cell", F.explode("_lngs").alias("lng_cell"))
    h_lat, h_lng = _home_cell(r)
    home = right.select(F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng"), "w", h_lat.alias("lat_cell"), h_lng.alias("lng_cell"))
    pairs = probes.join(home, ["lat_cell", "lng_cell"])
    pairs = pairs.where(~((F.col("a_lat") == F.col("b_lat")) & (F.col("a_lng") == F.col("b_lng"))))
    pairs = pairs.withColumn("d", haversine_miles("a_lat", "a_lng", "b_lat", "b_lng"))
    return pairs.where(F.col("d") < F.lit(r))


def place_weights(points: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Distinct coordinates with the number of entities at each (pre-aggregated before any join)."""
    return (
        points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull())
        .groupBy(F.col(lat).cast("double").alias("lat"), F.col(lng).cast("double").alias("lng"))
        .agg(F.count(F.lit(1)).alias("w"))
    )


def place_features(places: DataFrame, radii: Sequence[float] = S.RADII_MILES, nearest: bool = True) -> DataFrame:
    """Per place: weighted number of *other* entities strictly within each radius, and the
    distance to the nearest other entity (0 when the place is shared)."""
    radii = sorted(radii)
    r = radii[-1]
    pairs = _candidate_pairs(places, places, r)
    agg = pairs.groupBy(F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")).agg(
        *[F.sum(F.when(F.col("d") < F.lit(x), F.col("w")).otherwise(F.lit(0))).alias(f"_n{i}") for i, x in enumerate(radii)],
        F.min("d").alias("_min"),
    )
    out = places.join(agg, ["lat", "lng"], "left")
    cols = [
        (F.coalesce(F.col(f"_n{i}"), F.lit(0)) + F.col("w") - F.lit(1)).cast("bigint").alias(f"n_win_{int(x) if float(x).is_integer() else x}")
        for i, x in enumerate(radii)
    ]
    near = F.when(F.col("w") > 1, F.lit(0.0)).otherwise(F.col("_min"))
    out = out.select("lat", "lng", "w", *cols, near.alias("nearest"))
    if not nearest:
        return out.drop("nearest")
    return _fill_far_nearest(out, places, r)


def _fill_far_nearest(features: DataFrame, places: DataFrame, r: float) -> DataFrame:
    """Nearest distance for places with no other place within r: double r on the remainder."""
    features = cut_lineage(features)
    remainder = features.where(F.col("nearest").isNull()).select("lat", "lng")
    found_parts = []
    radius = r
    places_ck = None
    while radius < 4 * _HALF_CIRCUMFERENCE:
        if remainder.isEmpty():
            break
        if places_ck is None:
            places_ck = cut_lineage(places)
        radius *= 2
        pairs = _candidate_pairs(remainder, places_ck, radius)
        found = pairs.groupBy(F.col("a_lat").alias("lat"), F.col("a_lng").alias("lng")).agg(F.min("d").alias("_far"))
        found = cut_lineage(found)
        found_parts.append(found)
        remainder = cut_lineage(remainder.join(found, ["lat", "lng"], "left_anti"))
    if not found_parts:
        return features
    far = found_parts[0]
    for p in found_parts[1:]:
        far = far.unionByName(p)
    return features.join(far, ["lat", "lng"], "left").withColumn("nearest", F.coalesce("nearest", "_far")).drop("_far")


def add_distance_features(df: DataFrame, lat_long: str | None = "lat_long", lat: str = "lat", lng: str = "lng",
                          radii: Sequence[float] = S.RADII_MILES) -> DataFrame:
    """Join radius counts and nearest distance back onto every row (NULL without coordinates)."""
    if lat_long is not None:
        base = df.withColumn("_lat", F.col(f"{lat_long}.lat")).withColumn("_lng", F.col(f"{lat_long}.lng"))
    else:
        base = df.withColumn("_lat", F.col(lat)).withColumn("_lng", F.col(lng))
    places = place_weights(base, "_lat", "_lng")
    feats = place_features(places, radii).drop("w")
    feats = feats.withColumnRenamed("lat", "_lat").withColumnRenamed("lng", "_lng")
    return base.join(feats, ["_lat", "_lng"], "left").drop("_lat", "_lng")
