"""Distances, cells, radii and location scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Search radius in km by the most specific location level given.
RADII = [
    (("landmark", "road", "chowk", "street"), 1.5), (("block", "phase", "sector", "housing_society"), 3.0), (("village", "mouza", "basti", "area"), 5.0),
    (("union_council", "town"), 8.0), (("city", "tehsil"), 40.0), (("district",), 80.0), (("province",), 200.0),
]


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2.0)
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def bbox(lat: Column, lng: Column, lat0: float, lng0: float, km: float) -> Column:
    """Box around a circle: plain comparisons that reach the scan, ahead of the exact distance."""
    import math

    d_lat = math.degrees(km / EARTH_KM) * 1.0001
    top = min(89.9, abs(lat0) + d_lat)
    d_lng = math.degrees(km / EARTH_KM / max(math.cos(math.radians(top)), 1e-6)) * 1.0001
    box = lat.between(lat0 - d_lat, lat0 + d_lat)
    if d_lng >= 180:
        return box
    low, high = lng0 - d_lng, lng0 + d_lng
    if low < -180 or high > 180:  # across the date line
        return box & (lng.between(max(low, -180), min(high, 180)) | (lng >= low + 360) | (lng <= high - 360))
    return box & lng.between(low, high)


def geo_score(metres: Column) -> Column:
    return F.when(metres.isNull(), -1).when(metres < 20, 100).when(metres <= 50, 80).when(metres <= 150, 50).otherwise(10)


def coarse_cell(lat: Column, lng: Column) -> Column:
    return F.concat(F.floor(lat / 2).cast("string"), F.lit("_"), F.floor(lng / 2).cast("string"))  # null where either is


def location_score(distance: Column, radius: Column, address_score: Column) -> Column:
    """Falls with distance: at least 0.5 inside the radius, 0 from three radii on; without a distance, 0.6 of the address score."""
    return (
        F.when(distance.isNull(), address_score * 0.6).when(distance <= radius, F.greatest(F.lit(0.5), 1 - distance / (radius * 2)))
        .otherwise(F.greatest(F.lit(0.0), 0.5 - (distance - radius) / (radius * 4)))
    )


def effective_radius(location: dict) -> float:
    """Radius of a location: its distance, its radius, or that of its most specific level (40 km without any)."""
    for key in ("distance_km", "radius_km"):
        if location.get(key):
            return float(location[key])
    return next((km for keys, km in RADII if any(location.get(k) for k in keys)), 40.0)


def address_token_score(address: Column, names: list[str]) -> Column:
    """Share of the location's names that the address contains."""
    names = [n.lower() for n in names if n]
    if not names:
        return F.lit(0.0)
    hits = sum((F.coalesce(F.lower(address).contains(n), F.lit(False)).cast("int") for n in names[1:]), F.coalesce(F.lower(address).contains(names[0]), F.lit(False)).cast("int"))
    return hits / float(len(names))


def same_place(metres: Column) -> Column:
    """At most 50 m apart (unknown distances are not)."""
    return F.coalesce(metres <= 50, F.lit(False))


def viewport_radius(lat: Column, lng: Column, ne_lat: Column, ne_lng: Column) -> Column:
    """Metres from a centre to the north-east corner of its viewport; null up to 100 m."""
    m = haversine_km(lat, lng, ne_lat, ne_lng) * 1000
    return F.when(m > 100, m)
