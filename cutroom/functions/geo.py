"""Places on the globe as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null where a coordinate is missing."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def valid_place(lat: Column, lon: Column) -> Column:
    return lat.between(-90, 90) & lon.between(-180, 180)


def zone_hours(lon: Column) -> Column:
    """Time zone by longitude: whole hours from -12 to 14."""
    return F.least(F.lit(14), F.greatest(F.lit(-12), F.round(lon / 15).cast("int")))


def cell(lat: Column, lon: Column, km: float) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are at least km tall, and as wide at 60 degrees of latitude."""
    step = km / 111.0
    return F.floor(lat / F.lit(step)), F.floor(lon / F.lit(step * 2))


def parse_place(text: Column) -> Column:
    """struct<lat, lon> of an ISO 6709 text (+dd.dddd+ddd.dddd/) or of "lat,lon"; null for anything else or beyond the globe."""
    number = r"[+-]\d+(?:\.\d+)?"
    iso = rf"^\s*({number})({number})({number})?/?\s*$"
    pair = r"^\s*([+-]?\d+(?:\.\d+)?)\s*,\s*([+-]?\d+(?:\.\d+)?)\s*$"
    part = lambda k: F.coalesce(F.regexp_extract(text, iso, k).try_cast("double"), F.regexp_extract(text, pair, k).try_cast("double"))
    return F.when(valid_place(part(1), part(2)), F.struct(part(1).alias("lat"), part(2).alias("lon")))
