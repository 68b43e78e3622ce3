"""Coordinates from texts, and map projections, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUM = r"[+-]?\d+(?:\.\d+)?"


def decimal_or_dms(text: Column, limit: float) -> Column:
    """Degrees of a number, a number with N, S, E or W, or degrees, minutes and seconds; null beyond ``limit``."""
    t = F.trim(text)
    dms = r"^(\d+(?:\.\d+)?)\s*(?:deg|°|\s)\s*(\d+(?:\.\d+)?)\s*['′\s]\s*(\d+(?:\.\d+)?)\s*[\"″]?\s*([NSEWnsew])?$"
    part = lambda k: F.regexp_extract(t, dms, k).try_cast("double")
    angle = part(1) + part(2) / 60 + part(3) / 3600
    dms_value = F.when(F.upper(F.regexp_extract(t, dms, 4)).isin("S", "W"), -angle).otherwise(angle)
    plain = rf"^({_NUM})\s*([NSEWnsew])?$"
    number, ref = F.regexp_extract(t, plain, 1).try_cast("double"), F.upper(F.regexp_extract(t, plain, 2))
    plain_value = F.when(ref.isin("S", "W"), -F.abs(number)).when(ref.isin("N", "E"), F.abs(number)).otherwise(number)
    value = F.coalesce(plain_value, dms_value)
    return F.when(F.abs(value) <= limit, value)


def _location(lat: Column, lon: Column, alt: Column) -> Column:
    ok = lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return F.when(ok, F.struct(lat.alias("lat"), lon.alias("lon"), alt.alias("alt")))


def iso6709(text: Column) -> Column:
    """``±lat±lon±alt/`` or ``Latitude, Longitude: a, b`` as (lat, lon, alt)."""
    named = rf"(?i)^\s*latitude,\s*longitude:\s*({_NUM})\s*,\s*({_NUM})\s*$"
    packed = r"^\s*([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)([+-]\d+(?:\.\d+)?)?/?\s*$"
    get = lambda p, k: F.regexp_extract(text, p, k).try_cast("double")
    return F.coalesce(_location(get(named, 1), get(named, 2), F.lit(None).cast("double")), _location(get(packed, 1), get(packed, 2), get(packed, 3)))


def parse_location(text: Column) -> Column:
    """A location text in any of the known shapes as (lat, lon, alt), or null."""
    whole = F.trim(text)
    pieces = F.filter(F.split(whole, r"\s*,\s*|\s*;\s*|\s+\|\s+"), lambda p: F.trim(p) != "")
    words = F.filter(F.split(whole, r"\s+"), lambda p: p != "")

    def pair(parts: Column) -> Column:
        get = lambda k, limit: decimal_or_dms(F.try_element_at(parts, F.lit(k)), limit)
        return _location(get(1, 90.0), get(2, 180.0), get(3, 1e9))

    return F.coalesce(iso6709(whole), pair(pieces), pair(words))


def e7(value: Column) -> Column:
    """Degrees of an integer in ten-millionths."""
    return value / 1e7


def dms(degrees: Column, minutes: Column, seconds: Column, ref: Column) -> Column:
    value = degrees + minutes / 60.0 + seconds / 3600.0
    return F.when(F.upper(ref).isin("S", "W"), -value).otherwise(value)


def to_iso6709(lat: Column, lon: Column, alt: Column) -> Column:
    return F.concat(F.format_string("%+08.4f%+09.4f", lat, lon), F.when(alt.isNull(), F.lit("")).otherwise(F.format_string("%+.3f", alt)), F.lit("/"))


def mercator(lat: Column, lon: Column) -> Column:
    """Unit-square Web Mercator (x, y); latitudes are held within 85 degrees."""
    rad = F.radians(F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat)))
    return F.struct(((lon + 180.0) / 360.0).alias("x"), ((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / F.lit(3.141592653589793)) / 2).alias("y"))
