"""Geo: places as 52-bit geohashes, scores of a sorted set. All of it is column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The earth's radius in metres, metres per unit, the geohash alphabet.
RADIUS = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
LON, LAT = (-180.0, 180.0), (-90.0, 90.0)
STEPS = 26


def spread(c: Column) -> Column:
    """The bits of a number below 2^26, each after a zero. Said in binary digits, so that c stands once in the
    expression: shifts and masks would double it at every step."""
    return F.conv(F.regexp_replace(F.lpad(F.bin(c), STEPS, "0"), "(.)", "0$1"), 2, 10).cast("long")


def squash(c: Column) -> Column:
    """The even bits, together."""
    return F.conv(F.regexp_replace(F.lpad(F.bin(c), 2 * STEPS, "0"), ".(.)", "$1"), 2, 10).cast("long")


def scaled(c: Column, span: tuple[float, float]) -> Column:
    low, high = span
    return F.least(F.floor((c - low) / (high - low) * float(1 << STEPS)), F.lit((1 << STEPS) - 1)).cast("long")


def encode(lon: Column, lat: Column) -> Column:
    """The interleaved bits, longitude in the odd places. Latitudes reach to the poles, as in the usual string."""
    return spread(scaled(lat, LAT)).bitwiseOR(F.shiftleft(spread(scaled(lon, LON)), 1))


def decode(h: Column) -> tuple[Column, Column]:
    """(lon, lat) of the middle of a cell."""

    def middle(cell: Column, span: tuple[float, float]) -> Column:
        low, high = span
        return F.lit(low) + (cell.cast("double") + 0.5) / float(1 << STEPS) * (high - low)

    return middle(squash(F.shiftright(h, 1)), LON), middle(squash(h), LAT)


def geohash(lon: Column, lat: Column) -> Column:
    """The usual string of eleven signs; 52 bits give ten, and the last is 0."""
    digits = lambda h: F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.substring(F.lit(ALPHABET), F.pmod(F.floor(h / F.pow(F.lit(2.0), 52 - 5 * i)).cast("long"), F.lit(32)).cast("int") + 1, F.lit(1)))
    once = F.transform(F.array(encode(lon, lat)), lambda h: F.array_join(digits(h), ""))
    return F.concat(F.element_at(once, 1), F.lit("0"))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres along a great circle (haversine)."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * RADIUS * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def geoadd(places: DataFrame) -> DataFrame:
    """(key, member, lon, lat, ...) to scored members (key, member, score, ...). A place off the globe is an error."""
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    score = F.when(lon.between(*LON) & lat.between(*LAT), encode(lon, lat).cast("double")).otherwise(F.raise_error(F.lit("invalid longitude, latitude pair")).cast("double"))
    return places.select("key", "member", score.alias("score"), *[c for c in places.columns if c not in ("key", "member", "lon", "lat")])


def geopos(z: DataFrame) -> DataFrame:
    lon, lat = decode(F.col("score").cast("long"))
    return z.select("key", "member", lon.alias("lon"), lat.alias("lat"))


def geodist(z: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """pairs (key, a, b) with their distance."""
    p = geopos(z)
    both = pairs.join(p.toDF("key", "a", "lon1", "lat1"), ["key", "a"]).join(p.toDF("key", "b", "lon2", "lat2"), ["key", "b"])
    return both.select("key", "a", "b", (distance(*map(F.col, ("lon1", "lat1", "lon2", "lat2"))) / UNITS[unit]).alias("dist"))


def geosearch(z: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, unit: str = "m", count: int | None = None, reverse: bool = False) -> DataFrame:
    """Members within a radius (strictly) or a box (its edges included), nearest first; the centre is a literal, so
    the search is a filter of one scan, with a cheap test of latitude before the trigonometry."""
    metres = UNITS[unit]
    p = geopos(z)
    if radius is not None:
        reach = radius * metres / RADIUS * 57.29577951308232 + 1e-6
        p = p.where(F.col("lat").between(lat - reach, lat + reach))
    found = p.withColumn("dist", distance(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) / metres)
    if radius is not None:
        found = found.where(F.col("dist") < radius)
    else:
        width, height = box
        across = distance(F.lit(lon), F.col("lat"), F.col("lon"), F.col("lat")) / metres
        along = distance(F.lit(lon), F.lit(lat), F.lit(lon), F.col("lat")) / metres
        found = found.where((across <= width / 2) & (along <= height / 2))
    if count is None:
        return found
    return found.orderBy(F.desc("dist") if reverse else F.asc("dist"), "member").limit(count)
