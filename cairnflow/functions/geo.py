"""Geohash, Open Location Code, distances and bearings as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Alphabets and the mean radius of the Earth in metres.
GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"
OPEN_LOCATION = "23456789CFGHJMPQRVWX"
EARTH = 6_371_008.8


def _cell(value: Column, low: float, span: float, bits: int) -> Column:
    """Index of the cell of 2^bits that holds the value; the upper edge belongs to the last one."""
    return F.least(F.lit((1 << bits) - 1).cast("long"), F.floor((value - low) / span * float(1 << bits)).cast("long"))


def geohash_tokens(lng: Column, lat: Column, length: int = 6) -> Column:
    """Array of 5-bit numbers, longitude bit first."""
    lng_bits, lat_bits = (5 * length + 1) // 2, 5 * length // 2
    x, y = _cell(lng, -180.0, 360.0, lng_bits), _cell(lat, -90.0, 180.0, lat_bits)
    tokens = []
    for t in range(length):
        token = F.lit(0).cast("long")
        for b in range(5 * t, 5 * t + 5):
            source, at, n = (x, b // 2, lng_bits) if b % 2 == 0 else (y, b // 2, lat_bits)
            token = token * 2 + F.shiftright(source, n - 1 - at).bitwiseAND(1)
        tokens.append(token.cast("int"))
    return F.array(*tokens)


def tokens_to_geohash(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: F.substr(F.lit(GEOHASH), t + 1, F.lit(1))), "")


def geohash(lng: Column, lat: Column, length: int = 6) -> Column:
    return tokens_to_geohash(geohash_tokens(lng, lat, length))


def geohash_to_tokens(text: Column) -> Column:
    """The inverse of tokens_to_geohash, by position in the alphabet."""
    letters = F.array(*[F.lit(c) for c in GEOHASH])
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.array_position(letters, c) - 1).cast("int"))


def cell_center(tokens: Column, length: int = 6) -> tuple[Column, Column]:
    """(lng, lat) of the middle of a geohash cell."""
    x = y = F.lit(0).cast("long")
    for b in range(5 * length):
        bit = F.shiftright(F.element_at(tokens, b // 5 + 1), 4 - b % 5).bitwiseAND(1).cast("long")
        if b % 2 == 0:
            x = x * 2 + bit
        else:
            y = y * 2 + bit
    nx, ny = 1 << (5 * length + 1) // 2, 1 << 5 * length // 2
    return (x + 0.5) * (360.0 / nx) - 180.0, (y + 0.5) * (180.0 / ny) - 90.0


def pack_tokens(tokens: Column) -> Column:
    """Five bits a token in one number."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a * 32 + t)


def plus_code6(lng: Column, lat: Column) -> Column:
    """Open Location Code of six digits with `00+`; null outside the globe."""
    y = F.when(lat == 90.0, lat - 0.05).otherwise(lat) + 90.0
    x = lng + 180.0
    x = F.when(x >= 360.0, x - 360.0).otherwise(x)
    digit = lambda v: F.substr(F.lit(OPEN_LOCATION), (v + 1).cast("int"), F.lit(1))
    # cells of 1/20 degree counted in whole numbers, so that the digits agree with each other
    ny, nx = F.floor(y * 20.0).cast("long"), F.floor(x * 20.0).cast("long")
    parts = []
    for place in (400, 20, 1):
        parts += [digit(F.pmod(F.floor(n / place).cast("long"), F.lit(20))) for n in (ny, nx)]
    return F.when((F.abs(lat) <= 90.0) & (F.abs(lng) <= 180.0), F.concat(*parts, F.lit("00+")))


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres along the great circle."""
    a, b = F.radians(lat1), F.radians(lat2)
    v = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH) * F.asin(F.least(F.lit(1.0), F.sqrt(v)))


def bearing(lng: Column, lat: Column, anchor_lng: Column, anchor_lat: Column) -> Column:
    """Angle from an anchor, in [0, 2π)."""
    angle = F.atan2(lat - anchor_lat, (lng - anchor_lng) * F.cos(F.radians(anchor_lat)))
    return F.pmod(angle + 2 * math.pi, F.lit(2 * math.pi))


def local_metres(lng: Column, lat: Column, lng0: Column, lat0: Column) -> tuple[Column, Column]:
    """Equirectangular (x, y) about a centre."""
    return F.radians(lng - lng0) * F.cos(F.radians(lat0)) * EARTH, F.radians(lat - lat0) * EARTH


def fourier_features(x_km: Column, y_km: Column, scales: list[float]) -> Column:
    """Unit vector of sines and cosines of an offset at several scales."""
    parts = [f(v * (2 * math.pi / s)) for s in scales for v in (x_km, y_km) for f in (F.sin, F.cos)]
    return F.transform(F.array(*parts), lambda p: p / math.sqrt(2 * len(scales)))
