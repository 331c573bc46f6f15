"""Geometry as column expressions: distances, bearings, a hexagonal grid, geohashes.  No Python runs on the executors."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.config import EARTH_RADIUS_KM, HEX_EDGE_KM

#: Origin of the local projection and kilometres of a degree.
LAT0, LON0 = 41.15, -8.62
KM_PER_DEG = EARTH_RADIUS_KM * math.pi / 180.0
COS0 = math.cos(math.radians(LAT0))
GEOHASH_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance; NULL if any argument is."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(h))


def bearing_deg(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def hex_cell(lon: Column, lat: Column, edge_km: float = HEX_EDGE_KM) -> Column:
    """The axial hexagon "q_r" of a point, by cube rounding on a local equirectangular projection."""
    x, y = (lon - LON0) * (KM_PER_DEG * COS0), (lat - LAT0) * KM_PER_DEG
    q, r = (x * (math.sqrt(3.0) / 3.0) - y / 3.0) / edge_km, (y * (2.0 / 3.0)) / edge_km
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(-q - r + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.concat_ws("_", cq.cast("string"), cr.cast("string"))


def hex_centre(cell: Column, edge_km: float = HEX_EDGE_KM) -> Column:
    """struct(lon, lat) of a hexagon's centre."""
    parts = F.split(cell, "_")
    q, r = F.get(parts, F.lit(0)).cast("double"), F.get(parts, F.lit(1)).cast("double")
    x, y = (q * math.sqrt(3.0) + r * (math.sqrt(3.0) / 2.0)) * edge_km, r * 1.5 * edge_km
    return F.struct((x / (KM_PER_DEG * COS0) + LON0).alias("lon"), (y / KM_PER_DEG + LAT0).alias("lat"))


def cell_step_km(edge_km: float = HEX_EDGE_KM) -> float:
    """Centre to centre of neighbouring hexagons."""
    return math.sqrt(3.0) * edge_km


def cell_hop_km(a: Column, b: Column, edge_km: float = HEX_EDGE_KM) -> Column:
    ca, cb = hex_centre(a, edge_km), hex_centre(b, edge_km)
    return haversine_km(ca["lon"], ca["lat"], cb["lon"], cb["lat"])


def centre_of(cell: str, edge_km: float = HEX_EDGE_KM) -> tuple[float, float]:
    """hex_centre in Python, for operators that already run there."""
    q, r = map(float, cell.split("_"))
    x, y = (q * math.sqrt(3.0) + r * (math.sqrt(3.0) / 2.0)) * edge_km, r * 1.5 * edge_km
    return x / (KM_PER_DEG * COS0) + LON0, y / KM_PER_DEG + LAT0


def hop_km_of(a: str, b: str, edge_km: float = HEX_EDGE_KM) -> float:
    """cell_hop_km in Python."""
    (lon1, lat1), (lon2, lat2) = centre_of(a, edge_km), centre_of(b, edge_km)
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_RADIUS_KM * math.asin(math.sqrt(h))


def geohash(lon: Column, lat: Column, precision: int = 6) -> Column:
    """Geohash text of a point: bits of both axes interleaved, longitude first, five to a character."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    ix = F.least(F.greatest(F.floor((lon + 180.0) / 360.0 * (1 << nx)), F.lit(0)), F.lit((1 << nx) - 1)).cast("long")
    iy = F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * (1 << ny)), F.lit(0)), F.lit((1 << ny) - 1)).cast("long")
    chars = []
    for c in range(precision):
        value = F.lit(0).cast("long")
        for k in range(5 * c, 5 * c + 5):
            axis, at = (ix, nx - 1 - k // 2) if k % 2 == 0 else (iy, ny - 1 - k // 2)
            value = value * 2 + F.shiftright(axis, at).bitwiseAND(F.lit(1))
        chars.append(F.substring(F.lit(GEOHASH_ALPHABET), value.cast("int") + 1, F.lit(1)))
    return F.when(lon.isNull() | lat.isNull(), None).otherwise(F.concat(*chars))


def geohash_centre(cell: Column) -> Column:
    """struct(lon, lat) in the middle of a geohash cell: its characters' bits, taken apart again."""
    chars = F.transform(F.split(cell, ""), lambda c: F.instr(F.lit(GEOHASH_ALPHABET), F.nullif(c, F.lit(""))) - 1)
    bits = F.flatten(F.transform(F.filter(chars, lambda v: v >= 0), lambda v: F.transform(F.sequence(F.lit(4), F.lit(0)), lambda k: F.floor(v / F.pow(F.lit(2.0), k)).cast("int") % 2)))

    def middle(first: int, low: float, high: float) -> Column:
        own = F.filter(bits, lambda b, i: i % 2 == first)
        n = F.size(own)
        value = F.aggregate(own, F.lit(0.0), lambda s, b: s * 2 + b)
        return F.lit(low) + (value + 0.5) / F.pow(F.lit(2.0), n) * (high - low)

    return F.when(cell.isNotNull(), F.struct(middle(0, -180.0, 180.0).alias("lon"), middle(1, -90.0, 90.0).alias("lat")))


def path_km(points: Column) -> Column:
    """Length of an array of struct(lon, lat)."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1), lambda a, b: haversine_km(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def densify(points: Column, step_km: float, max_gap_km: float) -> Column:
    """Points with linear ones put in where a step is longer than step_km, but no longer than max_gap_km: ceil(d / step) - 1 of them."""
    n = F.size(points)

    def between(a: Column, b: Column) -> Column:
        d = haversine_km(a["lon"], a["lat"], b["lon"], b["lat"])
        parts = F.when((d > step_km) & (d <= max_gap_km), F.ceil(d / step_km)).otherwise(F.lit(1)).cast("int")
        return F.transform(
            F.sequence(F.lit(1), parts),
            lambda k: F.struct((a["lon"] + (b["lon"] - a["lon"]) * k / parts).alias("lon"), (a["lat"] + (b["lat"] - a["lat"]) * k / parts).alias("lat")),
        )

    rest = F.flatten(F.zip_with(F.slice(points, F.lit(1), n - 1), F.slice(points, F.lit(2), n - 1), between))
    return F.when(n < 2, points).otherwise(F.concat(F.slice(points, F.lit(1), F.lit(1)), rest))


def in_box(lon: Column, lat: Column, lons: tuple[float, float], lats: tuple[float, float], margin: float = 0.0) -> Column:
    return lon.between(lons[0] - margin, lons[1] + margin) & lat.between(lats[0] - margin, lats[1] + margin)
