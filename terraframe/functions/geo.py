"""Columns for coordinates, distances, boxes and tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean radius of the earth in metres.
EARTH_RADIUS_M = 6_371_008.8
E7 = 10_000_000
#: Slack, in 1e-7 degrees, with which box bounds are rounded to whole numbers.
BOX_SLACK = 1e-5


def degrees(e7: Column) -> Column:
    return e7 / F.lit(float(E7))


def to_e7(value: Column) -> Column:
    """Degrees as whole 1e-7 degrees; halves go up, also below zero."""
    return F.floor(value * E7 + 0.5).cast("int")


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres of points in degrees."""
    f1, f2 = F.radians(lat1), F.radians(lat2)
    s = F.pow(F.sin((f2 - f1) / 2), 2) + F.cos(f1) * F.cos(f2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(s), F.sqrt(F.greatest(1 - s, F.lit(0.0))))


def haversine_e7(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The same for points in whole 1e-7 degrees. Differences are taken of whole numbers: those of rounded radians have few
    digits where points are near, which shows in lengths that are rounded to 32 bits."""
    half = lambda a, b: F.sin(F.radians((b.cast("long") - a.cast("long")) / E7) / 2)
    s = F.pow(half(ay, by), 2) + F.cos(F.radians(ay / E7)) * F.cos(F.radians(by / E7)) * F.pow(half(ax, bx), 2)
    return 2 * EARTH_RADIUS_M * F.atan2(F.sqrt(s), F.sqrt(F.greatest(1 - s, F.lit(0.0))))


def box_bounds_e7(box: tuple[float, float, float, float]) -> tuple[int, int, int, int]:
    """A box in degrees as inclusive whole bounds."""
    lo = lambda x: math.ceil(x * E7 - BOX_SLACK)
    hi = lambda x: math.floor(x * E7 + BOX_SLACK)
    return lo(box[0]), lo(box[1]), hi(box[2]), hi(box[3])


def in_box(lon_e7: Column, lat_e7: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside a box, edges included. A box whose west is east of its east spans the antimeridian; one whose south is
    north of its north is empty. Comparisons of bare integer columns, so they reach the Parquet reader."""
    west, south, east, north = box_bounds_e7(box)
    if box[1] > box[3]:
        return F.lit(False)
    lat = lat_e7.between(south, north)
    if box[0] > box[2]:
        return lat & ((lon_e7 >= west) | (lon_e7 <= east))
    return lat & lon_e7.between(west, east)


def boxes_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two boxes (west, south, east, north) share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def valid_box(box: tuple[Column, ...]) -> Column:
    return (box[0] <= box[2]) & (box[1] <= box[3])


def normalize_lon(lon: float) -> float:
    return (lon + 180.0) % 360.0 - 180.0


def radius_box(lon: float, lat: float, km: float) -> tuple[float, float, float, float]:
    """A box that holds everything within km of a point; all longitudes where a pole is near."""
    angle = km * 1000 / EARTH_RADIUS_M
    d = math.degrees(angle) if math.isfinite(angle) else 360.0
    south, north = lat - d, lat + d
    if south <= -90 or north >= 90:
        return -180.0, max(south, -90.0), 180.0, min(north, 90.0)
    dlon = math.degrees(math.asin(min(1.0, math.sin(angle) / math.cos(math.radians(lat)))))
    if dlon >= 180:
        return -180.0, south, 180.0, north
    west, east = lon - dlon, lon + dlon
    pad = 1e-7
    return normalize_lon(west - pad), south - pad, normalize_lon(east + pad), north + pad


def tile_x(lon: Column, zoom: Column | int) -> Column:
    """Web-Mercator tile column with its fraction."""
    return (lon + 180) / 360 * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))


def tile_y(lat: Column, zoom: Column | int) -> Column:
    s = F.sin(F.radians(lat))
    return (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(zoom))


def tile_pixel(lon: Column, lat: Column, zoom: int, extent: int) -> tuple[Column, Column]:
    """Pixel inside the point's own tile, rounded and clamped to the extent."""
    px = lambda v: F.least(F.greatest(F.floor((v - F.floor(v)) * extent + 0.5), F.lit(0)), F.lit(extent)).cast("long")
    return px(tile_x(lon, zoom)), px(tile_y(lat, zoom))


def tile_bounds(x: Column, y: Column, zoom: Column) -> tuple[Column, Column, Column, Column]:
    """Box of a tile in degrees: west, south, east, north."""
    n = F.pow(F.lit(2.0), zoom)
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * v / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)


#: Latitude at the edges of the square Mercator world.
MAX_LATITUDE = 85.05112878


def world(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Position in the Mercator world, from 0 to 1; longitudes wrap, latitudes are clamped."""
    f = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    y = (1 - F.log(F.tan(f) + 1 / F.cos(f)) / math.pi) / 2
    return F.pmod((lon + 180) / 360, F.lit(1.0)), F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))


def from_world(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a position."""
    inside = F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))
    return F.pmod(x, F.lit(1.0)) * 360 - 180, F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * inside))))


def zigzag(v: Column) -> Column:
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def unzigzag(v: Column) -> Column:
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-(v.bitwiseAND(F.lit(1))))


def point_box_distance_m(lon: float, lat: float, west: Column, south: Column, east: Column, north: Column) -> Column:
    """Great-circle distance from a point to the nearest point of a box (0 inside)."""
    inside = F.lit(lon).between(west, east)
    near_lat = F.least(F.greatest(F.lit(lat), south), north)
    straight = haversine_m(F.lit(lon), F.lit(lat), F.lit(lon), near_lat)
    edge = lambda x: _edge_distance(lon, lat, x, south, north)
    return F.when(inside, straight).otherwise(F.least(edge(west), edge(east)))


def _edge_distance(lon: float, lat: float, x: Column, south: Column, north: Column) -> Column:
    # the nearest latitude on a meridian, clamped to the edge
    d = F.radians(x - lon)
    best = F.degrees(F.atan2(F.lit(math.tan(math.radians(lat))), F.cos(d)))
    best = F.when(F.cos(d) <= 0, F.when(F.lit(lat) >= 0, north).otherwise(south)).otherwise(best)
    return haversine_m(F.lit(lon), F.lit(lat), x, F.least(F.greatest(best, south), north))


def ring_area(xs: Column, ys: Column) -> Column:
    """Signed shoelace area of a closed ring given as two arrays."""
    n = F.size(xs) - 1
    cross = F.zip_with(
        F.zip_with(F.slice(xs, F.lit(1), n), F.slice(ys, F.lit(2), n), lambda x, y: x * y),
        F.zip_with(F.slice(xs, F.lit(2), n), F.slice(ys, F.lit(1), n), lambda x, y: x * y),
        lambda a, b: a - b,
    )
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2
