"""Bounds, longitudes, affine transforms and map projections as expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 and UTM constants.
SEMI_MAJOR, FLATTENING, SCALE, FALSE_EAST, FALSE_NORTH = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
#: Series of the transverse Mercator projection to fourth order, forward and inverse, and of the latitude.
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180, 13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440, 61 * _N**3 / 240 - 103 * _N**4 / 140, 49561 * _N**4 / 161280)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440, 17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45, 56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def centre(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> tuple[Column, Column]:
    return (xmin + xmax) / 2, (ymin + ymax) / 2


def in_degrees(x: Column, y: Column) -> Column:
    return F.abs(x).between(0, 360) & F.abs(y).between(0, 90)


def match_longitude(q: Column, axis_min: Column, axis_max: Column) -> Column:
    """Query longitude in the axis's convention: 0-360 if it has no negatives, -180-180 if it ends by 180."""
    return F.when((axis_min >= 0) & (q < 0), F.pmod(q, F.lit(360.0))).when((axis_max <= 180) & (q > 180), F.pmod(q + 180, F.lit(360.0)) - 180).otherwise(q)


def _zone_lon(zone: Column) -> Column:
    return F.radians((zone - 1) * 6 - 180 + 3)


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing by the fourth-order series; accurate to well under a millimetre within a zone."""
    zone, south = epsg % 100, epsg >= 32700
    phi, lam = F.radians(lat), F.radians(lon) - _zone_lon(zone)
    e = 2 * math.sqrt(_N) / (1 + _N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return FALSE_EAST + SCALE * _A * x, F.when(south, FALSE_NORTH).otherwise(0.0) + SCALE * _A * y


def from_utm(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude, the inverse of to_utm."""
    zone, south = epsg % 100, epsg >= 32700
    xi0, eta0 = (north - F.when(south, FALSE_NORTH).otherwise(0.0)) / (SCALE * _A), (east - FALSE_EAST) / (SCALE * _A)
    xi, eta = xi0, eta0
    for j, b in enumerate(BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    lat = chi
    for j, d in enumerate(DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(_zone_lon(zone) + F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return SEMI_MAJOR * F.radians(lon), SEMI_MAJOR * F.ln(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / SEMI_MAJOR), F.degrees(2 * F.atan(F.exp(y / SEMI_MAJOR)) - math.pi / 2)


def lon_lat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Degrees as they are, anything else out of the UTM zone."""
    lon, lat = from_utm(x, y, epsg)
    deg = in_degrees(x, y)
    return F.when(deg, x).otherwise(lon), F.when(deg, y).otherwise(lat)


def pixel_to_map(row: Column, col: Column, affine: Column) -> tuple[Column, Column]:
    """Corner of a pixel; affine is array(a, b, c, d, e, f) with x = a*col + b*row + c, y = d*col + e*row + f."""
    a = [affine[k] for k in range(6)]
    return a[0] * col + a[1] * row + a[2], a[3] * col + a[4] * row + a[5]


def map_to_pixel(x: Column, y: Column, affine: Column) -> tuple[Column, Column]:
    """Row and column of the pixel that holds a point."""
    a = [affine[k] for k in range(6)]
    det = a[0] * a[4] - a[1] * a[3]
    col = (a[4] * (x - a[2]) - a[1] * (y - a[5])) / det
    row = (a[0] * (y - a[5]) - a[3] * (x - a[2])) / det
    return F.floor(row), F.floor(col)


def scaled_affine(affine: Column, sx: float, sy: float) -> Column:
    """Affine of the raster with pixels sx, sy times as large."""
    return F.array(affine[0] * sx, affine[1] * sy, affine[2], affine[3] * sx, affine[4] * sy, affine[5])


def window_bounds(row: Column, col: Column, height: Column, width: Column, affine: Column, *, legacy_inverse: bool = False) -> Column:
    """xmin, ymin, xmax, ymax of a window. legacy_inverse applies the inverse transform to the pixel corners, to replay such files."""
    place = (lambda r, c: tuple(reversed(map_to_pixel_exact(c, r, affine)))) if legacy_inverse else (lambda r, c: pixel_to_map(r, c, affine))
    x0, y0 = place(row, col)
    x1, y1 = place(row + height, col + width)
    return F.struct(F.least(x0, x1).alias("xmin"), F.least(y0, y1).alias("ymin"), F.greatest(x0, x1).alias("xmax"), F.greatest(y0, y1).alias("ymax"))


def map_to_pixel_exact(x: Column, y: Column, affine: Column) -> tuple[Column, Column]:
    a = [affine[k] for k in range(6)]
    det = a[0] * a[4] - a[1] * a[3]
    return (a[0] * (y - a[5]) - a[3] * (x - a[2])) / det, (a[4] * (x - a[2]) - a[1] * (y - a[5])) / det


def boxes_meet(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two (xmin, ymin, xmax, ymax) boxes share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against array<array<double>> vertices."""
    n = F.size(ring)
    crossings = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda acc, i: acc + (lambda p, q: F.when(((p[1] > y) != (q[1] > y)) & (x < (q[0] - p[0]) * (y - p[1]) / (q[1] - p[1]) + p[0]), 1).otherwise(0))(F.element_at(ring, i), F.element_at(ring, (i % n + 1).cast("int"))),
    )
    return crossings % 2 == 1


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often use() names it: an expression named in a lambda is worked out for each of the lambda's items."""
    return F.transform(F.array(value), use)[0]


def ring_area(ring: Column) -> Column:
    """Area of a ring of array<array<double>> vertices, closed or not, whichever way round."""
    cross = lambda p, q: p[0] * q[1] - q[0] * p[1]

    def area(r: Column) -> Column:
        n = F.size(r)
        total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, i: a + cross(F.element_at(r, i), F.element_at(r, (i % n + 1).cast("int"))))
        return F.when(n > 2, F.abs(total) / 2).otherwise(0.0)

    return bound(ring, area)


def ring_in_box(ring: Column, box: tuple[Column, ...]) -> Column:
    """The part of a ring within (xmin, ymin, xmax, ymax), cut side by side; empty where they do not meet. Exact for convex rings; a concave one that falls into
    pieces has them joined along the box's sides, which leaves its area right."""
    ring = bound(ring, lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r))
    for axis, limit, above in ((0, box[0], True), (0, box[2], False), (1, box[1], True), (1, box[3], False)):
        ring = bound(ring, _cut(axis, limit, above))
    return ring


def _cut(axis: int, limit: Column, above: bool) -> Callable[[Column], Column]:
    """Cuts a ring at a line across an axis, keeping what is above it or below."""
    inside = lambda p: (p[axis] >= limit) if above else (p[axis] <= limit)

    def crossing(p: Column, q: Column) -> Column:
        t = (limit - p[axis]) / (q[axis] - p[axis])
        other = p[1 - axis] + t * (q[1 - axis] - p[1 - axis])
        return F.array(limit.cast("double"), other) if axis == 0 else F.array(other, limit.cast("double"))

    def cut(r: Column) -> Column:
        def from_(p: Column, i: Column) -> Column:
            q = F.element_at(r, ((i + 1) % F.size(r) + 1).cast("int"))
            stay = F.when(inside(p), F.array(p)).otherwise(F.array().cast("array<array<double>>"))
            return F.when(inside(p) != inside(q), F.concat(stay, F.array(crossing(p, q)))).otherwise(stay)

        return F.flatten(F.transform(r, from_))

    return cut


def ring_in_use(ring: Column) -> Column:
    """Whether a ring is there, has three vertices or more, and an area."""
    return F.coalesce(bound(ring, lambda r: (F.size(r) > 2) & (ring_area(r) > 0)), F.lit(False))
