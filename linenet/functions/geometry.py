"""Planar geometry on arrays of (x, y) structs, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((bx - ax) * (bx - ax) + (by - ay) * (by - ay))


def rounded(c: Column, digits: int) -> Column:
    """As SQL engines round doubles: scaled, then half away from zero (F.round goes by the shortest decimal text)."""
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def steps(coords: Column) -> Column:
    """Lengths of the pieces between neighbouring vertices."""
    n = F.greatest(F.size(coords) - 1, F.lit(0))
    return F.zip_with(F.slice(coords, F.lit(1), n), F.slice(coords, F.lit(2), n), lambda a, b: distance(a["x"], a["y"], b["x"], b["y"]))


def length(coords: Column) -> Column:
    """0 for points; null for no geometry."""
    return F.aggregate(steps(coords), F.lit(0.0), lambda acc, s: acc + s)


def walked(coords: Column) -> Column:
    """Distance along the line at each vertex."""
    return F.aggregate(steps(coords), F.array(F.lit(0.0)), lambda acc, s: F.concat(acc, F.array(F.element_at(acc, -1) + s)))


def bearing(coords: Column) -> Column:
    """Degrees clockwise from north, from the first vertex to the last; null for rings and empty lines."""
    a, b = F.element_at(coords, 1), F.element_at(coords, -1)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    turned = F.degrees(F.atan2(dx, dy))
    return F.when((F.size(coords) > 1) & ((dx != 0) | (dy != 0)), F.when(turned < 0, turned + 360).otherwise(turned))


def compass(bearing_degrees: Column) -> Column:
    """The nearest of eight points, halves upwards."""
    octant = F.pmod(F.floor(bearing_degrees / 45 + 0.5), F.lit(8)).cast("int")
    return F.when(bearing_degrees.isNotNull(), F.element_at(F.array(*[F.lit(c) for c in COMPASS]), octant + 1))


def metres_between(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Local metres from the WGS 84 series at the mean latitude."""
    phi = F.radians((lat1 + lat2) / 2)
    # fixed values: metres per degree of latitude and longitude on WGS 84
    per_lat = 111132.92 - 559.82 * F.cos(2 * phi) + 1.175 * F.cos(4 * phi) - 0.0023 * F.cos(6 * phi)
    per_lon = 111412.84 * F.cos(phi) - 93.5 * F.cos(3 * phi) + 0.118 * F.cos(5 * phi)
    dx, dy = (lon2 - lon1) * per_lon, (lat2 - lat1) * per_lat
    return F.sqrt(dx * dx + dy * dy)


def inside_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd over all rings (arrays of points), each edge half open in y."""

    def crossings(ring):
        n = F.size(ring)
        following = F.concat(F.slice(ring, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(ring, 1, 1))
        hit = F.zip_with(ring, following, lambda a, b: ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / F.when(b["y"] == a["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"]))
        return F.size(F.filter(hit, lambda h: h))

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda acc, c: acc + c) % 2 == 1


def point_along(coords: Column, share: float) -> Column:
    """The point at a share of the line's length, as a struct."""
    along, want = walked(coords), length(coords) * share
    k = F.greatest(F.lit(1), F.least(F.size(coords) - 1, F.size(F.filter(along, lambda d: d <= want))))
    a, b = F.element_at(coords, k), F.element_at(coords, k + 1)
    d0, d1 = F.element_at(along, k), F.element_at(along, k + 1)
    t = F.when(d1 > d0, (want - d0) / (d1 - d0)).otherwise(0.0)
    return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))


def utm(lon: Column, lat: Column, zone: int = 33) -> Column:
    """WGS 84 longitude and latitude to UTM metres (Krüger series), as a struct x, y."""
    a, f = 6378137.0, 1 / 298.257223563  # fixed values: the WGS 84 ellipsoid
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    c = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, k in enumerate(alpha, 1):
        x = x + k * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + k * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((500000 + 0.9996 * big * x).alias("x"), (0.9996 * big * y).alias("y"))
