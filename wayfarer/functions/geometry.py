"""Plane and sphere geometry as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def heading(dx: Column, dy: Column) -> Column:
    """Radians from the x axis, counter-clockwise."""
    return F.atan2(dy, dx)


def wrap(angle: Column) -> Column:
    """The angle in [-pi, pi)."""
    return F.pmod(angle + F.pi(), 2 * F.pi()) - F.pi()


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Unsigned degrees between two vectors; null if either has no length."""
    norms = length(ax, ay) * length(bx, by)
    cosine = (ax * bx + ay * by) / F.when(norms > 0, norms)
    return F.when(norms > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def turning_degrees(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Signed degrees from the first step to the second: negative unless the cross product is positive; 0 without length."""
    cross = ax * by - ay * bx
    unsigned = F.coalesce(angle_between(ax, ay, bx, by), F.lit(0.0))
    return F.when(cross > 0, unsigned).otherwise(-unsigned)


def folded_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors, from 0 to 180."""
    angle = F.pmod(angle_between(ax, ay, bx, by), F.lit(360.0))
    return F.when(angle > 180, 360 - angle).otherwise(angle)


def initial_bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees clockwise from north at which the great circle to the second point sets out, in (-180, 180]."""
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d)))


#: WGS 84 and the UTM projection (Snyder 1987, pp. 61-64).
_A, _E2, _K0 = 6378137.0, 0.00669438, 0.9996


def utm_zone(lon: Column) -> Column:
    return (F.floor((lon + 180) / 6) + 1).cast("long")


#: The letters of the latitude bands from 80 degrees south, 8 degrees each, the last 12.
UTM_LETTERS = "CDEFGHJKLMNPQRSTUVWXX"


def utm_letter(lat: Column) -> Column:
    """The latitude band's letter; null beyond 80 degrees south and 84 degrees north."""
    return F.when(lat.between(-80, 84), F.substring(F.lit(UTM_LETTERS), (F.floor((lat + 80) / 8) + 1).cast("int"), F.lit(1)))


def utm(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; 10,000 km are added south of the equator."""
    e2, ep2 = _E2, _E2 / (1 - _E2)
    phi, central = F.radians(lat), utm_zone(lon) * 6 - 183
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi) * F.tan(phi)
    n, cc, a = _A / F.sqrt(1 - e2 * s * s), ep2 * c * c, c * F.radians(lon - central)
    arc = [1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072]
    m = _A * (arc[0] * phi - arc[1] * F.sin(2 * phi) + arc[2] * F.sin(4 * phi) - arc[3] * F.sin(6 * phi))
    a2 = a * a
    east = _K0 * n * (a + (1 - t + cc) * a2 * a / 6 + (5 - 18 * t + t * t + 72 * cc - 58 * ep2) * a2 * a2 * a / 120) + 500000.0
    north = _K0 * (m + n * F.tan(phi) * (a2 / 2 + (5 - t + 9 * cc + 4 * cc * cc) * a2 * a2 / 24 + (61 - 58 * t + t * t + 600 * cc - 330 * ep2) * a2 * a2 * a2 / 720))
    return east, F.when(lat < 0, north + 10000000.0).otherwise(north)


TWO_PI = 2 * math.pi
