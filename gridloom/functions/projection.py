"""Transverse Mercator, forward and back, as column expressions (series of Krueger to the fifth power of n).

A zone is a row of numbers, so further zones are data. Angles are degrees, lengths metres. In the plane, ``x`` is the
easting and ``y`` the northing, as in rings.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Zone:
    """Origin, scale on the central meridian, false easting and northing, and the ellipsoid."""

    latitude: float
    longitude: float
    scale: float
    easting: float = 0.0
    northing: float = 0.0
    radius: float = 6378137.0
    flattening: float = 1 / 298.257222101


#: Origins of the Japanese plane rectangular zones 1 to 19, as (latitude, longitude in degrees and minutes).
PLANE_ORIGINS = [
    (33, 129, 30), (33, 131, 0), (36, 132, 10), (33, 133, 30), (36, 134, 20), (36, 136, 0), (36, 137, 10),
    (36, 138, 30), (36, 139, 50), (40, 140, 50), (44, 140, 15), (44, 142, 15), (44, 144, 15), (26, 142, 0),
    (26, 127, 30), (26, 124, 0), (26, 131, 0), (20, 136, 0), (26, 154, 0),
]
PLANE_ZONES = {6668 + i: Zone(lat, lon + minutes / 60, 0.9999) for i, (lat, lon, minutes) in enumerate(PLANE_ORIGINS, 1)}
WGS84 = 1 / 298.257223563


def zone(code: int) -> Zone:
    """The zone of an EPSG code: plane rectangular (6669 to 6687) or UTM (32601 to 32660 north, 32701 to 32760 south)."""
    if code in PLANE_ZONES:
        return PLANE_ZONES[code]
    south, number = divmod(code - 32600, 100)
    if south not in (0, 1) or not 1 <= number <= 60:
        raise ValueError(f"no zone with the code {code}")
    return Zone(0.0, 6.0 * number - 183, 0.9996, 500_000.0, 10_000_000.0 * south, flattening=WGS84)


def series(n: float) -> dict[str, list[float]]:
    """Coefficients of the series: ``a`` forward, ``b`` back, ``d`` from conformal to geographic latitude."""
    # The published coefficients by powers of n, the first of each row that of n ** (its place).
    rows = {
        "a": [[1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288], [13 / 48, -3 / 5, 557 / 1440, 281 / 630], [61 / 240, -103 / 140, 15061 / 26880], [49561 / 161280, -179 / 168], [34729 / 80640]],
        "b": [[1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512], [1 / 48, 1 / 15, -437 / 1440, 46 / 105], [17 / 480, -37 / 840, -209 / 4480], [4397 / 161280, -11 / 504], [4583 / 161280]],
        "d": [[2, -2 / 3, -2, 116 / 45, 26 / 45], [7 / 3, -8 / 5, -227 / 45, 2704 / 315], [56 / 15, -136 / 35, -1262 / 105], [4279 / 630, -332 / 35], [4174 / 315]],
    }
    return {k: [sum(c * n ** (j + i) for i, c in enumerate(row)) for j, row in enumerate(table, 1)] for k, table in rows.items()}


def _constants(z: Zone) -> tuple[dict[str, list[float]], float, float, float]:
    """Series, excentricity, scaled radius of the rectifying sphere, and the northing of the origin's latitude."""
    n = z.flattening / (2 - z.flattening)
    coefficients = series(n)
    e = 2 * math.sqrt(n) / (1 + n)
    sphere = z.scale * z.radius / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    sine = math.sin(math.radians(z.latitude))
    conformal = math.atan(math.sinh(math.atanh(sine) - e * math.atanh(e * sine)))
    arc = conformal + sum(a * math.sin(2 * j * conformal) for j, a in enumerate(coefficients["a"], 1))
    return coefficients, e, sphere, sphere * arc


def forward(longitude: Column, latitude: Column, z: Zone) -> tuple[Column, Column]:
    """Plane x and y of geographic coordinates."""
    coefficients, e, sphere, origin = _constants(z)
    sine, turn = F.sin(F.radians(latitude)), F.radians(longitude - z.longitude)
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(coefficients["a"], 1):
        north += a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east += a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return sphere * east + z.easting, sphere * north - origin + z.northing


def back(x: Column, y: Column, z: Zone) -> tuple[Column, Column]:
    """Longitude and latitude of plane coordinates."""
    coefficients, _, sphere, origin = _constants(z)
    xi, eta = (y - z.northing + origin) / sphere, (x - z.easting) / sphere
    north, east = xi, eta
    for j, b in enumerate(coefficients["b"], 1):
        north -= b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east -= b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.asin(F.sin(north) / F.cosh(east))
    latitude = conformal
    for j, d in enumerate(coefficients["d"], 1):
        latitude += d * F.sin(2 * j * conformal)
    return F.degrees(F.atan2(F.sinh(east), F.cos(north))) + z.longitude, F.degrees(latitude)


def _points(ring: Column, change, z: Zone) -> Column:
    def point(p: Column) -> Column:
        x, y = change(p["x"], p["y"], z)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


def to_plane(ring: Column, code: int) -> Column:
    """A ring of degrees in the plane of a zone, so that areas are square metres."""
    return _points(ring, forward, zone(code))


def to_degrees(ring: Column, code: int) -> Column:
    """A ring of a zone's plane in degrees."""
    return _points(ring, back, zone(code))


def reproject(ring: Column, source: int, target: int) -> Column:
    """A ring from one coordinate system to another; 4326 and 6668 are degrees."""
    degrees = {4326, 6668}
    made = ring if source in degrees else to_degrees(ring, source)
    return made if target in degrees else to_plane(made, target)


def shapes(shape: Column, source: int, target: int) -> Column:
    """:func:`reproject` for arrays of rings."""
    return F.transform(shape, lambda r: reproject(r, source, target))
