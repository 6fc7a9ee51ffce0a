"""Well-known binary geometry: the outer rings of polygons, as arrays of points."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

RINGS = "array<array<struct<x:double,y:double>>>"
#: Sizes in bytes of a GeoPackage header's envelope by its indicator.
ENVELOPES = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}
POLYGON, MULTIPOLYGON = 3, 6


def body_of(blob: bytes) -> bytes:
    """The well-known binary part of a GeoPackage blob; other blobs are returned as they are."""
    if blob[:2] != b"GP":
        return blob
    return blob[8 + ENVELOPES[blob[3] >> 1 & 7] :]


def outer_rings(blob: bytes | None) -> list[list[tuple[float, float]]]:
    """Outer rings of a polygon or multipolygon, without their closing points; other geometries have none."""
    if not blob:
        return []
    data, found = body_of(bytes(blob)), []

    def polygon(at: int, order: str, width: int, keep: bool) -> int:
        (rings,) = struct.unpack_from(order + "I", data, at)
        at += 4
        for ring in range(rings):
            (n,) = struct.unpack_from(order + "I", data, at)
            values = struct.unpack_from(f"{order}{n * width}d", data, at + 4)
            at += 4 + 8 * n * width
            points = [(values[i], values[i + 1]) for i in range(0, n * width, width)]
            if ring == 0 and keep:
                found.append(points[:-1] if len(points) > 1 and points[0] == points[-1] else points)
        return at

    def geometry(at: int) -> int:
        order = "<" if data[at] else ">"
        (kind,) = struct.unpack_from(order + "I", data, at + 1)
        at += 9 if kind & 0x20000000 else 5
        width = 2 + (kind & 0x80000000 > 0) + (kind & 0x40000000 > 0)
        kind &= 0x0FFFFFFF
        width, kind = width + (0, 1, 1, 2)[kind // 1000], kind % 1000
        if kind == POLYGON:
            return polygon(at, order, width, True)
        if kind == MULTIPOLYGON:
            (n,) = struct.unpack_from(order + "I", data, at)
            at += 4
            for _ in range(n):
                at = geometry(at)
        return at

    geometry(0)
    return found


def rings_of(blob: Column) -> Column:
    """Outer rings of a column of geometries."""

    @F.pandas_udf(RINGS)
    def decode(values: pd.Series) -> pd.Series:
        return pd.Series([[[{"x": x, "y": y} for x, y in ring] for ring in outer_rings(v)] for v in values])

    return decode(blob)


def polygon(ring: list[tuple[float, float]]) -> bytes:
    """A ring as well-known binary, closed and little-endian."""
    if not ring:
        return struct.pack("<BII", 1, POLYGON, 0)
    points = ring if ring[0] == ring[-1] else [*ring, ring[0]]
    return struct.pack("<BIII", 1, POLYGON, 1, len(points)) + b"".join(struct.pack("<dd", x, y) for x, y in points)


def geopackage_blob(ring: list[tuple[float, float]], srs: int = 4326) -> bytes:
    """A GeoPackage geometry without an envelope."""
    return b"GP" + struct.pack("<BBi", 0, 1, srs) + polygon(ring)
