"""Shapefiles: polygons and their attribute table, read through Spark's binary source, so from any file system."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW = "id long, rings array<array<struct<x:double,y:double>>>"
#: Shape types that are polygons, flat, with heights and with measures.
POLYGONS = (5, 15, 25)


def shapes(data: bytes) -> Iterator[list[list[tuple[float, float]]]]:
    """The rings of every record, without closing points; none for a record that is no polygon."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body, at = at + 8, at + 8 + 2 * words
        (kind,) = struct.unpack_from("<i", data, body)
        rings = []
        if kind in POLYGONS:
            parts, points = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), points]
            values = struct.unpack_from(f"<{2 * points}d", data, body + 44 + 4 * parts)
            for a, b in zip(starts, starts[1:], strict=False):
                ring = [(values[2 * i], values[2 * i + 1]) for i in range(a, b)]
                rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
        yield rings


def attributes(data: bytes, encoding: str) -> Iterator[dict[str, str]]:
    """The records of an attribute table as text; blanks are left out. A deleted record stays, as it has a shape."""
    count, header, size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < header - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    for i in range(count):
        at, row = header + i * size + 1, {}
        for name, width in fields:
            value = data[at : at + width].decode(encoding, errors="replace").strip().strip("\0")
            at += width
            if value:
                row[name] = value
        yield row


def read_shapefile(spark: SparkSession, path: str, encoding: str = "cp932") -> DataFrame:
    """``id`` (the record's number from 0), ``rings`` and ``attributes`` (a map of texts) of a ``.shp`` with its ``.dbf``.
    A file is one task, as its records have no index here."""

    def polygons(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                made = [[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in shapes(bytes(content))]
                yield pd.DataFrame({"id": range(len(made)), "rings": made})

    def records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                made = list(attributes(bytes(content), encoding))
                yield pd.DataFrame({"id": range(len(made)), "attributes": made})

    binary = lambda p: spark.read.format("binaryFile").load(p).select("content")
    left = binary(path).mapInPandas(polygons, ROW)
    right = binary(path.removesuffix(".shp") + ".dbf").mapInPandas(records, "id long, attributes map<string,string>")
    return left.join(right, "id", "left").select("id", "rings", F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"))
