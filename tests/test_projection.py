"""Transverse Mercator against numerical integration, conformality and round trips."""

import math
import sqlite3

import numpy as np
import pytest

from gridloom.functions import projection
from gridloom.operators import spatial
from gridloom.sources import geopackage
from pyspark.sql import functions as F


def plane(spark, points, code):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in points], "lon double, lat double")
    x, y = projection.forward(F.col("lon"), F.col("lat"), projection.zone(code))
    return [tuple(r) for r in df.coalesce(1).select(x.alias("x"), y.alias("y")).collect()]


def meridian(z, a, b, steps=20_000):
    """Length of the meridian between two latitudes, by the midpoint rule."""
    e2 = z.flattening * (2 - z.flattening)
    at = np.radians(a + (b - a) * (np.arange(steps) + 0.5) / steps)
    return float((z.radius * (1 - e2) / (1 - e2 * np.sin(at) ** 2) ** 1.5).mean() * math.radians(b - a))


def test_northing_is_the_meridian_arc(spark):
    z = projection.zone(6675)
    found = plane(spark, [(z.longitude, lat) for lat in (20, 34.2, 36, 41.7, 45)], 6675)
    for (x, y), lat in zip(found, (20, 34.2, 36, 41.7, 45), strict=True):
        assert abs(x) < 1e-6 and y == pytest.approx(0.9999 * meridian(z, 36, lat), abs=5e-4)


@pytest.mark.parametrize("code", [6675, 6678, 32654, 32754])
def test_conformal_with_the_scale_of_the_ellipsoid(spark, code):
    """Small steps north and east are at right angles and are stretched alike; on the central meridian by the scale."""
    z, step = projection.zone(code), 1e-5
    e2 = z.flattening * (2 - z.flattening)
    for off in (0.0, 0.7, 2.5):
        lon, lat = z.longitude + off, 38.0
        (w, s), (e, t), (x0, y0), (x1, y1) = plane(spark, [(lon - step, lat), (lon + step, lat), (lon, lat - step), (lon, lat + step)], code)
        sine = math.sin(math.radians(lat))
        normal = z.radius / math.sqrt(1 - e2 * sine**2)
        east = np.array([e - w, t - s]) / (2 * math.radians(step) * normal * math.cos(math.radians(lat)))
        north = np.array([x1 - x0, y1 - y0]) / (2 * math.radians(step) * normal * (1 - e2) / (1 - e2 * sine**2))
        assert np.hypot(*east) == pytest.approx(np.hypot(*north), rel=1e-7) and abs(east @ north) < 1e-7
        if off == 0:
            assert np.hypot(*east) == pytest.approx(z.scale, rel=1e-8)


def test_round_trip_below_a_millimetre(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-200_000, 200_000, 500), rng.uniform(-300_000, 300_000, 500), strict=True)], "x double, y double")
    z = projection.zone(6675)
    lon, lat = projection.back(F.col("x"), F.col("y"), z)
    x, y = projection.forward(F.col("lon"), F.col("lat"), z)
    far = df.withColumns({"lon": lon, "lat": lat}).select((x - F.col("x")).alias("dx"), (y - F.col("y")).alias("dy")).agg(F.max(F.abs("dx")), F.max(F.abs("dy"))).first()
    assert max(far) < 1e-3


def test_zones():
    assert projection.zone(6675).longitude == pytest.approx(137 + 1 / 6) and len(projection.PLANE_ZONES) == 19
    assert projection.zone(32654).longitude == 141.0 and projection.zone(32754).northing == 1e7
    with pytest.raises(ValueError):
        projection.zone(3857)


def test_areas_in_metres_and_geopackage_in_degrees(spark, tmp_path):
    square = [{"x": x, "y": y} for x, y in ((1000.0, 2000.0), (1100.0, 2000.0), (1100.0, 2050.0), (1000.0, 2050.0))]
    df = spark.createDataFrame([(1, square)], "id long, ring array<struct<x:double,y:double>>")
    degrees = df.select("id", projection.to_degrees(F.col("ring"), 6675).alias("ring"))
    (row,) = degrees.select(spatial.area(projection.to_plane(F.col("ring"), 6675)).alias("a"), F.col("ring")[0]["x"].alias("lon")).collect()
    assert row.a == pytest.approx(5000.0, rel=1e-6) and 137 < row.lon < 138
    path = str(tmp_path / "out.gpkg")
    assert geopackage.write_layer(df, path, "units", srs=4326, source=6675) == 1
    with sqlite3.connect(path) as db:
        assert db.execute("SELECT srs_id FROM gpkg_geometry_columns").fetchone() == (4326,)
    from gridloom.sources import wkb

    geopackage.register(spark)
    got = spark.read.format("gpkg").option("table", "units").load(path).select(F.explode(wkb.rings_of(F.col("geom"))).alias("ring")).first().ring
    want = degrees.first().ring
    assert np.array([(p.x, p.y) for p in got]) == pytest.approx(np.array([(p.x, p.y) for p in want]))
