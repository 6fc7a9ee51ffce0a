"""Rings made valid, and unions put together from edges."""

import numpy as np
import pytest

from gridloom.operators import overlay, rings
from pyspark.sql import functions as F

RINGS = "array<struct<x:double,y:double>>"


def edges(*shape):
    return np.concatenate([overlay.ring_edges(*np.array(r, float).T) for r in shape])


def area(made):
    return sum(overlay.signed_area(overlay.ring_edges(*r.T)) for r in made)


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def test_known_rings():
    bow = rings.walked(rings.noded(edges([(0, 0), (2, 2), (2, 0), (0, 2)])))
    assert len(bow) == 2 and area(bow) == pytest.approx(2.0)
    spike = rings.walked(rings.noded(edges([(0, 0), (2, 0), (5, 0), (2, 0), (2, 2), (0, 2)])))
    assert [len(r) for r in spike] == [4] and area(spike) == pytest.approx(4.0)
    nested = rings.walked(rings.noded(edges(square(0, 0, 10), square(2, 2, 6), square(4, 4, 2))))
    assert sorted(overlay.signed_area(overlay.ring_edges(*r.T)) for r in nested) == pytest.approx([-36, 4, 100])
    overlapping = rings.walked(rings.noded(edges(square(0, 0, 4), square(2, 2, 4))))  # the common part is held twice
    assert area(overlapping) == pytest.approx(16 + 16 - 2 * 4)
    assert rings.walked(rings.noded(edges([(0, 0), (1, 1), (2, 2)]))) == [] and rings.walked(np.zeros((0, 4))) == []
    doubled = rings.walked(rings.noded(edges(square(0, 0, 4), square(0, 0, 4))))
    assert doubled == []


def test_random_rings_hold_the_odd_points():
    rng = np.random.default_rng(8)
    at = (np.arange(120) + 0.5) / 12
    x, y = map(np.ravel, np.meshgrid(at, at))
    for k in range(25):
        points = np.round(rng.uniform(0, 10, (rng.integers(4, 12), 2)), 0 if k % 2 else 3)
        e = overlay.ring_edges(*points.T)
        made = rings.walked(rings.noded(e))
        want = np.array([overlay.crossings(e, a, b) % 2 for a, b in zip(x, y, strict=True)])
        out = np.concatenate([overlay.ring_edges(*r.T) for r in made]) if made else np.zeros((0, 4))
        got = np.array([overlay.crossings(out, a, b) % 2 for a, b in zip(x, y, strict=True)])
        assert (got != want).mean() < 0.002  # points on an edge may fall to either side
        total = area(made)
        assert total == pytest.approx(want.mean() * 100, abs=1.6)
        assert area(rings.walked(rings.noded(out))) == pytest.approx(total)  # a valid shape stays as it is


def test_columns(spark):
    rows = [([[{"x": a, "y": b} for a, b in ((0.0, 0.0), (2.0, 2.0), (2.0, 0.0), (0.0, 2.0))]],), ([[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]],), (None,), ([],)]
    got = spark.createDataFrame(rows, f"s array<{RINGS}>").select(rings.valid_shape(F.col("s")).alias("v")).collect()
    assert [r.v is None or len(r.v) for r in got] == [2, True, True, True]


def tiles(spark, cells, size=1.0):
    rows = [(g, [{"x": x * size, "y": y * size} for x, y in square(*c)][:: (1 if k % 2 else -1)]) for k, (g, c) in enumerate(cells)]
    return spark.createDataFrame(rows, f"g string, ring {RINGS}")


def outline(made):
    return sorted((r.g, r.hole, round(abs(overlay.signed_area(overlay.ring_edges(*np.array([(p.x, p.y) for p in r.ring]).T))), 6), len(r.ring)) for r in made.collect())


def test_dissolved_frame_corner_and_parts(spark):
    frame = [("frame", (x, y, 1)) for x in range(3) for y in range(3) if (x, y) != (1, 1)]
    others = [("corner", (0, 0, 1)), ("corner", (1, 1, 1)), ("parts", (0, 0, 1)), ("parts", (5, 5, 1)), ("parts", (6, 5, 1))]
    got = outline(rings.dissolved(tiles(spark, frame + others), "g"))
    assert got == [("corner", False, 1.0, 4), ("corner", False, 1.0, 4), ("frame", False, 9.0, 12), ("frame", True, 1.0, 4), ("parts", False, 1.0, 4), ("parts", False, 2.0, 6)]
    shapes = rings.shapes(rings.dissolved(tiles(spark, frame), "g"), "g")
    assert shapes.select(overlay.shape_area(F.col("shape"))).first()[0] == pytest.approx(8.0)


def test_dissolved_with_vertices_on_edges(spark):
    """A large tile beside small ones: their vertices lie on its edge."""
    cells = [("a", (0, 0, 2)), ("a", (2, 0, 1)), ("a", (2, 1, 1)), ("a", (0, 2, 1))]
    got = outline(rings.dissolved(tiles(spark, cells), "g", size=1.5))
    assert [(g, hole, a) for g, hole, a, _ in got] == [("a", False, 7.0)]


def test_long_ring(spark):
    n = 300
    cells = [("row", (x, 0, 1)) for x in range(n)]
    assert outline(rings.dissolved(tiles(spark, cells), "g")) == [("row", False, float(n), 2 * n + 2)]


def test_copies_of_a_unit_go_to_layers_of_their_own(spark, tmp_path):
    """Two units in one place, a third beside them: the query agrees with its SQL, which counts areas of all and sides
    that one unit alone has."""
    import __spark_entry__
    import duckdb

    rows = [(0, 1), (10000, 1), (1, 1), (2, 2)]  # ids that are 10,000 apart lie in one place
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(1, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["pref"]: (r["length"], r["area"]) for r in __spark_entry__.queries()["dissolved_rings"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = db.sql(__spark_entry__.oracle_sql()["dissolved_rings"]).fetchall()
    assert found == {p: (length, area) for p, length, area in want} == {1: (30.0, 300.0), 2: (40.0, 100.0)}
