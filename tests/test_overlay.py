"""Intersections of polygons of any shape, against known values and grids of points."""

import numpy as np
import pytest

from gridloom.operators import overlay, spatial
from pyspark.sql import functions as F

SIDE = 400


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def star(rng, x, y, points=9):
    angles = np.sort(rng.uniform(0, 2 * np.pi, points))
    return [(x + r * np.cos(a), y + r * np.sin(a)) for a, r in zip(angles, rng.uniform(0.5, 4, points), strict=True)]


def edges(shape):
    flat = np.array([p for ring in shape for p in ring], float).reshape(-1, 2)
    return overlay.shape_edges(flat[:, 0], flat[:, 1], np.array([len(r) for r in shape]))


def marks(shape, low, high):
    """Which points of a grid lie in a shape: those that an odd number of its rings holds."""
    at = low + (np.arange(SIDE) + 0.5) * (high - low) / SIDE
    x, y = np.meshgrid(at, at)
    hit = np.zeros(x.shape, bool)
    for ring in shape:
        for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
            if y0 != y1:
                hit ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return hit


L = [[(0, 0), (8, 0), (8, 2), (2, 2), (2, 8), (0, 8)]]
FRAME = [square(0, 0, 10), square(3, 3, 4)]


def test_known_areas():
    area = lambda a, b: overlay.overlap(edges(a), edges(b))
    assert area(L, [square(-5, -5, 50)]) == pytest.approx(28.0)  # an L in a square that holds it
    assert area(L, [square(0.25, 5, 0.5)]) == pytest.approx(0.25)  # a building in its arm
    assert area(L, [square(4, 4, 1)]) == 0.0
    assert area(FRAME, [square(4, 4, 1)]) == pytest.approx(0.0, abs=1e-12)  # in the hole
    assert area(FRAME, [square(2, 2, 4)]) == pytest.approx(16 - 9)
    assert area([square(0, 0, 2), square(5, 0, 2)], [square(1, 0, 5)]) == pytest.approx(4.0)  # two parts
    assert area([square(0, 0, 2)], [square(2, 0, 2)]) == 0.0  # a touch
    assert area(L, L) == pytest.approx(28.0) and area(FRAME, FRAME) == pytest.approx(84.0)


def test_far_from_the_origin():
    far = [[(x + 4e6, y + 5e6) for x, y in ring] for ring in FRAME]
    assert overlay.overlap(edges(far), edges([square(4e6 + 2, 5e6 + 2, 4)])) == pytest.approx(7.0, rel=1e-7)


def test_directions_and_order_of_rings_do_not_matter():
    island = [square(0, 0, 10), square(2, 2, 6), square(4, 4, 2)]  # an island in a hole
    for shape in (island, island[::-1], [r[::-1] for r in island], [island[1], island[0][::-1], island[2]]):
        assert abs(overlay.signed_area(edges(shape))) == pytest.approx(100 - 36 + 4)
        assert overlay.overlap(edges(shape), edges([square(5, 5, 9)])) == pytest.approx(1 + 25 - 9)


def test_random_stars_against_a_grid():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = [star(rng, 5, 5)], [star(rng, *rng.uniform(2, 8, 2))]
        if rng.random() < 0.5:
            a = [square(-1, -1, 12), a[0]]  # a star as a hole
        cell = (14 / SIDE) ** 2
        want = (marks(a, -2, 12) & marks(b, -2, 12)).sum() * cell
        assert overlay.overlap(edges(a), edges(b)) == pytest.approx(want, abs=0.12)
        assert overlay.meet(edges(a), edges(b)) or want == 0


def test_meet():
    meet = lambda a, b: overlay.meet(edges(a), edges(b))
    assert meet(L, [square(0.25, 5, 0.5)]) and meet([square(0.25, 5, 0.5)], L)  # one inside the other
    assert not meet(L, [square(4, 4, 1)]) and not meet(FRAME, [square(4, 4, 1)])
    assert meet([square(0, 0, 2)], [square(2, 2, 2)]) and meet(FRAME, [square(3, 3, 1)])  # a corner, a hole's corner
    assert not meet([square(0, 0, 1), square(9, 9, 1)], [square(4, 4, 1)])


def test_odd_shapes():
    assert len(edges([[(0, 0), (1, 1)]])) == 0 and len(edges([])) == 0 and len(edges([[(0, 0), (1, 1), (2, 2)]])) == 0
    assert overlay.overlap(edges([]), edges(L)) == 0.0 and not overlay.meet(edges([]), edges(L))


def test_columns_and_units(spark):
    as_rows = lambda shape: [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in shape]
    units = spark.createDataFrame([("l", as_rows(L)), ("f", as_rows(FRAME)), ("far", as_rows([square(50, 50, 2)])), ("none", None)], f"unit string, ring {overlay.SHAPE}")
    houses = spark.createDataFrame([(1, as_rows([square(0.25, 5, 0.5)])[0]), (2, as_rows([square(4, 4, 1)])[0]), (3, as_rows([square(8, 0, 1)])[0])], "id long, ring array<struct<x:double,y:double>>")
    got = {r.unit: (r.building_count, round(r.built_area, 9), round(r.built_ratio, 9)) for r in spatial.covered(units, houses, "unit", 4.0).collect()}
    assert got == {"l": (2, 0.25, round(0.25 / 28, 9)), "f": (2, 1.25, round(1.25 / 84, 9)), "far": (0, 0.0, 0.0), "none": (0, 0.0, 0.0)}
    pair = houses.where("id = 1").select(F.col("ring").alias("a")).crossJoin(houses.where("id = 2").select(F.col("ring").alias("b")))
    assert pair.select(spatial.clipped_area(F.col("a"), F.col("b"))).first()[0] == 0.0


def rings_frame(spark, rows, name):
    ring = "array<struct<x:double,y:double>>"
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in r] if r else None) for i, r in rows], f"{name} long, ring {ring}")


def test_many_pairs_agree_with_one_by_one():
    rng = np.random.default_rng(3)
    a = [edges([star(rng, *rng.uniform(0, 9, 2))] + ([square(20, 20, 2)] if i % 3 == 0 else [])) for i in range(60)]
    b = [edges(FRAME if i % 4 == 0 else [star(rng, *rng.uniform(0, 9, 2))]) for i in range(60)]
    areas, met = overlay.many(a, b)
    assert areas == pytest.approx([overlay.overlap(x, y) for x, y in zip(a, b, strict=True)], abs=1e-9)
    assert met.tolist() == [overlay.meet(x, y) for x, y in zip(a, b, strict=True)]


def test_units_of_one_shape_are_measured_once(spark, monkeypatch):
    seen = []
    real = spatial.box_join
    monkeypatch.setattr(spatial, "box_join", lambda a, b, *rest: (seen.append(b.count()), real(a, b, *rest))[1])
    units = rings_frame(spark, [(i, square(i % 2 * 10, 0, 10)) for i in range(40)] + [(40, None)], "unit")
    buildings = rings_frame(spark, [(i, square(i, 1, 1)) for i in range(20)] + [(20, None)], "id")
    out = {r["unit"]: (r["building_count"], r["built_area"]) for r in spatial.covered(units, buildings, "unit", 10.0).collect()}
    assert seen == [2] and len(out) == 41
    assert out[0] == (11, 10.0) and out[38] == out[0] and out[1] == (11, 10.0) and out[40] == (0, 0.0)


def test_full_cells_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "MEETING", 4)
    a = rings_frame(spark, [(i, square(0.1 * i, 0, 3)) for i in range(30)], "id").withColumnRenamed("ring", "ra")
    b = rings_frame(spark, [(i, square(2.5, 0.2 * i, 1)) for i in range(20)], "unit").withColumnRenamed("ring", "rb")
    met = spatial.box_join(a, b, "ra", "rb", 2.0)
    found = sorted((r["id"], r["unit"]) for r in met.select("id", "unit").collect())
    assert found == sorted((i, j) for i in range(30) for j in range(20) if 0.1 * i <= 3.5 and 0.1 * i + 3 >= 2.5 and 0.2 * j <= 3)
