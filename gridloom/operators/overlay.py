"""Intersection of polygons of any shape: not convex, with holes, of several parts.

A shape is an array of rings. A ring inside an odd number of larger ones is a hole, whatever its direction. The area
below an edge, down to a common base, is a trapezoid; a shape is the sum of its edges' trapezoids, counted as positive
or negative by the edge's direction. So the intersection of two shapes is the signed sum, over pairs of edges, of the
areas below both, which have a closed form: no clipping, and no case for touching or crossing edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = "array<array<struct<x:double,y:double>>>"
PAIRS = 1_000_000


def flat(shape: Column) -> list[Column]:
    """A shape as the x and the y of all points and the number of points of each ring."""
    take = lambda name: F.flatten(F.transform(shape, lambda r: F.transform(r, lambda p: p[name].cast("double"))))
    return [take("x"), take("y"), F.transform(shape, lambda r: F.coalesce(F.size(r), F.lit(0)))]


def crossings(edges: np.ndarray, x: float, y: float) -> int:
    """Edges that the ray to the right of a point crosses."""
    x0, y0, x1, y1 = edges.T
    spans = (y0 > y) != (y1 > y)
    e = edges[spans]
    return int((x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]).sum())


def ring_edges(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A ring's edges as rows x0, y0, x1, y1; a closing copy of the first point does no harm."""
    return np.c_[x, y, np.roll(x, -1), np.roll(y, -1)]


def signed_area(edges: np.ndarray) -> float:
    if not len(edges):
        return 0.0
    x, y = edges[:, [0, 2]] - edges[0, 0], edges[:, [1, 3]] - edges[0, 1]
    return float((x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]).sum() / 2)


def inner_point(edges: np.ndarray) -> tuple[float, float]:
    """A point inside a ring that has an area: half way along the first inner stretch of a line that meets no vertex."""
    levels = np.unique(edges[:, 1])
    gap = int(np.argmax(np.diff(levels)))
    y = (levels[gap] + levels[gap + 1]) / 2
    e = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    at = np.sort(e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]))
    return float((at[0] + at[1]) / 2), float(y)


def shape_edges(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The edges of a shape, outer rings counter-clockwise and holes clockwise; rings without an area count for nothing."""
    ends = np.cumsum(sizes)
    rings = [ring_edges(x[e - n : e], y[e - n : e]) for e, n in zip(ends, sizes, strict=True) if n >= 3]
    areas = [signed_area(r) for r in rings]
    keep = [i for i, a in enumerate(areas) if a]
    out = []
    for i in keep:
        holes = 0
        if len(keep) > 1:
            px, py = inner_point(rings[i])
            holes = sum(crossings(rings[j], px, py) % 2 for j in keep if (abs(areas[j]), j) > (abs(areas[i]), i))
        turn = (areas[i] > 0) == (holes % 2 == 0)
        out.append(rings[i] if turn else rings[i][:, [2, 3, 0, 1]])
    return np.concatenate(out) if out else np.zeros((0, 4))


def below_both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Signed areas below both edges of a pair, above y = 0."""
    low = np.maximum(np.minimum(a[:, 0], a[:, 2]), np.minimum(b[:, 0], b[:, 2]))
    high = np.minimum(np.maximum(a[:, 0], a[:, 2]), np.maximum(b[:, 0], b[:, 2]))
    own = high > low
    out, a, b, low, high = np.zeros(len(a)), a[own], b[own], low[own], high[own]

    def at(e: np.ndarray, x: np.ndarray) -> np.ndarray:
        return e[:, 1] + (x - e[:, 0]) * (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])

    d0, d1 = at(a, low) - at(b, low), at(a, high) - at(b, high)
    m0, m1 = np.minimum(at(a, low), at(b, low)), np.minimum(at(a, high), at(b, high))
    turn = d0 * d1 < 0
    t = np.divide(d0, d0 - d1, out=np.zeros(len(d0)), where=turn)
    middle = at(a, low + t * (high - low))
    height = np.where(turn, (m0 + middle) * t + (middle + m1) * (1 - t), m0 + m1) / 2
    out[own] = height * (high - low) * np.sign(a[:, 0] - a[:, 2]) * np.sign(b[:, 0] - b[:, 2])
    return out


def pair_blocks(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of two tables of edges, some at a time."""
    step = max(1, PAIRS // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        yield np.repeat(part, len(b), 0), np.tile(b, (len(part), 1))


def bounds(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection of two shapes, given by their edges."""
    if not len(a) or not len(b):
        return 0.0
    (a0, a1), (b0, b1) = bounds(a), bounds(b)
    low, high = np.maximum(a0.min(0), b0.min(0)), np.minimum(a1.max(0), b1.max(0))
    if (low >= high).any():
        return 0.0
    shift = np.r_[low, low]
    # Only edges above the common stretch of x count; what lies below the lower side adds the same on both sides of it.
    a, b = (e[(x0[:, 0] < high[0]) & (x1[:, 0] > low[0]) & (e[:, 0] != e[:, 2])] - shift for e, x0, x1 in ((a, a0, a1), (b, b0, b1)))
    base = min(a[:, [1, 3]].min(initial=0), b[:, [1, 3]].min(initial=0))
    a, b = a - [0, base, 0, base], b - [0, base, 0, base]
    return max(0.0, float(sum(below_both(x, y).sum() for x, y in pair_blocks(a, b))))


def edges_meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether an edge of one table has a point in common with one of the other."""
    if not len(a) or not len(b):
        return False
    (a0, a1), (b0, b1) = bounds(a), bounds(b)
    a = a[((a0 <= b1.max(0)) & (a1 >= b0.min(0))).all(1)]
    b = b[((b0 <= a1.max(0)) & (b1 >= a0.min(0))).all(1)]

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))

    for x, y in pair_blocks(a, b):
        (x0, x1), (y0, y1) = bounds(x), bounds(y)
        near = ((x0 <= y1) & (y0 <= x1)).all(1)
        p, q, r, s = x[near, :2], x[near, 2:], y[near, :2], y[near, 2:]
        if ((side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)).any():
            return True
    return False


def meet(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shapes have a point in common, a touch included: edges that meet, or one ring inside the other shape."""
    if not len(a) or not len(b):
        return False
    if edges_meet(a, b):
        return True
    # No edges meet, so a ring lies in the other shape with all of its points or with none.
    return any(crossings(b, *p) % 2 for p in starts(a)) or any(crossings(a, *p) % 2 for p in starts(b))


def starts(e: np.ndarray) -> np.ndarray:
    """A point of each run of joined edges."""
    return e[np.r_[True, (e[1:, :2] != e[:-1, 2:]).any(1)], :2]


def edge_list(shape: Column) -> Column:
    """The edges of a shape (:func:`shape_edges`) as one array of x0, y0, x1, y1: worked out once for a shape that meets many."""

    @F.pandas_udf("array<double>")
    def make(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        out: list = [None] * len(n)
        single = [i for i, k in enumerate(n) if k is not None and len(k) == 1 and k[0] >= 3]
        if single:  # single rings need no nesting and are turned together
            sizes = np.array([len(x.iloc[i]) for i in single])
            ends = np.cumsum(sizes)
            first = ends - sizes
            xs, ys = np.concatenate([x.iloc[i] for i in single]), np.concatenate([y.iloc[i] for i in single])
            after = np.arange(1, len(xs) + 1)
            after[ends - 1] = first
            edges = np.c_[xs, ys, xs[after], ys[after]]
            at = np.repeat(first, sizes)
            dx0, dy0, dx1, dy1 = xs - xs[at], ys - ys[at], xs[after] - xs[at], ys[after] - ys[at]
            areas = np.add.reduceat(dx0 * dy1 - dy0 * dx1, first)
            edges = np.where(np.repeat(areas < 0, sizes)[:, None], edges[:, [2, 3, 0, 1]], edges).ravel()
            for i, a, b, area in zip(single, first, ends, areas, strict=True):
                out[i] = edges[4 * a : 4 * b] if area else np.zeros(0)
        done = set(single)
        for i, row in enumerate(zip(x, y, n, strict=True)):
            if i not in done and not any(v is None for v in row):
                out[i] = shape_edges(*row).ravel()
        return pd.Series(out, dtype=object)

    return make(*flat(shape))


def pair_index(na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows with ``na`` and ``nb`` consecutive items, all pairs of a row's items: row, place of a, place of b."""
    total = na * nb
    row = np.repeat(np.arange(len(na)), total)
    k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    return row, (np.cumsum(na) - na)[row] + k // nb[row], (np.cumsum(nb) - nb)[row] + k % nb[row]


def many(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`overlap` and :func:`meet` of many pairs of shapes, none without edges, in the same steps."""
    rows = len(a)
    na, nb = np.array([len(e) for e in a]), np.array([len(e) for e in b])
    ra, rb = np.repeat(np.arange(rows), na), np.repeat(np.arange(rows), nb)
    a, b = np.concatenate(a), np.concatenate(b)
    (a0, a1), (b0, b1) = bounds(a), bounds(b)
    sides = lambda f, v, n: f.reduceat(v, np.cumsum(n) - n, axis=0)
    low = np.maximum(sides(np.minimum, a0, na), sides(np.minimum, b0, nb))
    high = np.minimum(sides(np.maximum, a1, na), sides(np.maximum, b1, nb))

    def above(e: np.ndarray, e0: np.ndarray, e1: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = (low < high).all(1)[r] & (e0[:, 0] < high[r, 0]) & (e1[:, 0] > low[r, 0]) & (e[:, 0] != e[:, 2])
        return e[own] - np.c_[low, low][r[own]], r[own]

    (p, rp), (q, rq) = above(a, a0, a1, ra), above(b, b0, b1, rb)
    base = np.zeros(rows)
    for e, r in ((p, rp), (q, rq)):
        np.minimum.at(base, r, e[:, [1, 3]].min(1, initial=0))
    p[:, [1, 3]] -= base[rp, None]
    q[:, [1, 3]] -= base[rq, None]
    row, i, j = pair_index(np.bincount(rp, minlength=rows), np.bincount(rq, minlength=rows))
    areas = np.maximum(np.bincount(row, below_both(p[i], q[j]), rows), 0)

    met = np.zeros(rows, bool)
    row, i, j = pair_index(na, nb)
    near = ((a0[i] <= b1[j]) & (b0[j] <= a1[i])).all(1)
    row, x, y = row[near], a[i[near]], b[j[near]]

    def side(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        return np.sign((q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0]))

    p, q, r, s = x[:, :2], x[:, 2:], y[:, :2], y[:, 2:]
    met[row[(side(p, q, r) * side(p, q, s) <= 0) & (side(r, s, p) * side(r, s, q) <= 0)]] = True
    # Where no edges meet, a ring lies in the other shape with all of its points or with none.
    open_ = ~met & (low <= high).all(1)
    for e, re, f, rf in ((a, ra, b, rb), (b, rb, a, ra)):
        first = np.r_[True, (re[1:] != re[:-1]) | (e[1:, :2] != e[:-1, 2:]).any(1)] & open_[re]
        points, own, f = e[first, :2], re[first], f[open_[rf]]
        row, i, j = pair_index(np.bincount(own, minlength=rows), np.bincount(rf[open_[rf]], minlength=rows))
        px, py, (x0, y0, x1, y1) = points[i, 0], points[i, 1], f[j].T
        spans = (y0 > py) != (y1 > py)
        i, px, py, x0, y0, x1, y1 = (v[spans] for v in (i, px, py, x0, y0, x1, y1))
        crossed = np.bincount(i[px < (x1 - x0) * (py - y0) / (y1 - y0) + x0], minlength=len(points))
        met[own[crossed % 2 == 1]] = True
    return areas, met


def measured(a: Column, b: Column) -> Column:
    """A struct of the ``area`` of two shapes' intersection and whether they have a point in common (``meets``), from their
    :func:`edge_list`. A batch's pairs are taken together, about ``PAIRS`` pairs of edges at a time; pairs of shapes with
    more than that are taken in blocks."""

    @F.pandas_udf("area double, meets boolean")
    def measure(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        area, meets = np.full(len(a), np.nan), np.full(len(a), None, object)
        some, work = [], 0

        def flush() -> None:
            if some:
                area[some], meets[some] = many([a.iloc[i].reshape(-1, 4) for i in some], [b.iloc[i].reshape(-1, 4) for i in some])
            some.clear()

        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is None or y is None:
                continue
            size = len(x) * len(y) // 16
            if not size:
                area[i], meets[i] = 0.0, False
            elif size > PAIRS:
                p, q = x.reshape(-1, 4), y.reshape(-1, 4)
                area[i], meets[i] = overlap(p, q), meet(p, q)
            else:
                if work + size > PAIRS:
                    flush()
                    work = 0
                some.append(i)
                work += size
        flush()
        known = np.array([m is not None for m in meets], bool)
        return pd.DataFrame({"area": pd.Series(area).where(known, None), "meets": pd.Series(meets, dtype="boolean")})

    return measure(a, b)


def overlay(a: Column, b: Column) -> Column:
    """:func:`measured` of two shapes."""
    return measured(edge_list(a), edge_list(b))


def shape_area(shape: Column) -> Column:
    """Area of a shape; holes are taken off."""

    @F.pandas_udf("double")
    def measure(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if any(v is None for v in row) else abs(signed_area(shape_edges(*row))) for row in zip(x, y, n, strict=True)], dtype="float64")

    return measure(*flat(shape))
