"""Rings made valid, and rings put together from the edges of many.

:func:`valid_shape` cuts a shape's edges where they meet, drops what is covered an even number of times, and walks the
rest: the result has the points that an odd number of the input's rings hold. :func:`dissolved` does the walk over the
cluster: edges of a group cancel by a count, each end finds its next edge by a join on vertices, and rings are found by
doubling steps, so no task holds a group's edges; only finished rings are gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.lineage import cut, remove, scratch
from gridloom.operators.overlay import PAIRS, SHAPE, crossings, flat, ring_edges

DIGITS = 9


def meeting_places(e: np.ndarray) -> list[np.ndarray]:
    """For every edge, the places (0 to 1 along it) where another edge crosses, touches or overlaps it."""
    p, d = e[:, :2], e[:, 2:] - e[:, :2]
    out: list[list[np.ndarray]] = [[] for _ in e]
    low, high = np.minimum(p, e[:, 2:]), np.maximum(p, e[:, 2:])
    step = max(1, PAIRS // max(1, len(e)))
    for at in range(0, len(e), step):
        own = np.arange(at, min(at + step, len(e)))
        near = ((low[own, None] <= high[None] + 1e-12) & (high[own, None] >= low[None] - 1e-12)).all(2)
        i, j = np.nonzero(near)
        i = own[i]
        i, j = i[i != j], j[i != j]
        det = d[i, 0] * d[j, 1] - d[i, 1] * d[j, 0]
        gap = p[j] - p[i]
        size = np.hypot(*d[i].T) * np.hypot(*d[j].T)
        cross = np.abs(det) > 1e-12 * size
        s = np.divide(gap[:, 0] * d[j, 1] - gap[:, 1] * d[j, 0], det, out=np.full(len(i), -1.0), where=cross)
        t = np.divide(gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0], det, out=np.full(len(i), -1.0), where=cross)
        hit = cross & (s > -1e-9) & (s < 1 + 1e-9) & (t > -1e-9) & (t < 1 + 1e-9)
        for k in np.flatnonzero(hit):
            out[i[k]].append(s[k : k + 1])
        along = ~cross & (np.abs(gap[:, 0] * d[i, 1] - gap[:, 1] * d[i, 0]) <= 1e-9 * (d[i] ** 2).sum(1))
        for k in np.flatnonzero(along):  # on one line: the ends of the other edge
            ends = np.stack([p[j[k]], e[j[k], 2:]]) - p[i[k]]
            out[i[k]].append((ends @ d[i[k]]) / (d[i[k]] @ d[i[k]]))
    return [np.concatenate([*v, np.zeros(0)]) for v in out]


def noded(e: np.ndarray) -> np.ndarray:
    """The edges cut at all places where they meet; what lies twice in one place is gone, what lies there three times
    is there once."""
    e = e[(e[:, :2] != e[:, 2:]).any(1)]
    parts = []
    for edge, places in zip(e, meeting_places(e), strict=True):
        t = np.unique(np.r_[0.0, places[(places > 0) & (places < 1)], 1.0])
        points = np.round(edge[:2] + t[:, None] * (edge[2:] - edge[:2]), DIGITS)
        parts.append(np.c_[points[:-1], points[1:]])
    cut_ = np.concatenate(parts) if parts else e
    turned = (cut_[:, 0] > cut_[:, 2]) | ((cut_[:, 0] == cut_[:, 2]) & (cut_[:, 1] > cut_[:, 3]))
    cut_ = np.where(turned[:, None], cut_[:, [2, 3, 0, 1]], cut_)
    cut_ = cut_[(cut_[:, :2] != cut_[:, 2:]).any(1)]
    kept, times = np.unique(cut_, axis=0, return_counts=True)
    return kept[times % 2 == 1]


def walked(e: np.ndarray) -> list[np.ndarray]:
    """The rings of noded edges, each with the inside on its left: outer rings counter-clockwise, holes clockwise."""
    if not len(e):
        return []
    middle, d = (e[:, :2] + e[:, 2:]) / 2, e[:, 2:] - e[:, :2]
    inside = np.array([_left_inside(e, m, v) for m, v in zip(middle, d, strict=True)])
    e = np.where(inside[:, None], e, e[:, [2, 3, 0, 1]])
    leaving: dict[tuple, list[int]] = {}
    for k, edge in enumerate(e):
        leaving.setdefault(tuple(edge[:2]), []).append(k)
    turn = np.arctan2(e[:, 3] - e[:, 1], e[:, 2] - e[:, 0])
    free, rings = set(range(len(e))), []
    while free:
        at = first = min(free)
        ring = []
        while at in free:
            free.discard(at)
            ring.append(e[at, :2])
            back = turn[at] + np.pi
            choice = [k for k in leaving.get(tuple(e[at, 2:]), []) if k in free or k == first]
            if not choice:
                break
            at = min(choice, key=lambda k: (back - turn[k] - 1e-9) % (2 * np.pi))
        if len(ring) >= 3:
            rings.append(np.array(ring))
    return rings


def _left_inside(e: np.ndarray, middle: np.ndarray, d: np.ndarray) -> bool:
    """Whether the left side of an edge is inside: of the edges that a ray to its left crosses, the edge itself not
    among them, an odd number."""
    # A ray along an axis that the edge does not follow; coordinates are turned so that it runs to the right.
    if abs(d[1]) >= abs(d[0]):
        turned, point, left_is_right = e, middle, d[1] < 0
    else:
        turned, point, left_is_right = e[:, [1, 0, 3, 2]], middle[::-1], d[0] > 0
    beyond = crossings(turned, point[0] + 1e-9 * max(1.0, abs(point[0])), point[1])
    return (beyond % 2 == 1) == left_is_right


def valid_shape(shape: Column) -> Column:
    """A shape whose rings do not cross: the points that an odd number of the given rings hold. Crossings are cut,
    spikes and doubled edges are dropped, nested rings become holes; null where no area is left."""

    @F.pandas_udf(SHAPE)
    def make(x: pd.Series, y: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for row in zip(x, y, n, strict=True):
            if any(v is None for v in row):
                out.append(None)
                continue
            ends = np.cumsum(row[2])
            every = [ring_edges(row[0][b - k : b], row[1][b - k : b]) for b, k in zip(ends, row[2], strict=True) if k]
            rings = walked(noded(np.concatenate(every))) if every else []
            out.append([[{"x": a, "y": b} for a, b in ring.tolist()] for ring in rings] or None)
        return pd.Series(out)

    return make(*flat(shape))


def directed_edges(units: DataFrame, by: str) -> DataFrame:
    """``by, p, q``: the edges of rings turned counter-clockwise."""
    from gridloom.operators.spatial import edges_of

    signed = F.aggregate(edges_of(F.col("ring")), F.lit(0.0), lambda t, e: t + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    turned = units.withColumn("ring", F.when(signed < 0, F.reverse("ring")).otherwise(F.col("ring")))
    return turned.select(by, F.explode(edges_of(F.col("ring"))).alias("e")).select(by, "e.p", "e.q").where("p <> q")


def cut_at_vertices(edges: DataFrame, by: str, size: float) -> DataFrame:
    """Edges cut at the group's vertices that lie on them: an equi-join on grid cells of the given size, then the
    exact test."""
    low, high = lambda c: F.least(F.col(f"p.{c}"), F.col(f"q.{c}")), lambda c: F.greatest(F.col(f"p.{c}"), F.col(f"q.{c}"))
    at = lambda c: F.floor(c / size)
    numbered = cut(edges.withColumn("id", F.monotonically_increasing_id()))
    placed = numbered.withColumn("cx", F.explode(F.sequence(at(low("x")), at(high("x"))))).withColumn("cy", F.explode(F.sequence(at(low("y")), at(high("y")))))
    points = numbered.select(by, F.explode(F.array("p", "q")).alias("v")).distinct()
    points = points.select(by, "v", at(F.col("v.x")).alias("cx"), at(F.col("v.y")).alias("cy"))
    dx, dy = F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y")
    ux, uy = F.col("v.x") - F.col("p.x"), F.col("v.y") - F.col("p.y")
    length = dx * dx + dy * dy
    along = (ux * dx + uy * dy) / length
    on = (F.abs(ux * dy - uy * dx) <= 1e-9 * length) & (along > 1e-12) & (along < 1 - 1e-12)
    found = placed.join(points, [by, "cx", "cy"]).where(on).select("id", along.alias("t"), "v").groupBy("id").agg(F.array_sort(F.collect_set(F.struct("t", "v"))).alias("s"))
    whole = numbered.join(found, "id", "left")
    chain = F.concat(F.array("p"), F.coalesce(F.transform("s", lambda s: s["v"]), F.expr("CAST(array() AS array<struct<x:double,y:double>>)")), F.array("q"))
    pairs = whole.select(by, chain.alias("c")).select(by, F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: F.struct(a.alias("p"), b.alias("q")))).alias("e"))
    return pairs.select(by, "e.p", "e.q")


def boundary(edges: DataFrame, by: str) -> DataFrame:
    """``by, p, q`` of the edges that are not cancelled by one in the other direction."""
    forward = F.col("p") < F.col("q")
    net = edges.groupBy(by, F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum(F.when(forward, 1).otherwise(-1)).alias("net")).where("net <> 0")
    return net.select(by, F.when(F.col("net") > 0, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(F.col("net") > 0, F.col("b")).otherwise(F.col("a")).alias("q"))


def layers(units: DataFrame, by: str, unit: str) -> DataFrame:
    """``layer, ring``: a group's members with the same ring are dealt to layers, as a struct of the group and a number, so
    that members of a layer share no area where members only overlap as copies."""
    place = F.row_number().over(Window.partitionBy(by, "ring").orderBy(unit))
    return units.withColumn("__n", place).select(F.struct(F.col(by), F.col("__n").alias("n")).alias("layer"), "ring")


def dissolved(units: DataFrame, by: str, size: float | None = None) -> DataFrame:
    """Rings of each group's union: ``by, ring, hole``. Members may share edges and vertices but not areas (copies
    go to layers of their own, see :func:`layers`); with
    ``size`` (of a grid cell), edges are first cut at vertices of others that lie on them. Parts that touch in a
    point are rings of their own."""
    edges = directed_edges(units, by)
    if size:
        edges = cut_at_vertices(edges, by, size)
    numbered = cut(boundary(edges, by).withColumn("id", F.monotonically_increasing_id()))
    angle = lambda a, b: F.atan2(F.col(f"{b}.y") - F.col(f"{a}.y"), F.col(f"{b}.x") - F.col(f"{a}.x"))
    after = numbered.select(by, F.col("p").alias("q"), F.col("id").alias("next"), angle("p", "q").alias("leave"))
    clockwise = F.pmod(angle("p", "q") + np.pi - F.col("leave") - 1e-9, F.lit(2 * np.pi))
    ways = numbered.select(by, "id", "p", "q").join(after, [by, "q"]).withColumn("turn", clockwise)
    steps = ways.groupBy("id").agg(F.min_by("next", "turn").alias("next"))
    heads = _doubled(steps.select("id", "next", F.col("id").alias("value")), lambda own, other: F.least(own, other))
    # The steps from an edge to the head of its ring; the head itself stays where it is.
    chain = heads.select("id", F.col("value").alias("head")).join(steps, "id")
    start = chain.select("id", F.when(F.col("id") == F.col("head"), F.col("id")).otherwise(F.col("next")).alias("next"), (F.col("id") != F.col("head")).cast("long").alias("value"))
    far = _doubled(start, lambda own, other: own + other)
    placed = numbered.join(far.select("id", F.col("value").alias("far")), "id").join(chain.select("id", "head"), "id")
    rings = placed.groupBy(by, "head").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("far")).alias("k"), "p"))), lambda s: s["p"]).alias("ring"))
    from gridloom.operators.spatial import edges_of

    signed = F.aggregate(edges_of(F.col("ring")), F.lit(0.0), lambda t, e: t + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"])
    return rings.select(by, "ring", (signed < 0).alias("hole"))


def _doubled(rows: DataFrame, merge) -> DataFrame:
    """``id, next, value`` with values merged along the way: every round doubles the way that a row has seen, until no
    value changes."""
    spark = rows.sparkSession
    path = scratch(spark, "doubled")  # tables, not checkpoints: the planner's size of a checkpoint grows with each join
    rows.write.parquet(path)
    while True:
        rows, old, path = spark.read.parquet(path), path, scratch(spark, "doubled")
        ahead = rows.select(F.col("id").alias("next"), F.col("next").alias("beyond"), F.col("value").alias("other"))
        made = rows.join(ahead, "next").select("id", F.col("beyond").alias("next"), merge(F.col("value"), F.col("other")).alias("value"), F.col("value").alias("before"))
        made.write.parquet(path)
        remove(spark, old)
        made = spark.read.parquet(path)
        if made.where("value <> before").isEmpty():
            return made.drop("before")


def shapes(rings: DataFrame, by: str) -> DataFrame:
    """``by, shape``: the rings of a group as one shape, outer rings before holes."""
    return rings.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("hole", "ring"))), lambda s: s["ring"]).alias("shape"))
