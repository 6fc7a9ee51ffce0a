"""Spatial models from edges, against dense matrices."""

import math

import numpy as np
import pytest

from gridloom.operators import autoregression, spatial
from pyspark.sql import functions as F


def grid(spark, rows, cols):
    """Queen contiguity of a grid, row-standardised, and its dense matrix."""
    at = {(r, c): r * cols + c for r in range(rows) for c in range(cols)}
    w = np.zeros((rows * cols,) * 2)
    for (r, c), i in at.items():
        near = [at[r + a, c + b] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (r + a, c + b) in at]
        w[i, near] = 1 / len(near)
    src, dst = np.nonzero(w)
    edges = spark.createDataFrame([(int(i), int(j), float(w[i, j])) for i, j in zip(src, dst, strict=True)], "src long, dst long, w double")
    return edges, w


def test_log_determinant_of_two_thousand_units(spark):
    edges, w = grid(spark, 40, 50)
    rows = spark.range(2000).select(F.col("id").alias("u"))
    found = autoregression.traces(rows, edges.cache(), powers=30, probes=24)
    power = np.eye(2000)
    for k in range(autoregression.EXACT):
        power = power @ w
        assert found[k] == pytest.approx(np.trace(power), abs=1e-8)
    eigenvalues = np.linalg.eigvals(w)
    for p in (-0.8, -0.3, 0.2, 0.5, 0.8):
        want = np.log(np.abs(1 - p * eigenvalues)).sum()
        assert autoregression.log_determinant(p, found) == pytest.approx(want, abs=1e-3 * 2000)  # per unit
        assert autoregression.log_determinant(p, found) == pytest.approx(want, rel=0.02)


def test_models_equal_the_dense_ones(spark):
    edges, w = grid(spark, 16, 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=256)
    y = np.linalg.solve(np.eye(256) - 0.5 * w, 1 + 2 * x + rng.normal(size=256))
    values = spark.createDataFrame([(i, float(y[i]), float(x[i])) for i in range(256)] + [(999, None, 1.0)], "unit long, y double, x double")
    dense, sparse = spatial.spatial_models(values, edges, "unit", "y", ["x"]), autoregression.models(values, edges, "unit", "y", ["x"], powers=30, probes=48)
    a, b = ({r.model: r for r in d["models"].collect()} for d in (dense, sparse))
    for name in ("ols", "lag", "error"):
        assert b[name].parameter == pytest.approx(a[name].parameter, abs=0.02)
        assert b[name].log_likelihood == pytest.approx(a[name].log_likelihood, abs=0.3)
        assert b[name].pseudo_r2 == pytest.approx(a[name].pseudo_r2, abs=0.02) and b[name].best == a[name].best
    ca, cb = ({(r.model, r.name): r.coef for r in d["coefficients"].collect()} for d in (dense, sparse))
    assert {k: round(v, 1) for k, v in ca.items()}.keys() == cb.keys() and all(abs(ca[k] - cb[k]) < 0.1 for k in ca)
    ta, tb = ({r.test: r.statistic for r in d["tests"].collect()} for d in (dense, sparse))
    assert tb == pytest.approx(ta, rel=1e-6)
    assert math.isfinite(b["lag"].aic)


def test_larger_tables_get_the_models_from_edges(spark):
    from gridloom.operators import spatial
    from pyspark.sql import functions as F

    ids = spark.range(36).select("id", F.floor(F.col("id") / 6).alias("r"), (F.col("id") % 6).alias("c"))
    edges = spatial.queen_edges(ids.select("id", spatial.rectangle(F.col("c"), F.col("r"), F.col("c") + 1, F.col("r") + 1).alias("ring")), "id")
    values = ids.select("id", ((F.col("r") * 7 + F.col("c") * 3) % 11 + F.col("r")).cast("double").alias("y"), (F.col("id") * 13 % 17).cast("double").alias("x"))
    wide = spatial.models_of_any_size(values, edges, "id", "y", ["x"], bound=10)
    near = spatial.spatial_models(values, edges, "id", "y", ["x"])
    for table, key, value in (("models", ["model"], "log_likelihood"), ("coefficients", ["model", "name"], "coef"), ("tests", ["test"], "statistic")):
        a, b = ({tuple(r[k] for k in key): r[value] for r in t[table].collect()} for t in (wide, near))
        assert a.keys() == b.keys()
        assert max(abs(a[k] - b[k]) / (1 + abs(b[k])) for k in a) < 0.1


def test_traces_of_units_in_the_same_place(spark):
    places = [(r, c) for r in range(3) for c in range(4) for _ in range(1 + (r + 2 * c) % 3)]
    a = np.array([[i != j and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1 for j, q in enumerate(places)] for i, p in enumerate(places)], float)
    w = a / a.sum(1, keepdims=True)
    table = lambda m: spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m), strict=True)], "src long, dst long, w double").cache()
    classes, more = autoregression.twins(table(w))
    assert classes.select("src").distinct().count() == 12 and sum(n for _, n in more) == len(places) - 12
    uneven, oneway = w.copy(), w.copy()
    uneven[0, np.flatnonzero(w[0])[0]] *= 2
    oneway[0, np.flatnonzero(w[0])[-1]] = 0
    for m in (w, uneven, oneway):
        want = [np.trace(np.linalg.matrix_power(m, k)) for k in range(1, autoregression.EXACT + 1)]
        assert autoregression.exact_traces(table(m)) == pytest.approx(want, abs=1e-9)
    for m in (uneven, oneway):
        assert autoregression.twins(table(m))[1] == []


def test_vertices_are_dealt_by_the_pairs_they_make(spark, monkeypatch):
    units = spark.range(40).select(F.col("id").alias("u"), spatial.rectangle(F.lit(0.0), F.col("id") % 4, F.lit(1.0), F.col("id") % 4 + 1).alias("ring"))
    plain = {tuple(r) for r in spatial.queen_edges(units, "u").collect()}
    monkeypatch.setattr(spatial, "PAIRS_PER_TASK", 100)
    dealt = spatial.queen_edges(units, "u")
    assert {tuple(r) for r in dealt.collect()} == plain and len(plain) == 2 * 10 * 19 + 2 * 10 * 29
    # 4 vertices of 10 units and 6 of 20: 2,800 pairs
    assert "hashpartitioning(p" in dealt._jdf.queryExecution().toString() and ", 28)" in dealt._jdf.queryExecution().toString()
