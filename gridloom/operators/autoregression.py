"""Spatial lag and error models for cross-sections of any size, from the table of edges alone.

The likelihood at a parameter p needs two things. The squared error is a form in one matrix of moments: of the target,
the columns and the spatial lags of both, added up over the rows. The log-determinant of I - p W is minus the sum over k
of p**k tr(W**k) / k; traces up to the sixth come exactly from joins of powers of the edge table, which stay as sparse as
neighbourhoods are (units with the same neighbours count as one), and later ones from random signs that are sent along the edges again and again. No matrix over the
units exists anywhere; the driver holds moments and traces.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import pvalues
from gridloom.functions.lineage import remove, scratch, stage
from gridloom.operators.spatial import golden

EXACT = 6


def joined(values: DataFrame, edges: DataFrame, unit: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows ``u, columns`` that have them all, and the edges between these, staged."""
    rows = stage(values.select(F.col(unit).alias("u"), *(F.col(c).cast("double").alias(c) for c in columns)).dropna(), "units")
    ids = rows.select(F.col("u").alias("__u"))
    ids = ids.hint("merge")
    own = edges.join(ids, F.col("src") == F.col("__u"), "left_semi").join(ids, F.col("dst") == F.col("__u"), "left_semi")
    return rows, stage(own.select("src", "dst", F.col("w").cast("double").alias("w")), "edges")


def lag(edges: DataFrame, rows: DataFrame, columns: list[str], name: str = "w_{}") -> DataFrame:
    """``u`` and the weighted sums of its neighbours' values; units without neighbours are absent."""
    # Merged by a shuffle: a broadcast of the units' values would pass the driver, once a power.
    met = edges.join(rows.select(F.col("u").alias("dst"), *columns).hint("merge"), "dst")
    return met.groupBy(F.col("src").alias("u")).agg(*(F.sum(F.col("w") * F.col(c)).alias(name.format(c)) for c in columns))


def with_lags(edges: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    lags = [f"w_{c}" for c in columns]
    return rows.join(lag(edges, rows, columns).hint("merge"), "u", "left").fillna(0.0, lags)


def moments(rows: DataFrame, columns: list[str]) -> np.ndarray:
    """The matrix of sums of products of the columns."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    sums = rows.agg(*(F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"s{k}") for k, (i, j) in enumerate(pairs))).first()
    out = np.zeros((len(columns),) * 2)
    for (i, j), v in zip(pairs, sums, strict=True):
        out[i, j] = out[j, i] = v or 0.0
    return out


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sparse product of two tables ``src, dst, w``."""
    right = b.select(F.col("src").alias("dst"), F.col("dst").alias("__to"), F.col("w").alias("__w"))
    return a.join(right.hint("merge"), "dst").groupBy("src", F.col("__to").alias("dst")).agg(F.sum(F.col("w") * F.col("__w")).alias("w"))


def trace(a: DataFrame, b: DataFrame) -> float:
    """The trace of the product of two tables ``src, dst, w``."""
    turned = b.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("__w"))
    return a.join(turned.hint("merge"), ["src", "dst"]).agg(F.sum(F.col("w") * F.col("__w"))).first()[0] or 0.0


def twins(edges: DataFrame) -> tuple[DataFrame, list[tuple[float, float]]]:
    """Edges between classes of units with the same weight and the same neighbours, each other included, and (weight,
    members beyond the first) of all classes, added up by weight. Differences of two members are eigenvectors of the weights, with value
    - weight; the other eigenvalues are those of the classes' table. Neighbours are compared by sums of two hashes. Weights that
    are not even within a row, or edges without their reverse, make no classes."""
    hashed = lambda seed, *names: F.xxhash64(F.lit(seed), *names).cast("decimal(20,0)")
    rows = edges.groupBy("src").agg(F.min("w").alias("w"), F.max("w").alias("top"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("loop"), *(F.sum(hashed(s, "dst")).alias(f"h{s}") for s in (1, 2)))
    units = stage(rows, "rows")
    turned = [F.sum(hashed(s, "src", "dst")) == F.sum(hashed(s, "dst", "src")) for s in (1, 2)]
    even = units.agg(F.max(((F.col("w") != F.col("top")) | (F.col("loop") > 0)).cast("int"))).first()[0]
    if even != 0 or not all(edges.agg(*turned).first()):
        return edges, []
    key = [F.col("w"), *((F.col(f"h{s}") + hashed(s, "src")).alias(f"h{s}") for s in (1, 2))]
    keyed = units.select("src", *key)
    classes = keyed.groupBy("w", "h1", "h2").agg(F.min("src").alias("c"), F.count(F.lit(1)).alias("m"))
    more = classes.where("m > 1").groupBy("w").agg(F.sum(F.col("m") - 1).alias("more")).collect()  # a row per weight
    if not more:
        return edges, []
    members = stage(keyed.join(classes.drop("m").hint("merge"), ["w", "h1", "h2"]).select("src", "c"), "members")
    first = edges.join(members.where("src = c").select("src").hint("merge"), "src", "left_semi")
    met = first.join(members.select(F.col("src").alias("dst"), "c").hint("merge"), "dst")
    return stage(met.groupBy("src", F.col("c").alias("dst")).agg(F.sum("w").alias("w")), "classes"), [(r.w, r.more) for r in more]


def exact_traces(edges: DataFrame) -> list[float]:
    """tr(W**k) for k from 1 to ``EXACT``, from joins of the edge table between :func:`twins`' classes and its second and
    third power: units in one place would else all meet each other, once a power."""
    edges, more = twins(edges)
    second = stage(product(edges, edges), "power")
    third = stage(product(second, edges), "power")
    first = edges.where("src = dst").agg(F.sum("w")).first()[0] or 0.0
    found = [first, trace(edges, edges), trace(second, edges), trace(second, second), trace(third, second), trace(third, third)]
    return [t + sum(n * (-w) ** k for w, n in more) for k, t in enumerate(found, 1)]


def traces(rows: DataFrame, edges: DataFrame, powers: int = 40, probes: int = 32, seed: int = 42) -> np.ndarray:
    """tr(W**k) for k from 1: exact up to ``EXACT``, then means over random signs. Every power is staged, and the one
    before it deleted."""
    spark = rows.sparkSession
    out = exact_traces(edges)
    names = [f"r{i}" for i in range(probes)]

    def sign(i: int) -> Column:
        return (F.xxhash64("u", F.lit(seed), F.lit(i)).bitwiseAND(1) * 2 - 1).cast("double")

    now, before = rows.select("u", *(sign(i).alias(n) for i, n in enumerate(names))), None
    for k in range(1, powers + 1):
        path = scratch(spark, "probes")
        lag(edges, now, names, "{}").write.parquet(path)
        now = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
        if k > EXACT:
            hit = now.agg(*(F.sum(sign(i) * F.col(n)).alias(n) for i, n in enumerate(names))).first()
            out.append(float(np.mean([v or 0.0 for v in hit])))
    return np.array(out)


def log_determinant(p: float, found: np.ndarray) -> float:
    """log |I - p W| from traces; beyond the last one, traces are taken to stay as they are."""
    k = np.arange(1, len(found) + 1)
    tail = -math.log(1 - abs(p)) - float((abs(p) ** k / k).sum()) if abs(p) < 1 else 0.0
    return -float((p**k * found / k).sum()) - tail * max(0.0, float(found[-2:].mean())) * (1 if p > 0 else 0)


def models(values: DataFrame, edges: DataFrame, unit: str, y: str, xs: list[str], powers: int = 40, probes: int = 32, seed: int = 42) -> dict[str, DataFrame]:
    """The tables of :func:`gridloom.operators.spatial.spatial_models`, for any number of units: ``models``,
    ``coefficients`` and ``tests``. The parameter is sought between -0.95 and 0.95."""
    rows, own = joined(values, edges, unit, [y, *xs])
    rows = rows.withColumn("__one", F.lit(1.0))
    columns = [y, "__one", *xs]
    lagged = stage(with_lags(own, rows, columns), "lagged")
    m = moments(lagged, [*columns, *(f"w_{c}" for c in columns)])
    n, k, found = m[1, 1], len(xs) + 1, traces(rows.select("u"), own, powers, probes, seed)
    width = k + 1
    target, wy = np.eye(2 * width)[0], np.eye(2 * width)[width]
    x, wx = np.eye(2 * width)[:, 1:width], np.eye(2 * width)[:, width + 1 :]
    sides = {"ols": lambda p: (target, x), "lag": lambda p: (target - p * wy, x), "error": lambda p: (target - p * wy, x - p * wx)}

    def fit(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, float]:
        beta = np.linalg.lstsq(b.T @ m @ b, b.T @ m @ a, rcond=None)[0]
        rest = a - b @ beta
        return beta, float(rest @ m @ rest)

    def likelihood(a: np.ndarray, b: np.ndarray, p: float) -> float:
        return -n / 2 * (math.log(2 * math.pi * fit(a, b)[1] / n) + 1) + log_determinant(p, found)

    table, coefficients = [], []
    for name, side in sides.items():
        p = 0.0 if name == "ols" else golden(lambda v, side=side: likelihood(*side(v), v), -0.95, 0.95)
        beta, ll, count = fit(*side(p))[0], likelihood(*side(p), p), k + (name != "ols")
        r2 = _reduced(lagged, own, columns, beta, p) if name == "lag" else _squared_correlation(m, target, x @ beta, n)
        table.append(tuple([name, *map(float, (p, r2, ll, 2 * count - 2 * ll, math.log(n) * count - 2 * ll))]))
        coefficients += [(name, c, float(v)) for c, v in zip(["const", *xs], beta, strict=True)]
    best = min(table, key=lambda r: r[4])[0]

    beta, error = fit(target, x)
    e, we, s2 = target - x @ beta, wy - wx @ beta, error / n
    t = float((own.agg(F.sum(F.col("w") * F.col("w"))).first()[0] or 0.0) + found[1])
    wxb = wx @ beta
    inside = wxb @ m @ wxb - (x.T @ m @ wxb) @ np.linalg.pinv(x.T @ m @ x) @ (x.T @ m @ wxb)
    j, de, dl = float((inside + t * s2) / s2), float(e @ m @ we / s2), float(e @ m @ wy / s2)
    tests = {"lm_error": de**2 / t, "lm_lag": dl**2 / j, "rlm_error": (de - t / j * dl) ** 2 / (t * (1 - t / j)), "rlm_lag": (dl - de) ** 2 / (j - t)}
    made = values.sparkSession.createDataFrame
    return {
        "models": made([(*r, r[0] == best) for r in table], "model string, parameter double, pseudo_r2 double, log_likelihood double, aic double, schwarz double, best boolean"),
        "coefficients": made(coefficients, "model string, name string, coef double"),
        "tests": made([(name, float(v), pvalues.chi2_sf(max(float(v), 0.0), 1)) for name, v in tests.items()], "test string, statistic double, p_value double"),
    }


def _squared_correlation(m: np.ndarray, a: np.ndarray, b: np.ndarray, n: float) -> float:
    """Squared correlation of two columns given as weights of the moments' columns; the constant is column 1."""
    one = np.eye(len(m))[1]
    cov = lambda p, q: p @ m @ q - (p @ m @ one) * (q @ m @ one) / n
    bottom = cov(a, a) * cov(b, b)
    return float(cov(a, b) ** 2 / bottom) if bottom > 0 else 0.0


def _reduced(lagged: DataFrame, edges: DataFrame, columns: list[str], beta: np.ndarray, p: float, tolerance: float = 1e-6) -> float:
    """Squared correlation of the target with the sum over k of p**k W**k X beta: lags are added until they are small."""
    spark = lagged.sparkSession
    fitted = sum((F.col(c) * float(b) for c, b in zip(columns[1:], beta, strict=True)), F.lit(0.0))
    now, before, steps = lagged.select("u", F.col(columns[0]).alias("y"), fitted.alias("f"), fitted.alias("v")), None, 0
    scale = now.agg(F.stddev_pop("v")).first()[0] or 1.0
    while True:
        path, steps = scratch(spark, "reduced"), steps + 1
        moved = lag(edges, now, ["v"], "__moved")
        now.join(moved.hint("merge"), "u", "left").select("u", "y", (F.col("f") + F.coalesce("__moved", F.lit(0.0)) * p).alias("f"), (F.coalesce("__moved", F.lit(0.0)) * p).alias("v")).write.parquet(path)
        now = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
        if steps >= 200 or (now.agg(F.stddev_pop("v")).first()[0] or 0.0) < tolerance * scale:
            r = now.agg(F.corr("y", "f")).first()[0]
            return float(r**2) if r is not None and not math.isnan(r) else 0.0
