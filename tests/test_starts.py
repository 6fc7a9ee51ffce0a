"""Many k-means starts in the same passes, against one fit after the other."""

import inspect

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from gridloom.operators import cluster, starts
from pyspark.sql import functions as F

COLUMNS = ["a", "b", "c"]


def blobs(n=600):
    rng = np.random.default_rng(5)
    at = rng.integers(0, 3, n)
    return np.array([[0, 0, 0], [6, 0, 1], [0, 7, 2]])[at] + rng.normal(0, 0.6, (n, 3))


def frame(spark, x):
    return spark.createDataFrame(pd.DataFrame({"id": range(len(x)), **dict(zip(COLUMNS, x.T, strict=True))})).repartition(3)


def test_starts_in_memory_agree_with_single_fits():
    x = blobs()
    costs, centres = starts.fit_many(x, 4, list(range(6)))
    for seed in range(6):
        cost, own = cluster.fit_once(x, 4, seed)
        assert costs[seed] == pytest.approx(cost) and centres[seed] == pytest.approx(own)


def test_fits_over_rows_take_one_job_a_pass(spark, monkeypatch):
    jobs = []
    real = starts.added
    monkeypatch.setattr(starts, "added", lambda *a: (jobs.append(1), real(*a))[1])
    x = blobs()
    fits = cluster.best_fits(frame(spark, x), COLUMNS, [2, 3], starts=20, bound=100)
    assert len(jobs) < 40  # forty fits, one after the other, take some hundred
    for k in (2, 3):
        best = min(cluster.fit_once(x, k, s)[0] for s in range(20))
        assert fits[k].cost == pytest.approx(best, rel=1e-3)
    assert sorted(map(tuple, np.round(fits[3].centres).astype(int))) == [(0, 0, 0), (0, 7, 2), (6, 0, 1)]


def test_stability_and_gap_over_rows(spark):
    df = frame(spark, blobs())
    made = cluster.bootstrap_stability(df, COLUMNS, 3, replicates=5, starts=3, bound=100).collect()
    assert len(made) == 5 and all(r["ari"] == pytest.approx(1.0) for r in made)
    rows = {r["feature"]: r for r in cluster.perturbation_stability(df, COLUMNS, 3, starts=5, bound=100).collect()}
    assert rows["c"]["ari"] == pytest.approx(1.0) and rows["a"]["ari"] < 0.9
    wide = cluster.gap_statistic(df, COLUMNS, [2, 3, 4], references=4, starts=8, reference_starts=2, bound=100)
    near = cluster.gap_statistic(df, COLUMNS, [2, 3, 4], references=4, starts=8, reference_starts=2)
    assert [w[1] for w in wide] == pytest.approx([w[1] for w in near], abs=0.1) and cluster.gap_choice(wide) == cluster.gap_choice(near) == 3


def test_tiles_are_bounded_in_number_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 16)
    monkeypatch.setattr(cluster, "TILES", 3)
    x = blobs(200)
    seen = cluster.tile_pairs(*[frame(spark, x)] * 2, COLUMNS, lambda a, b: pa.table({"n": [sum(len(p) for _, p in a) * sum(len(q) for _, q in b)]}), "n long", size=16).collect()
    assert len(seen) <= 9 and sum(r["n"] for r in seen) == 200 * 200
    df = frame(spark, x).withColumn("cluster", F.col("id") % 3)
    got = {(r["id"], r["cluster"]): (r["total"], r["n"]) for r in cluster.distance_sums(df, COLUMNS, "cluster").collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i in range(0, 200, 17):
        for c in range(3):
            assert got[i, c] == (pytest.approx(d[i, c::3].sum()), len(range(c, 200, 3)))


def test_starts_in_memory_take_their_steps_in_single_precision(monkeypatch):
    passes, real = [], starts.sums_of
    x = np.random.default_rng(3).normal(size=(5000, 6)) + 1e4
    want = [cluster.fit_once(x - 1e4, 4, s)[0] for s in range(4)]
    monkeypatch.setattr(starts, "sums_of", lambda *a: (passes.append(1), real(*a))[1])
    costs, centres = starts.fit_many(x, 4, list(range(4)))
    assert len(passes) < 10  # in double precision each start takes some tens of them
    assert costs.min() == pytest.approx(min(want), rel=1e-2)
    own = cluster.squares(x - 1e4, centres[0] - 1e4).argmin(1)
    assert ((x - centres[0][own]) ** 2).sum() == pytest.approx(costs[0], rel=1e-4)


def test_steps_in_single_precision_count_rows_once():
    x = np.repeat(np.random.default_rng(4).normal(size=(50, 3)), 3, axis=0)
    centres = np.array([[x[0], x[3], x[3], x[9]], [x[6], x[6], x[6], x[6]]])  # equal centres: rows belong to the first
    counts, sums = starts.Single(x).sums_of(centres)
    want = starts.sums_of(x, centres)
    assert counts == pytest.approx(want[0]) and sums == pytest.approx(want[1], abs=1e-4)


def test_cross_sections_fit_in_memory_at_sizes_of_a_gigabyte():
    for f in (cluster.best_fits, cluster.gap_statistic, cluster.bootstrap_stability):
        assert inspect.signature(f).parameters["bound"].default >= 120_000


def test_silhouettes_of_several_labellings_take_one_pass(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 16)
    passes, real = [], cluster.tile_pairs
    monkeypatch.setattr(cluster, "tile_pairs", lambda *a: (passes.append(1), real(*a))[1])
    df = frame(spark, np.r_[blobs(150), blobs(150)[:20]]).withColumns({"u": F.col("id") % 3, "v": F.when(F.col("a") > 3, 1).otherwise(0), "w": F.when(F.col("id") == 7, 1).otherwise(F.col("id") % 2 * 2)})
    got = cluster.mean_silhouettes(df, COLUMNS, {"u": 3, "v": 2, "w": 4})
    assert len(passes) == 1
    for name, value in got.items():
        assert value == pytest.approx(cluster.silhouette_samples(df, COLUMNS, name).agg(F.avg("silhouette")).first()[0])
