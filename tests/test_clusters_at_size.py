import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom import workflows
from gridloom.operators import cluster, starts


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2600, 3)).round(2) + np.repeat([[0, 0, 0], [4, 0, 1]], 1300, 0)
    x[100:140] = x[0]  # copies
    label = (x[:, 0] > 2).astype(int) + 2 * (np.arange(2600) == 7)
    df = spark.createDataFrame([(i, int(label[i]), *map(float, x[i])) for i in range(2600)], "id long, cluster int, a double, b double, c double")
    return cluster.compact(df), x, label


def test_two_tiles_meet_once(points):
    def met(a, b):
        n = lambda side: sum(rows.num_rows for rows, _ in side)
        return pa.table({"own": pa.array([b is None]), "pairs": pa.array([n(a) ** 2 if b is None else n(a) * n(b)], pa.int64())})

    found = cluster.tile_pairs(points[0].select("id", "a", "b"), None, ["a", "b"], met, "own boolean, pairs long").collect()
    assert len(found) == 6 and sum(r.own for r in found) == 3
    assert sum(r.pairs * (1 if r.own else 2) for r in found) == 2600**2


def test_silhouettes_of_several_tiles(points):
    df, x, label = points
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    n = np.bincount(label)
    sums, every = d @ np.eye(len(n))[label], np.arange(len(x))
    a, other = sums[every, label] / np.maximum(n[label] - 1, 1), sums / n
    other[every, label] = np.inf
    want = np.where(n[label] == 1, 0.0, (other.min(1) - a) / np.maximum(a, other.min(1)))
    got = {r.id: r.silhouette for r in cluster.silhouette_samples(df, ["a", "b", "c"]).collect()}
    assert [got[i] for i in range(len(x))] == pytest.approx(want, abs=1e-9)


def test_lists_of_columns_share_passes(points, monkeypatch):
    df, sets = points[0].drop("cluster"), {"ab": ["a", "b"], "all": ["a", "b", "c"], "c": ["c"]}
    calls, plain = [], starts.fit_rows
    monkeypatch.setattr(starts, "fit_rows", lambda *args, **more: calls.append(len(args[1])) or plain(*args, **more))
    got = cluster.best_fits_by_columns(df, sets, 2, starts=4, bound=100)
    assert calls == [3]
    for name, columns in sets.items():
        alone = cluster.best_fits(df, columns, [2], starts=4, bound=100)[2]
        assert got[name].cost == pytest.approx(alone.cost) and got[name].centres == pytest.approx(alone.centres)


def test_tables_of_a_typology_are_made_when_asked_for(points, monkeypatch):
    made = []
    plain = cluster.profiles
    monkeypatch.setattr(cluster, "profiles", lambda *args: made.append(1) or plain(*args))
    tables = workflows.typology(points[0].select("id", "a", "b", "c"), ["a", "b", "c"], 2)
    assert set(tables) == {"assignments", "profiles", "kruskal_wallis", "correlations"}
    assert tables["assignments"].agg(F.count(F.lit(1))).first()[0] == 2600 and made == []
    assert tables["profiles"].count() == 2 and made == [1] and tables["profiles"] is tables["profiles"]
