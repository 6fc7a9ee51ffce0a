import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import batched, classify, leaveout, trees
from gridloom.operators.cluster import compact

N, P = 160, 3


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, P)).round(3)
    y = (x[:, 0] + 0.6 * rng.normal(size=N) > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame([(i, int(y[i]), *map(float, x[i])) for i in range(N)], "id long, label int, a double, b double, c double")
    return compact(batched.task_rows(df, ["a", "b", "c"], F.array()).drop("out").withColumn("place", F.col("id")))


def refitted(rows, model, places):
    """Classes of rows from fits without them."""
    out = {}
    for at in range(0, len(places), 40):
        some = places[at : at + 40]
        task = F.create_map(*(F.lit(v) for k, i in enumerate(some) for v in (i, k)))[F.col("place").cast("int")]
        held = rows.withColumn("out", F.when(task.isNotNull(), F.array(task)).otherwise(F.array().cast("array<int>")))
        made = batched.held_out(held.where(task.isNotNull()), model.fit_tasks(held, len(some), 3, P), len(some))
        out |= {r.id: r.y_pred for r in made.collect()}
    return out


@pytest.mark.parametrize("name", ["logistic_regression", "svm_linear"])
def test_settled_classes_are_those_of_fits_without_the_row(rows, name):
    model = classify.batched_models([name])[name]
    got = {r.id: r.y_pred for r in leaveout.settled(model, rows, N, 3, P).collect()}
    assert len(got) == N
    sure = {i: c for i, c in got.items() if c is not None}
    assert len(sure) > N / 2
    want = refitted(rows, model, list(range(N)))
    assert sure == {i: want[i] for i in sure}


def test_walked_trees_are_those_grown_without_the_row(rows):
    got = {r.id: r.y_pred for r in leaveout.settled(trees.Forest(trees=25, depth=5), rows, N, 3, P).collect()}
    assert len(got) == N
    for i in range(0, N, 16):  # a fit of one task draws as a walk does
        assert got[i] == refitted(rows, trees.Forest(trees=25, depth=5), [i])[i]


def test_shares_of_walked_trees(rows):
    """Every tree's share, not the vote alone."""
    model, edges = trees.Forest(trees=6, depth=4), trees.bin_edges(rows, P)
    data = trees.with_hash(rows).orderBy("id").toPandas()
    x, y, h = np.array(data.x.tolist()), data.label.to_numpy().astype(np.int64), data.h.to_numpy().view(np.uint64)
    code = trees.coded(x, edges).astype(np.uint8)
    made = [leaveout.tree_shares(code, y, h, t, 3, model) for t in range(6)]
    for i in (0, 7, 31, 90):
        held = rows.withColumn("out", F.when(F.col("id") == i, F.array(F.lit(0))).otherwise(F.array().cast("array<int>")))
        grown = trees.Forest(trees=6, depth=4).fit_tasks(held, 1, 3, P).trees
        for t in range(6):
            own = grown.stats[t, grown.leaves(code[i : i + 1], np.array([t]))][0]
            assert made[t][i] == pytest.approx(own / own.sum())


def test_the_only_row_of_a_class_is_fitted_anew(spark):
    df = spark.createDataFrame([(i, 2 if i == 5 else i % 2, float(i % 2) + i / 100) for i in range(24)], "id long, label int, x double")
    models = classify.batched_models(["logistic_regression", "svm_linear"])
    rows = batched.task_rows(df, ["x"], F.array()).drop("out").withColumn("place", F.col("id"))
    for m in models.values():
        assert [r.id for r in leaveout.settled(m, rows, 24, 3, 1).where("y_pred IS NULL").collect()].count(5) == 1
    got = classify.leave_one_out(df, ["x"], models).collect()
    assert len(got) == 48 and all(r.y_pred != 2 for r in got if r.id == 5)


def test_few_rows_are_fitted_anew(spark, monkeypatch):
    """Fits grow with what is not settled, not with the rows."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=1500)
    df = spark.createDataFrame([(i, int(v + 0.3 * rng.normal() > 0), float(v)) for i, v in enumerate(x)], "id long, label int, x double")
    fits, plain = [], batched.Logistic.fit_tasks
    monkeypatch.setattr(batched.Logistic, "fit_tasks", lambda self, rows, tasks, *rest: fits.append(tasks) or plain(self, rows, tasks, *rest))
    got = classify.leave_one_out(df, ["x"], classify.batched_models(["logistic_regression"])).collect()
    assert len({r.id for r in got}) == 1500 and sum(fits) < 60
