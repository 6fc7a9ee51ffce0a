"""Batched fits against plain numpy, one training set at a time."""

import numpy as np
import pytest

from gridloom.operators import batched, classify, trees
from pyspark.sql import functions as F

N, P, K, T = 120, 3, 3, 4


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(N, P)), 2)
    y = (x @ rng.normal(size=(P, K)) * 2 + rng.gumbel(size=(N, K))).argmax(1)
    out = np.arange(N) % T
    y[out != 3] = np.where(y[out != 3] == 2, 0, y[out != 3])  # task 3 trains on two classes
    return x, y, out


@pytest.fixture(scope="module")
def rows(spark, data):
    x, y, out = data
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist(), [int(out[i])]) for i in range(N)], "id long, label int, x array<double>, out array<int>").repartition(3).cache()


def ones(x):
    return np.c_[x, np.ones(len(x))]


def test_logistic_is_at_the_minimum(rows, data):
    x, y, out = data
    predict = batched.Logistic().fit_tasks(rows, T, K, P)
    for t in range(T):
        own, beta = out != t, predict.coefficients[t]
        present = np.unique(y[own])
        z = ones(x[own]) @ beta[present].T
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        slope = (q - (y[own][:, None] == present)).T @ ones(x[own])
        slope[:, :P] += (2 if len(present) == 2 else 1) * beta[present][:, :P]
        assert np.abs(slope).max() < 1e-5
    assert (predict(x, np.full(N, 3))[:, 2] == 0).all()  # a class without training rows


def test_machines_are_at_the_minimum(rows, data):
    x, y, out = data
    predict = batched.LinearMachine().fit_tasks(rows, T, K, P)
    for (a, b), beta in predict.coefficients.items():
        for t in range(T):
            own = (out != t) & ((y == a) | (y == b))
            sign = np.where(y[own] == a, 1.0, -1.0)
            slack = np.maximum(1 - sign * (ones(x[own]) @ beta[t]), 0)
            slope = np.r_[beta[t][:P], 0] - 2 * (slack * sign) @ ones(x[own])
            if len(np.unique(sign)) == 2:
                assert np.abs(slope).max() < 1e-5


def plain_boosting(x, y, rounds, depth, least, ridge, rate, edges, classes):
    """One training set, node by node: scores of the rows of ``x``, as a function of other rows."""
    code, prior = trees.coded(x, edges), np.bincount(y, minlength=classes) / len(y)
    present, start = prior > 0, np.log(np.maximum(prior, 1e-300))
    f, grown = np.tile(start, (len(y), 1)), []

    def gain(g, h):
        return g.sum() ** 2 / (h.sum() + ridge) if h.sum() + ridge > 0 else 0.0

    def build(own, g, h, level):
        best = (1e-9, None)
        for j in range(x.shape[1]) if level < depth else ():
            for b in range(len(edges[j])):
                left = own[code[own, j] <= b]
                right = own[code[own, j] > b]
                if min(len(left), len(right)) >= least:
                    score = gain(g[left], h[left]) + gain(g[right], h[right]) - gain(g[own], h[own])
                    if score > best[0] + 1e-12:
                        best = (score, (j, b, left, right))
        if best[1] is None:
            return rate * -g[own].sum() / (h[own].sum() + ridge) if h[own].sum() + ridge > 0 else 0.0
        j, b, left, right = best[1]
        return j, b, build(left, g, h, level + 1), build(right, g, h, level + 1)

    def value(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(rounds):
        q = batched.softmax(f, present)
        new = [build(np.arange(len(y)), q[:, k] - (y == k), q[:, k] * (1 - q[:, k]), 0) for k in range(classes)]
        f = f + np.array([[value(node, row) for node in new] for row in code])
        grown.append(new)

    def chances(z):
        rows = trees.coded(z, edges)
        return batched.softmax(np.array([start + sum(np.array([value(n, row) for n in new]) for new in grown) for row in rows]), present)

    return chances


@pytest.mark.parametrize("ridge", [0.0, 1.0])
def test_boosting_equals_plain_version(rows, data, ridge):
    x, y, out = data
    predict = trees.Boosting(rounds=5, depth=2, least=3, ridge=ridge, staged=2).fit_tasks(rows, T, K, P)
    for t in (0, 3):
        own = out != t
        want = plain_boosting(x[own], y[own], 5, 2, 3, ridge, 0.1, predict.edges, K)(x[~own])
        assert predict(x[~own], np.full((~own).sum(), t)) == pytest.approx(want, abs=1e-5)


def test_best_cut_of_a_forest_node(data):
    x, y, _ = data
    edges = [np.quantile(x[:, f], [0.2, 0.4, 0.6, 0.8]) for f in range(P)]
    code = trees.coded(x, edges)
    keys = (np.arange(P) * trees.BINS + code).ravel()
    keys, sums = trees.cell_sums(keys, np.repeat(np.eye(K)[y], P, 0))
    node, feature, bin_, left, whole = trees.best_cuts(keys, sums, P, trees.gini, lambda s: s.sum(1), 3)

    def impurity(labels):
        share = np.bincount(labels, minlength=K) / max(len(labels), 1)
        return len(labels) * (1 - (share**2).sum())

    cuts = {(f, b): impurity(y[code[:, f] <= b]) + impurity(y[code[:, f] > b]) for f in range(P) for b in range(4)}
    assert (feature[0], bin_[0]) == min(cuts, key=cuts.get) and node.tolist() == [0]
    assert left[0].tolist() == np.bincount(y[code[:, feature[0]] <= bin_[0]], minlength=K).tolist() and whole[0].sum() == N


def test_forest_learns_and_leaves_hold_training_rows(rows, data):
    x, y, out = data
    predict = trees.Forest(trees=30, depth=4).fit_tasks(rows, T, K, P)
    found = batched.held_out(rows, predict, T).collect()
    assert len(found) == N and {r.task for r in found} == set(range(T))
    most = np.bincount(y).max() / N
    assert np.mean([r.y_true == r.y_pred for r in found]) > most
    shares = predict(x, out)
    assert shares.sum(1) == pytest.approx(np.ones(N))
    root = predict.trees.stats[:, 1].sum(1)  # bootstrap weights of a tree add up to about its training rows
    assert abs(root.mean() - N * (T - 1) / T) < 5
    again = trees.Forest(trees=30, depth=4).fit_tasks(rows.repartition(1), T, K, P)
    assert (again.trees.feature == predict.trees.feature).all()  # draws follow ids, not partitions


def test_leave_one_out_together_and_alone(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2) + i / 100) for i in range(24)], "id long, label int, x double")
    models = classify.batched_models(["logistic_regression", "svm_linear"]) | classify.build_models(["dummy_most_frequent"])
    got = classify.leave_one_out(df, ["x"], models).collect()
    assert len(got) == 72 and len({(r.model, r.id) for r in got}) == 72
    assert all(r.y_true == r.y_pred for r in got if r.model != "dummy_most_frequent")


def test_cross_validate_mixes_batched_and_single_fits(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 3) + i / 100, float(i % 7)) for i in range(60)], "id long, label int, x double, z double")
    split = classify.stratified_folds(df, "label", F.col("id"), 3, repeats=2)
    models = classify.batched_models(["logistic_regression", "xgboost", "svm_rbf"]) | classify.build_models(["dummy_most_frequent"])
    models["xgboost"].rounds = 6
    got = classify.cross_validate(split, ["x", "z"], models).collect()
    assert len(got) == 4 * 60 * 2 and len({(r.model, r.fold, r.id) for r in got}) == len(got)
    right = {m: np.mean([r.y_true == r.y_pred for r in got if r.model == m]) for m in models}
    assert right["logistic_regression"] > 0.9 and right["xgboost"] > 0.9 and right["svm_rbf"] > 0.9
    assert {r.probability is None for r in got if r.model == "svm_rbf"} == {True}


def expected_value(trees_, t, node, value, row, known):
    """A tree's value with some columns known, node by node."""
    f = trees_.feature[t, node]
    if f < 0:
        return value[t, node]
    left, right = 2 * node, 2 * node + 1
    if f in known:
        return expected_value(trees_, t, left if row[f] <= trees_.bin[t, node] else right, value, row, known)
    cover = trees_.cover()
    a, b = cover[t, left], cover[t, right]
    return (a * expected_value(trees_, t, left, value, row, known) + b * expected_value(trees_, t, right, value, row, known)) / (a + b)


@pytest.mark.parametrize("model", [trees.Forest(trees=4, depth=4), trees.Boosting(rounds=3, depth=3)])
def test_explanations_equal_all_orderings(spark, rows, data, model):
    from itertools import permutations

    from gridloom.operators import explain

    x, _, _ = data
    alone = rows.withColumn("out", F.array().cast("array<int>"))
    predict = model.fit_tasks(alone, 1, K, P)
    found = explain.explained(alone, predict, ["a", "b", "c"], K).collect()
    got = {(r.id, r["class"], "abc".index(r.feature)): r.value for r in found}
    assert len(got) == N * K * P
    code, orders = trees.coded(x, predict.edges), list(permutations(range(P)))
    for i in range(0, N, 17):
        want = np.zeros((P, K))
        for own, chosen, value in predict.parts():
            for t in chosen:
                for order in orders:
                    for k, f in enumerate(order):
                        gain = expected_value(own, t, 1, value, code[i], set(order[: k + 1])) - expected_value(own, t, 1, value, code[i], set(order[:k]))
                        want[f] += gain / len(orders)
        for f in range(P):
            assert [got[i, c, f] for c in range(K)] == pytest.approx(want[f].tolist(), abs=1e-6)


def test_explanations_of_many_columns_add_up(spark):
    from gridloom.operators import explain

    rng = np.random.default_rng(0)
    x = rng.normal(size=(150, 46))
    y = (x[:, 3] + x[:, 40] > 0).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist(), []) for i in range(150)], "id long, label int, x array<double>, out array<int>")
    predict = trees.Forest(trees=40, depth=5).fit_tasks(df, 1, 2, 46)
    names = [f"c{i}" for i in range(46)]
    values = explain.explained(df, predict, names, 2)
    top = [r.feature for r in explain.importance(values).orderBy(F.desc("mean_abs_shap")).limit(2).collect()]
    assert set(top) == {"c3", "c40"}
    sums = {r.id: r.s for r in values.where("class = 1").groupBy("id").agg(F.sum("value").alias("s")).collect()}
    (own, chosen, value), = predict.parts()
    base = sum(expected_value(own, t, 1, value, None, set())[1] for t in chosen)
    shares = predict(x, np.zeros(150, int))[:, 1]
    assert [sums[i] + base for i in range(150)] == pytest.approx(shares.tolist(), abs=1e-5)


def test_a_task_sends_a_cell_once_whatever_its_rows(spark):
    rng, forest = np.random.default_rng(5), trees.Forest(trees=6, depth=3)
    x = rng.integers(0, 4, (5_000, P)).astype(float)
    y = (x[:, 0] > 1).astype(int)
    df = spark.createDataFrame([(i, int(c), v.tolist(), []) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, label int, x array<double>, out array<int>")
    grown = forest.fit_tasks(df.repartition(3), 1, 2, P).trees
    assert (grown.feature == forest.fit_tasks(df.repartition(1), 1, 2, P).trees.feature).all()
    batch = df.select("label", "x", "out").toArrow().combine_chunks().to_batches()[0]
    at = trees.Trees(6, 0, 1)

    def entries(part, first, last):
        code, n = x[: part.num_rows].astype(int), part.num_rows
        yield code, np.repeat(np.arange(n), last - first), np.tile(np.arange(first, last), n), np.ones((n * (last - first), 1))

    keys, sums = trees.counted(iter([batch] * 3), at, entries, 2, 5, P, P, 0)
    assert len(keys) == len(set(keys.tolist())) == 3 * P * 4
    assert sums.sum() == 3 * 3 * P * 5_000
    assert trees.tree_runs(np.full(10, trees.CELLS // 3), 1).tolist() == [0, 3, 6, 9, 10]
    assert trees.tree_runs(np.ones(10, int), 5).tolist() == [0, 2, 4, 6, 8, 10]


@pytest.mark.parametrize("made", [lambda: batched.LinearMachine(), lambda: batched.FourierMachine(features=8)])
def test_machines_take_blocks_that_lack_the_classes_of_a_pair(spark, monkeypatch, made):
    """A block whose rows are all of one class has none for the machine of the other two."""
    labels = [0] * batched.BLOCK + [1] * 40 + [2] * 40
    rows = [(i, y, [float(y == 1) + i % 7 / 50, float(y == 2) - i % 5 / 50], [i % 2]) for i, y in enumerate(labels)]
    df = spark.createDataFrame(rows, "id long, label int, x array<double>, out array<int>").coalesce(1)
    predict = made().fit_tasks(df, 2, 3, 2)
    scores = predict(np.array([[0.1, 0.0], [1.1, 0.0], [0.1, 1.0]]), np.zeros(3, int))
    assert scores.argmax(1).tolist() == [0, 1, 2]


def test_products_of_columns_come_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(50, 4)), rng.uniform(size=(50, 3))
    whole = np.einsum("nt,ni,nj->tij", w, x, x).reshape(3, 16)
    monkeypatch.setattr(batched, "PRODUCTS", 100)
    assert np.allclose(batched.weighted_products(w, x), whole)
    assert batched.weighted_products(w[:0], x[:0]).shape == (3, 16)


def test_cuts_of_one_partition_equal_those_of_cells(data):
    rng, x = np.random.default_rng(8), np.random.default_rng(9).integers(0, 6, (400, P))
    stats = np.eye(K)[(x[:, 0] > 2).astype(int) + rng.integers(0, 2, 400) * (K > 2)]

    def entries(part, first, last):
        yield x, np.arange(400), np.zeros(400, int) + first, stats

    made = trees.Trees(3, 0, K)
    found = trees.dense_cuts(*trees.dense_counts(iter([None]), made, entries, 1, 2, P, 2, 3), trees.gini, lambda s: s.sum(1), 3)
    keys, sums = trees.counted(iter([None]), made, entries, 1, 2, P, 2, 3)
    want = trees.best_cuts(keys, sums.T, P, trees.gini, lambda s: s.sum(1), 3)
    for a, b in zip(found, want, strict=True):
        assert np.allclose(a, b)


def test_runs_of_trees_over_one_partition_are_tasks_of_their_own(spark):
    one = spark.range(10).coalesce(1).localCheckpoint()
    parts = one.mapInArrow(lambda batches: batches, "id long").union(one.mapInArrow(lambda batches: batches, "id long"))
    with trees.separate_unions(spark):
        assert parts.select(F.spark_partition_id().alias("p")).distinct().count() == 2
