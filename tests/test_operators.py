"""Semantic traps, properties and known values of single operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.config import PanelConfig
from gridloom.functions import ordering, pvalues, scalar
from gridloom.operators import classify, cluster, eda, features, panel, spatial, stats, temporal, texture
from gridloom.schema import nan_to_null, numeric_columns, panel_schema, require_columns, resolve_columns, to_long

NAN = float("nan")


def test_nan_is_missing(spark):
    df = nan_to_null(spark.createDataFrame([(1, 1.0), (1, NAN), (1, 3.0)], "unit_id long, v double"))
    assert df.agg(F.avg("v"), F.count("v"), F.max("v")).first()[:] == (2.0, 2, 3.0)


def test_clip_keeps_null_and_zero_fill_keeps_long_codes(spark):
    df = spark.createDataFrame([(None, "7"), (0.5, "1234567"), (3.0, "00012")], "d double, code string")
    rows = df.select(scalar.at_least(F.col("d"), 1.0), scalar.zero_filled(F.col("code"))).collect()
    assert [tuple(r) for r in rows] == [(None, "00007"), (1.0, "1234567"), (3.0, "00012")]


def test_placeholders_and_zero_division(spark):
    df = spark.createDataFrame([("X",), ("-",), (" 12 ",), (None,)], "v string")
    assert [r[0] for r in df.select(scalar.number(F.col("v"))).collect()] == [None, None, 12.0, None]
    zero = spark.createDataFrame([(1.0, 0.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in zero.select(scalar.ratio(F.col("a"), F.col("b"))).collect()] == [None, None]


def test_single_row_std(spark):
    df = spark.createDataFrame([(1, 5.0), (2, None)], "unit_id long, v double")
    rows = {r.unit_id: (r.v_mean, r.v_std) for r in df.groupBy("unit_id").agg(*temporal.mean_std(["v"])).collect()}
    assert rows == {1: (5.0, 0.0), 2: (None, 0.0)}


def test_trend_needs_points_and_uses_all_rows_for_time(spark):
    rows = [(1, "2020-01-01", 1.0), (1, "2020-02-01", 2.0), (1, "2020-03-01", 3.0), (1, "2021-01-01", None), (2, "2020-01-01", 1.0), (2, "2020-02-01", 2.0)]
    df = spark.createDataFrame(rows, "unit_id long, month string, v double").withColumn("month", F.to_date("month"))
    got = {r.unit_id: r.v_slope for r in temporal.with_days(df).groupBy("unit_id").agg(*temporal.trend_slopes(["v"])).collect()}
    days, y = np.array([0, 31, 60]), np.array([1.0, 2.0, 3.0])
    assert got[2] is None and got[1] == pytest.approx(np.polyfit(days, y, 1)[0] * 366, abs=1e-6)


def test_first_value_may_be_null_and_amplitude(spark):
    rows = [(1, "2020-01-01", None), (1, "2020-02-01", 2.0), (1, "2021-01-01", 6.0)]
    df = spark.createDataFrame(rows, "unit_id long, month string, v double").withColumn("month", F.to_date("month"))
    assert df.groupBy("unit_id").agg(*temporal.first_values(["v"])).first().v is None
    assert temporal.seasonal_amplitude(df, ["v"]).first().v_seasonal_amp == 4.0


def test_coverage_gaps(spark):
    rows = [(1, "2020-01-01", 1.0), (1, "2020-02-01", None), (1, "2020-03-01", 1.0), (1, "2020-04-01", 1.0)]
    df = spark.createDataFrame(rows, "unit_id long, month string, v double").withColumn("month", F.to_date("month"))
    r = temporal.coverage(df, ["v"]).first()
    assert (r.n_total_months, r.n_valid_months, float(r.valid_pct), r.gap_count) == (4, 3, 75.0, 1)


def test_mean_of_means_differs(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (1, 1, 0.0), (1, 2, 6.0)], "k long, y int, v double")
    assert temporal.mean_of_period_means(df, "k", "y", ["v"]).first().v == 3.0


def test_joins(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    with pytest.raises(ValueError, match="not unique"):
        panel.join_many_to_one(left, spark.createDataFrame([(1, 1), (1, 2)], "k long, w int"), ["k"])
    right = spark.createDataFrame([(1, "x", 9), (None, "y", 8)], "k long, v string, w int")
    assert sorted(map(tuple, panel.join_many_to_one(left, right, ["k"]).select("v", "w").collect()), key=str) == [("a", 9), ("b", None), ("c", None)]
    assert {tuple(r) for r in panel.join_null_safe(left, right.drop("v"), ["k"]).select("v", "w").collect()} == {("a", 9), ("b", None), ("c", 8)}


def test_dedup_spine_batches(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(100)], "k long, i long")
    first = panel.keep_first(df, ["k"], ["i"])
    assert {(r.k, r.i) for r in first.collect()} == {(i, i) for i in range(7)}
    spine = panel.month_spine(spark.createDataFrame([(1,)], "unit_id long"), "2019-11-01", "2020-02-01")
    assert spine.count() == 4
    batches = panel.in_batches(df, ["i"], 30).collect()
    assert all(r.batch == r.i // 30 for r in batches)


def test_collapse_and_health(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, 3.0, 4.0)], "k long, a_x double, a_y double")
    assert [r.a for r in panel.collapse_suffixes(df).orderBy("k").collect()] == [None, 3.0]  # the left column stays, whatever it holds
    health = panel.join_health(spark.createDataFrame([(None, 1.0)] * 3, "a double, b double"), ["a", "b"]).first()
    assert health.worst_missing_share == 1.0 and not health.passes


def test_schema_helpers(spark):
    df = spark.createDataFrame([("u", "2020-01", 1.0, 5)], "unit_id string, month string, v double, year int")
    assert resolve_columns(df, ["v", "zz"]) == ["v"] and numeric_columns(df) == ["v", "year"]
    assert panel_schema(["v"]).fieldNames()[-1] == "v"
    with pytest.raises(ValueError, match="zz"):
        require_columns(df, ["zz"])


def test_correlation_of_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 4.0)], "a double, b double")
    r = eda.correlations(df, [("a", "b")]).first()
    assert r.r is None and r.n == 2


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-100, 100, allow_nan=False).map(lambda x: round(x, 3)), min_size=4, max_size=30))
def test_moments_property(spark, values):
    x = np.array(values)
    row = eda.describe(spark.createDataFrame([(v,) for v in values], "v double"), ["v"]).first()
    assert row["mean"] == pytest.approx(x.mean(), abs=1e-6) and row.q50 == pytest.approx(np.median(x), abs=1e-9)
    if x.std() > 1e-3:
        n, m2 = len(x), ((x - x.mean()) ** 2).mean()
        g1 = ((x - x.mean()) ** 3).mean() / m2**1.5
        assert row.skew == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2), rel=1e-4, abs=1e-6)


def test_scaler_round_trip(spark):
    df = spark.createDataFrame([(i, float(i * i), 4.0) for i in range(9)], "id long, v double, c double")
    p = features.scaler_parameters(df, ["v", "c"])
    scaled = features.scale(df, p)
    back = features.unscale(scaled, p).orderBy("id").collect()
    assert all(r.v == pytest.approx(r.id**2, abs=1e-4) and r.c == 4.0 for r in back)
    assert {r.c for r in scaled.collect()} == {0.0}


def test_running_sum_and_ranks(spark):
    df = spark.createDataFrame([(g, v) for g in (1, 2, None) for v in (5, 5, 1, 9)], "g long, v long")
    got = {(r.g, r.v, r.avg_rank) for r in ordering.average_ranks(df, "v", ["g"]).collect()}
    assert got == {(g, v, k) for g in (1, 2, None) for v, k in ((1, 1.0), (5, 2.5), (9, 4.0))}
    big = spark.range(1000).withColumn("x", F.lit(2))
    assert all(r.before == 2 * r.id for r in ordering.running_sum(big, ["id"], "x").collect())


def test_p_values():
    assert pvalues.chi2_sf(9.2083, 2) == pytest.approx(0.010010, abs=2e-6)
    assert pvalues.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert pvalues.f_sf(4.2565, 2, 9) == pytest.approx(0.05, abs=1e-4)
    assert pvalues.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-4)
    assert pvalues.normal_sf(1.959964) == pytest.approx(0.025, abs=1e-6)


def test_shapiro_and_wilcoxon_known_values():
    w, p = stats.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])  # a published example
    assert w == pytest.approx(0.79, abs=0.01) and p == pytest.approx(0.0067, abs=0.002)
    assert stats.wilcoxon([1, 2, 3, 4, 5]) == (0.0, 0.0625)
    assert stats.wilcoxon([0.0, 0.0]) == (0.0, 1.0)


def test_ols_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "a double, b double, y double")
    model = stats.ols(df, "y", ["a", "b"])
    xx = np.column_stack([np.ones(60), x])
    beta, rss = np.linalg.lstsq(xx, y, rcond=None)[:2]
    assert [r[1] for r in model["coefficients"]] == pytest.approx(beta.tolist())
    se = np.sqrt(rss[0] / 57 * np.diag(np.linalg.inv(xx.T @ xx)))
    assert [r[2] for r in model["coefficients"]] == pytest.approx(se.tolist())


def test_cluster_scores(spark):
    rows = [(i, float(i % 3 * 10 + i * 0.01), float(i % 3)) for i in range(30)]
    df = spark.createDataFrame([(i, x, y, i % 3) for i, x, y in rows], "id long, x double, y double, cluster int")
    s = cluster.silhouette_samples(df, ["x", "y"])
    assert s.agg(F.min("silhouette")).first()[0] > 0.9
    alone = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 1), (3, 1.1, 1)], "id long, x double, cluster int")
    assert {r.id: r.silhouette for r in cluster.silhouette_samples(alone, ["x"]).collect()}[1] == 0.0
    assert cluster.adjusted_rand(df, "cluster", "cluster").first()[0] == pytest.approx(1.0)
    assert cluster.normalised_mutual_information(df, "cluster", "cluster").first()[0] == pytest.approx(1.0)
    assert cluster.ari_of(cluster.ward_labels(np.array([[r[1], r[2]] for r in rows]), 3), np.arange(30) % 3) == 1.0


def test_k_selection_rules():
    assert cluster.primary_k([(3, 0.2351), (5, 0.2551)]) == 3  # a gain of exactly 0.02 is not enough
    assert cluster.vote({"silhouette": 4, "ch": 5, "db": 5, "gap": 5, "elbow": 4}) == 5
    assert cluster.vote({"silhouette": 5, "ch": 2, "db": 5, "gap": 2, "elbow": 3}) == 5
    assert cluster.vote({"silhouette": 8, "ch": 2, "db": 3, "gap": 2, "elbow": 4}) == 2
    assert cluster.gap_choice([(2, 0.1, 0.0), (3, 0.5, 0.1), (4, 0.55, 0.1)]) == 3
    assert cluster.elbow([2, 3, 4, 5], [100, 40, 35, 33]) == 3
    assert cluster.elbow([4, 5], [9, 3]) == 4  # fewer than three: the first


def test_k_selection_tries_all_k(spark):
    from gridloom.plans.registry import QUERIES

    rows = sorted(QUERIES["k_selection"](spark, "/root/testdata/sf0.001").collect(), key=lambda r: r.k)
    assert [r.k for r in rows] == [2, 3, 4, 5, 6, 7, 8]
    assert all(a.inertia > b.inertia for a, b in zip(rows, rows[1:], strict=False))
    assert sum(r.recommended for r in rows) == 1 and all(r.gap_se > 0 for r in rows)


@pytest.mark.parametrize("bound", [1000, 0])
def test_gap_finds_seven_clusters(spark, bound):
    rng = np.random.default_rng(0)
    rows = [(i, *(float(v) for v in (20 * np.cos(i % 7 * 0.9), 20 * np.sin(i % 7 * 0.9)) + rng.normal(size=2) * 0.2)) for i in range(210)]
    df = cluster.compact(spark.createDataFrame(rows, "id long, x double, y double"))
    counts = {"references": 50, "starts": 20} if bound else {"references": 2, "starts": 3, "reference_starts": 1}
    ks = [5, 6, 7, 8] if bound else [6, 7, 8]
    gap = cluster.gap_statistic(df, ["x", "y"], ks, bound=bound, **counts)
    assert [g[0] for g in gap] == ks and (not bound or cluster.gap_choice(gap) == 7)
    fits = cluster.best_fits(df, ["x", "y"], [7])
    own = cluster.assigned(df, ["x", "y"], fits[7]).withColumn("truth", F.col("id") % 7)
    assert cluster.adjusted_rand(own, "cluster", "truth").first()[0] == 1.0


def test_pruning_keeps_listed(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.2)], "feature_1 string, feature_2 string, r double")
    assert stats.prune_redundant(pairs, ["a", "b", "c"], keep=["a"])[0] == ["a", "c"]
    assert stats.prune_redundant(pairs, ["a", "b", "c"], keep=[], limit=0.95)[0] == ["a", "b", "c"]


def test_group_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(i, f"g{i % 11}", i % 3) for i in range(200)], "id long, g string, label int")
    folds = classify.group_folds(df, "g", "label", 4)
    assert folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert folds.count() == 200


def test_repeated_folds_differ_and_are_all_run(spark):
    df = spark.createDataFrame([(i, f"g{i // 4}", i % 3, float(i % 3)) for i in range(60)], "id long, g string, label int, x double")
    models = classify.build_models(["dummy_most_frequent"])
    for split in (classify.stratified_folds(df, "label", F.col("id"), 5, repeats=5), classify.group_folds(df, "g", "label", 5, repeats=5)):
        split = cluster.compact(split)
        names = classify.fold_columns(split)
        assert len(names) == 5
        rows = split.orderBy("id").collect()
        assert len({tuple(r[n] for r in rows) for n in names}) == 5
        out = classify.cross_validate(split, ["x"], models).groupBy("fold").agg(F.count_distinct("id").alias("n")).collect()
        assert len(out) == 25 and sum(r.n for r in out) == 5 * 60


def test_leave_one_out_fits_the_models_given(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2 * 4 + i * 0.01)) for i in range(6)], "id long, label int, x double")
    models = classify.build_models(["dummy_most_frequent", "logistic_regression"])
    got = {(r.model, r.id): (r.y_true, r.y_pred) for r in classify.leave_one_out(df, ["x"], models).collect()}
    assert len(got) == 12
    for i in range(6):  # without its own row the other class is the larger
        assert got["dummy_most_frequent", i] == (i % 2, 1 - i % 2)
        assert got["logistic_regression", i] == (i % 2, i % 2)


def test_registry_skips_absent_packages():
    made = classify.build_models(registry={"none": ("no_such_package.Model", {}), "dummy": ("gridloom.operators.classify.MostFrequent", {})})
    assert list(made) == ["dummy"]


def test_boosting_rounds_are_a_parameter(spark):
    path, params = classify.REGISTRY["gradient_boosting"]
    made = classify.build_models(["gradient_boosting"])["gradient_boosting"](10, 2, 3).made().getClassifier()
    assert (made.getMaxIter(), made.getMaxDepth()) == (100, 3)
    few = classify.build_models(registry={"few": (path, params | {"maxIter": 7})})["few"](10, 2, 3).made().getClassifier()
    assert few.getMaxIter() == 7


def test_glcm_of_a_small_window(spark):
    levels = [[0, 0, 1], [0, 1, 1], [2, 2, 2]]
    df = spark.createDataFrame([("w", r, c, v) for r, row in enumerate(levels) for c, v in enumerate(row)], "k string, row long, col long, level int")
    m = texture.glcm(df, ["k"])
    assert all(r[1] == pytest.approx(1.0) for r in m.groupBy("angle").agg(F.sum("p")).collect())
    flat = {(r.i, r.j): r.p for r in m.where("angle = 0").collect()}
    assert flat == {(0, 0): pytest.approx(2 / 12), (0, 1): pytest.approx(2 / 12), (1, 0): pytest.approx(2 / 12), (1, 1): pytest.approx(2 / 12), (2, 2): pytest.approx(4 / 12)}
    assert texture.window_texture(df.limit(4), ["k"]).count() == 0


def test_geometry(spark):
    units = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 20.0, 10.0)], "unit_id long, x double, y double")
    rings = units.select("unit_id", F.lit("g").alias("g"), spatial.rectangle(F.col("x"), F.col("y"), F.col("x") + 10, F.col("y") + 10).alias("ring"))
    edges = {(r.src, r.dst): r.w for r in spatial.queen_edges(rings, "unit_id").collect()}
    assert edges == {(1, 2): 1.0, (2, 1): 0.5, (2, 3): 0.5, (3, 2): 1.0}
    assert spatial.dissolve(rings, "g").count() == 10
    house = spark.createDataFrame([(1,)], "id long").select("id", spatial.rectangle(F.lit(8.0), F.lit(1.0), F.lit(12.0), F.lit(3.0)).alias("ring"))
    got = {r.unit_id: (r.building_count, r.built_area, r.built_ratio) for r in spatial.covered(rings.drop("g"), house, "unit_id", 10.0).collect()}
    assert got == {1: (1, 4.0, 0.04), 2: (1, 4.0, 0.04), 3: (0, 0.0, 0.0)}


def test_osm_ways(spark):
    rows = [("node", i, float(y), float(x), None) for i, (x, y) in enumerate([(0, 0), (2, 0), (2, 2), (0, 2)])] + [("way", 9, None, None, [0, 1, 2, 3, 0]), ("way", 8, None, None, [0, 1, 0]), ("relation", 7, None, None, [0, 1, 2, 3])]
    got = spatial.ways_to_rings(spark.createDataFrame(rows, "type string, id long, lat double, lon double, nodes array<long>")).select("id", spatial.area(F.col("ring")).alias("a")).collect()
    assert [(r.id, r.a) for r in got] == [(9, 4.0)]


def test_long_form_keeps_null(spark):
    df = spark.createDataFrame([(1, 1.0, None)], "id long, a double, b double")
    assert to_long(df, ["id"], ["a", "b"]).count() == 2


def test_migration_golden_rows(spark):
    """Two published rows of the census chain."""
    rows = [("05201", 315814, 34916, 186207, 88713, 307672, 32809, 172755, 95949), ("05202", 54730, 5058, 28184, 20248, 49968, 4231, 24953, 20765)]
    names = [f"{c}_{y}" for y in (2015, 2020) for c in ("pop_total", "age_u15", "age_15_64", "age_65_plus")]
    df = spark.createDataFrame(rows, "muni_code string, " + ", ".join(f"{n} long" for n in names))
    got = panel.intercensal_change(df).orderBy("muni_code").select("pop_change", "pop_change_pct", "working_age_change", "working_age_change_pct", "youth_change", "elderly_change").collect()
    assert [tuple(r) for r in got] == [(-8142, -0.0258, -13452, -0.0722, -2107, 7236), (-4762, -0.087, -3231, -0.1146, -827, 517)]


def test_target_golden_rows(spark):
    """Published ratios with their classes: low ratios are stable. The census row of 05202 gives 20765 / 49968."""
    rows = [("02411", 0.2525), ("02423", 0.362654), ("05210", 0.371893), ("05202", 20765 / 49968), ("02441", 0.416539), ("02304", 0.424016), ("02303", 0.5527), ("none", None), ("zero", float("inf")), ("edge", 0.37), ("top", 0.42)]
    df = spark.createDataFrame(rows, "unit string, elderly_ratio double")
    got = {r.unit: (r.target_class, r.target_code) for r in features.build_target(df, "elderly_ratio", PanelConfig().target_thresholds).collect()}
    assert got == {"02411": ("stable", 0), "02423": ("stable", 0), "05210": ("shrinking", 1), "05202": ("shrinking", 1), "02441": ("shrinking", 1), "02304": ("severely_shrinking", 2), "02303": ("severely_shrinking", 2), "edge": ("shrinking", 1), "top": ("severely_shrinking", 2)}


def test_exact_quantiles_against_numpy(spark):
    rng = np.random.default_rng(4)
    rows = [(g, float(rng.choice([1, 2, 5, rng.normal()]))) for g in ("a", "b", None) for _ in range(137)] + [("c", 3.0), ("d", None)]
    at = (0.0, 0.025, 0.25, 0.5, 0.9, 1.0)
    got = {r.g: r.q for r in ordering.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", at, ["g"]).collect()}
    assert set(got) == {"a", "b", None, "c"}
    for g in got:
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g], at).tolist())
    alone = ordering.exact_quantiles(spark.createDataFrame(rows, "g string, v double"), "v", (0.5,)).first().q
    assert alone[0] == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_places(spark):
    rows = ordering.placed(spark.range(500).select((F.col("id") * 37 % 500).alias("v")), ["v"]).collect()
    assert len(rows) == 500 and all(r.place == r.v for r in rows)


def test_ranks_are_gathered_by_tasks_that_grow_in_number(spark, monkeypatch):
    kept, plain = [], eda.cut
    monkeypatch.setattr(eda, "PER_TASK", 50)
    monkeypatch.setattr(eda, "cut", lambda df: kept.append(plain(df)) or kept[-1])
    df = spark.createDataFrame([(float(i % 17), float(i * 7 % 23)) for i in range(200)], "a double, b double")
    a, b = (np.array([r[c] for r in df.collect()]) for c in (0, 1))
    rank = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    assert eda.spearman(df, [("a", "b")]).first().r == pytest.approx(np.corrcoef(rank(a), rank(b))[0, 1])
    assert kept[-1].count() == 200 and kept[-1].rdd.getNumPartitions() == 8  # 400 ranks, 50 a task


def test_spearman_with_gaps(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(80, 3)), 1)
    x[rng.random((80, 3)) < 0.15] = np.nan
    x[:, 2] = np.round(rng.normal(size=80), 1)
    df = nan_to_null(spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double"))
    ranks = lambda v: np.array([(v < t).sum() + ((v == t).sum() + 1) / 2 for t in v])
    for r in eda.spearman(df, [("a", "b"), ("a", "c"), ("b", "c")]).collect():
        i, j = "abc".index(r.feature_1), "abc".index(r.feature_2)
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r.n == both.sum() and r.r == pytest.approx(np.corrcoef(ranks(x[both, i]), ranks(x[both, j]))[0, 1])


def test_pruning_rules(spark):
    names = ["a", "b", "c", "d", "flat"]
    pairs = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9), ("b", "c", 0.2), ("c", "d", 0.9 + 5e-7), ("a", "d", 0.1), ("b", "d", -0.1)], "feature_1 string, feature_2 string, r double")
    left, gone = stats.prune_redundant(pairs, names, keep=[], constant=["flat"])
    assert gone[0] == ("flat", "near-constant", 0.0)
    assert [g[0] for g in gone[1:]] == ["c", "a"] and left == ["b", "d"]  # (c, d) is the last first column; c means more
    tied = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.9)], "feature_1 string, feature_2 string, r double")
    assert stats.prune_redundant(tied, ["a", "b", "c"], keep=["a"])[1][0][0] == "b"  # the first second column
    df = spark.createDataFrame([(1.0, 5.0), (1.01, 9.0)], "x double, y double")
    assert stats.near_constant(df, ["x", "y"]) == ["x"]


def test_slope_agreement_needs_three(spark):
    slopes = spark.createDataFrame([(i, float(i), float(i % 2)) for i in range(5)], "unit_id long, a_slope double, b_slope double")
    p = features.scaler_parameters(slopes, ["a_slope", "b_slope"])
    scaled = features.scale(slopes, p).withColumn("b_slope", F.when(F.col("unit_id") < 2, F.col("b_slope")))
    got = {r.slope_feature: (r.pearson_r, r.n_valid) for r in stats.slope_agreement(slopes, scaled, p, ["a_slope", "b_slope", "absent"]).collect()}
    assert got == {"a_slope": (1.0, 5), "b_slope": (None, 2)}


def test_qq_points(spark):
    from statistics import NormalDist

    rows = stats.qq_points(spark.createDataFrame([(3.0,), (1.0,), (None,), (2.0,)], "v double"), "v").orderBy("place").collect()
    assert [r.place for r in rows] == [1, 2, 3] and [r.observed for r in rows] == [-1.0, 0.0, 1.0]
    assert [r.theoretical for r in rows] == pytest.approx([NormalDist().inv_cdf((i + 0.5) / 3) for i in range(3)], abs=1e-9)


def test_rescaling(spark):
    df = spark.createDataFrame([("g", 1.0, 4.0), ("g", 3.0, 4.0), ("h", None, 9.0), ("h", 5.0, 7.0)], "g string, v double, c double")
    rows = {(r.g, r.c): r for r in eda.min_max(df, ["v"]).collect()}
    assert rows["h", 7.0].v == 1.0 and rows["h", 9.0].v is None
    flat = eda.min_max(df, ["c"], ["g"]).where("g = 'g'").collect()
    assert {r.c for r in flat} == {0.5}
    z = eda.standardised(df, ["c", "v"], ["g"]).collect()
    assert sorted(r.c for r in z if r.g == "g") == [0.0, 0.0] and sorted(round(r.c, 6) for r in z if r.g == "h") == [-0.707107, 0.707107]


def test_neighbour_votes_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cluster.tile_pairs, "__defaults__", (16,))
    rng = np.random.default_rng(5)
    x, y = np.round(rng.normal(size=(90, 2)), 1), rng.integers(0, 3, 90)
    df = spark.createDataFrame([(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))], "id long, label int, a double, b double")
    got = {r.id: int(r.prediction) for r in classify.neighbour_votes(df, df, ["a", "b"], 5, skip_same=True).collect()}
    for i in range(90):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        near = sorted((round(d[j], 9), j) for j in range(90) if j != i)[:5]
        voters = [(1.0, j) for v, j in near if v == 0] or [(1 / v, j) for v, j in near]
        sums = {c: sum(w for w, j in voters if y[j] == c) for c in set(y[[j for _, j in voters]])}
        best = max(sums.values())
        assert got[i] in {c for c, s in sums.items() if s == pytest.approx(best)}


@pytest.mark.parametrize("bound", [1000, 0])
def test_stability_beyond_the_bound(spark, bound):
    rng = np.random.default_rng(1)
    rows = [(i, *(float(v) for v in rng.normal(size=2) * 0.2 + [10 * (i % 3), 5 * (i % 2)])) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    made = cluster.bootstrap_stability(df, ["x", "y"], 3, replicates=3, starts=4, bound=bound).collect()
    assert len(made) == 3 and all(r.ari > 0.9 for r in made)
    gone = {r.feature: (r.ari, r.fraction_changed) for r in cluster.perturbation_stability(df, ["x", "y"], 3, starts=4, bound=bound).collect()}
    assert gone["y"][0] == pytest.approx(1.0) and gone["x"][0] < 0.5


def test_shapley_values_add_up(spark):
    df = spark.createDataFrame([(i, i % 2, float(i % 2), float(i % 5)) for i in range(40)], "id long, label int, a double, b double")
    model = classify.build_models(["random_forest"])["random_forest"](40, 2, 2).fit(cluster.as_vector(df, ["a", "b"]))
    got = {r.feature: r.mean_abs_shap for r in classify.shapley(df, ["a", "b"], model).collect()}
    assert got["a"] > 0.2 > got["b"]


def test_pca_against_numpy(spark):
    x = np.random.default_rng(2).normal(size=(70, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double, c double")
    values, loadings = cluster.pca(df, ["a", "b", "c"])
    want, vectors = np.linalg.eigh(np.cov(x.T))
    assert values == pytest.approx(want[::-1])
    assert np.abs(loadings.T @ vectors[:, ::-1]) == pytest.approx(np.eye(3), abs=1e-8)
    scored = cluster.scores(df, ["a", "b", "c"], loadings, 2)
    top = max(abs(v) for r in scored.collect() for v in (r.pc1, r.pc2))
    arrows = {r.feature: (r.x, r.y) for r in cluster.biplot(scored, loadings, ["a", "b", "c"]).collect()}
    assert arrows["b"] == pytest.approx((loadings[1, 0] * top * 0.8, loadings[1, 1] * top * 0.8))


def test_vif_against_regressions(spark):
    x = np.random.default_rng(6).normal(size=(80, 3))
    x[:, 2] = x[:, 0] + 0.3 * x[:, 1] + 0.2 * x[:, 2]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    got = stats.vif(df, ["a", "b", "c"])
    for j, c in enumerate("abc"):
        rest = np.column_stack([np.ones(80), np.delete(x, j, 1)])
        e = x[:, j] - rest @ np.linalg.lstsq(rest, x[:, j], rcond=None)[0]
        assert got[c] == pytest.approx(((x[:, j] - x[:, j].mean()) ** 2).sum() / (e @ e))


def ring_columns(spark, rows, names):
    kinds = ", ".join(f"{n} array<struct<x:double,y:double>>" for n in names)
    return spark.createDataFrame([tuple([{"x": float(x), "y": float(y)} for x, y in r] for r in row) for row in rows], kinds)


def inside(ring, x, y):
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            hit = not hit
    return hit


def test_contains_and_intersects(spark):
    ring = [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)]
    others = [[(2.5, 4), (3.5, 4), (3, 5)], [(1, 1), (2, 1), (2, 2)], [(-9, -9), (20, -9), (20, 20), (-9, 20)], [(6, 0), (8, 0), (8, 1)], [(5, 5), (9, 5), (9, 9)], [(7, 7), (9, 7), (9, 9)]]
    df = ring_columns(spark, [(ring, o) for o in others], "ab")
    assert [r[0] for r in df.select(spatial.intersects(F.col("a"), F.col("b"))).collect()] == [False, True, True, True, True, False]
    points = [(x / 4 + 0.06, y / 4 + 0.06) for x in range(28) for y in range(28)]
    pixels = spark.createDataFrame([tuple(map(float, p)) for p in points], "x double, y double")
    found = spatial.pixels_in_rings(pixels, df.limit(1).select(F.lit(1).alias("u"), F.col("a").alias("ring")), "ring", 2.0)
    assert {(r.x, r.y) for r in found.collect()} == {p for p in points if inside(ring, *p)}
    corner = df.limit(1).select(spatial.contains(F.col("a"), F.lit(0.0), F.lit(0.0)), spatial.contains(F.col("a"), F.lit(6.0), F.lit(1.0))).first()
    assert tuple(corner) == (True, False)


def test_simplify_against_recursion():
    def keep(points, a, b, tolerance):
        if b - a < 2:
            return set()
        d = points[b] - points[a]
        rel = points[a + 1 : b] - points[a]
        length = np.hypot(*d)
        off = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / length if length else np.hypot(rel[:, 0], rel[:, 1])
        if off.max() <= tolerance:
            return set()
        at = a + 1 + int(off.argmax())
        return {at} | keep(points, a, at, tolerance) | keep(points, at, b, tolerance)

    rng = np.random.default_rng(8)
    n = np.array([40, 1, 0, 2, 90])
    points = rng.normal(size=(n.sum(), 2)).cumsum(0)
    starts = np.cumsum(n) - n
    mark = spatial.kept_points(points, starts, n, 1.5)
    for s, k in zip(starts, n, strict=True):
        want = {int(s), int(s + k - 1)} | keep(points, s, s + k - 1, 1.5) if k else set()
        assert set(np.flatnonzero(mark[s : s + k]) + s) == want


def lattice(spark, n=6):
    cells = [(i * n + j, float(i), float(j)) for i in range(n) for j in range(n)]
    units = spark.createDataFrame(cells, "unit_id long, x double, y double")
    return units.select("unit_id", spatial.rectangle(F.col("x"), F.col("y"), F.col("x") + 1, F.col("y") + 1).alias("ring"))


def test_spatial_models_recover_the_lag(spark):
    rings = lattice(spark, 9)
    edges = cluster.compact(spatial.queen_edges(rings, "unit_id"))
    w = np.zeros((81, 81))
    for r in edges.collect():
        w[r.src, r.dst] = r.w
    rng = np.random.default_rng(9)
    x = rng.normal(size=81)
    y = np.linalg.solve(np.eye(81) - 0.6 * w, 1 + 2 * x + 0.1 * rng.normal(size=81))
    values = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "unit_id long, y double, x double")
    made = spatial.spatial_models(values, edges, "unit_id", "y", ["x"])
    models = {r.model: r for r in made["models"].collect()}
    assert models["lag"].best and models["lag"].parameter == pytest.approx(0.6, abs=0.05)
    own = {r.name: r.coef for r in made["coefficients"].where("model = 'lag'").collect()}
    assert own["const"] == pytest.approx(1, abs=0.2) and own["x"] == pytest.approx(2, abs=0.05)
    xx = np.column_stack([np.ones(81), x])
    rss = np.linalg.lstsq(xx, y, rcond=None)[1][0]
    assert models["ols"].log_likelihood == pytest.approx(-81 / 2 * (np.log(2 * np.pi * rss / 81) + 1))
    assert {r.test: r.p_value < 0.01 for r in made["tests"].collect()}["lm_lag"]
    with pytest.raises(ValueError, match="more than 10 units"):
        spatial.spatial_models(values, edges, "unit_id", "y", ["x"], bound=10)


@pytest.mark.parametrize(("bound", "permutations"), [(1000, 199), (0, 4)])
def test_moran_permutations(spark, bound, permutations):
    rings = lattice(spark)
    values = spark.createDataFrame([(i, float(i // 6)) for i in range(36)], "unit_id long, v double")
    edges = cluster.compact(spatial.queen_edges(rings, "unit_id"))
    r = spatial.moran_permutation(values, edges, "unit_id", "v", permutations=permutations, bound=bound).first()
    assert r.i == pytest.approx(spatial.morans_i(values, edges, "unit_id", "v").first().i)
    assert r.expected == pytest.approx(-1 / 35) and r.z_sim > 2 and r.p_sim == pytest.approx(1 / (permutations + 1))


def test_probabilities_come_out_of_cross_validation(spark):
    df = spark.createDataFrame([(i, i % 3, float(i % 3 * 4 + (i * 7 % 10) / 5)) for i in range(60)], "id long, label int, x double")
    split = classify.stratified_folds(df, "label", F.col("id"), 3)
    made = classify.cross_validate(split, ["x"], classify.build_models(["logistic_regression", "dummy_most_frequent"]))
    assert made.where("model = 'logistic_regression' AND size(probability) = 3").count() == 60
    assert made.where("model = 'dummy_most_frequent' AND probability IS NULL").count() == 60
    assert classify.auc(classify.class_roc(made, 0)).first()[0] == pytest.approx(1.0)


def test_renames(spark):
    df = spark.createDataFrame([(1, 2, 3)], "muni_code long, NDVI_stdDev long, pop long")
    assert panel.renamed(df, {"NDVI_stdDev": "NDVI_std", "absent": "x"}).columns == ["muni_code", "NDVI_std", "pop"]
    assert panel.suffixed(df, ["muni_code"], "2020").columns == ["muni_code", "NDVI_stdDev_2020", "pop_2020"]


def test_one_against_the_rest_without_a_class(spark):
    rows = [(i, float(i % 2 * 2), float(i % 2 * 6 + i * 0.01), 1.0) for i in range(20)]
    df = cluster.as_vector(spark.createDataFrame(rows, "id long, label double, x double, y double"), ["x", "y"])
    model = classify.linear_svm(maxIter=50).fit(df)
    assert all(r.prediction == r.label for r in model.transform(df).collect())
    alone = classify.linear_svm(maxIter=50).fit(df.where("label = 2"))
    assert {r.prediction for r in alone.transform(df).collect()} == {2.0}


def test_moments_of_many_columns(spark):
    x = np.random.default_rng(3).normal(size=(50, 16)) + np.arange(16)
    names = [f"v{i}" for i in range(16)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, *[0.0] * 15)], ", ".join(f"{n} double" for n in names)).repartition(4)
    cov, means, n = stats.moments(df, names)
    assert n == 50 and means == pytest.approx(x.mean(0)) and cov == pytest.approx(np.cov(x.T, bias=True))
    few = stats.moments(df, names[:3])
    assert few[0] == pytest.approx(cov[:3, :3])


def test_many_pairs_with_and_without_gaps(spark):
    x = np.random.default_rng(11).normal(size=(60, 16))
    x[:, 3] = 2.0
    x[::7, 5] = np.nan
    names = [f"v{i}" for i in range(16)]
    df = nan_to_null(spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names)))
    rows = eda.correlation_matrix(df, names).collect()
    assert len(rows) == 120
    for r in rows:
        i, j = int(r.feature_1[1:]), int(r.feature_2[1:])
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        assert r.n == both.sum()
        assert r.r is None if 3 in (i, j) else r.r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1])


def test_maximal_correlation(spark):
    """Against the eigenvalues of Q, built entry by entry."""
    rng = np.random.default_rng(4)
    pixels = [("w", int(r), int(c), int(v)) for (r, c), v in np.ndenumerate(rng.integers(0, 5, (9, 9)))] + [("flat", r, c, 1) for r in range(3) for c in range(3)]
    matrix = texture.glcm(spark.createDataFrame(pixels, "window string, row long, col long, level int"), ["window"])
    got = {r.window: r.maxcorr for r in texture.maximal_correlation(matrix, ["window"]).collect()}
    found = []
    for angle in (0, 45, 90, 135):
        p = np.zeros((5, 5))
        for r in matrix.where(f"window = 'w' AND angle = {angle}").collect():
            p[r.i, r.j] = r.p
        margin = p.sum(1)
        q = np.array([[sum(p[i, k] * p[j, k] / (margin[i] * margin[k]) for k in range(5)) for j in range(5)] for i in range(5)])
        found.append(np.sqrt(sorted(np.linalg.eigvals(q).real)[-2]))
    assert got["w"] == pytest.approx(np.mean(found)) and got["flat"] == 0.0
    assert {*texture.HARALICK, "maxcorr"} <= set(texture.haralick(matrix, ["window"]).columns)  # all 18


def test_rings_that_intersect_are_tested_once_for_all_copies(spark, monkeypatch):
    from gridloom.operators import spatial

    seen = []
    real = spatial.box_join
    monkeypatch.setattr(spatial, "box_join", lambda a, b, *rest: (seen.append((a.count(), b.count())), real(a, b, *rest))[1])
    rows = lambda n, at, s: spark.range(n).select("id", spatial.rectangle(F.lit(at), F.lit(at), F.lit(at + s), F.lit(at + s)).alias("ring"))
    a, b = rows(30, 0.0, 2.0).withColumnRenamed("ring", "ra"), rows(20, 1.0, 2.0).toDF("unit", "rb")
    met = spatial.polygon_join(a, b, "ra", "rb", 1.0)
    assert met.columns == ["id", "ra", "unit", "rb"] and met.count() == 600 and met.select("id", "unit").distinct().count() == 600
    assert seen == [(1, 1)]


def test_zonal_means_meet_each_place_and_ring_once(spark, monkeypatch):
    from gridloom.operators import spatial

    seen = []
    real = spatial.pixels_in_rings
    monkeypatch.setattr(spatial, "pixels_in_rings", lambda p, u, *rest: (seen.append((p.count(), u.count())), real(p, u, *rest))[1])
    units = spark.range(12).select(F.col("id").alias("unit"), spatial.rectangle(F.col("id") % 2 * 4, F.lit(0), F.col("id") % 2 * 4 + 4, F.lit(4)).alias("ring"))
    pixels = spark.range(90).select((F.col("id") % 3 * 3 + 0.5).alias("x"), F.lit(1.0).alias("y"), F.when(F.col("id") > 2, F.col("id")).cast("double").alias("v"))
    out = {r["unit"]: (r["n"], r["mean"]) for r in spatial.zonal_mean(pixels, units, "unit", "ring", "v", 2.0).collect()}
    ids = [[i for i in range(90) if i % 3 in kinds] for kinds in ((0, 1), (2,))]
    assert seen == [(3, 2)] and len(out) == 12
    for unit, (n, mean) in out.items():
        want = ids[unit % 2]
        assert n == len(want) and mean == pytest.approx(np.mean([i for i in want if i > 2]))


def test_neighbourhoods_are_dealt_by_bands_into_partitions_that_grow_with_the_pixels(spark, monkeypatch):
    from gridloom.operators import texture

    monkeypatch.setattr(texture, "BAND", 4)
    monkeypatch.setattr(texture, "PIXELS", 20)
    pixels = spark.range(15 * 9).select(F.lit(1).alias("w"), F.floor(F.col("id") / 9).alias("row"), (F.col("id") % 9).alias("col"), (F.col("id") * 7 % 23).cast("double").alias("v"))
    sent = texture.neighbourhood(pixels, ["w"], "v")
    assert sent.rdd.getNumPartitions() == 7
    got = {(r["row"], r["col"]): r["focal_std"] for r in texture.focal_std(pixels, ["w"], "v").collect()}
    grid = (np.arange(15 * 9) * 7 % 23).reshape(15, 9).astype(float)
    assert len(got) == grid.size
    for (r, c), value in got.items():
        assert value == pytest.approx(grid[max(r - 1, 0) : r + 2, max(c - 1, 0) : c + 2].std())


def test_moran_permutations_leave_the_edges_on_the_cluster(spark, monkeypatch):
    """Edges do not come to the driver, and a permutation deals the values as numpy does from its seed."""
    monkeypatch.setattr(spatial, "cross_section", None)
    monkeypatch.setattr(spatial, "EDGES", 50)
    v = np.random.default_rng(3).normal(size=36)
    values = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "unit_id long, v double")
    edges = cluster.compact(spatial.queen_edges(lattice(spark), "unit_id"))
    r = spatial.moran_permutation(values, edges, "unit_id", "v", permutations=20).first()
    rows, z = edges.collect(), v - v.mean()
    src, dst, w = (np.array([e[c] for e in rows]) for c in ("src", "dst", "w"))
    of = lambda y: 36 / w.sum() * (w * y[src] * y[dst]).sum() / (z @ z)
    drawn = np.array([of(np.random.default_rng(42 + p).permutation(z)) for p in range(20)])
    assert r.i == pytest.approx(of(z)) and r.z_sim == pytest.approx((of(z) - drawn.mean()) / drawn.std())


def test_permutations_are_scored_together_and_pair_hash_orders(spark):
    class Model:
        calls = 0

        def transform(self, d):
            Model.calls += 1
            x = vector_to_array("features")
            return d.withColumn("prediction", (x[0] + x[1] / 10 > 1).cast("int"))

    from pyspark.ml.functions import vector_to_array

    rows = [(i, i % 2, float(i % 2 * 2), float(i * 7 % 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, label int, a double, b double")
    found = {(r.feature, r.repeat): r["drop"] for r in classify.permutation_importance(df, ["a", "b"], Model(), repeats=3).collect()}
    assert Model.calls == 2 and len(found) == 6
    for (c, r), drop in found.items():
        own = df.select("id", F.xxhash64("id", F.lit(42 + r)).alias("h"), F.xxhash64("id", F.lit(c), F.lit(42 - r - 1)).alias("g")).collect()
        to, other = [k.id for k in sorted(own, key=lambda k: (k.h, k.id))], [k.id for k in sorted(own, key=lambda k: (k.g, k.id))]
        dealt = {t: rows[o]["ab".index(c) + 2] for t, o in zip(to, other, strict=True)}
        guess = lambda i, a, b: int(a + b / 10 > 1) == rows[i][1]
        hits = [guess(i, dealt[i], rows[i][3]) if c == "a" else guess(i, rows[i][2], dealt[i]) for i in range(40)]
        base = [guess(i, *rows[i][2:]) for i in range(40)]
        assert drop == pytest.approx((sum(base) - sum(hits)) / 40)


def test_ward_rounds_give_the_clusters_of_one_by_one_merging(spark):
    k, rng = 4, np.random.default_rng(4)
    x = np.r_[rng.normal(0, 1, (16, 2)), rng.normal(6, 1, (14, 2)), [[40.0, 40.0], [41.5, 40.0], [80.0, -5.0]]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    got = {r.id: r.cluster for r in cluster.ward(df, ["a", "b"], k, bound=12).collect()}
    want = cluster.ward_labels(x, k)
    assert len(got) == len(x) and len(set(got.values())) == k
    assert cluster.ari_of(want, np.array([got[i] for i in range(len(x))])) == 1.0


def test_ward_merges_against_one_by_one():
    x = np.random.default_rng(8).normal(size=(60, 3))
    groups, want = [[i] for i in range(60)], []
    while len(groups) > 1:
        costs = {(i, j): len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum() for i, a in enumerate(groups) for j, b in enumerate(groups[:i])}
        i, j = min(costs, key=costs.get)
        want.append(costs[i, j])
        groups[j] += groups.pop(i)
    made = sorted(cluster.ward_merges(x, np.ones(60)))
    assert [m[0] for m in made] == pytest.approx(want) and len({m[1] for m in made}) == 59


def test_ward_compares_equal_points_once_and_only_clusters_that_changed(spark, monkeypatch):
    x, compared = np.random.default_rng(9).normal(size=(60, 2)), []
    real = cluster.tile_pairs
    monkeypatch.setattr(cluster, "tile_pairs", lambda a, *rest: (compared.append(a.count()), real(a, *rest))[1])
    rows = [(i + 60 * c, float(a), float(b)) for c in range(5) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = {r.id: r.cluster for r in cluster.ward(df, ["a", "b"], 3, bound=20).collect()}
    assert compared[0] == 60 and len(compared) > 1 and max(compared[1:]) < 40
    assert len(got) == 300 and all(got[i] == got[i % 60] for i in got)
    want = cluster.joined_labels(60, sorted(cluster.ward_merges(x, np.full(60, 5.0)))[:57])
    assert cluster.ari_of(want, np.array([got[i] for i in range(60)])) == 1.0
    few = {r.id: r.cluster for r in cluster.ward(df.where("id % 60 < 2"), ["a", "b"], 4).collect()}
    assert len(few) == 10 and len(set(few.values())) == 4
