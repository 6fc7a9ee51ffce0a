"""Clustering, classification and their metrics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.operators import classify, cluster, features, stats
from gridloom.plans.base import LONG, POINTS, XS, cross, points, query, rounded


def _labelled(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.col("label").alias("cluster"), *XS)


def _square(a: str, b: str) -> str:
    return " + ".join(f"({a}.{x} - {b}.{x}) ^ 2" for x in XS)


@query(f"""WITH {POINTS}, n AS (SELECT label, count(*) AS n FROM pts GROUP BY 1),
    d AS (SELECT a.id, a.label AS own, b.label AS c, sum(sqrt({_square('a', 'b')})) AS t FROM pts a, pts b GROUP BY 1, 2, 3),
    s AS (SELECT id, own, max(CASE WHEN own = c THEN t / nullif(n - 1, 0) END) AS a, max(CASE WHEN own = c THEN n END) AS size, min(CASE WHEN own <> c THEN t / n END) AS b FROM d JOIN n ON n.label = c GROUP BY 1, 2)
    SELECT id, own AS cluster, round(CASE WHEN size = 1 THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END, 5) AS silhouette FROM s""")
def silhouette_euclidean(spark, sf_dir):
    """Per point, by pairs of tiles."""
    return rounded(cluster.silhouette_samples(_labelled(spark, sf_dir), XS), 5)


MOMENTS = f"{POINTS}, c AS (SELECT label, count(*) AS n, {', '.join(f'avg({x}) AS m_{x}' for x in XS)} FROM pts GROUP BY 1)"
WITHIN = " + ".join(f"(pts.{x} - m_{x}) ^ 2" for x in XS)


@query(f"""WITH {MOMENTS}, g AS (SELECT {', '.join(f'avg({x}) AS g_{x}' for x in XS)} FROM pts),
    w AS (SELECT sum({WITHIN}) AS ssw, count(*) AS n FROM pts JOIN c USING (label)), b AS (SELECT sum(n * ({' + '.join(f'(m_{x} - g_{x}) ^ 2' for x in XS)})) AS ssb, count(*) AS k FROM c, g)
    SELECT round((ssb / (k - 1)) / (ssw / (n - k)), 5) AS calinski_harabasz FROM w, b""")
def calinski_harabasz(spark, sf_dir):
    """M17."""
    return rounded(cluster.calinski_harabasz(_labelled(spark, sf_dir), XS), 5)


@query(f"""WITH {MOMENTS}, s AS (SELECT label, avg(sqrt({WITHIN})) AS s FROM pts JOIN c USING (label) GROUP BY 1), cs AS (SELECT * FROM c JOIN s USING (label)),
    r AS (SELECT a.label, max((a.s + b.s) / sqrt({' + '.join(f'(a.m_{x} - b.m_{x}) ^ 2' for x in XS)})) AS worst FROM cs a JOIN cs b ON a.label <> b.label GROUP BY 1)
    SELECT round(avg(worst), 5) AS davies_bouldin FROM r""")
def davies_bouldin(spark, sf_dir):
    """M17."""
    return rounded(cluster.davies_bouldin(_labelled(spark, sf_dir), XS), 5)


@query(f"WITH {MOMENTS} SELECT round(sum({WITHIN}), 4) AS inertia FROM pts JOIN c USING (label)")
def inertia(spark, sf_dir):
    """M17."""
    return rounded(cluster.within_between(_labelled(spark, sf_dir), XS).select(F.col("ssw").alias("inertia")), 4)


TWO = f"{POINTS}, uv AS (SELECT label AS u, CASE WHEN x0 > 0.1 THEN 0 WHEN x1 > 0 THEN 1 ELSE label END AS v FROM pts), t AS (SELECT u, v, CAST(count(*) AS DOUBLE) AS c FROM uv GROUP BY 1, 2)"


def _two(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.col("label").alias("u"), F.when(F.col("x0") > 0.1, 0).when(F.col("x1") > 0, 1).otherwise(F.col("label")).alias("v"))


@query(f"""WITH {TWO}, s AS (SELECT sum(c * (c - 1) / 2) AS s, sum(c) AS n FROM t), a AS (SELECT sum(c * (c - 1) / 2) AS a FROM (SELECT sum(c) AS c FROM t GROUP BY u)), b AS (SELECT sum(c * (c - 1) / 2) AS b FROM (SELECT sum(c) AS c FROM t GROUP BY v))
    SELECT round((s - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 6) AS ari FROM s, a, b""")
def adjusted_rand_index(spark, sf_dir):
    """M21."""
    return rounded(cluster.adjusted_rand(_two(spark, sf_dir), "u", "v"))


@query(f"""WITH {TWO}, n AS (SELECT sum(c) AS n FROM t), h AS (SELECT -sum(c / n * ln(c / n)) AS h FROM t, n), a AS (SELECT -sum(c / n * ln(c / n)) AS a FROM (SELECT sum(c) AS c FROM t GROUP BY u), n), b AS (SELECT -sum(c / n * ln(c / n)) AS b FROM (SELECT sum(c) AS c FROM t GROUP BY v), n)
    SELECT round(2 * (a + b - h) / (a + b), 6) AS nmi FROM h, a, b""")
def nmi(spark, sf_dir):
    """M21."""
    return rounded(cluster.normalised_mutual_information(_two(spark, sf_dir), "u", "v"))


@query(f"WITH {POINTS} SELECT label AS cluster, count(*) AS size, " + ", ".join(f"round(avg({x}), 6) AS {x}_mean, round(stddev_samp({x}), 6) AS {x}_std, floor(median({x}) * 1000000 + 0.25) / 1000000 AS {x}_median" for x in XS) + " FROM pts GROUP BY 1")
def cluster_profiles(spark, sf_dir):
    """A24, A25. A median of two values of six digits has seven, the last a 5: it is cut where no value lies."""
    out = cluster.profiles(_labelled(spark, sf_dir), XS)
    middle = {f"{x}_median": F.floor(F.col(f"{x}_median") * 1000000 + 0.25) / 1000000 for x in XS}
    return out.withColumns({f"{x}_{s}": F.round(f"{x}_{s}", 6) for x in XS for s in ("mean", "std")} | middle)


@query(f"WITH {POINTS}, m AS (SELECT label AS cluster, {', '.join(f'avg({x}) AS {x}' for x in XS)} FROM pts GROUP BY 1) SELECT cluster, " + ", ".join(f"round(({x} - avg({x}) OVER ()) / stddev_samp({x}) OVER (), 5) AS {x}" for x in XS) + " FROM m")
def profile_heatmap(spark, sf_dir):
    """Data of the profile heatmap: cluster means, standardised."""
    return rounded(cluster.profile_heatmap(_labelled(spark, sf_dir), XS), 5)


@query(f"WITH {POINTS}, r AS (SELECT id, label AS cluster, " + ", ".join(f"(x{i} - min(x{i}) OVER ()) / (max(x{i}) OVER () - min(x{i}) OVER ()) AS x{i}" for i in range(64)) + f" FROM pts) SELECT id, cluster, feature, round(value, 6) AS value FROM r UNPIVOT (value FOR feature IN ({', '.join(XS)}))")
def parallel_coordinates(spark, sf_dir):
    """Data of the parallel coordinates: every column between 0 and 1."""
    return rounded(cluster.parallel_coordinates(_labelled(spark, sf_dir), XS))


@query(f"WITH {POINTS}, w AS (SELECT id, label AS cluster, round(x0, 6) AS silhouette FROM pts) SELECT id, cluster, silhouette, row_number() OVER (ORDER BY cluster, silhouette, id) - 1 AS place FROM w")
def silhouette_order(spark, sf_dir):
    """Places of samples in a silhouette plot (here of a column of the points)."""
    return cluster.silhouette_order(_labelled(spark, sf_dir).select("id", "cluster", F.col("x0").alias("silhouette")))


@query()
def pca_biplot(spark, sf_dir):
    """Arrow ends of the biplot."""
    df = points(spark, sf_dir)
    _, loadings = cluster.pca(df, XS)
    return cluster.biplot(cluster.scores(df, XS, loadings, 2), loadings, XS)


@query(f"WITH {TWO} SELECT u, " + ", ".join(f"count(CASE WHEN v = {v} THEN 1 END) AS \"{v}\"" for v in range(3)) + " FROM uv GROUP BY 1")
def crosstab_pivot(spark, sf_dir):
    """A23."""
    return cluster.crosstab(_two(spark, sf_dir), "u", "v", [0, 1, 2])


@query(f"WITH {TWO}, c AS (SELECT u, v, count(*) AS n FROM uv GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS r FROM c) SELECT u, v AS majority, n AS votes FROM r WHERE r = 1")
def majority_vote(spark, sf_dir):
    """A29."""
    return cluster.majority(_two(spark, sf_dir), ["u"], "v")


@query(f"WITH {POINTS} SELECT label AS cluster, round(corr(x0, x1), 6) AS r, count(*) AS n FROM pts GROUP BY 1 HAVING count(*) >= 5")
def per_cluster_correlation(spark, sf_dir):
    """M34."""
    from gridloom.operators.eda import safe_corr

    per = _labelled(spark, sf_dir).groupBy("cluster").agg(safe_corr(F.col("x0"), F.col("x1")).alias("r"), F.count(F.lit(1)).alias("n"))
    return rounded(per.where("n >= 5"))


FOLDS = f"{POINTS}, pred AS (SELECT id % 5 AS fold, label AS y_true, CASE WHEN id % 7 < 4 THEN label WHEN x0 > 0 THEN (label + 1) % 10 ELSE (label * 3) % 10 END AS y_pred FROM pts)"


def _predictions(spark, sf_dir):
    p = points(spark, sf_dir)
    guess = F.when(F.col("id") % 7 < 4, F.col("label")).when(F.col("x0") > 0, (F.col("label") + 1) % 10).otherwise((F.col("label") * 3) % 10)
    return p.select("id", (F.col("id") % 5).alias("fold"), F.col("label").alias("y_true"), guess.alias("y_pred"))


@query(f"WITH {FOLDS}, c AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY 1, 2) SELECT y_true, y_pred, n, round(n / sum(n) OVER (PARTITION BY y_true), 6) AS row_share FROM c")
def confusion_matrix(spark, sf_dir):
    """A26."""
    return rounded(classify.confusion(_predictions(spark, sf_dir)))


CLASSES = f"""{FOLDS}, t AS (SELECT fold, y_true AS class, count(*) AS support, CAST(sum(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM pred GROUP BY 1, 2), p AS (SELECT fold, y_pred AS class, count(*) AS predicted FROM pred GROUP BY 1, 2),
    m AS (SELECT fold, class, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(tp, 0) AS tp FROM t FULL JOIN p USING (fold, class)),
    c AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1_score FROM m)"""


@query(f"WITH {CLASSES} SELECT fold, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM c")
def per_class_metrics(spark, sf_dir):
    """M49."""
    return rounded(classify.per_class(_predictions(spark, sf_dir), ["fold"]).drop("predicted", "tp"))


@query(f"""WITH {CLASSES}, s AS (SELECT fold, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN recall END) AS balanced_accuracy, sum(f1_score * support) / sum(support) AS f1_weighted, avg(f1_score) AS f1_macro,
    sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted, CAST(sum(support) AS DOUBLE) AS s, CAST(sum(tp) AS DOUBLE) AS c, CAST(sum(predicted * support) AS DOUBLE) AS pt, CAST(sum(predicted * predicted) AS DOUBLE) AS pp, CAST(sum(support * support) AS DOUBLE) AS tt FROM c GROUP BY 1)
    SELECT fold, {', '.join(f'round({m}, 6) AS {m}' for m in ('accuracy', 'balanced_accuracy', 'f1_weighted', 'f1_macro', 'precision_weighted', 'recall_weighted'))},
    round((accuracy - pt / (s * s)) / (1 - pt / (s * s)), 6) AS kappa, round(coalesce((c * s - pt) / nullif(sqrt((s * s - pp) * (s * s - tt)), 0), 0), 6) AS mcc FROM s""")
def fold_metrics(spark, sf_dir):
    """M48."""
    return rounded(classify.fold_metrics(_predictions(spark, sf_dir), ["fold"]))


SCORED = f"{POINTS}, sc AS (SELECT round(x0, 2) AS score, CASE WHEN label % 2 = 0 THEN 1 ELSE 0 END AS pos FROM pts), g AS (SELECT score, sum(pos) AS tp, sum(1 - pos) AS fp FROM sc GROUP BY 1), w AS (SELECT score, tp, fp, sum(tp) OVER o AS ctp, sum(fp) OVER o AS cfp, sum(tp) OVER () AS p, sum(fp) OVER () AS n FROM g WINDOW o AS (ORDER BY score DESC))"


def _roc(spark, sf_dir):
    return classify.roc_points(points(spark, sf_dir).select(F.round("x0", 2).alias("score"), (F.col("label") % 2 == 0).alias("pos")), "score", "pos")


@query(f"WITH {SCORED} SELECT score AS threshold, round(ctp / p, 6) AS tpr, round(cfp / n, 6) AS fpr FROM w")
def roc_points(spark, sf_dir):
    """ROC points."""
    return rounded(_roc(spark, sf_dir).select("threshold", "tpr", "fpr"))


@query(f"WITH {SCORED} SELECT round(sum(fp / n * (2 * ctp - tp) / 2 / p), 6) AS auc FROM w")
def roc_auc(spark, sf_dir):
    """Trapezoid area."""
    return rounded(classify.auc(_roc(spark, sf_dir)))


@query(f"WITH {POINTS} SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY (id * 31 + 7) % 1009, id) - 1) % 5 AS INTEGER) AS fold FROM pts")
def stratified_fold_assign(spark, sf_dir):
    """A place in the class's order by a portable key, modulo k."""
    p = points(spark, sf_dir).select("id", "label")
    return classify.stratified_folds(p, "label", F.struct((F.col("id") * 31 + 7) % 1009, F.col("id")))


DIST = "sqrt(" + " + ".join(f"(a.{x} - b.{x}) ^ 2" for x in XS) + ")"
VOTES = """n AS (SELECT id, label, d, row_number() OVER (PARTITION BY id ORDER BY d, other) AS r FROM m),
    v AS (SELECT id, label, sum(1 / d) AS w FROM n WHERE r <= 5 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY w DESC, label) AS r FROM v)"""


@query(f"""WITH {POINTS}, m AS (SELECT a.id, b.id AS other, b.label, {DIST} AS d FROM pts a JOIN pts b ON a.id % 5 <> b.id % 5), {VOTES}
    SELECT id, CAST(label AS INTEGER) AS prediction FROM r WHERE r = 1""")
def knn_vote(spark, sf_dir):
    """Distance-weighted vote of five neighbours, every fifth predicted from the other four."""
    p, out = cluster.as_vector(points(spark, sf_dir), XS).select("id", "label", "features"), None
    for fold in range(5):
        model = classify.Neighbours(5).fit(p.where(F.col("id") % 5 != fold))
        part = model.transform(p.where(F.col("id") % 5 == fold)).select("id", F.col("prediction").cast("int").alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""WITH {POINTS}, m AS (SELECT a.id, b.id AS other, b.label, {DIST} AS d FROM pts a JOIN pts b ON a.id <> b.id), {VOTES}
    SELECT r.id, CAST(pts.label AS INTEGER) AS y_true, CAST(r.label AS INTEGER) AS y_pred FROM r JOIN pts ON pts.id = r.id WHERE r.r = 1""")
def leave_one_out_neighbours(spark, sf_dir):
    """M47 for the nearest-neighbour vote: every point from all others."""
    return classify.leave_one_out_neighbours(points(spark, sf_dir).select("id", "label", *XS), XS)


@query(f"WITH {LONG}, s AS (SELECT feature, round(var_samp(value), 6) AS variance FROM long GROUP BY 1) SELECT feature, variance, round(sum(variance) OVER (ORDER BY variance DESC, feature) / sum(variance) OVER (), 6) AS cumulative FROM s")
def cumulative_variance(spark, sf_dir):
    """Cumulative shares over a row per feature."""
    from gridloom.schema import to_long

    v = to_long(points(spark, sf_dir), [], XS).groupBy("feature").agg(F.round(F.var_samp("value"), 6).alias("variance"))
    w = Window.orderBy(F.desc("variance"), "feature").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(v.select("feature", "variance", (F.sum("variance").over(w) / F.sum("variance").over(Window.partitionBy())).alias("cumulative")))


@query(f"""WITH {MOMENTS}, k AS (SELECT label AS k, sum({WITHIN}) AS inertia FROM pts JOIN c USING (label) GROUP BY 1), d AS (SELECT k, inertia, inertia - lag(inertia) OVER (ORDER BY k) AS d1 FROM k)
    SELECT k, round(inertia, 5) AS inertia, round(d1, 5) AS d1, round(lead(d1) OVER (ORDER BY k) - d1, 5) AS d2 FROM d""")
def second_differences(spark, sf_dir):
    """First and second differences over a row per k."""
    df = _labelled(spark, sf_dir)
    centres = df.groupBy("cluster").agg(*(F.var_pop(x).alias(x) for x in XS), F.count(F.lit(1)).alias("n"))
    total = sum((F.col(x) for x in XS[1:]), F.col("x0"))
    w = Window.orderBy("k")
    per = centres.select(F.col("cluster").alias("k"), (F.col("n") * total).alias("inertia"))
    first = per.withColumn("d1", F.col("inertia") - F.lag("inertia").over(w))
    return rounded(first.withColumn("d2", F.lead("d1").over(w) - F.col("d1")), 5)


@query()
def pca_variance(spark, sf_dir):
    """M14."""
    values, _ = cluster.pca(points(spark, sf_dir), XS)
    share = values / values.sum()
    return spark.createDataFrame([(f"PC{i + 1}", float(v), float(s), float(c)) for i, (v, s, c) in enumerate(zip(values, share, np.cumsum(share), strict=True))], "component string, explained_variance double, explained_variance_ratio double, cumulative_variance_ratio double")


@query()
def pca_scores(spark, sf_dir):
    """Centred projections."""
    df = points(spark, sf_dir)
    return rounded(cluster.scores(df, XS, cluster.pca(df, XS)[1], 2).select("id", "pc1", "pc2"))


def _clusters(df, columns, k: int = 3):
    """Clusters from the best of 100 starts."""
    return cluster.assigned(df, columns, cluster.best_fits(df, columns, [k], starts=100)[k])


@query()
def kmeans_multistart(spark, sf_dir):
    """M15."""
    df = points(spark, sf_dir)
    return cluster.profiles(_clusters(df, XS), XS)


@query()
def kmeans_in_pca_space(spark, sf_dir):
    """Agreement of clusters from raw columns and from principal components."""
    df = points(spark, sf_dir)
    values, loadings = cluster.pca(df, XS)
    n = cluster.components_needed(values, 0.8)
    reduced = cluster.compact(cluster.scores(df, XS, loadings, n))
    raw = _clusters(df, XS).select("id", F.col("cluster").alias("u"))
    own = _clusters(reduced, [f"pc{i + 1}" for i in range(n)]).select("id", F.col("cluster").alias("v"))
    both = cluster.compact(raw.join(own, "id"))
    return cluster.adjusted_rand(both, "u", "v").join(cluster.normalised_mutual_information(both, "u", "v"))


@query()
def k_selection(spark, sf_dir):
    """Metrics by k, votes and the choice."""
    df = cluster.compact(points(spark, sf_dir).select("id", *XS))
    ks = [2, 3, 4, 5, 6, 7, 8]
    fits = cluster.best_fits(df, XS, ks, starts=100)
    every = df
    for k in ks:
        every = cluster.assigned(every, XS, fits[k]).withColumnRenamed("cluster", f"k{k}")
    every = cluster.compact(every)
    silhouettes = cluster.mean_silhouettes(every, XS, {f"k{k}": k for k in ks})

    def metrics(k: int) -> tuple:
        labelled = every.withColumnRenamed(f"k{k}", "cluster")
        return (k, silhouettes[f"k{k}"], cluster.calinski_harabasz(labelled, XS).first()[0], cluster.davies_bouldin(labelled, XS).first()[0], cluster.within_between(labelled, XS).first()["ssw"])

    with ThreadPoolExecutor(len(ks)) as pool:  # short jobs, side by side
        rows = list(pool.map(metrics, ks))
    gap = cluster.gap_statistic(df, XS, ks, references=50, fits=fits)
    votes = {"silhouette": max(rows, key=lambda r: r[1])[0], "ch": max(rows, key=lambda r: r[2])[0], "db": min(rows, key=lambda r: r[3])[0], "gap": cluster.gap_choice(gap), "elbow": cluster.elbow(ks, [r[4] for r in rows])}
    chosen = cluster.vote(votes)
    return spark.createDataFrame([(*map(float, r[1:]), r[0], g[1], g[2], r[0] == chosen) for r, g in zip(rows, gap, strict=True)], "silhouette double, calinski_harabasz double, davies_bouldin double, inertia double, k int, gap double, gap_se double, recommended boolean")


@query()
def bootstrap_stability(spark, sf_dir):
    """1000 subsamples of four fifths."""
    from gridloom.functions.ordering import exact_quantiles

    made = cluster.compact(cluster.bootstrap_stability(points(spark, sf_dir), XS, 3))
    limits = exact_quantiles(made, "ari", (0.025, 0.975))
    return made.agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari")).join(limits.withColumnRenamed("q", "ci"))  # one row each


@query()
def perturbation_stability(spark, sf_dir):
    """M24."""
    return cluster.perturbation_stability(points(spark, sf_dir), XS, 3)


@query()
def specification_robustness(spark, sf_dir):
    """Clusters from column subsets against those from all columns, with the silhouette of each."""
    df, out = cluster.compact(points(spark, sf_dir)), None
    half = len(XS) // 2
    specifications = {"all": XS, "first": XS[:half], "last": XS[half:], "even": XS[::2]}
    fits = cluster.best_fits_by_columns(df, specifications, 3)
    labels = {name: cluster.compact(cluster.assigned(df, columns, fits[name]).select("id", "cluster", *columns)) for name, columns in specifications.items()}
    base = labels["all"].select("id", F.col("cluster").alias("u"))
    for name, columns in specifications.items():
        agreement = cluster.adjusted_rand(base.join(labels[name].select("id", F.col("cluster").alias("v")), "id"), "u", "v")
        part = agreement.join(cluster.silhouette_samples(labels[name], columns).agg(F.avg("silhouette").alias("silhouette"))).select(F.lit(name).alias("specification"), "ari", "silhouette")  # one row each
        out = part if out is None else out.unionByName(part)
    return out


@query()
def ward_clusters(spark, sf_dir):
    """M20."""
    return cluster.ward(points(spark, sf_dir), XS, 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


FEATURES = ["b1_mean", "b2_mean", "b3_mean", "acctbal"]


def _classed(spark, sf_dir):
    """The cross-section with classes that the features tell in part: a ratio of two of them and an error, cut at the
    target's thresholds."""
    from gridloom.config import PanelConfig

    raw = cluster.compact(cross(spark, sf_dir).select(F.col("unit_id").alias("id"), "pref_name", *FEATURES))
    df = features.scale(raw, features.scaler_parameters(raw, FEATURES, "standard"))
    error = ((F.col("id") * 7919) % 1000) / 1000 - 0.5
    ratio = 0.395 + 0.025 * F.col("b2_mean") + 0.015 * F.col("acctbal") + 0.04 * error
    return features.build_target(df.withColumn("ratio", ratio), "ratio", PanelConfig().target_thresholds).withColumnRenamed("target_code", "label").drop("target_class")


def _supervised(spark, sf_dir, k: int = 5, repeats: int = 1):
    df = cluster.compact(_classed(spark, sf_dir))
    return cluster.compact(classify.stratified_folds(df, "label", F.struct((F.col("id") * 31 + 7) % 1009, F.col("id")), k, repeats=repeats))


@query()
def logistic_cv(spark, sf_dir):
    """Cross-validated comparison of a baseline and a logistic model."""
    predictions = classify.cross_validate(_supervised(spark, sf_dir, repeats=5), FEATURES, classify.batched_models(["dummy_most_frequent", "dummy_stratified", "logistic_regression"]))
    return classify.comparison(classify.fold_metrics(predictions, ["model", "fold"]))


@query()
def model_family_cv(spark, sf_dir):
    """The other families on the same splits."""
    df = _supervised(spark, sf_dir, repeats=5)
    predictions = classify.cross_validate(df, FEATURES, classify.batched_models(["svm_linear", "svm_rbf", "random_forest", "knn", "mlp", "gradient_boosting", "xgboost"]))
    return classify.comparison(classify.fold_metrics(predictions, ["model", "fold"]))


EXPERIMENTS = {"all_features": [*FEATURES, "ratio", "ratio_rank"], "no_leaky": FEATURES, "no_demographic": FEATURES[:3], "rs_only": FEATURES[:2]}


@query()
def leakage_experiments(spark, sf_dir):
    """One run per feature subset, from all columns, the target's own ratio among them, to remote sensing alone."""
    df = _supervised(spark, sf_dir, repeats=5).withColumn("ratio_rank", F.col("ratio") * F.col("ratio"))
    models, out = classify.batched_models(["logistic_regression", "random_forest"]), None
    for name, columns in EXPERIMENTS.items():
        part = classify.cross_validate(df, columns, models, experiment=name)
        out = part if out is None else out.unionByName(part)
    return classify.fold_metrics(out, ["experiment", "model"])


@query()
def class_roc_auc(spark, sf_dir):
    """Area under the curve per class, from cross-validated probabilities."""
    made, out = classify.cross_validate(_supervised(spark, sf_dir), FEATURES, classify.build_models(["logistic_regression"])), None
    for c in range(3):
        part = classify.auc(classify.class_roc(made, c)).select(F.lit(c).alias("class"), "auc")
        out = part if out is None else out.unionByName(part)
    return out


@query()
def group_fold_assign(spark, sf_dir):
    """Whole groups in one fold."""
    return classify.group_folds(_supervised(spark, sf_dir).drop("fold"), "pref_name", "label", 3).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pref_name").alias("groups"))


@query()
def random_forest_importance(spark, sf_dir):
    """M40, M52."""
    from pyspark.ml.classification import RandomForestClassifier

    df = cluster.as_vector(_supervised(spark, sf_dir), FEATURES)
    return classify.tree_importance(RandomForestClassifier(numTrees=200, seed=42).fit(df), FEATURES, spark)


@query()
def permutation_importance(spark, sf_dir):
    """M51."""
    df = _supervised(spark, sf_dir)
    model = classify.build_models(["logistic_regression"])["logistic_regression"](df.count(), len(FEATURES), 3).fit(cluster.as_vector(df, FEATURES))
    return classify.permutation_importance(df, FEATURES, model, repeats=10).groupBy("feature").agg(F.avg("drop").alias("importance"))


@query()
def shapley_importance(spark, sf_dir):
    """Shapley values over all orderings."""
    from pyspark.ml.classification import RandomForestClassifier

    df = _supervised(spark, sf_dir)
    model = RandomForestClassifier(numTrees=200, seed=42).fit(cluster.as_vector(df, FEATURES))
    return classify.shapley(df, FEATURES, model)


@query()
def tree_shap_importance(spark, sf_dir):
    """Exact Shapley values of a forest's trees, for all 64 columns of the points."""
    from gridloom.operators import batched, explain, trees

    df = points(spark, sf_dir).select("id", "label", *XS)
    rows = cluster.compact(batched.task_rows(df, XS, F.array()))
    classes = rows.agg(F.max("label")).first()[0] + 1
    predict = trees.Forest(trees=100, depth=6).fit_tasks(rows, 1, classes, len(XS))
    return explain.importance(explain.explained(rows, predict, XS, classes))


@query()
def leave_one_out(spark, sf_dir):
    """The reference's three models on the cross-section."""
    models = classify.batched_models(["logistic_regression", "random_forest", "svm_linear"])
    return classify.fold_metrics(classify.leave_one_out(_supervised(spark, sf_dir), FEATURES, models), ["model"])


@query(f"""WITH {LONG}, c AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2), g AS (SELECT feature, avg(value) AS gm FROM long GROUP BY 1),
    f AS (SELECT feature, round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 6) AS f_statistic FROM c JOIN g USING (feature) GROUP BY feature)
    SELECT feature, f_statistic, row_number() OVER (ORDER BY f_statistic DESC, feature) AS place FROM f""")
def feature_selection(spark, sf_dir):
    """SelectKBest: features ranked by the F statistic."""
    from gridloom.schema import to_long

    table = rounded(stats.anova(to_long(points(spark, sf_dir), ["label"], XS), "label"))
    return table.select("feature", "f_statistic").withColumn("place", F.row_number().over(Window.orderBy(F.desc("f_statistic"), "feature")).cast("long"))
