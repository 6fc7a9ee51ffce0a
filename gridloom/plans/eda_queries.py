"""Exploratory tables, transforms, statistics and regressions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from gridloom.functions import ordering
from gridloom.operators import eda, features, stats
from gridloom.plans.base import BANDS, CROSS, LONG, PANEL, POINTS, UNITS, XS, chi2_p, cross, f_p, panel, points, query, r_p, read, rounded, simpson, t_p, units
from gridloom.schema import to_long

ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PLONG = f"WITH {PANEL}, long AS (SELECT feature, value FROM (SELECT b1, b2, b3, b4 FROM panel) UNPIVOT INCLUDE NULLS (value FOR feature IN (b1, b2, b3, b4)))"
Q = "quantile_cont(value, {})"


@query(f"""{PLONG} SELECT feature, count(value) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(min(value), 6) AS min,
    round({Q.format(.25)}, 6) AS q25, round({Q.format(.5)}, 6) AS q50, round({Q.format(.75)}, 6) AS q75, round(max(value), 6) AS max,
    round(skewness(value), 4) AS skew, round(kurtosis(value), 4) AS kurtosis, count(*) - count(value) AS missing_count,
    round((count(*) - count(value)) * 100.0 / count(*), 4) AS missing_pct FROM long GROUP BY feature""")
def describe_stats(spark, sf_dir):
    """The summary table."""
    out = rounded(eda.describe(panel(spark, sf_dir), BANDS))
    return out.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("skew", "kurtosis", "missing_pct")})


@query(f"{PLONG} SELECT feature, round(skewness(value), 4) AS g1, round(kurtosis(value), 4) AS g2 FROM long GROUP BY feature")
def skew_kurtosis_corrected(spark, sf_dir):
    """A7."""
    return rounded(to_long(panel(spark, sf_dir), [], BANDS).groupBy("feature").agg(eda.skew_g1().alias("g1"), eda.kurtosis_g2().alias("g2")), 4)


@query(f"WITH {PANEL},{UNITS} SELECT pref_name, " + ", ".join(f"round(avg({b}), 6) AS {b}_mean, round(stddev_samp({b}), 6) AS {b}_std, round(min({b}), 6) AS {b}_min, round(max({b}), 6) AS {b}_max, count({b}) AS {b}_count" for b in ("b1", "b3")) + " FROM panel JOIN units USING (unit_id) WHERE pref_name IS NOT NULL GROUP BY 1")
def group_stats_flat(spark, sf_dir):
    """A8, T2."""
    return rounded(eda.group_stats(panel(spark, sf_dir).join(units(spark, sf_dir), "unit_id"), "pref_name", ["b1", "b3"]))


@query(f"{PLONG} SELECT feature, count(*) - count(value) AS missing_count, round((count(*) - count(value)) * 100.0 / count(*), 4) AS missing_pct, (count(*) - count(value)) * 100.0 / count(*) > 8 AS flagged FROM long GROUP BY feature")
def missing_summary(spark, sf_dir):
    """A9."""
    return rounded(eda.missing_summary(panel(spark, sf_dir), BANDS, 8.0), 4)


GLONG = f"WITH {PANEL},{UNITS}, g AS (SELECT pref_name, b1, b2, b3, b4 FROM panel JOIN units USING (unit_id)), long AS (SELECT pref_name, feature, value FROM g UNPIVOT INCLUDE NULLS (value FOR feature IN (b1, b2, b3, b4)))"


@query(f"{GLONG} SELECT pref_name, feature, count(*) - count(value) AS missing_count, round((count(*) - count(value)) * 100.0 / count(*), 4) AS missing_pct, (count(*) - count(value)) * 100.0 / count(*) > 30 AS flagged FROM long GROUP BY 1, 2")
def missing_by_group(spark, sf_dir):
    """A9 by group: the data behind the missing heatmap."""
    return rounded(eda.missing_summary(panel(spark, sf_dir).join(units(spark, sf_dir), "unit_id"), BANDS, by=["pref_name"]), 4)


@query(f"WITH {PANEL} SELECT month, round(avg(CASE WHEN b1 IS NULL THEN 100.0 ELSE 0 END), 4) AS b1_missing_pct, round(avg(CASE WHEN b3 IS NULL THEN 100.0 ELSE 0 END), 4) AS b3_missing_pct FROM panel GROUP BY 1")
def missing_by_month(spark, sf_dir):
    """A9 by time."""
    pct = lambda c: F.avg(F.when(F.col(c).isNull(), 100.0).otherwise(0.0)).alias(f"{c}_missing_pct")
    return rounded(panel(spark, sf_dir).groupBy("month").agg(pct("b1"), pct("b3")), 4)


@query(f"{PLONG} SELECT round(avg(p), 4) AS overall_missing_pct FROM (SELECT (count(*) - count(value)) * 100.0 / count(*) AS p FROM long GROUP BY feature)")
def overall_missing(spark, sf_dir):
    """A10."""
    return rounded(eda.overall_missing(eda.missing_summary(panel(spark, sf_dir), BANDS)), 4)


BOUNDS = f"""{PLONG}, q AS (SELECT feature, count(value) AS n_valid, {Q.format(.25)} AS q1, {Q.format(.75)} AS q3 FROM long GROUP BY feature HAVING count(value) >= 10),
    bounds AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q)"""


@query(f"""{BOUNDS} SELECT feature, n_valid, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound,
    count(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 END) AS outlier_count,
    round(count(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 END) * 100.0 / n_valid, 2) AS outlier_pct
    FROM bounds JOIN long USING (feature) GROUP BY feature, n_valid, q1, q3, iqr, lower_bound, upper_bound""")
def iqr_outlier_summary(spark, sf_dir):
    """M6."""
    return rounded(eda.outlier_summary(panel(spark, sf_dir), BANDS).withColumn("outlier_pct", F.col("outlier_pct").cast("double")))


ROWS = BOUNDS.replace("SELECT feature, value FROM (SELECT b1, b2, b3, b4 FROM panel)", "SELECT unit_id, month, feature, value FROM (SELECT unit_id, month, b1, b2, b3, b4 FROM panel)")


@query(f"{ROWS} SELECT unit_id, month, feature, round(value, 6) AS value FROM long JOIN bounds USING (feature) WHERE value < lower_bound OR value > upper_bound")
def iqr_outlier_rows(spark, sf_dir):
    """M6: observation table."""
    return rounded(eda.outlier_rows(panel(spark, sf_dir), ["unit_id", "month"], BANDS).select("unit_id", "month", "feature", "value"))


@query(f"{ROWS} SELECT unit_id, count(*) AS n FROM long JOIN bounds USING (feature) WHERE value < lower_bound OR value > upper_bound GROUP BY 1 ORDER BY n DESC, unit_id LIMIT 5")
def top_outlier_units(spark, sf_dir):
    """O3: most affected units."""
    out = eda.outlier_rows(panel(spark, sf_dir), ["unit_id"], BANDS)
    return out.groupBy("unit_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "unit_id").limit(5)


@query(f"""{PLONG}, s AS (SELECT feature, avg(value) AS m, stddev_samp(value) AS s FROM long GROUP BY 1)
    SELECT feature, CAST(sum(CASE WHEN abs((value - m) / s) > 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_extreme, count(*) - count(value) AS n_missing,
    round(var_samp(value), 6) AS variance, round(median(value), 6) AS median, var_samp(value) < 0.01 AS near_constant FROM long JOIN s USING (feature) GROUP BY feature""")
def zscore_flags(spark, sf_dir):
    """M7, W10."""
    return rounded(eda.zscore_flags(panel(spark, sf_dir), BANDS))


CORR = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r, count(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END) AS n FROM {{t}}" for a, b in combinations([*BANDS, "n_items"], 2))


@query(f"WITH {PANEL}, pairs AS ({CORR.format(t='panel')}) SELECT feature_1, feature_2, round(r, 6) AS r, n FROM pairs")
def pearson_pairs(spark, sf_dir):
    """M1: pairwise-complete matrix."""
    return rounded(eda.correlation_matrix(panel(spark, sf_dir), [*BANDS, "n_items"]))


XCORR = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM wide" for a, b in combinations(["x0", "x1", "y0", "z0"], 2))


@query(f"WITH {POINTS}, wide AS (SELECT x0, x1, 2 * x0 + 0.1 * x1 AS y0, x0 - x1 AS z0 FROM pts), pairs AS ({XCORR}) SELECT feature_1 || ' - ' || feature_2 AS pair, feature_1, feature_2, round(r, 6) AS correlation, round(abs(r), 6) AS abs_correlation FROM pairs WHERE abs(r) >= 0.6")
def high_corr_pairs(spark, sf_dir):
    """M2."""
    wide = points(spark, sf_dir).selectExpr("x0", "x1", "2 * x0 + 0.1D * x1 AS y0", "x0 - x1 AS z0")
    return rounded(eda.high_correlations(eda.correlation_matrix(wide, ["x0", "x1", "y0", "z0"]), 0.6))


@query(f"WITH {CROSS}, pairs AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r, count({a}) AS n FROM xs" for a in ("b1_mean", "b2_mean", "b3_mean", "b4_mean") for b in ("acctbal", "n_rows")) + ") SELECT feature_1, feature_2, round(r, 6) AS r, n FROM pairs WHERE abs(r) > 0.05")
def rs_demo_block(spark, sf_dir):
    """M3: a rectangular block above a threshold."""
    block = [(a, b) for a in ("b1_mean", "b2_mean", "b3_mean", "b4_mean") for b in ("acctbal", "n_rows")]
    return rounded(eda.correlations(cross(spark, sf_dir), block).where("abs(r) > 0.05"))


def _rank(c: str) -> str:
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


@query(f"WITH {CROSS} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr(ra, rb), 6) AS r, count(*) AS n FROM (SELECT {_rank(a)} AS ra, {_rank(b)} AS rb FROM xs WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in (("b1_mean", "acctbal"), ("b2_mean", "n_rows"))))
def spearman_pairs(spark, sf_dir):
    """M4: correlation of average ranks."""
    return rounded(eda.spearman(cross(spark, sf_dir), [("b1_mean", "acctbal"), ("b2_mean", "n_rows")]))


@query(f"{PLONG}, v AS (SELECT feature, CASE WHEN feature = 'b2' THEN exp(value / 10000) ELSE value END AS value FROM long WHERE value IS NOT NULL), s AS (SELECT feature, count(*) AS n_valid, avg(value) AS mean, stddev_samp(value) AS std, skewness(value) AS g1, kurtosis(value) AS g2, min(value) AS low FROM v GROUP BY 1 HAVING count(*) >= 8) SELECT feature, n_valid, round(mean, 4) AS mean, round(std, 4) AS std, round(g1, 3) AS skewness, round(g2, 2) AS kurtosis, CASE WHEN abs(g1) > 2 THEN CASE WHEN low >= 0 THEN 'log1p' ELSE 'robust_scale' END WHEN abs(g1) > 1 THEN CASE WHEN low >= 0 THEN 'sqrt' ELSE 'robust_scale' END ELSE 'none' END AS suggested_transform FROM s")
def suggested_transform(spark, sf_dir):
    """M59, T21."""
    skewed = panel(spark, sf_dir).withColumn("b2", F.exp(F.col("b2") / 10000))
    out = eda.distribution_summary(skewed, BANDS)
    return out.withColumns({"mean": F.round("mean", 4), "std": F.round("std", 4), "skewness": F.round("skewness", 3), "kurtosis": F.round("kurtosis", 2)})


@query(f"""WITH {CROSS}, l AS (SELECT unit_id, ln(1 + b2_mean) AS b2_mean, CASE WHEN unit_id % 6 = 0 THEN NULL ELSE ln(1 + acctbal - least(low, 0)) END AS acctbal FROM xs,
    (SELECT min(CASE WHEN unit_id % 6 = 0 THEN NULL ELSE acctbal END) AS low FROM xs))
    SELECT unit_id, round(coalesce(b2_mean, (SELECT median(b2_mean) FROM l)), 6) AS b2_mean, round(coalesce(acctbal, (SELECT median(acctbal) FROM l)), 6) AS acctbal FROM l""")
def log1p_impute(spark, sf_dir):
    """log1p with a shift for negatives, then the median."""
    x = cross(spark, sf_dir).withColumn("acctbal", F.when(F.col("unit_id") % 6 != 0, F.col("acctbal")))
    logged, _ = features.shifted_log1p(x, ["b2", "acctbal"])
    return rounded(features.impute(logged, ["b2_mean", "acctbal"]).select("unit_id", "b2_mean", "acctbal"))


@query(f"WITH {CROSS} SELECT unit_id, " + ", ".join(f"round(({c} - (SELECT median({c}) FROM xs)) / (SELECT CASE WHEN quantile_cont({c}, .75) = quantile_cont({c}, .25) THEN 1 ELSE quantile_cont({c}, .75) - quantile_cont({c}, .25) END FROM xs), 6) AS {c}" for c in ("b1_mean", "b2_mean", "acctbal")) + ", 0.0::DOUBLE AS flat FROM xs")
def robust_scale(spark, sf_dir):
    """Median and quartile distance; a constant column divides by 1."""
    x = cross(spark, sf_dir).select("unit_id", "b1_mean", "b2_mean", "acctbal", F.lit(3.0).alias("flat"))
    return rounded(features.scale(x, features.scaler_parameters(x, ["b1_mean", "b2_mean", "acctbal", "flat"])))


@query(f"WITH {CROSS} SELECT unit_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in ("b1_mean", "b2_mean", "acctbal")) + " FROM xs")
def zscore_scale(spark, sf_dir):
    """Population deviation."""
    x = cross(spark, sf_dir).select("unit_id", "b1_mean", "b2_mean", "acctbal")
    return rounded(features.scale(x, features.scaler_parameters(x, ["b1_mean", "b2_mean", "acctbal"], "standard")))


@query(f"WITH {CROSS} SELECT unit_id, round(b1_mean, 3) AS b1_mean, round(b3_mean, 3) AS b3_mean FROM xs")
def inverse_scale(spark, sf_dir):
    """Scaled back with parameters rounded to 6 digits, which is approximate."""
    x = cross(spark, sf_dir).select("unit_id", "b1_mean", "b3_mean")
    parameters = features.scaler_parameters(x, ["b1_mean", "b3_mean"])
    return rounded(features.unscale(features.scale(x, parameters), parameters), 3)


@query(f"WITH {CROSS} SELECT 'has_rows' AS \"check\", count(*) > 0 AS passes FROM xs UNION ALL SELECT 'unique_keys', count(*) = count(DISTINCT unit_id) FROM xs UNION ALL SELECT 'all_classes', count(DISTINCT unit_id % 3) = 3 FROM xs UNION ALL SELECT 'complete_b1_mean', count(*) = count(b1_mean) FROM xs UNION ALL SELECT 'complete_holes', count(*) = count(CASE WHEN unit_id % 4 <> 0 THEN 1 END) FROM xs")
def validation_flags(spark, sf_dir):
    """M56."""
    x = cross(spark, sf_dir).withColumns({"target_code": F.col("unit_id") % 3, "holes": F.when(F.col("unit_id") % 4 != 0, 1)})
    return features.validate(x, "unit_id", ["b1_mean", "holes"])


@query("WITH b AS (SELECT min(l_extendedprice) AS low, (max(l_extendedprice) - min(l_extendedprice)) / 50 AS w FROM lineitem) SELECT CAST(least(floor((l_extendedprice - low) / w), 49) AS INTEGER) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1")
def histogram_bins(spark, sf_dir):
    """Histogram data."""
    return eda.histogram(read(spark, sf_dir, "lineitem"), "l_extendedprice", 50)


@query(f"WITH {PANEL},{UNITS} SELECT pref_name, round(min(b1), 6) AS low, round(quantile_cont(b1, .25), 6) AS q1, round(median(b1), 6) AS median, round(quantile_cont(b1, .75), 6) AS q3, round(max(b1), 6) AS high FROM panel JOIN units USING (unit_id) GROUP BY 1")
def box_stats(spark, sf_dir):
    """Five-number summaries by group."""
    return rounded(eda.box_stats(panel(spark, sf_dir).join(units(spark, sf_dir), "unit_id"), "pref_name", "b1"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(corr(l_extendedprice, l_quantity), 6) AS r, count(*) AS n FROM lineitem")
def scatter_fit(spark, sf_dir):
    """M58."""
    out = eda.fit_line(read(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"), "n")


GROUPED = f"WITH {LONG}"


@query(f"""{GROUPED}, c AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2), g AS (SELECT feature, avg(value) AS gm FROM long GROUP BY 1)
    SELECT feature, round((sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))), 4) AS f_statistic, count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM c JOIN g USING (feature) GROUP BY feature""")
def anova_f(spark, sf_dir):
    """M35."""
    return rounded(stats.anova(to_long(points(spark, sf_dir), ["label"], XS), "label"), 4)


@query(f"""{GROUPED}, r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM long),
    g AS (SELECT feature, count(*) AS n, sum(r) AS s FROM r GROUP BY feature, label), t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS c FROM long GROUP BY 1, 2) GROUP BY 1)
    SELECT feature, round((12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (CAST(sum(n) AS DOUBLE) ^ 3 - sum(n))), 4) AS h_statistic, count(*) - 1 AS df FROM g JOIN t USING (feature) GROUP BY feature""")
def kruskal_wallis_h(spark, sf_dir):
    """M33."""
    return rounded(stats.kruskal_wallis(to_long(points(spark, sf_dir), ["label"], XS), "label"), 4)


SCORES = f"{GROUPED}, sc AS (SELECT label AS fold, feature AS model, round(avg(value), 2) AS score FROM long GROUP BY 1, 2)"


@query(f"""{SCORES}, r AS (SELECT fold, model, rank() OVER (PARTITION BY fold ORDER BY score) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM sc),
    m AS (SELECT model, sum(r) AS s, count(*) AS n FROM r GROUP BY 1), t AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM sc GROUP BY fold, score))
    SELECT round((12.0 / (max(n) * count(*) * (count(*) + 1)) * sum(s * s) - 3.0 * max(n) * (count(*) + 1)) / (1 - any_value(ties) / (max(n) * count(*) * (CAST(count(*) AS DOUBLE) * count(*) - 1))), 4) AS chi2,
    CAST(count(*) AS DOUBLE) AS k, CAST(max(n) AS DOUBLE) AS n FROM m, t""")
def friedman_stat(spark, sf_dir):
    """M55."""
    return rounded(stats.friedman(_scores(spark, sf_dir), "fold", "model", "score"), 4)


def _scores(spark, sf_dir):
    long = to_long(points(spark, sf_dir), ["label"], XS)
    return long.groupBy(F.col("label").alias("fold"), F.col("feature").alias("model")).agg(F.round(F.avg("value"), 2).alias("score"))


@query(f"{SCORES} SELECT model, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS std, round(quantile_cont(score, .025), 6) AS ci_lower, round(quantile_cont(score, .975), 6) AS ci_upper FROM sc GROUP BY 1")
def percentile_ci(spark, sf_dir):
    """A28, M50."""
    return rounded(stats.percentile_ci(_scores(spark, sf_dir), ["model"], "score"))


@query(f"{SCORES}, m AS (SELECT model, avg(score) AS mean, count(*) AS n_folds FROM sc GROUP BY 1) SELECT model, round(mean, 6) AS mean, n_folds, row_number() OVER (ORDER BY round(mean, 6) DESC, model) AS place FROM m")
def model_ranking(spark, sf_dir):
    """Comparison table sorted by mean. There is one row per model."""
    from pyspark.sql import Window

    table = _scores(spark, sf_dir).groupBy("model").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n_folds"))
    return rounded(table.withColumn("place", F.row_number().over(Window.orderBy(F.round("mean", 6).desc(), "model")).cast("long")))


@query(f"{SCORES}, r AS (SELECT model, rank() OVER (PARTITION BY fold ORDER BY score DESC) + (count(*) OVER (PARTITION BY fold, score) - 1) / 2.0 AS r FROM sc) SELECT model, round(CAST(avg(r) AS DOUBLE), 6) AS consensus FROM r GROUP BY 1")
def average_rank_consensus(spark, sf_dir):
    """Mean of average ranks over sources."""
    ranked = ordering.average_ranks(_scores(spark, sf_dir), "score", ["fold"], descending=True)
    return rounded(ranked.groupBy("model").agg(F.avg("avg_rank").alias("consensus")))


def _line(x: str) -> str:
    return f"SELECT '{x}' AS feature, regr_slope(l_extendedprice, {x}) AS slope, regr_intercept(l_extendedprice, {x}) AS intercept, regr_r2(l_extendedprice, {x}) AS r2, count(*) AS n FROM lineitem"


@query(f"WITH b AS ({_line('l_discount')} UNION ALL {_line('l_tax')}) SELECT feature, round(slope, 4) AS slope, round(intercept, 3) AS intercept, round(r2, 6) AS r2, n, round({r_p('sqrt(r2)', 'n')}, 6) AS p_value FROM b")
def bivariate_ols(spark, sf_dir):
    """One-variable fits with their p-values."""
    out = stats.bivariate(read(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_discount", "l_tax"])
    return out.select("feature", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"), "n", F.round("p_value", 6).alias("p_value"))


@query(f"""WITH {POINTS}, m AS (SELECT covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS d, covar_pop(x1, x0) AS p, covar_pop(x2, x0) AS q, avg(x0) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM pts),
    s AS (SELECT *, (d * p - b * q) / (a * d - b * b) AS b1, (a * q - b * p) / (a * d - b * b) AS b2 FROM m)
    SELECT 'const' AS name, round(my - b1 * m1 - b2 * m2, 6) AS coef FROM s UNION ALL SELECT 'x1', round(b1, 6) FROM s UNION ALL SELECT 'x2', round(b2, 6) FROM s""")
def multiple_ols_normal_eq(spark, sf_dir):
    """Coefficients from the covariance matrix."""
    model = stats.ols(points(spark, sf_dir), "x0", ["x1", "x2"])
    return spark.createDataFrame([(r[0], round(r[1], 6)) for r in model["coefficients"]], "name string, coef double")


@query(f"WITH {POINTS} SELECT 'x1' AS feature, round(1 / (1 - corr(x1, x2) ^ 2), 6) AS vif FROM pts UNION ALL SELECT 'x2', round(1 / (1 - corr(x1, x2) ^ 2), 6) FROM pts")
def vif_pairs(spark, sf_dir):
    """For two columns the factor is 1 / (1 - r2)."""
    return spark.createDataFrame([(k, round(v, 6)) for k, v in stats.vif(points(spark, sf_dir), ["x1", "x2"]).items()], "feature string, vif double")


@query(f"""WITH {POINTS}, c AS (SELECT regr_slope(x0, x1) AS b, regr_intercept(x0, x1) AS a FROM pts), e AS (SELECT x1, (x0 - a - b * x1) ^ 2 AS e2 FROM pts, c) SELECT round(count(*) * regr_r2(e2, x1), 5) AS lm FROM e""")
def breusch_pagan(spark, sf_dir):
    """M28."""
    return spark.createDataFrame([(round(stats.breusch_pagan(points(spark, sf_dir), "x0", ["x1"])["lm"], 5),)], "lm double")


PAIRS = [(a, b) for a in ("b1_mean", "b2_mean") for b in ("acctbal", "n_rows")]


@query(f"WITH {CROSS}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r, count({a}) AS n FROM xs" for a, b in PAIRS) + f"), t AS (SELECT *, {r_p('r', 'n')} AS p FROM p) SELECT feature_1, feature_2, round(r, 6) AS r, n, round(p, 6) AS p_value, p < 0.05 / 4 AS significant FROM t")
def pearson_with_p(spark, sf_dir):
    """M4: correlations with p-values and Bonferroni."""
    return rounded(stats.correlation_p(eda.correlations(cross(spark, sf_dir), PAIRS)))


@query(f"WITH {CROSS}, p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr(ra, rb) AS r, count(*) AS n FROM (SELECT {_rank(a)} AS ra, {_rank(b)} AS rb FROM xs WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in PAIRS) + f"), t AS (SELECT *, {r_p('r', 'n')} AS p FROM p) SELECT feature_1, feature_2, round(r, 6) AS r, n, round(p, 6) AS p_value, p < 0.05 / 4 AS significant FROM t")
def spearman_with_p(spark, sf_dir):
    """M4: rank correlations with p-values and Bonferroni."""
    return rounded(stats.correlation_p(eda.spearman(cross(spark, sf_dir), PAIRS)))


@query(f"WITH {PANEL}, g AS (SELECT b1, b2, b3, b4 FROM panel) " + " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, round(corr(ra, rb), 6) AS r, count(*) AS n FROM (SELECT {_rank(a)} AS ra, {_rank(b)} AS rb FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)" for a, b in combinations(BANDS, 2)))
def spearman_matrix(spark, sf_dir):
    """M4: all pairs of columns with different gaps; ranks are taken within pair-valid rows."""
    return rounded(eda.spearman(panel(spark, sf_dir), list(combinations(BANDS, 2))))


OLS_X = ["x1", "x2", "x3"]


def _ols_sql(y: str, xs: list[str], table: str) -> str:
    """Least squares in SQL: the centred cross products, their inverse by cofactors, then every coefficient."""
    names, p = [*xs, y], len(xs)
    sums = ", ".join(f"covar_pop({a}, {b}) * count(*) AS s{i}{j}" for i, a in enumerate(names) for j, b in enumerate(names) if i <= j)
    at = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def minor(i: int, j: int) -> str:
        r, c = [k for k in range(p) if k != i], [k for k in range(p) if k != j]
        return f"({at(r[0], c[0])} * {at(r[1], c[1])} - {at(r[0], c[1])} * {at(r[1], c[0])})"

    det = " + ".join(f"{'-' if j % 2 else ''}{at(0, j)} * {minor(0, j)}" for j in range(p))
    inverse = ", ".join(f"{'-' if (i + j) % 2 else ''}{minor(i, j)} / det AS v{i}{j}" for i in range(p) for j in range(p))
    beta = ", ".join("(" + " + ".join(f"v{i}{j} * {at(j, p)}" for j in range(p)) + f") AS b{i}" for i in range(p))
    rss = f"s{p}{p} - (" + " + ".join(f"b{i} * {at(i, p)}" for i in range(p)) + ")"
    mean_part = " + ".join(f"m{i} * v{i}{j} * m{j}" for i in range(p) for j in range(p))
    const = f"m{p} - (" + " + ".join(f"b{i} * m{i}" for i in range(p)) + ")"
    rows = [f"SELECT 'const' AS name, {const} AS coef, sqrt(s2 / n + s2 * ({mean_part})) AS se, n - {p + 1} AS dof FROM d", *(f"SELECT '{x}', b{i}, sqrt(s2 * v{i}{i}), n - {p + 1} FROM d" for i, x in enumerate(xs))]
    return f"""a AS (SELECT count(*) AS n, {', '.join(f'avg({c}) AS m{i}' for i, c in enumerate(names))}, {sums} FROM {table}),
    e AS (SELECT *, {det} AS det FROM a), f AS (SELECT *, {inverse} FROM e), g AS (SELECT *, {beta} FROM f), d AS (SELECT *, ({rss}) / (n - {p + 1}) AS s2 FROM g),
    coefficients AS ({' UNION ALL '.join(rows)})"""


@query(f"WITH RECURSIVE {POINTS}, {_ols_sql('x0', OLS_X, 'pts')}, q AS (SELECT 0 AS step, 0.0::DOUBLE AS low, 20.0::DOUBLE AS high, (SELECT max(dof) FROM coefficients) AS dof UNION ALL SELECT step + 1, CASE WHEN {t_p('((low + high) / 2)', 'dof')} > 0.05 THEN (low + high) / 2 ELSE low END, CASE WHEN {t_p('((low + high) / 2)', 'dof')} > 0.05 THEN high ELSE (low + high) / 2 END, dof FROM q WHERE step < 45) SELECT name, round(coef, 6) AS coef, round(se, 6) AS se, round(coef / se, 6) AS t, round({t_p('coef / se', 'coefficients.dof')}, 6) AS p_value, round(coef - low * se, 6) AS ci_lower, round(coef + low * se, 6) AS ci_upper FROM coefficients, (SELECT low FROM q WHERE step = 45)")
def ols_summary(spark, sf_dir):
    """Coefficients with standard errors, t, p and limits."""
    model = stats.ols(points(spark, sf_dir), "x0", OLS_X)
    return rounded(spark.createDataFrame(model["coefficients"], "name string, coef double, se double, t double, p_value double, ci_lower double, ci_upper double"))


def _vif(own: str, a: str, b: str) -> str:
    """SQL for the factor of a column on two others, from correlations named by both columns in order."""
    r = lambda x, y: "_".join(sorted((x, y)))
    return f"round(1 / (1 - ({r(own, a)} ^ 2 + {r(own, b)} ^ 2 - 2 * {r(own, a)} * {r(own, b)} * {r(a, b)}) / (1 - {r(a, b)} ^ 2)), 2)"


@query(f"""WITH {POINTS}, w AS (SELECT x0, x1, 2 * x0 + 0.1 * x1 + 0.3 * x2 AS y0 FROM pts), c AS (SELECT corr(x0, x1) AS x0_x1, corr(x0, y0) AS x0_y0, corr(x1, y0) AS x1_y0 FROM w),
    v AS (SELECT *, {_vif('x0', 'x1', 'y0')} AS v0, {_vif('x1', 'x0', 'y0')} AS v1, {_vif('y0', 'x0', 'x1')} AS vy FROM c),
    f AS (SELECT *, CASE WHEN greatest(v0, v1, vy) <= 5 THEN '' WHEN v0 >= v1 AND v0 >= vy THEN 'x0' WHEN v1 >= vy THEN 'x1' ELSE 'y0' END AS gone FROM v),
    g AS (SELECT *, round(1 / (1 - CASE gone WHEN 'x0' THEN x1_y0 WHEN 'x1' THEN x0_y0 WHEN 'y0' THEN x0_x1 ELSE 0 END ^ 2), 2) AS rest FROM f),
    h AS (SELECT *, CASE WHEN rest <= 5 THEN '' WHEN gone = 'x0' THEN 'x1' ELSE 'x0' END AS also FROM g)
    SELECT feature, feature <> gone AND feature <> also AS kept, CASE WHEN feature = gone THEN greatest(v0, v1, vy) WHEN feature = also THEN rest END AS vif FROM h, (VALUES ('x0'), ('x1'), ('y0')) AS t(feature)""")
def vif_iterative(spark, sf_dir):
    """Iterative removal."""
    wide = points(spark, sf_dir).withColumn("y0", 2 * F.col("x0") + 0.1 * F.col("x1") + 0.3 * F.col("x2"))
    left, gone = stats.drop_by_vif(wide, ["x0", "x1", "y0"])
    return spark.createDataFrame([(c, True, None) for c in left] + [(c, False, v) for c, v in gone], "feature string, kept boolean, vif double")


@query(f"WITH {POINTS}, r AS (SELECT corr(x0, 2 * x0 + 0.1 * x1) AS r, var_samp(x2 / 100) < 0.01 AS flat FROM pts) SELECT feature, CASE WHEN feature = 'x0' AND r >= 0.85 THEN round(r, 6) WHEN feature = 'z' AND flat THEN 0 END AS dropped_at FROM r, (VALUES ('x0'), ('x1'), ('x2'), ('y0'), ('z')) AS t(feature)")
def redundancy_pruning(spark, sf_dir):
    """M8: near-constant columns first, then the most correlated pair; a listed column stays."""
    wide = points(spark, sf_dir).withColumns({"y0": 2 * F.col("x0") + 0.1 * F.col("x1"), "z": F.col("x2") / 100})
    names = ["x0", "x1", "x2", "y0", "z"]
    flat = stats.near_constant(wide, ["y0", "z"])
    left, gone = stats.prune_redundant(eda.correlation_matrix(wide, names), names, keep=["y0"], constant=flat)
    return spark.createDataFrame([(c, None) for c in left] + [(a, round(r, 6)) for a, _, r in gone], "feature string, dropped_at double")


@query()
def shapiro_normality(spark, sf_dir):
    """M5: W and p on a bounded sample of 5000 by hash."""
    rows = []
    for c in ITEM:
        sample = stats.hash_sample(read(spark, sf_dir, "lineitem").select(c, F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k")), "k", 5000)
        w, p = stats.shapiro_wilk([r[0] for r in sample.collect()])
        rows.append((c, round(w, 6), p, p > 0.05))
    return spark.createDataFrame(rows, "feature string, w double, p_value double, normal_5pct boolean")


TAIL = simpson("exp(-$u * $u / 2)", "z")


@query(f"""{SCORES}, d AS (SELECT a.model AS model_a, b.model AS model_b, a.score - b.score AS d FROM sc a JOIN sc b ON a.fold = b.fold AND a.model < b.model),
    q AS (SELECT *, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY model_a, model_b, abs(d)) - 1) / 2.0 AS k, count(*) OVER (PARTITION BY model_a, model_b, abs(d)) AS c FROM d WHERE d <> 0),
    s AS (SELECT model_a, model_b, count(*) AS n, least(sum(CASE WHEN d > 0 THEN k ELSE 0 END), sum(CASE WHEN d < 0 THEN k ELSE 0 END)) AS stat, max(c) AS most, sum(c * c - 1.0) AS ties FROM q GROUP BY 1, 2),
    al AS (SELECT model_a, model_b, count(*) AS folds FROM d GROUP BY 1, 2),
    w AS (SELECT total, sum(count(*)) OVER (ORDER BY total) AS ways FROM (SELECT list_sum(list_transform(range(10), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END)) AS total FROM (SELECT unnest(range(1024)) AS m)) GROUP BY 1),
    j AS (SELECT al.model_a, al.model_b, folds, coalesce(n, 0) AS n, CAST(coalesce(stat, 0) AS DOUBLE) AS stat, most, abs(stat - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM al LEFT JOIN s USING (model_a, model_b)),
    p AS (SELECT model_a, model_b, stat, CASE WHEN n = 0 THEN 1 WHEN most = 1 AND n = folds THEN least(1, 2 * (SELECT max(ways) FROM w WHERE total <= floor(stat)) / 1024) ELSE 1 - 2 * {TAIL} / sqrt(2 * pi()) END AS p FROM j)
    SELECT model_a, model_b, round(stat, 5) AS statistic, round(p, 5) AS p_value, round(least(1, p * (SELECT count(*) FROM p)), 5) AS p_adjusted, p * (SELECT count(*) FROM p) < 0.05 AS significant FROM p""")
def pairwise_wilcoxon(spark, sf_dir):
    """Pairwise signed-rank tests with Bonferroni correction: exact without ties (ten folds), else normal."""
    return rounded(stats.pairwise_tests(_scores(spark, sf_dir), "model", "fold", "score"), 5)


@query(f"""{SCORES}, m AS (SELECT a.model AS model_a, b.model AS model_b, a.score - b.score AS d FROM sc a JOIN sc b ON a.fold = b.fold AND a.model < b.model),
    s AS (SELECT model_a, model_b, avg(d) AS mean, stddev_samp(d) AS sd, count(*) AS n FROM m GROUP BY 1, 2), t AS (SELECT *, mean / (sd / sqrt(n)) AS t FROM s), p AS (SELECT *, CASE WHEN sd = 0 THEN 1 ELSE {t_p('t', '(n - 1)')} END AS p FROM t)
    SELECT model_a, model_b, round(CASE WHEN sd = 0 THEN 0 ELSE t END, 5) AS statistic, round(p, 5) AS p_value, round(least(1, p * (SELECT count(*) FROM p)), 5) AS p_adjusted, p * (SELECT count(*) FROM p) < 0.05 AS significant FROM p""")
def pairwise_paired_t(spark, sf_dir):
    """Paired t tests between all models with Bonferroni correction."""
    return rounded(stats.pairwise_tests(_scores(spark, sf_dir), "model", "fold", "score", test=stats.paired_t), 5)


@query(f"""{GROUPED}, c AS (SELECT feature, label, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2), g AS (SELECT feature, avg(value) AS gm FROM long GROUP BY 1),
    a AS (SELECT feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS f, count(*) - 1 AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2 FROM c JOIN g USING (feature) GROUP BY feature)
    SELECT feature, round(f, 5) AS f_statistic, df1, df2, round({f_p('f', 'df1', 'df2')}, 5) AS p_value FROM a""")
def anova_p_values(spark, sf_dir):
    """M35 with p-values."""
    return rounded(stats.anova_p(stats.anova(to_long(points(spark, sf_dir), ["label"], XS), "label")), 5)


@query(f"""{GROUPED}, r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM long),
    g AS (SELECT feature, count(*) AS n, sum(r) AS s FROM r GROUP BY feature, label), t AS (SELECT feature, sum(c * c * c - c) AS ties FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS c FROM long GROUP BY 1, 2) GROUP BY 1),
    h AS (SELECT feature, (12.0 / (sum(n) * (sum(n) + 1)) * sum(s * s / n) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (CAST(sum(n) AS DOUBLE) ^ 3 - sum(n))) AS h, count(*) - 1 AS df FROM g JOIN t USING (feature) GROUP BY feature)
    SELECT feature, round(h, 4) AS h_statistic, df, round({chi2_p('h', 'df')}, 4) AS p_value FROM h""")
def kruskal_p_values(spark, sf_dir):
    """M33 with p-values."""
    return rounded(stats.kruskal_p(stats.kruskal_wallis(to_long(points(spark, sf_dir), ["label"], XS), "label")), 4)


def _summaries(spark, sf_dir):
    from gridloom.operators import temporal

    p = panel(spark, sf_dir)
    return eda.missing_summary(p, BANDS), eda.correlation_matrix(p, BANDS), eda.outlier_summary(p, BANDS), temporal.coverage(p, BANDS), eda.distribution_summary(p, BANDS)


GAPS = f"""{PANEL}, v AS (SELECT unit_id, month, b1 IS NOT NULL OR b2 IS NOT NULL OR b3 IS NOT NULL OR b4 IS NOT NULL AS ok FROM panel),
    d AS (SELECT unit_id, ok, CASE WHEN ok AND date_diff('day', lag(month) OVER (PARTITION BY unit_id, ok ORDER BY month), month) > 35 THEN 1 ELSE 0 END AS gap FROM v),
    cov AS (SELECT unit_id, sum(CASE WHEN ok THEN 1 ELSE 0 END) AS n_valid_months, sum(gap) AS gap_count FROM d GROUP BY 1)"""
PAIR_R = " UNION ALL ".join(f"SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r FROM panel" for a, b in combinations(BANDS, 2))
OUTLIERS = BOUNDS.removeprefix("WITH ").replace(PANEL, GAPS, 1) + ", o AS (SELECT feature, count(CASE WHEN value < lower_bound OR value > upper_bound THEN 1 END) AS n, any_value(n_valid) AS n_valid FROM bounds JOIN long USING (feature) GROUP BY 1)"


@query(f"""WITH {OUTLIERS}, miss AS (SELECT feature, (count(*) - count(value)) * 100.0 / count(*) AS pct FROM long GROUP BY 1), pr AS ({PAIR_R}), sk AS (SELECT feature, abs(skewness(value)) AS g FROM long GROUP BY 1 HAVING count(value) >= 8)
    SELECT 'expected_columns' AS "check", 'warn' AS status, 1 AS n UNION ALL SELECT 'texture_available', 'ok', 0
    UNION ALL SELECT 'missing_rates', CASE WHEN count(CASE WHEN pct > 8 THEN 1 END) > 0 THEN 'warn' ELSE 'ok' END, count(CASE WHEN pct > 8 THEN 1 END) FROM miss
    UNION ALL SELECT 'temporal_coverage', CASE WHEN coalesce(min(n_valid_months), 0) < 24 THEN 'warn' ELSE 'ok' END, count(CASE WHEN gap_count > 0 THEN 1 END) FROM cov
    UNION ALL SELECT 'outliers_documented', 'ok', CAST(sum(n) AS BIGINT) FROM o
    UNION ALL SELECT 'high_correlations', CASE WHEN count(CASE WHEN abs(r) >= 0.8 THEN 1 END) > 0 THEN 'warn' ELSE 'ok' END, count(CASE WHEN abs(r) >= 0.8 THEN 1 END) FROM pr
    UNION ALL SELECT 'distributions_understood', 'ok', count(CASE WHEN g > 1 THEN 1 END) FROM sk""")
def eda_quality_checks(spark, sf_dir):
    """All seven checks over the summaries."""
    missing, pairs, outliers, coverage, distribution = _summaries(spark, sf_dir)
    return eda.quality_checks(missing, pairs, outliers, coverage, distribution, [*BANDS, "absent"], panel(spark, sf_dir).columns, ["b1_contrast"], missing_limit=8.0)


@query(f"""WITH {OUTLIERS}, miss AS (SELECT feature, (count(*) - count(value)) * 100.0 / count(*) AS pct FROM long GROUP BY 1)
    SELECT 'high_missing' AS type, feature, '' AS unit_id, '' AS month, round(pct, 4) AS detail FROM miss WHERE pct > 8
    UNION ALL SELECT 'high_outlier_rate', feature, '', '', pct FROM (SELECT feature, round(n * 100.0 / n_valid, 2) AS pct FROM o ORDER BY 2 DESC, 1 LIMIT 3) WHERE pct > 0.1
    UNION ALL SELECT 'temporal_gaps', '', '', '', count(*) FROM cov WHERE gap_count > 0 HAVING count(*) > 0 UNION ALL SELECT 'texture_available', 'b3/b4', '', '', 2""")
def eda_quality_flags(spark, sf_dir):
    """Flag rows; two bands stand for texture columns."""
    missing, _, outliers, coverage, _ = _summaries(spark, sf_dir)
    return rounded(eda.quality_flags(missing, outliers, coverage, 8.0, 0.1, ["b3", "b4"], most=3), 4)


@query(f"""WITH {OUTLIERS}, miss AS (SELECT feature, (count(*) - count(value)) * 100.0 / count(*) AS pct FROM long GROUP BY 1), pr AS ({PAIR_R}),
    mm AS (SELECT unit_id, month(month) AS m, avg(b1) AS b1, avg(b2) AS b2 FROM panel GROUP BY 1, 2),
    amp AS (SELECT avg(b1) AS b1, avg(b2) AS b2 FROM (SELECT unit_id, CASE WHEN count(b1) >= 2 THEN round(max(b1) - min(b1), 6) END AS b1, CASE WHEN count(b2) >= 2 THEN round(max(b2) - min(b2), 6) END AS b2 FROM mm GROUP BY 1)),
    sk AS (SELECT feature, skewness(CASE WHEN feature = 'b2' THEN exp(value / 10000) WHEN feature = 'b4' THEN exp(value * 40) ELSE value END) AS g FROM long WHERE value IS NOT NULL GROUP BY 1 HAVING count(*) >= 8)
    SELECT 'missing' AS topic, 1 AS place, 'overall' AS subject, round(avg(pct), 3) AS value FROM miss
    UNION ALL SELECT 'skewed', CAST(row_number() OVER (ORDER BY abs(g) DESC, feature) AS INTEGER), feature, round(g, 3) FROM (SELECT * FROM sk WHERE abs(g) > 1 ORDER BY abs(g) DESC, feature LIMIT 5)
    UNION ALL SELECT 'correlated', CAST(row_number() OVER (ORDER BY abs(r) DESC) AS INTEGER), feature_1 || '/' || feature_2, round(r, 3) FROM (SELECT * FROM pr WHERE abs(r) >= 0.005 ORDER BY abs(r) DESC LIMIT 3)
    UNION ALL SELECT 'seasonal', CAST(row_number() OVER (ORDER BY abs(value) DESC, subject) AS INTEGER), subject, round(value, 3) FROM (SELECT 'b1_seasonal_amp' AS subject, b1 AS value FROM amp UNION ALL SELECT 'b2_seasonal_amp', b2 FROM amp)
    UNION ALL SELECT 'strongest_link', 1, feature_1 || '/' || feature_2, round(r, 3) FROM (SELECT * FROM pr ORDER BY abs(r) DESC LIMIT 1)""")
def eda_key_findings(spark, sf_dir):
    """Findings of all five topics; two bands are stretched so that there are skewed ones."""
    from gridloom.operators import temporal

    missing, pairs, _, _, _ = _summaries(spark, sf_dir)
    p = panel(spark, sf_dir)
    distribution = eda.distribution_summary(p.withColumns({"b2": F.exp(F.col("b2") / 10000), "b4": F.exp(F.col("b4") * 40)}), BANDS)
    return rounded(eda.key_findings(missing, distribution, pairs, temporal.seasonal_amplitude(p, ["b1", "b2"]), pairs, 0.005), 3)


@query(f"{GLONG}, a AS (SELECT pref_name, feature, value FROM long UNION ALL SELECT 'Overall', feature, value FROM long) SELECT pref_name, feature, round((count(*) - count(value)) * 100.0 / count(*), 4) AS missing_pct FROM a GROUP BY 1, 2")
def missing_heatmap(spark, sf_dir):
    """Missing percentages by group, with an Overall row."""
    return rounded(eda.heatmap(panel(spark, sf_dir).join(units(spark, sf_dir), "unit_id"), "pref_name", BANDS), 4)


@query(f"WITH {CROSS} SELECT unit_id, round((b1_mean - min(b1_mean) OVER w) / (max(b1_mean) OVER w - min(b1_mean) OVER w), 6) AS b1_mean, round(coalesce((acctbal - avg(acctbal) OVER g) / stddev_samp(acctbal) OVER g, CASE WHEN count(*) OVER g > 1 THEN 0 END), 6) AS acctbal FROM xs WINDOW w AS (), g AS (PARTITION BY region)")
def min_max_and_group_z(spark, sf_dir):
    """Min-max over all rows, z-scores within groups."""
    x = cross(spark, sf_dir).select("unit_id", "region", "b1_mean", "acctbal")
    return rounded(eda.standardised(eda.min_max(x, ["b1_mean"]), ["acctbal"], ["region"]).drop("region"))


@query(f"{PLONG}, v AS (SELECT value, row_number() OVER (ORDER BY value) AS place FROM long WHERE feature = 'b4' AND value IS NOT NULL), s AS (SELECT count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM v) SELECT place, round((place - 0.5) / n, 6) AS share, round((value - m) / sd, 6) AS observed FROM v, s")
def qq_data(spark, sf_dir):
    """Quantile-quantile data; the theoretical quantile is checked through the share it stands for."""
    from statistics import NormalDist

    @F.pandas_udf("double")
    def share(v):
        return v.map(NormalDist().cdf)

    return rounded(stats.qq_points(panel(spark, sf_dir), "b4").select("place", share("theoretical").alias("share"), "observed"))


SLOPES = f"{PANEL}, d AS (SELECT *, date_diff('day', min(month) OVER (PARTITION BY unit_id), month) AS dd FROM panel), sl AS (SELECT unit_id, regr_slope(b1, dd / mx) AS b1_slope, regr_slope(b2, dd / mx) AS b2_slope FROM (SELECT *, CAST(max(dd) OVER (PARTITION BY unit_id) AS DOUBLE) AS mx FROM d) GROUP BY 1)"


@query(f"WITH {SLOPES}, p AS (SELECT 'b1_slope' AS slope_feature, corr(b1_slope, b1_slope + 0.4 * sin(unit_id)) AS r, count(*) AS n FROM sl UNION ALL SELECT 'b2_slope', corr(b2_slope, b2_slope + 900 * sin(unit_id)), count(*) FROM sl) SELECT slope_feature, round(r, 4) AS pearson_r, round({r_p('r', 'n')}, 4) AS p_value, n AS n_valid FROM p")
def slope_cross_validation(spark, sf_dir):
    """Recomputed slopes against scaled ones, scaled back."""
    from gridloom.operators import temporal

    slopes = temporal.with_days(panel(spark, sf_dir)).groupBy("unit_id").agg(*temporal.trend_slopes(["b1", "b2"]))
    noisy = slopes.select("unit_id", (F.col("b1_slope") + 0.4 * F.sin("unit_id")).alias("b1_slope"), (F.col("b2_slope") + 900 * F.sin("unit_id")).alias("b2_slope"))
    names = ["b1_slope", "b2_slope"]
    parameters = features.scaler_parameters(noisy, names)
    out = stats.slope_agreement(slopes, features.scale(noisy, parameters), parameters, names)
    return out.select("slope_feature", "pearson_r", F.round("p_value", 4).alias("p_value"), "n_valid")


META = [("unit_id", "identifier", "bigint", False, False), *((f"{b}_{s}", "feature", "double", f"{b}_{s}" == "b2_mean", f"{b}_{s}" in ("b1_mean", "b2_mean")) for b in BANDS for s in ("mean", "std")), ("n_b1", "feature", "bigint", False, False), ("n_rows", "feature", "bigint", False, False), ("acctbal", "feature", "double", False, False), ("pref_name", "identifier", "string", False, False), ("region", "identifier", "string", False, False)]


@query('SELECT * FROM (VALUES ' + ", ".join(f"('{c}', '{r}', '{t}', {str(a).lower()}, {str(b).lower()})" for c, r, t, a, b in META) + ') AS t("column", role, dtype, log1p_applied, scaled)')
def feature_metadata(spark, sf_dir):
    """K4."""
    return features.feature_metadata(cross(spark, sf_dir), ["unit_id", "pref_name", "region"], [], ["b2_mean"], ["b1_mean", "b2_mean"])
