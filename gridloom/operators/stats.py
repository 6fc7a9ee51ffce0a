"""Tests and regressions: sums in Spark, the last few numbers on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions import pvalues
from gridloom.functions.ordering import average_ranks, exact_quantiles  # noqa: F401  (ranks are part of this module's interface)


def anova(long: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """One-way F per feature from per-group counts, sums and squares: feature, f_statistic, df1, df2."""
    rows = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    cells = rows.groupBy(feature, group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    w = Window.partitionBy(feature)
    grand = F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w)
    parts = cells.withColumn("d", F.col("m") - grand)
    sums = parts.groupBy(feature).agg(F.sum(F.col("n") * F.col("d") * F.col("d")).alias("ssb"), F.sum(F.col("n") * F.col("v")).alias("ssw"), (F.count(F.lit(1)) - 1).alias("df1"), (F.sum("n") - F.count(F.lit(1))).alias("df2"))
    return sums.select(feature, F.try_divide(F.try_divide(F.col("ssb"), F.col("df1")), F.try_divide(F.col("ssw"), F.col("df2"))).alias("f_statistic"), "df1", "df2")


def with_p(table: DataFrame, p) -> DataFrame:
    """A small table of statistics with a p-value column; ``p`` maps a row's dict to a number."""
    rows = [(*r, p(r.asDict())) for r in table.collect()]  # a row per feature
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.sparkSession.createDataFrame(rows, f"{kinds}, p_value double")


def anova_p(table: DataFrame) -> DataFrame:
    return with_p(table, lambda r: None if r["f_statistic"] is None else pvalues.f_sf(r["f_statistic"], r["df1"], r["df2"]))


def kruskal_wallis(long: DataFrame, group: str, feature: str = "feature", value: str = "value") -> DataFrame:
    """H with tie correction per feature: feature, h_statistic, df."""
    rows = long.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    ranked = average_ranks(rows, value, [feature])
    groups = ranked.groupBy(feature, group).agg(F.count(F.lit(1)).alias("n"), F.sum("avg_rank").alias("r"))
    h = groups.groupBy(feature).agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), (F.count(F.lit(1)) - 1).alias("df"))
    t = F.col("count").cast("double")
    ties = rows.groupBy(feature, value).count().groupBy(feature).agg(F.sum(t * t * t - t).alias("ties"))
    n = F.col("n")
    correction = 1 - F.col("ties") / (n * n * n - n)
    statistic = F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), correction)
    return h.join(ties, feature).select(feature, statistic.alias("h_statistic"), "df")


def kruskal_p(table: DataFrame) -> DataFrame:
    return with_p(table, lambda r: None if r["h_statistic"] is None else pvalues.chi2_sf(r["h_statistic"], r["df"]))


def friedman(scores: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Tie-corrected chi-square over blocks: chi2, k, n."""
    w, same = Window.partitionBy(block).orderBy(value), Window.partitionBy(block, value)
    ranked = scores.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(same) - 1) / 2)
    per = ranked.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("count").cast("double")
    ties = scores.groupBy(block, value).count().agg(F.sum(t * t * t - t).alias("ties"))
    sums = per.agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.count(F.lit(1)).cast("double").alias("k"), F.max("n").cast("double").alias("n"))
    k, n = F.col("k"), F.col("n")
    chi = 12 / (n * k * (k + 1)) * F.col("s") - 3 * n * (k + 1)
    return sums.join(ties).select(F.try_divide(chi, 1 - F.col("ties") / (n * k * (k * k - 1))).alias("chi2"), "k", "n")


def wilcoxon(differences: list[float]) -> tuple[float, float]:
    """Signed-rank statistic and two-sided p: exact up to 50 untied non-zero differences, else normal."""
    d = np.array([x for x in differences if x], float)
    n = len(d)
    if not n:
        return 0.0, 1.0
    size = np.abs(d)
    order = np.sort(size)
    ranks = (np.searchsorted(order, size, "left") + np.searchsorted(order, size, "right") + 1) / 2
    plus, minus = ranks[d > 0].sum(), ranks[d < 0].sum()
    stat = min(plus, minus)
    counts = np.unique(size, return_counts=True)[1]
    if n <= 50 and counts.max() == 1 and n == len(differences):
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return float(stat), float(min(1.0, 2 * ways[: int(stat) + 1].sum() / 2.0**n))
    var = n * (n + 1) * (2 * n + 1) / 24 - (counts**3 - counts).sum() / 48
    return float(stat), float(2 * pvalues.normal_sf(abs(stat - n * (n + 1) / 4) / math.sqrt(var)))


def paired_t(differences: list[float]) -> tuple[float, float]:
    d = np.array(differences, float)
    sd = d.std(ddof=1)
    if len(d) < 2 or sd == 0:
        return 0.0, 1.0
    t = d.mean() / (sd / math.sqrt(len(d)))
    return float(t), float(pvalues.t_two_sided(float(t), len(d) - 1))


def pairwise_tests(folds: DataFrame, model: str, fold: str, value: str, alpha: float = 0.05, test=wilcoxon) -> DataFrame:
    """Paired tests between all models with Bonferroni correction; folds are few."""
    rows = {}
    for r in folds.select(model, fold, value).collect():
        rows.setdefault(r[0], {})[r[1]] = r[2]
    names = sorted(rows)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    out = []
    for a, b in pairs:
        stat, p = test([rows[a][f] - rows[b][f] for f in sorted(rows[a]) if f in rows[b]])
        adjusted = min(1.0, p * len(pairs))
        out.append((a, b, stat, p, adjusted, adjusted < alpha))
    return folds.sparkSession.createDataFrame(out, "model_a string, model_b string, statistic double, p_value double, p_adjusted double, significant boolean")


def moments(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Covariance (by n) of complete rows, their means and n. A few columns take one aggregation; many take two passes:
    means first, then every partition's cross products of the centred rows, added up."""
    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    for c in rows.columns:  # one predicate a column: the planner multiplies a predicate over many renamed columns
        rows = rows.where(F.col(c).isNotNull())
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    centre = [F.count(F.lit(1)).alias("n"), *(F.avg(f"c{i}").alias(f"m{i}") for i in range(p))]
    if len(pairs) <= 100:
        r = rows.agg(*centre, *(F.covar_pop(f"c{i}", f"c{j}").alias(f"v{i}_{j}") for i, j in pairs)).first()
        n, means = r["n"], np.array([r[f"m{i}"] for i in range(p)], float)
        out = np.zeros((p, p))
        for i, j in pairs:
            out[i, j] = out[j, i] = r[f"v{i}_{j}"] if r[f"v{i}_{j}"] is not None else math.nan
        return out, means, n
    r = rows.agg(*centre).first()
    n, means = r["n"], np.array([r[f"m{i}"] for i in range(p)], float)

    def products(frames):
        import pandas as pd

        total = np.zeros((p, p))
        for frame in frames:
            x = frame.to_numpy() - means
            total += x.T @ x
        yield pd.DataFrame({"part": [total.ravel().tolist()]})

    parts = rows.mapInPandas(products, "part array<double>")  # a row per partition
    sums = parts.select(F.posexplode("part").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    return np.array([s["v"] for s in sums]).reshape(p, p) / max(n, 1), means, n


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares with intercept from the covariance matrix: coefficients with SE, t, p and 95% limits, R2,
    adjusted R2 and F."""
    cov, means, n = moments(df, [*xs, y])
    p = len(xs)
    sxx, sxy, syy = cov[:p, :p] * n, cov[:p, p] * n, cov[p, p] * n
    inverse = np.linalg.inv(sxx)
    beta = inverse @ sxy
    rss = max(syy - sxy @ beta, 0.0)
    dof = n - p - 1
    s2 = rss / dof
    se = np.sqrt(np.r_[s2 / n + s2 * means[:p] @ inverse @ means[:p], s2 * np.diag(inverse)])
    coef = np.r_[means[p] - means[:p] @ beta, beta]
    t = coef / se
    q = pvalues.t_quantile(0.975, dof)
    r2 = 1 - rss / syy
    f = (r2 / p) / ((1 - r2) / dof)
    table = [(name, float(b), float(s), float(v), pvalues.t_two_sided(float(v), dof), float(b - q * s), float(b + q * s)) for name, b, s, v in zip(["const", *xs], coef, se, t, strict=True)]
    return {"coefficients": table, "r2": float(r2), "adj_r2": float(1 - (1 - r2) * (n - 1) / dof), "f": float(f), "f_p": pvalues.f_sf(float(f), p, dof), "n": n, "rss": float(rss), "aic": float(n * math.log(2 * math.pi * rss / n) + n + 2 * (p + 1))}


def fitted(df: DataFrame, y: str, xs: list[str], model: dict) -> DataFrame:
    """``df`` with prediction and residual."""
    beta = {r[0]: r[1] for r in model["coefficients"]}
    prediction = F.lit(beta["const"])
    for x in xs:
        prediction = prediction + F.col(x) * beta[x]
    return df.withColumn("prediction", prediction).withColumn("residual", F.col(y) - F.col("prediction"))


def breusch_pagan(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Regress squared residuals on the regressors: LM = n R2 against chi-square with p degrees."""
    squared = fitted(df, y, xs, ols(df, y, xs)).withColumn("__e2", F.col("residual") * F.col("residual"))
    second = ols(squared, "__e2", xs)
    lm = second["n"] * second["r2"]
    return {"lm": lm, "p_value": pvalues.chi2_sf(lm, len(xs)), "f": second["f"], "f_p": second["f_p"]}


def vif(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Diagonal of the inverse correlation matrix of complete rows."""
    cov, _, _ = moments(df, columns)
    scale = np.sqrt(np.diag(cov))
    corr = cov / np.outer(scale, scale)
    if np.linalg.cond(corr) < 1e12:
        return dict(zip(columns, np.diag(np.linalg.inv(corr)).tolist(), strict=True))
    out = {}
    for j, c in enumerate(columns):  # a column that others determine has an infinite factor
        rest = np.delete(np.arange(len(columns)), j)
        lack = 1 - corr[j, rest] @ np.linalg.pinv(corr[np.ix_(rest, rest)]) @ corr[rest, j]
        out[c] = float(1 / lack) if lack > 1e-10 else math.inf
    return out


def drop_by_vif(df: DataFrame, columns: list[str], limit: float = 5.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Take out the column with the largest factor (rounded to 2 digits) while it is above ``limit``."""
    left, gone = list(columns), []
    while len(left) > 1:
        factors = {c: round(v, 2) for c, v in vif(df, left).items()}
        worst = max(left, key=lambda c: factors[c])
        if factors[worst] <= limit:
            break
        gone.append((worst, factors[worst]))
        left.remove(worst)
    return left, gone


def bivariate(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Slope, intercept, r2, n and the slope's p-value of y on each x alone, in one aggregation."""
    made = []
    for x in xs:
        a, b = F.col(x).cast("double"), F.col(y).cast("double")
        made.append(F.struct(F.lit(x).alias("feature"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.regr_r2(b, a).alias("r2"), F.regr_count(b, a).alias("n")))
    table = df.agg(*(m.alias(f"f{i}") for i, m in enumerate(made))).select(F.explode(F.array(*(f"f{i}" for i in range(len(xs))))).alias("f")).select("f.*")
    return with_p(table, lambda r: pvalues.pearson_p(None if r["r2"] is None else math.sqrt(max(r["r2"], 0.0)), r["n"]))


def correlation_p(pairs: DataFrame, tests: int | None = None, alpha: float = 0.05) -> DataFrame:
    """Pairs (r, n) with two-sided p and a Bonferroni verdict."""
    limit = alpha / (tests or max(1, pairs.count()))
    out = with_p(pairs, lambda r: pvalues.pearson_p(r["r"], r["n"]))
    return out.withColumn("significant", F.col("p_value") < limit)


def percentile_ci(df: DataFrame, by: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """Mean with percentile confidence limits."""
    q = exact_quantiles(df, value, (alpha / 2, 1 - alpha / 2), by)
    both = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).join(q, by, "left")
    return both.select(*by, "mean", "std", F.col("q")[0].alias("ci_lower"), F.col("q")[1].alias("ci_upper"))


def near_constant(df: DataFrame, columns: list[str], min_variance: float = 0.01) -> list[str]:
    """Columns whose sample variance is below a limit."""
    row = df.agg(*(F.var_samp(F.col(c).cast("double")).alias(c) for c in columns)).first()
    return [c for c in columns if row[c] is not None and row[c] < min_variance]


def prune_redundant(pairs: DataFrame, columns: list[str], keep: list[str], limit: float = 0.85, constant: list[str] = (), tolerance: float = 1e-6) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Drop near-constant columns that are not on the keep-list, then one of the most correlated pair until none
    reaches ``limit``. Pairwise r does not change when columns go, so the matrix is computed once. Of pairs within
    ``tolerance`` of the largest |r| the one with the last first column counts, and of these that with the first
    second column. Of a pair, one on the keep-list stays; else the column with the larger mean |r| (the zero
    diagonal included) goes."""
    at = {c: i for i, c in enumerate(columns)}
    m = np.zeros((len(columns), len(columns)))
    for r in pairs.collect():
        if r["r"] is not None and r["feature_1"] in at and r["feature_2"] in at:
            m[at[r["feature_1"]], at[r["feature_2"]]] = m[at[r["feature_2"]], at[r["feature_1"]]] = abs(r["r"])
    gone = [(c, "near-constant", 0.0) for c in columns if c in constant and c not in keep]
    left = [at[c] for c in columns if c not in {g[0] for g in gone}]
    while len(left) > 1:
        own = m[np.ix_(left, left)]
        top = own.max()
        if top < limit:
            break
        level = np.argwhere(np.triu(np.abs(own - top) < tolerance, 1))
        first = level[:, 0].max()
        second = level[level[:, 0] == first, 1].min()
        a, b = left[first], left[second]
        kept = [columns[x] in keep for x in (a, b)]
        out = b if kept[0] and not kept[1] else a if kept[1] and not kept[0] else (a if own[first].mean() >= own[second].mean() else b)
        gone.append((columns[out], columns[b if out == a else a], float(own[first, second])))
        left.remove(out)
    return [columns[i] for i in left], gone


def slope_agreement(slopes: DataFrame, scaled: DataFrame, parameters: DataFrame, columns: list[str], unit: str = "unit_id", digits: int = 6) -> DataFrame:
    """Recomputed slopes against those scaled back with parameters rounded as stored: slope_feature, pearson_r (4
    digits), p_value (6), n_valid; fewer than three common units give no r. Columns that either side lacks are
    passed over."""
    from gridloom.operators.eda import correlations

    picked = [c for c in columns if c in slopes.columns and c in scaled.columns]
    own = {r.feature: (round(r.center, digits), round(r.scale, digits)) for r in parameters.collect()}  # a row per column
    raw = scaled.select(unit, *((F.col(c) * own.get(c, (0.0, 1.0))[1] + own.get(c, (0.0, 1.0))[0]).alias(f"__raw_{c}") for c in picked))
    table = correlations(slopes.select(unit, *picked).join(raw, unit), [(c, f"__raw_{c}") for c in picked])
    tested = with_p(table, lambda r: pvalues.pearson_p(r["r"], r["n"]) if r["n"] >= 3 else None)
    enough = F.col("n") >= 3
    return tested.select(F.col("feature_1").alias("slope_feature"), F.when(enough, F.round("r", 4)).alias("pearson_r"), F.round("p_value", 6).alias("p_value"), F.col("n").alias("n_valid"))


def qq_points(df: DataFrame, value: str) -> DataFrame:
    """Normal quantile-quantile data of the standardised values, by sorted position: place, theoretical, observed.
    The theoretical quantile is the inverse normal at (place - 0.5) / n."""
    from gridloom.functions.ordering import placed

    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    total = rows.agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.stddev_samp("v").alias("s")).first()
    ordered = placed(rows, ["v"])
    p = (F.col("place") + 0.5) / F.lit(total["n"])
    observed = F.try_divide(F.col("v") - F.lit(total["m"]), F.lit(total["s"]))
    return ordered.select((F.col("place") + 1).alias("place"), inverse_normal(p).alias("theoretical"), observed.alias("observed"))


def inverse_normal(p):
    """The standard normal quantile of a column of shares."""

    @F.pandas_udf("double")
    def quantile(v):
        import pandas as pd

        return pd.Series([normal_quantile(x) for x in v], dtype=float)

    return quantile(p)


def shapiro_wilk(values: list[float]) -> tuple[float, float]:
    """W and p by the published R94 approximation, for 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ss, u = (m * m).sum(), 1 / math.sqrt(n)
    c = m / math.sqrt(ss)
    a = np.empty(n)
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0, math.sqrt(0.5))
    else:
        # The polynomial coefficients of the approximation.
        last = c[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
        before = c[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        if n > 5:
            phi = (ss - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * before**2)
            a[2:-2] = m[2:-2] / math.sqrt(phi)
            a[-1], a[-2], a[0], a[1] = last, before, -last, -before
        else:
            phi = (ss - 2 * m[-1] ** 2) / (1 - 2 * last**2)
            a[1:-1] = m[1:-1] / math.sqrt(phi)
            a[-1], a[0] = last, -last
    w = min(1.0, float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    y = math.log(max(1 - w, 1e-300))
    if n <= 11:
        gamma = np.polyval([0.459, -2.273], n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n), math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
    else:
        log_n = math.log(n)
        mean, sd = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, pvalues.normal_sf((y - mean) / sd)


def normal_quantile(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A seeded sample without replacement: the n smallest hashes of the key."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


