"""Exploratory tables. Everything runs over the long form (ids, feature, value): one shuffle on the feature."""

from __future__ import annotations

from collections.abc import Sequence

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.lineage import cut
from gridloom.functions.ordering import average_ranks, exact_quantiles
from gridloom.schema import to_long

QUARTILES = (0.25, 0.5, 0.75)
PAIRS_PER_PASS = 100
#: Ranks that a task gathers by row.
PER_TASK = 500_000


def known(c: Column) -> Column:
    """NaN (an undefined moment) as NULL."""
    return F.when(~F.isnan(c), c)


def skew_g1(value: str = "value") -> Column:
    """Bias-corrected skewness."""
    n = F.count(value).cast("double")
    return F.when(n > 2, known(F.skewness(value)) * F.sqrt(n * (n - 1)) / F.when(n > 2, n - 2))


def kurtosis_g2(value: str = "value") -> Column:
    """Bias-corrected excess kurtosis."""
    n = F.count(value).cast("double")
    factor = (n - 1) / F.when(n > 3, (n - 2) * (n - 3))
    return F.when(n > 3, factor * ((n + 1) * known(F.kurtosis(value)) + 6))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max, skew, kurtosis, missing count and percentage by feature."""
    n = F.count(F.lit(1))
    long = to_long(df, [], columns)
    stats = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        skew_g1().alias("skew"),
        kurtosis_g2().alias("kurtosis"),
        (n - F.count("value")).alias("missing_count"),
        ((n - F.count("value")) * 100.0 / n).alias("missing_pct"),
    )
    q = {name: F.col("q")[i] for i, name in enumerate(("q25", "q50", "q75"))}
    return stats.join(exact_quantiles(long, "value", QUARTILES, ["feature"]), "feature", "left").select("feature", "count", "mean", "std", "min", *(c.alias(k) for k, c in q.items()), "max", "skew", "kurtosis", "missing_count", "missing_pct")


def group_stats(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """mean, std, min, max and count per group and column, as ``column_stat``; NULL groups are dropped."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "count": F.count}
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(*(f(c).alias(f"{c}_{s}") for c in columns for s, f in stats.items()))


def missing_summary(df: DataFrame, columns: list[str], flag_pct: float = 30.0, by: list[str] | None = None) -> DataFrame:
    """Missing count and percentage per column (and group), flagged above a percentage."""
    by = by or []
    long = to_long(df, by, columns).groupBy(*by, "feature")
    lost = F.sum(F.col("value").isNull().cast("long"))
    out = long.agg(lost.alias("missing_count"), (lost * 100.0 / F.count(F.lit(1))).cast("double").alias("missing_pct"))
    return out.withColumn("flagged", F.col("missing_pct") > flag_pct)


def overall_missing(summary: DataFrame) -> DataFrame:
    """Mean of the columns' missing percentages."""
    return summary.agg(F.avg("missing_pct").alias("overall_missing_pct"))


def iqr_bounds(df: DataFrame, columns: list[str], factor: float = 1.5, min_valid: int = 10) -> DataFrame:
    long = to_long(df, [], columns).where("value IS NOT NULL")
    n = long.groupBy("feature").agg(F.count("value").alias("n_valid")).where(F.col("n_valid") >= min_valid)
    q = n.join(exact_quantiles(long, "value", (0.25, 0.75), ["feature"]), "feature").select("feature", "n_valid", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return q.withColumns({"iqr": iqr, "lower_bound": F.col("q1") - factor * iqr, "upper_bound": F.col("q3") + factor * iqr})


def outlier_rows(df: DataFrame, ids: list[str], columns: list[str], factor: float = 1.5, min_valid: int = 10) -> DataFrame:
    """Every value strictly outside its feature's bounds. There is one row of bounds per listed column."""
    bounds = iqr_bounds(df, columns, factor, min_valid).select("feature", "lower_bound", "upper_bound")
    long = to_long(df, ids, columns).join(F.broadcast(bounds), "feature")
    return long.where((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound")))


def outlier_summary(df: DataFrame, columns: list[str], factor: float = 1.5, min_valid: int = 10) -> DataFrame:
    bounds = iqr_bounds(df, columns, factor, min_valid)
    out = outlier_rows(df, [], columns, factor, min_valid).groupBy("feature").agg(F.count(F.lit(1)).alias("outlier_count"))
    joined = bounds.join(out, "feature", "left").withColumn("outlier_count", F.coalesce("outlier_count", F.lit(0)))
    return joined.withColumn("outlier_pct", F.round(F.col("outlier_count") * 100.0 / F.col("n_valid"), 2))


def zscore_flags(df: DataFrame, columns: list[str], limit: float = 3.0, near_constant: float = 0.01) -> DataFrame:
    """Per column: values beyond ``limit`` deviations, missing values, and whether the variance is tiny."""
    stats = df.agg(*(f(F.col(c).cast("double")).alias(f"{p}{c}") for c in columns for p, f in (("m_", F.avg), ("s_", F.stddev_samp))))
    row = stats.first()
    extreme = lambda c: F.abs((F.col(c) - F.lit(row[f"m_{c}"])) / F.lit(row[f"s_{c}"])) > limit if row[f"s_{c}"] else F.lit(False)
    marked = df.select(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), extreme(c).alias("far")).alias(c) for c in columns))
    long = marked.select(F.explode(F.array(*columns)).alias("s")).select("s.*").groupBy("feature")
    out = long.agg(F.sum(F.coalesce(F.col("far"), F.lit(False)).cast("long")).alias("n_extreme"), F.sum(F.col("value").isNull().cast("long")).alias("n_missing"), F.var_samp("value").alias("variance"))
    medians = exact_quantiles(to_long(df, [], columns), "value", (0.5,), ["feature"]).select("feature", F.col("q")[0].alias("median"))
    out = out.join(medians, "feature", "left")
    return out.withColumn("near_constant", F.col("variance") < near_constant)


def standardised(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Sample z-scores per column, within groups if asked for; the values of a constant column are 0."""
    return _rescaled(df, columns, by, F.avg, F.stddev_samp, lambda x, m, s: F.when(s == 0, (x - m) * 0).otherwise((x - m) / s))


def min_max(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Every column from 0 to 1 between its extremes, within groups if asked for; a constant column is 0.5."""
    return _rescaled(df, columns, by, F.min, F.max, lambda x, low, high: F.when(high == low, x * 0 + 0.5).otherwise((x - low) / (high - low)))


def _rescaled(df: DataFrame, columns: list[str], by: list[str] | None, first, second, made) -> DataFrame:
    """Columns made anew from two aggregates of theirs: literals, or a join of a row per group."""
    value = lambda c: F.col(c).cast("double")
    aggs = [f(value(c)).alias(f"__{i}_{c}") for c in columns for i, f in enumerate((first, second))]
    if by:
        joined = df.join(df.groupBy(*by).agg(*aggs), by)
        return joined.withColumns({c: made(value(c), F.col(f"__0_{c}"), F.col(f"__1_{c}")) for c in columns}).select(*df.columns)
    row = df.agg(*aggs).first()
    side = lambda i, c: F.lit(row[f"__{i}_{c}"]).cast("double")
    return df.withColumns({c: made(value(c), side(0, c), side(1, c)) for c in columns})


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; NULL for a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def correlations(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson r and n per pair, over rows where both are present. Up to PAIRS_PER_PASS pairs take one aggregation; of
    more, those of columns without gaps come from one covariance matrix and the others from passes of that width over
    the staged columns."""
    out = None
    if len(pairs) > PAIRS_PER_PASS:
        names = list(dict.fromkeys(c for p in pairs for c in p))
        df = cut(df.select(*(F.col(c).cast("double").alias(c) for c in names)))
        lost = df.agg(*(F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in names)).first()
        whole = [c for c in names if not lost[c]]
        out = _matrix_pairs(df, whole, [p for p in pairs if p[0] in whole and p[1] in whole])
        pairs = [p for p in pairs if p[0] not in whole or p[1] not in whole]
    for at in range(0, len(pairs), PAIRS_PER_PASS):
        run = pairs[at : at + PAIRS_PER_PASS]
        aggs = [F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("r"), F.count(F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)).alias("n")).alias(f"p{i}") for i, (a, b) in enumerate(run)]
        part = df.agg(*aggs).select(F.explode(F.array(*(f"p{i}" for i in range(len(run))))).alias("p")).select("p.*")
        out = part if out is None else out.unionByName(part)
    return out


def _matrix_pairs(df: DataFrame, columns: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """Pairs of columns without gaps, from their covariance matrix."""
    from gridloom.operators.stats import moments

    rows = []
    if pairs:
        cov, _, n = moments(df, columns)
        at = {c: i for i, c in enumerate(columns)}
        for a, b in pairs:
            scale = (cov[at[a], at[a]] * cov[at[b], at[b]]) ** 0.5
            rows.append((a, b, float(cov[at[a], at[b]] / scale) if scale > 0 else None, n))
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, r double, n long")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """The upper triangle as pairs."""
    return correlations(df, list(combinations(columns, 2)))


def high_correlations(pairs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs from ``threshold`` on, with their names and absolute values."""
    strong = pairs.where(F.abs("r") >= threshold)
    return strong.select(F.concat_ws(" - ", "feature_1", "feature_2").alias("pair"), "feature_1", "feature_2", F.col("r").alias("correlation"), F.abs("r").alias("abs_correlation"))


def spearman(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Pearson of average ranks within pair-valid rows, for all pairs at once. A column is ranked once for all pairs
    whose partner misses no value that it has; only other pairs get ranks of their own."""
    names = list(dict.fromkeys(c for p in pairs for c in p))
    rows = cut(df.select(F.monotonically_increasing_id().alias("__id"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names))))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    both = [(at[a], at[b]) for a, b in pairs]
    lost = rows.agg(F.count(F.lit(1)).alias("__n"), *(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNull(), 1)).alias(f"{x}_{y}") for a, b in both for x, y in ((a, b), (b, a)))).first()
    sides = {}
    for a, b in both:
        for x, y in ((a, b), (b, a)):
            sides[x, y] = (x, F.col(x)) if not lost[f"{x}_{y}"] else (f"{x}_{y}", F.when(F.col(y).isNotNull(), F.col(x)))
    keyed = dict(sides.values())
    long = rows.select("__id", F.explode(F.array(*(F.struct(F.lit(k).alias("key"), c.alias("value")) for k, c in keyed.items()))).alias("s")).select("__id", "s.*").where("value IS NOT NULL")
    ranked = average_ranks(long, "value", ["key"])
    # Dealt by row before they are gathered: gathering within what ranks come in would hold nearly all rows of a task.
    parts = max(1, -(-lost["__n"] * len(keyed) // PER_TASK))
    dealt = ranked.select("__id", "key", "avg_rank").repartition(parts, "__id")
    wide = cut(dealt.groupBy("__id").agg(*(F.max(F.when(F.col("key") == k, F.col("avg_rank"))).alias(k) for k in keyed)))
    table = correlations(wide, [(sides[a, b][0], sides[b, a][0]) for a, b in both])
    named = F.array(*(F.struct(F.lit(sides[x, y][0]).alias("k1"), F.lit(sides[y, x][0]).alias("k2"), F.lit(a).alias("f1"), F.lit(b).alias("f2")) for (a, b), (x, y) in zip(pairs, both, strict=True)))
    match = F.filter(named, lambda n: (n["k1"] == F.col("feature_1")) & (n["k2"] == F.col("feature_2")))[0]
    return table.withColumn("m", match).select(F.col("m.f1").alias("feature_1"), F.col("m.f2").alias("feature_2"), "r", "n")


def distribution_summary(df: DataFrame, columns: list[str], min_valid: int = 8) -> DataFrame:
    """Moments and a suggested transform by skewness and sign."""
    long = to_long(df, [], columns).where("value IS NOT NULL").groupBy("feature")
    out = long.agg(F.count("value").alias("n_valid"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), skew_g1().alias("skewness"), kurtosis_g2().alias("kurtosis"), F.min("value").alias("low"))
    size, positive = F.abs("skewness"), F.col("low") >= 0
    advice = F.when(size > 2, F.when(positive, "log1p").otherwise("robust_scale")).when(size > 1, F.when(positive, "sqrt").otherwise("robust_scale")).otherwise("none")
    return out.where(F.col("n_valid") >= min_valid).withColumn("suggested_transform", advice).drop("low")


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Counts by equal-width bins between the column's extremes; the largest value is in the last bin."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, n long")
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).cast("int")
    return df.where(F.col(column).isNotNull()).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, group: str, column: str) -> DataFrame:
    """Five-number summary per group."""
    rows = df.where(F.col(group).isNotNull())
    q = rows.groupBy(group).agg(F.min(column).alias("low"), F.max(column).alias("high")).join(exact_quantiles(rows, column, QUARTILES, [group]), group, "left")
    return q.select(group, "low", *(F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))), "high")


def top_by(table: DataFrame, order: Column, n: int) -> DataFrame:
    return table.orderBy(order.desc(), "feature").limit(n)


def fit_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Degree-one fit and r of a scatter."""
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    return rows.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), safe_corr(F.col("x"), F.col("y")).alias("r"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"))


def quality_checks(missing: DataFrame, pairs: DataFrame, outliers: DataFrame, coverage: DataFrame, distribution: DataFrame, expected: list[str], present: list[str], texture: list[str], missing_limit: float = 20.0, corr_limit: float = 0.8, min_months: int = 24) -> DataFrame:
    """Rule table over the summaries, one row per check: check, status (``ok`` or ``warn``), n. n counts absent
    expected columns, columns above the missing limit, texture columns present, units with gaps, outlying values,
    strong pairs and features that a transform would help; coverage warns if a unit has fewer than ``min_months``."""
    spark = missing.sparkSession
    absent = [c for c in expected if c not in present]
    count = lambda df, when: df.agg(F.count(F.when(when, 1)).alias("n"))
    row = lambda df, check, warns: df.select(F.lit(check).alias("check"), F.when(warns, "warn").otherwise("ok").alias("status"), F.col("n").cast("long").alias("n"))
    fixed = [("expected_columns", "warn" if absent else "ok", len(absent)), ("texture_available", "ok", len([c for c in texture if c in present]))]
    parts = [
        spark.createDataFrame(fixed, "check string, status string, n long"),
        row(count(missing, F.col("missing_pct") > missing_limit), "missing_rates", F.col("n") > 0),
        row(coverage.agg(F.count(F.when(F.col("gap_count") > 0, 1)).alias("n"), F.min("n_valid_months").alias("least")), "temporal_coverage", F.coalesce(F.col("least"), F.lit(0)) < min_months),
        row(outliers.agg(F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("tables")), "outliers_documented", F.col("tables") == 0),
        row(count(pairs, F.abs("r") >= corr_limit), "high_correlations", F.col("n") > 0),
        row(count(distribution, F.col("suggested_transform") != "none"), "distributions_understood", F.lit(False)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def key_findings(missing: DataFrame, distribution: DataFrame, pairs: DataFrame, amplitude: DataFrame, relations: DataFrame, corr_limit: float = 0.8) -> DataFrame:
    """What a report would say first: topic, place, subject, value. Overall missing share; up to five skewed features;
    up to three strong pairs; seasonal amplitudes by feature (mean over units); the strongest relation."""
    top = lambda df, order, n: df.orderBy(*order).limit(n)
    ranked = lambda df, topic, order: df.select(F.lit(topic).alias("topic"), F.row_number().over(Window.orderBy(*order)).alias("place"), "subject", F.col("value").cast("double").alias("value"))
    overall = overall_missing(missing).select(F.lit("missing").alias("topic"), F.lit(1).alias("place"), F.lit("overall").alias("subject"), F.col("overall_missing_pct").alias("value"))
    skewed = distribution.where("suggested_transform <> 'none'").select(F.col("feature").alias("subject"), F.col("skewness").alias("value"))
    strong = pairs.where(F.abs("r") >= corr_limit).select(F.concat_ws("/", "feature_1", "feature_2").alias("subject"), F.col("r").alias("value"))
    link = relations.where("r IS NOT NULL").select(F.concat_ws("/", "feature_1", "feature_2").alias("subject"), F.col("r").alias("value"))
    seasonal = to_long(amplitude, [], [c for c in amplitude.columns if c.endswith("_seasonal_amp")]).groupBy(F.col("feature").alias("subject")).agg(F.avg("value").alias("value"))
    by_size = [F.abs("value").desc(), F.col("subject")]
    out = overall
    for topic, table, n in (("skewed", skewed, 5), ("correlated", strong, 3), ("seasonal", seasonal, None), ("strongest_link", link, 1)):
        out = out.unionByName(ranked(top(table, by_size, n) if n else table, topic, by_size))  # a few rows each
    return out


def quality_flags(missing: DataFrame, outliers: DataFrame, coverage: DataFrame, missing_limit: float = 20.0, outlier_limit: float = 5.0, texture: Sequence[str] = (), most: int = 5) -> DataFrame:
    """Flag rows: type, feature, unit_id, month, detail. Features above the missing limit (detail: percent), a note of
    the texture columns there are (their number), of the ``most`` features with the largest outlier shares those above
    the limit (percent), and units with gaps (their number). Flags are about the whole table, so unit_id and month are
    empty."""
    row = lambda df, kind, detail: df.select(F.lit(kind).alias("type"), "feature", F.lit("").alias("unit_id"), F.lit("").alias("month"), F.col(detail).cast("double").alias("detail"))
    high = row(missing.where(F.col("missing_pct") > missing_limit), "high_missing", "missing_pct")
    far = outliers.orderBy(F.desc("outlier_pct"), "feature").limit(most).where(F.col("outlier_pct") > outlier_limit)
    gaps = coverage.agg(F.count(F.when(F.col("gap_count") > 0, 1)).alias("n")).where("n > 0").withColumn("feature", F.lit(""))
    out = high.unionByName(row(far, "high_outlier_rate", "outlier_pct")).unionByName(row(gaps, "temporal_gaps", "n"))
    if texture:
        note = missing.sparkSession.createDataFrame([("/".join(texture), len(texture))], "feature string, n long")
        out = out.unionByName(row(note, "texture_available", "n"))
    return out


def heatmap(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """Missing percentages by group and feature, with an ``Overall`` row per feature."""
    own = missing_summary(df.where(F.col(group).isNotNull()), columns, by=[group]).select(F.col(group).cast("string").alias(group), "feature", "missing_pct")
    return own.unionByName(missing_summary(df, columns).select(F.lit("Overall").alias(group), "feature", "missing_pct"))
