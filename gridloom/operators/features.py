"""Feature engineering on the cross-section: ratios, target, drop lists, transforms and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.ordering import exact_quantiles
from gridloom.functions.scalar import at_least
from gridloom.schema import finite, resolve_columns, to_long

#: Target classes from low to high ratio; their places are the codes.
CLASSES = ("stable", "shrinking", "severely_shrinking")


def demographic_ratios(df: DataFrame) -> DataFrame:
    """Shares over a denominator of at least one; a NULL denominator gives NULL."""
    made = {
        "elderly_ratio": ("age_65_plus", "pop_total"),
        "youth_ratio": ("age_u15", "pop_total"),
        "aging_index": ("age_65_plus", "age_u15"),
        "household_size": ("pop_total", "households_total"),
    }
    return df.withColumns({name: F.col(a) / at_least(F.col(b).cast("double"), 1.0) for name, (a, b) in made.items() if len(resolve_columns(df, (a, b))) == 2})


def build_target(df: DataFrame, ratio: str, thresholds: tuple[float, float], labels: tuple[str, str, str] = CLASSES, target: str = "target_class", code: str = "target_code") -> DataFrame:
    """Rows with a finite ratio, and its class and code: below the first threshold 0, below the second 1, else 2."""
    low, high = thresholds
    below = lambda first, second, third: F.when(F.col(ratio) < low, first).when(F.col(ratio) < high, second).otherwise(third)
    return df.where(finite(F.col(ratio))).withColumns({target: below(*map(F.lit, labels)), code: below(F.lit(0), F.lit(1), F.lit(2))})


def drop_correlated(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop features with their ``_mean`` and ``_std`` forms."""
    return df.drop(*resolve_columns(df, [n + s for n in names for s in ("", "_mean", "_std")]))


def shifted_log1p(df: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """log1p of ``X_mean`` or else ``X``; a column with negatives is shifted to start at 0 first."""
    picked = [n for x in names for n in resolve_columns(df, (f"{x}_mean", x))[:1]]
    if not picked:
        return df, []
    low = df.agg(*(F.min(c).alias(c) for c in picked)).first()
    shift = {c: -low[c] if low[c] is not None and low[c] < 0 else 0.0 for c in picked}
    return df.withColumns({c: F.log1p(F.col(c) + F.lit(shift[c])) for c in picked}), picked


def impute(df: DataFrame, columns: list[str], how: str = "median") -> DataFrame:
    """Missing values become the column's exact median, or its mean."""
    if how == "median":
        rows = exact_quantiles(to_long(df, [], columns), "value", (0.5,), ["feature"]).collect()  # a row per column
        values = {r.feature: r.q[0] for r in rows}
    else:
        values = df.agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in columns)).first().asDict()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(values.get(c)).cast("double")) for c in columns})


def scaler_parameters(df: DataFrame, columns: list[str], how: str = "robust") -> DataFrame:
    """Center and scale per column: median and quartile distance, or mean and population deviation; 0 becomes 1."""
    long = to_long(df, [], columns)
    if how == "robust":
        q = exact_quantiles(long, "value", (0.25, 0.5, 0.75), ["feature"])
        stats = q.select("feature", F.col("q")[1].alias("center"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
    else:
        stats = long.groupBy("feature").agg(F.avg("value").alias("center"), F.stddev_pop("value").alias("scale"))
    return stats.withColumn("scale", F.when(F.col("scale") == 0, 1.0).otherwise(F.col("scale")))


def scale(df: DataFrame, parameters: DataFrame) -> DataFrame:
    """(x - center) / scale; the parameters are one row per column."""
    return df.withColumns({r.feature: (F.col(r.feature) - r.center) / r.scale for r in parameters.collect()})


def unscale(df: DataFrame, parameters: DataFrame, logged: list[str] = (), digits: int = 6) -> DataFrame:
    """x * scale + center with rounded parameters, then expm1 of what was logged: an approximate inverse."""
    out = {}
    for r in parameters.collect():
        raw = F.col(r.feature) * round(r.scale, digits) + round(r.center, digits)
        out[r.feature] = F.expm1(raw) if r.feature in logged else raw
    return df.withColumns(out)


def transform(df: DataFrame, columns: list[str], log1p: list[str], how: str = "robust") -> tuple[DataFrame, DataFrame, list[str]]:
    """log1p, then imputation, then scaling; with the parameters and the logged columns."""
    logged, names = shifted_log1p(df, log1p)
    filled = impute(logged, columns)
    parameters = scaler_parameters(filled, columns, how)
    return scale(filled, parameters), parameters, names


def feature_metadata(df: DataFrame, identifiers: list[str], target: list[str], logged: list[str], scaled: list[str]) -> DataFrame:
    """One row per column: role, dtype, and what was done to it."""
    role = {**dict.fromkeys(identifiers, "identifier"), **dict.fromkeys(target, "target")}
    rows = [(c, role.get(c, "feature"), t, c in logged, c in scaled) for c, t in df.dtypes]
    return df.sparkSession.createDataFrame(rows, "column string, role string, dtype string, log1p_applied boolean, scaled boolean")


def validate(df: DataFrame, key: str, columns: list[str], classes: int = 3, code: str = "target_code") -> DataFrame:
    """Output checks from one aggregation: check, passes."""
    nulls = [F.sum(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in columns]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("keys"), F.count_distinct(code).alias("classes"), *nulls)
    checks = [("has_rows", F.col("n") > 0), ("unique_keys", F.col("n") == F.col("keys")), ("all_classes", F.col("classes") == classes), *((f"complete_{c}", F.col(f"null_{c}") == 0) for c in columns)]
    return row.select(F.explode(F.array(*(F.struct(F.lit(n).alias("check"), c.alias("passes")) for n, c in checks))).alias("c")).select("c.*")
