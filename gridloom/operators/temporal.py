"""Per-unit time operators. Every function groups by the unit alone, so that one exchange on it serves all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mean_std(columns: list[str], zero_std: bool = True) -> list[Column]:
    """Mean and sample deviation per column; a single value has deviation 0, none has NULL mean."""
    out = []
    for c in columns:
        std = F.stddev_samp(c)
        out += [F.avg(c).alias(f"{c}_mean"), (F.coalesce(std, F.lit(0.0)) if zero_std else std).alias(f"{c}_std")]
    return out


def with_days(panel: DataFrame, unit: str = "unit_id", month: str = "month") -> DataFrame:
    """Days since the unit's first month, over all of its rows."""
    return panel.withColumn("days", F.datediff(F.col(month), F.min(month).over(Window.partitionBy(unit))))


def trend_slopes(columns: list[str], min_points: int = 3, digits: int = 6) -> list[Column]:
    """Slope against time scaled to [0, 1] over the unit's whole span; NULL with too few rows, values or days."""
    span, rows = F.max("days"), F.count(F.lit(1))
    enough = lambda c: (rows >= min_points) & (span > 0) & (F.count(c) >= min_points)
    return [F.when(enough(c), F.round(F.regr_slope(c, F.col("days")) * span, digits)).alias(f"{c}_slope") for c in columns]


def seasonal_amplitude(panel: DataFrame, columns: list[str], unit: str = "unit_id", month: str = "month", digits: int = 6) -> DataFrame:
    """Largest minus smallest month-of-year mean, from two such means on."""
    inner = panel.groupBy(unit, F.month(month).alias("__moy")).agg(*(F.avg(c).alias(c) for c in columns))
    return inner.groupBy(unit).agg(*(F.when(F.count(c) >= 2, F.round(F.max(c) - F.min(c), digits)).alias(f"{c}_seasonal_amp") for c in columns))


def variation(columns: list[str], tiny: float = 1e-10) -> list[Column]:
    """Deviation over absolute mean, from two values and a mean that is not zero on."""
    return [F.when((F.count(c) > 1) & (F.abs(F.avg(c)) > tiny), F.try_divide(F.stddev_samp(c), F.abs(F.avg(c)))).alias(f"{c}_cv") for c in columns]


def first_values(columns: list[str], month: str = "month") -> list[Column]:
    """The value of the earliest month, NULL or not."""
    return [F.min_by(c, month).alias(c) for c in columns]


def coverage(panel: DataFrame, columns: list[str], unit: str = "unit_id", month: str = "month", gap_days: int = 35) -> DataFrame:
    """Months, valid months (any column present), their share, first and last valid month, and gaps between
    consecutive valid months of more than ``gap_days``."""
    valid = panel.withColumn("__valid", F.coalesce(*(F.col(c).cast("double") for c in columns)).isNotNull())
    w = Window.partitionBy(unit, "__valid").orderBy(month)
    gaps = valid.withColumn("__gap", F.when(F.col("__valid") & (F.datediff(F.col(month), F.lag(month).over(w)) > gap_days), 1).otherwise(0))
    n, ok = F.count(F.lit(1)), F.sum(F.col("__valid").cast("int"))
    return gaps.groupBy(unit).agg(
        n.alias("n_total_months"),
        ok.cast("long").alias("n_valid_months"),
        F.round(ok * 100.0 / n, 2).alias("valid_pct"),
        F.min(F.when(F.col("__valid"), F.col(month))).alias("first_month"),
        F.max(F.when(F.col("__valid"), F.col(month))).alias("last_month"),
        F.sum("__gap").cast("long").alias("gap_count"),
    )


def cross_section(panel: DataFrame, columns: list[str], static: list[str], unit: str = "unit_id", month: str = "month", min_points: int = 3) -> DataFrame:
    """One row per unit: means, deviations, slopes, first static values, and seasonal amplitudes."""
    flat = with_days(panel, unit, month).groupBy(unit).agg(*mean_std(columns), *trend_slopes(columns, min_points), *first_values(static, month))
    return flat.join(seasonal_amplitude(panel, columns, unit, month), unit, "left")


def mean_of_period_means(df: DataFrame, key: str, period: str, columns: list[str]) -> DataFrame:
    """Unweighted mean over periods of each period's mean."""
    inner = df.groupBy(key, period).agg(*(F.avg(c).alias(c) for c in columns))
    return inner.groupBy(key).agg(*(F.avg(c).alias(c) for c in columns))


def median_composite(scenes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Median over the scenes of a cell; masked values are NULL and ignored."""
    return scenes.groupBy(*keys).agg(*(F.median(c).alias(c) for c in columns))


def weighted_mean(df: DataFrame, keys: list[str], columns: list[str], weight: str) -> DataFrame:
    """Zonal means: weights of missing pixels do not count."""
    w = F.col(weight)
    return df.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c) for c in columns))
