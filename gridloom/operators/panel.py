"""Assembling the unit x month panel: spine, joins with cardinality checks, dedup, health checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.ordering import placed
from gridloom.schema import resolve_columns


def check_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Raise if a key occurs twice; one aggregation whose result is a single row at most."""
    if not df.groupBy(*keys).count().where("count > 1").limit(1).isEmpty():
        raise ValueError(f"keys are not unique: {', '.join(keys)}")
    return df


def join_many_to_one(left: DataFrame, right: DataFrame, keys: list[str], check: bool = True) -> DataFrame:
    """Left join on checked keys; overlapping columns of the right side give way to the left's."""
    extra = [c for c in right.columns if c in left.columns and c not in keys]
    right = right.drop(*extra)
    return left.join(check_unique(right, keys) if check else right, keys, "left")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which NULL keys match each other."""
    other = right.select(*(F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [left[k].eqNullSafe(other[f"__r_{k}"]) for k in keys]
    condition = on[0]
    for c in on[1:]:
        condition &= c
    return left.join(other, condition, "left").drop(*(f"__r_{k}" for k in keys))


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("__rank")


def month_spine(units: DataFrame, start: str, end: str, unit: str = "unit_id") -> DataFrame:
    """Every unit with every month from start to end, both included."""
    months = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
    return units.select(unit).distinct().select(unit, F.explode(months).alias("month"))


def on_spine(panel: DataFrame, spine: DataFrame, keys: list[str]) -> DataFrame:
    """The panel with a fully masked row for each empty month."""
    return spine.join(panel, keys, "left")


def fill_missing_units(found: DataFrame, units: DataFrame, key: str, zero: Iterable[str]) -> DataFrame:
    """Units without a row get one of zeros."""
    absent = units.select(key).join(found, key, "left_anti")
    return found.unionByName(absent.select(key, *(F.lit(0).cast(dict(found.dtypes)[c]).alias(c) for c in zero)), allowMissingColumns=True)


def match_rate(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` whose key is known on the right: n, matched, rate."""
    known = right.select(F.col(key).alias("__known")).where("__known IS NOT NULL").distinct()
    joined = left.join(known, left[key] == F.col("__known"), "left")
    return joined.agg(F.count(F.lit(1)).alias("n"), F.count("__known").alias("matched")).withColumn("rate", F.try_divide(F.col("matched"), F.col("n")))


def join_health(df: DataFrame, columns: list[str], limit: float = 0.95) -> DataFrame:
    """Largest share of missing values over the joined columns, and whether the join passes."""
    picked = resolve_columns(df, columns)
    shares = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in picked))
    worst = F.greatest(*(F.col(c) for c in picked)) if len(picked) > 1 else F.col(picked[0])
    return shares.select(worst.alias("worst_missing_share"), (worst <= limit).alias("passes"))


def pivot_years(df: DataFrame, keys: list[str], year: str, years: list[int], values: list[str]) -> DataFrame:
    """Long to wide: each value per year as ``value_year``; the years are given, so no extra pass finds them."""
    aggs = [F.max(F.when(F.col(year) == y, F.col(v))).alias(f"{v}_{y}") for y in years for v in values]
    return df.groupBy(*keys).agg(*aggs)


def collapse_suffixes(df: DataFrame, suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Of ``name_x``/``name_y`` pairs the left column stays, as ``name``, whatever it holds."""
    left, right = suffixes
    for c in [c[: -len(left)] for c in df.columns if c.endswith(left) and c[: -len(left)] + right in df.columns]:
        df = df.drop(c, c + right).withColumnRenamed(c + left, c)
    return df


def renamed(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names; those that are absent are passed over."""
    return df.withColumnsRenamed({old: new for old, new in names.items() if old in df.columns})


def suffixed(df: DataFrame, keys: list[str], suffix: str) -> DataFrame:
    """Every column but the keys with a suffix, as a census year's."""
    return df.withColumnsRenamed({c: f"{c}_{suffix}" for c in df.columns if c not in keys})


def drop_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.drop(*resolve_columns(df, columns))


def in_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Offset batches of ``size`` rows in key order."""
    return placed(df, order, "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames, by column name; absent columns are NULL."""
    first, *rest = frames
    for other in rest:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def intercensal_change(df: DataFrame, before: str = "2015", after: str = "2020") -> DataFrame:
    """Absolute change and its share of the base (4 digits) between two censuses; NULL for a zero base."""

    def change(c: str) -> Column:
        return F.col(f"{c}_{after}") - F.col(f"{c}_{before}")

    def pct(c: str) -> Column:
        return F.round(F.try_divide(change(c).cast("double"), F.col(f"{c}_{before}").cast("double")), 4)

    return df.withColumns({
        "pop_change": change("pop_total"),
        "pop_change_pct": pct("pop_total"),
        "working_age_change": change("age_15_64"),
        "working_age_change_pct": pct("age_15_64"),
        "youth_change": change("age_u15"),
        "elderly_change": change("age_65_plus"),
    })
