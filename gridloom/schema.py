"""Schemas, column discovery and the NaN/NULL boundary."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key columns of a panel, never analysed as features.
KEYS = ("unit_id", "unit_level", "pref_name", "unit_code", "month", "month_dt")

PANEL_KEYS = T.StructType([T.StructField(n, T.StringType()) for n in ("unit_id", "unit_level", "pref_name", "unit_code", "month")])


def panel_schema(features: Iterable[str]) -> T.StructType:
    """Pinned read schema: string keys (leading zeros matter) and double features."""
    return T.StructType([*PANEL_KEYS.fields, *(T.StructField(f, T.DoubleType()) for f in features)])


def nan_to_null(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing is NULL: NaN would poison every aggregate."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType | T.FloatType)]
    picked = [c for c in floats if columns is None or c in set(columns)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in picked}) if picked else df


def resolve_columns(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted columns that exist, in the order asked for."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = KEYS) -> list[str]:
    """Columns of a numeric type; derived ``year`` and ``month_num`` count unless excluded."""
    gone = set(exclude)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in gone]


def require_columns(df: DataFrame, needed: Iterable[str]) -> DataFrame:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """One row per id and column; NULL values stay."""
    return df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(ids, columns, name, value)


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
