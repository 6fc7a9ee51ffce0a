"""Sinks: tables, result files, manifests."""

from __future__ import annotations

import json
from datetime import UTC, date, datetime
from html import escape
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_both(df: DataFrame, path: str, by: list[str] | None = None, rows_per_file: int = 0) -> None:
    """The same rows as Parquet and CSV beside each other."""
    kept = df.persist()
    for kind in ("parquet", "csv"):
        writer = kept.write.mode("overwrite").option("header", True)
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        if by:
            writer = writer.partitionBy(*by)
        writer.format(kind).save(f"{path}.{kind}")
    kept.unpersist()


def write_month(df: DataFrame, path: str) -> None:
    """Replace only the months that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A small result table in one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def plain(value):
    """Values that JSON can hold, recursively."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [plain(v) for v in value]
    if isinstance(value, datetime | date):
        return value.isoformat()
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


def write_json(path: str, value) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(value), indent=2, ensure_ascii=False), encoding="utf-8")


def manifest(df: DataFrame, **extra) -> dict:
    """Row count, columns, months and time of writing."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *([F.min("month").alias("a"), F.max("month").alias("z")] if "month" in df.columns else [])).first()
    out = {"row_count": row["n"], "columns": df.columns, "created_utc": datetime.now(UTC).isoformat()}
    if "month" in df.columns:
        out |= {"first_month": row["a"], "last_month": row["z"]}
    return out | extra


#: Names in the record of an area of interest.
AREA_NAMES = ("aoi_full", "aoi_golden")


def provenance(path: str, full: str, golden: str, boundaries: str, prefectures: list[str], golden_units: list[str], full_count: int) -> dict:
    """What an area of interest was made of, written as JSON: its source, prefectures, units and counts."""
    members = ({"prefectures": prefectures, "unit_count": full_count}, {"unit_ids": golden_units, "unit_count": len(golden_units)})
    made: dict = {name: {"path": file} | own for name, file, own in zip(AREA_NAMES, (full, golden), members, strict=True)}
    made |= {"source_boundaries": boundaries, "created_utc": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")}
    write_json(path, made)
    return made


def write_pixels(pixels: DataFrame, path: str, month: str = "month") -> None:
    """A raster export as a pixel table: row, col and band values, by month and band."""
    keys = [c for c in (month, "row", "col", "x", "y") if c in pixels.columns]
    bands = [c for c in pixels.columns if c not in keys]
    long = pixels.unpivot(keys, bands, "band", "value").where("value IS NOT NULL")
    long.write.mode("overwrite").partitionBy(month, "band").parquet(path)


def write_chunks(units: DataFrame, path: str, key: str, size: int, tolerance: float = 0.0, ring: str = "ring") -> None:
    """Polygons for an upload elsewhere: simplified, in key order, in batches of ``size`` rows, one folder each."""
    from gridloom.operators.panel import in_batches
    from gridloom.operators.spatial import simplify

    slim = units.withColumn(ring, simplify(F.col(ring), tolerance)) if tolerance else units
    in_batches(slim, [key], size).write.mode("overwrite").partitionBy("batch").parquet(path)


def write_report(path: str, title: str, tables: dict[str, DataFrame], rows: int = 50) -> None:
    """A page with the first rows of every table, as a reader's overview; whole tables are written beside it by the
    other sinks."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for name, df in tables.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape(str(plain(v)))}</td>" for v in r) + "</tr>" for r in df.limit(rows).collect())
        parts.append(f"<h2>{escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(parts), encoding="utf-8")


def to_json_rows(df: DataFrame) -> DataFrame:
    """One JSON string per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
