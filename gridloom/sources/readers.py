"""File sources with pinned schemas."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.lineage import cut
from gridloom.functions.scalar import digits, zero_filled
from gridloom.schema import nan_to_null, require_columns

#: Encodings to try for legacy text, in order, as the JVM names them.
ENCODINGS = ("windows-31j", "UTF-8", "Shift_JIS")


def read_panel(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet panel; NaN becomes NULL."""
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.parquet(path))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """CSV with a header and declared types, so that ids keep their leading zeros."""
    return spark.read.schema(schema).csv(path, header=True, encoding=encoding, sep=sep, mode="FAILFAST", enforceSchema=False)


def read_legacy_text(spark: SparkSession, path: str, expect: Iterable[str], sep: str = ",") -> DataFrame:
    """A text table whose encoding is not known: the first in which the expected header names appear; a byte order mark
    before the first name is dropped. Rows are staged while the session's ``spark.sql.legacy.javaCharsets`` is on,
    which such encodings need; then it is as it was."""
    setting, wanted = "spark.sql.legacy.javaCharsets", set(expect)
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        for encoding in ENCODINGS:
            df = spark.read.csv(path, header=True, encoding=encoding, sep=sep)
            df = df.toDF(*(c.lstrip("\ufeff") for c in df.columns))
            if wanted <= set(df.columns):
                return cut(df)
    finally:
        spark.conf.set(setting, before)
    raise ValueError(f"{path}: no known encoding has the columns {sorted(wanted)}")


def _exists(spark: SparkSession, pattern: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(f.getPath().toString() for f in found or [])


def read_glob(spark: SparkSession, pattern: str, schema: T.StructType | str, source: str | None = None) -> DataFrame:
    """All CSV files of a pattern as one table, with their path as ``source`` if asked for; no match is an error."""
    files = _exists(spark, pattern)
    if not files:
        raise FileNotFoundError(pattern)
    df = read_csv(spark, files, schema)
    return df.withColumn(source, F.input_file_name()) if source else df


def read_month_csv(spark: SparkSession, path: str, features: Iterable[str], level: str) -> DataFrame:
    """One month's units: codes are zero-filled (``village``) or reduced to digits (other levels), and the first row
    of a repeated key stays."""
    from gridloom.operators.panel import keep_first

    schema = T.StructType([*(T.StructField(n, T.StringType()) for n in ("unit_id", "unit_code", "pref_name", "month")), *(T.StructField(f, T.DoubleType()) for f in features)])
    df = nan_to_null(read_csv(spark, path, schema))
    code = zero_filled(F.col("unit_code")) if level == "village" else digits(F.col("unit_code"))
    keyed = df.withColumn("unit_code", code).withColumn("__row", F.monotonically_increasing_id())
    return keep_first(keyed, ["unit_id", "month"], ["__row"]).drop("__row")


def done_batches(spark: SparkSession, folder: str, month: str) -> set[int]:
    """Batch numbers that a folder already holds for a month."""
    names = [f.rsplit("/", 1)[-1] for f in _exists(spark, f"{folder}/*{month}*batch*")]
    return {int(m[1]) for n in names if (m := re.search(r"batch_?(\d+)", n))}


def missing_batches(spark: SparkSession, folder: str, month: str, wanted: Iterable[int]) -> list[int]:
    return sorted(set(wanted) - done_batches(spark, folder, month))


def read_osm(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a saved JSON response: type, id, lat, lon, nodes, building."""
    element = "type string, id long, lat double, lon double, nodes array<long>, tags map<string,string>"
    raw = spark.read.schema(f"elements array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in _fields(element))}>>").json(path, multiLine=True)
    return raw.select(F.explode("elements").alias("e")).select("e.type", "e.id", "e.lat", "e.lon", "e.nodes", F.col("e.tags")["building"].alias("building"))


def _fields(ddl: str) -> list[str]:
    return re.split(r",\s(?=\w+ \w)", ddl)


def scenes(df: DataFrame, start: str, end: str, max_cloud: float, bands: list[str], ts: str = "ts", cloud: str = "cloud_pct") -> DataFrame:
    """Image rows of a period (end excluded) under a cloud limit, with the bands asked for: all pushed to the scan."""
    rows = df.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")) & (F.col(cloud) <= max_cloud))
    keys = [c for c in df.columns if c in ("image_id", "unit_id", "row", "col", "weight", "scl", ts)]
    return rows.select(*keys, *bands)


def canonical(df: DataFrame, pref: str, code: str, keep: Iterable[str] = ()) -> DataFrame:
    """Source columns under their canonical names, as strings; missing ones are an error."""
    require_columns(df, [pref, code])
    return df.select(F.col(pref).cast("string").alias("pref_name"), F.col(code).cast("string").alias("unit_code"), *(c for c in keep if c in df.columns))
