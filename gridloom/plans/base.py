"""Query registration, and the panel that queries build from the star schema."""

from __future__ import annotations

import textwrap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
BANDS = ["b1", "b2", "b3", "b4"]


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = textwrap.dedent(sql).strip()
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def holes(value: Column, modulus: int) -> Column:
    """Missing values at places that either engine can compute."""
    return F.when((F.col("unit_id") * 31 + F.col("mi")) % modulus != 0, value)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unit x month panel: suppliers by shipping month, four bands, two of them with holes."""
    items = read(spark, sf_dir, "lineitem")
    month = F.trunc("l_shipdate", "month")
    cells = items.groupBy(F.col("l_suppkey").alias("unit_id"), month.alias("month")).agg(
        F.avg("l_quantity").alias("q"),
        F.avg("l_extendedprice").alias("b2"),
        F.avg("l_discount").alias("d"),
        F.avg("l_tax").alias("b4"),
        F.count(F.lit(1)).alias("n_items"),
    )
    indexed = cells.withColumn("mi", F.year("month") * 12 + F.month("month"))
    return indexed.select("unit_id", "month", "mi", holes(F.col("q"), 11).alias("b1"), "b2", holes(F.col("d"), 13).alias("b3"), "b4", "n_items")


PANEL = """
p0 AS (
  SELECT l_suppkey AS unit_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_quantity) AS q,
         avg(l_extendedprice) AS b2, avg(l_discount) AS d, avg(l_tax) AS b4, count(*) AS n_items
  FROM lineitem GROUP BY 1, 2),
p1 AS (SELECT *, CAST(year(month) * 12 + month(month) AS INTEGER) AS mi FROM p0),
panel AS (
  SELECT unit_id, month, mi, CASE WHEN (unit_id * 31 + mi) % 11 <> 0 THEN q END AS b1, b2,
         CASE WHEN (unit_id * 31 + mi) % 13 <> 0 THEN d END AS b3, b4, n_items FROM p1)"""

UNITS = """
units AS (
  SELECT s_suppkey AS unit_id, s_acctbal AS acctbal, n_name AS pref_name, r_name AS region
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CROSS = f"""{PANEL},{UNITS},
agg AS (
  SELECT unit_id, {", ".join(f"avg({b}) AS {b}_mean, coalesce(stddev_samp({b}), 0) AS {b}_std" for b in BANDS)},
         count(b1) AS n_b1, count(*) AS n_rows
  FROM panel GROUP BY unit_id),
xs AS (SELECT agg.*, acctbal, pref_name, region FROM agg JOIN units USING (unit_id))"""


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Static attributes of the units."""
    supplier, nation, region = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    return named.select(F.col("s_suppkey").alias("unit_id"), F.col("s_acctbal").alias("acctbal"), F.col("n_name").alias("pref_name"), F.col("r_name").alias("region"))


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per unit: means and deviations of the bands, and the static attributes."""
    from gridloom.operators.temporal import mean_std

    flat = panel(spark, sf_dir).groupBy("unit_id").agg(*mean_std(BANDS), F.count("b1").alias("n_b1"), F.count(F.lit(1)).alias("n_rows"))
    return flat.join(units(spark, sf_dir), "unit_id")


#: Fixed value: width of the test vectors; all of it is used.
DIMS = 64


def points(spark: SparkSession, sf_dir: str, dims: int = DIMS) -> DataFrame:
    """Embeddings as rows of ``id, label, x0..``."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label"), *(F.round(F.col("embedding")[i].cast("double"), 6).alias(f"x{i}") for i in range(dims)))


POINTS = "pts AS (SELECT vec_id AS id, label, " + ", ".join(f"round(CAST(embedding[{i + 1}] AS DOUBLE), 6) AS x{i}" for i in range(DIMS)) + " FROM embeddings)"
XS = [f"x{i}" for i in range(DIMS)]
LONG = f"{POINTS}, long AS (SELECT id, label, feature, value FROM pts UNPIVOT (value FOR feature IN ({', '.join(XS)})))"


def simpson(body: str, upto: str, nodes: int = 2000) -> str:
    """SQL for the integral of ``body`` (a function of ``u``) from 0 to ``upto``."""
    return f"(list_sum(list_transform(range({nodes + 1}), lambda i: (CASE WHEN i IN (0, {nodes}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * ({body.replace('$u', f'(({upto}) * i / {nodes})')}))) * ({upto}) / {3 * nodes})"


def t_p(t: str, dof: str) -> str:
    """SQL for the two-sided p-value of Student's t: an integral of a power of the cosine."""
    area = simpson(f"pow(cos($u), ({dof}) - 1)", f"atan(abs({t}) / sqrt({dof}))")
    return f"(1 - 2 * exp(lgamma((({dof}) + 1) / 2.0) - lgamma(({dof}) / 2.0)) / sqrt(pi()) * {area})"


def r_p(r: str, n: str) -> str:
    """SQL for the two-sided p-value of a correlation."""
    return t_p(f"(({r}) * sqrt((({n}) - 2) / (1 - ({r}) * ({r}))))", f"(({n}) - 2)")


def f_p(f: str, d1: str, d2: str) -> str:
    """SQL for the upper tail of the F distribution: an integral of powers of sine and cosine."""
    area = simpson(f"pow(sin($u), ({d2}) - 1) * pow(cos($u), ({d1}) - 1)", f"asin(sqrt(({d2}) / (({d2}) + ({d1}) * ({f}))))")
    return f"(2 * exp(lgamma((({d1}) + ({d2})) / 2.0) - lgamma(({d1}) / 2.0) - lgamma(({d2}) / 2.0)) * {area})"


def chi2_p(x: str, k: str) -> str:
    """SQL for the upper tail of the chi-square distribution."""
    area = simpson(f"pow($u, ({k}) - 1) * exp(-$u * $u)", f"sqrt(({x}) / 2.0)")
    return f"(1 - 2 * {area} / exp(lgamma(({k}) / 2.0)))"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison."""
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})
