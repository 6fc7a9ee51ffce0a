"""The four stages as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import workflows
from gridloom.config import PanelConfig
from gridloom.plans.base import BANDS, PANEL, POINTS, UNITS, XS, panel, points, query, rounded, units

EARLY, LATE = "1996-06-01", "1996-05-01"  # the two months of overlap come twice; the first frame's rows stay


@query(f"WITH {PANEL},{UNITS} SELECT unit_id, month, round(b1, 6) AS b1, n_items, acctbal, pref_name, region FROM panel LEFT JOIN units USING (unit_id)")
def stage_panel(spark, sf_dir):
    """Stage 1: two overlapping runs of months, static attributes by unit, one row per unit and month."""
    p = panel(spark, sf_dir).select("unit_id", "month", "b1", "n_items")
    late = p.where(F.col("month") >= F.lit(LATE).cast("date")).withColumn("n_items", F.when(F.col("month") < F.lit(EARLY).cast("date"), -1).otherwise(F.col("n_items")).cast("long"))
    return rounded(workflows.build_panel([p.where(F.col("month") < F.lit(EARLY).cast("date")), late], [units(spark, sf_dir)], None))


def _explored(spark, sf_dir):
    config = PanelConfig(temporal=BANDS, static=["pref_name"], missing_flag_pct=8.0)
    df = panel(spark, sf_dir).join(units(spark, sf_dir).select("unit_id", "pref_name"), "unit_id").drop("mi", "n_items")
    return workflows.explore(df.withColumn("unit_id", F.col("unit_id").cast("string")), config)


@query(f"WITH {PANEL}, long AS (SELECT feature, value FROM (SELECT b1, b2, b3, b4 FROM panel) UNPIVOT INCLUDE NULLS (value FOR feature IN (b1, b2, b3, b4))) SELECT feature, count(value) AS count, round(avg(value), 5) AS mean, round(median(value), 5) AS q50, count(*) - count(value) AS missing_count FROM long GROUP BY 1")
def stage_explore(spark, sf_dir):
    """Stage 2: the basic statistics of the exploratory tables."""
    table = _explored(spark, sf_dir)["basic_statistics"]
    return rounded(table.select("feature", "count", "mean", "q50", "missing_count"), 5)


READY = f"""{PANEL},{UNITS}, f AS (SELECT unit_id, sum(CASE WHEN year(month) >= 1996 THEN n_items ELSE 0 END) / sum(n_items) AS late_ratio, avg(b1) AS b1_mean, ln(1 + avg(b2)) AS b2_mean FROM panel GROUP BY 1),
    x AS (SELECT unit_id, late_ratio, b1_mean, b2_mean, acctbal FROM f JOIN units USING (unit_id))"""


def _scaled(c: str) -> str:
    return f"round(({c} - (SELECT median({c}) FROM x)) / (SELECT quantile_cont({c}, .75) - quantile_cont({c}, .25) FROM x), 5) AS {c}"


@query(f"WITH {READY} SELECT unit_id, {_scaled('b1_mean')}, {_scaled('b2_mean')}, {_scaled('acctbal')}, CASE WHEN late_ratio < 0.37 THEN 'stable' WHEN late_ratio < 0.42 THEN 'shrinking' ELSE 'severely_shrinking' END AS target_class FROM x")
def stage_preprocess(spark, sf_dir):
    """Stage 3: cross-section, target, log1p, imputation and robust scaling."""
    p = panel(spark, sf_dir)
    late = F.sum(F.when(F.year("month") >= 1996, F.col("n_items")).otherwise(0))
    shares = p.groupBy("unit_id").agg(F.try_divide(late, F.sum("n_items")).alias("late_ratio")).join(units(spark, sf_dir), "unit_id")
    config = PanelConfig(temporal=["b1", "b2"], static=["late_ratio", "acctbal", "pref_name"], log1p=["b2"], drop=["mi", "n_items"], target_ratio="late_ratio")
    ready = workflows.preprocess(p.join(shares, "unit_id"), config)["ready"]
    return rounded(ready.select("unit_id", "b1_mean", "b2_mean", "acctbal", "target_class"), 5)


@query(f"WITH {POINTS}, y AS (SELECT CAST(label = 2 AS INTEGER) AS y_true FROM pts) SELECT y_true, (SELECT mode(y_true) FROM y) AS y_pred, count(*) * 5 AS n, 1.0::DOUBLE AS row_share FROM y GROUP BY 1")
def stage_evaluate(spark, sf_dir):
    """Stage 4a: 5 x 5 folds; the baseline gives every row the class that most rows have, once a repeat."""
    df = points(spark, sf_dir).select("id", (F.col("label") == 2).cast("int").alias("label"), "x0", "x1")
    made = workflows.evaluate(df, ["x0", "x1"], ["dummy_most_frequent", "logistic_regression"])
    return made["confusion"].where("model = 'dummy_most_frequent'").drop("model")


@query()
def stage_typology(spark, sf_dir):
    """Stage 4b: clusters of the standardised points with silhouettes."""
    made = workflows.typology(points(spark, sf_dir).select("id", *XS), XS, 3)
    return made["assignments"].groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))
