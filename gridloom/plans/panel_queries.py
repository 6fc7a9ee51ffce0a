"""Scans, projections, joins, aggregations and windows of the panel."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import scalar
from gridloom.operators import panel as P
from gridloom.operators import temporal as T
from gridloom.plans.base import BANDS, PANEL, UNITS, cross, panel, query, read, rounded, units


@query(f"WITH {PANEL} SELECT unit_id, month, mi, round(b1, 6) AS b1, round(b2, 4) AS b2, round(b3, 6) AS b3, round(b4, 6) AS b4, n_items FROM panel")
def panel_build(spark, sf_dir):
    """Panel assembly from line items."""
    return _flat(panel(spark, sf_dir))


@query(f"""WITH {PANEL} SELECT unit_id, month, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month_num,
    CASE WHEN month(month) IN (12, 1, 2) THEN 'winter' WHEN month(month) IN (3, 4, 5) THEN 'spring'
         WHEN month(month) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season,
    CASE WHEN month(month) IN (12, 1, 2) THEN 'DJF' WHEN month(month) IN (3, 4, 5) THEN 'MAM'
         WHEN month(month) IN (6, 7, 8) THEN 'JJA' ELSE 'SON' END AS season_code FROM panel""")
def season_mapping(spark, sf_dir):
    """Derived temporal columns from a 'YYYY-MM' string."""
    text = panel(spark, sf_dir).select("unit_id", F.date_format("month", "yyyy-MM").alias("ym"))
    dated = text.withColumns(scalar.month_parts(F.to_date("ym", "yyyy-MM")))
    return dated.select("unit_id", F.col("month_dt").alias("month"), "year", "month_num", "season", scalar.season(F.col("month_num"), scalar.SEASON_CODES).alias("season_code"))


@query(f"""WITH {PANEL} SELECT unit_id, {", ".join(f"round(avg({b}), 6) AS {b}_mean, round(coalesce(stddev_samp({b}), 0), 6) AS {b}_std" for b in BANDS)} FROM panel GROUP BY unit_id""")
def temporal_mean_std(spark, sf_dir):
    """A1."""
    return rounded(panel(spark, sf_dir).groupBy("unit_id").agg(*T.mean_std(BANDS)))


@query(f"""WITH {PANEL}, t AS (SELECT *, month - min(month) OVER (PARTITION BY unit_id) AS days FROM panel)
    SELECT unit_id, {", ".join(f"CASE WHEN count(*) >= 3 AND max(days) > 0 AND count({b}) >= 3 THEN round(regr_slope({b}, days) * max(days), 6) END AS {b}_slope" for b in BANDS)}
    FROM t GROUP BY unit_id""")
def ols_trend_slope(spark, sf_dir):
    """A2, W2."""
    return T.with_days(panel(spark, sf_dir)).groupBy("unit_id").agg(*T.trend_slopes(BANDS))


@query(f"""WITH {PANEL}, m AS (SELECT unit_id, month(month) AS moy, avg(b1) AS b1, avg(b3) AS b3 FROM panel GROUP BY 1, 2)
    SELECT unit_id, CASE WHEN count(b1) >= 2 THEN round(max(b1) - min(b1), 6) END AS b1_seasonal_amp,
           CASE WHEN count(b3) >= 2 THEN round(max(b3) - min(b3), 6) END AS b3_seasonal_amp FROM m GROUP BY unit_id""")
def seasonal_amplitude(spark, sf_dir):
    """A3."""
    return T.seasonal_amplitude(panel(spark, sf_dir), ["b1", "b3"])


@query(f"""WITH {PANEL} SELECT unit_id, round(arg_min_null(b1, month), 6) AS b1, round(arg_min_null(b3, month), 6) AS b3 FROM panel GROUP BY unit_id""")
def first_static_value(spark, sf_dir):
    """A4: earliest row's value, NULL included."""
    return _flat(panel(spark, sf_dir).groupBy("unit_id").agg(*T.first_values(["b1", "b3"])))


@query(f"""WITH {PANEL} SELECT unit_id, {", ".join(f"CASE WHEN count({b}) > 1 AND abs(avg({b})) > 1e-10 THEN round(stddev_samp({b}) / abs(avg({b})), 6) END AS {b}_cv" for b in BANDS)} FROM panel GROUP BY unit_id""")
def coef_variation(spark, sf_dir):
    """A5."""
    return rounded(panel(spark, sf_dir).groupBy("unit_id").agg(*T.variation(BANDS)))


def _flat(df):
    return df.withColumns({c: F.round(c, 4 if c == "b2" else 6) for c in BANDS if c in df.columns})


COVERAGE = f"""WITH {PANEL}, v AS (SELECT unit_id, month, b1 IS NOT NULL AS ok FROM panel),
    g AS (SELECT *, CASE WHEN ok THEN month - lag(month) OVER (PARTITION BY unit_id, ok ORDER BY month) END AS gap FROM v)"""


@query(f"""{COVERAGE} SELECT unit_id, count(*) AS n_total_months, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS n_valid_months,
    round(sum(CAST(ok AS INTEGER)) * 100.0 / count(*), 2) AS valid_pct, min(CASE WHEN ok THEN month END) AS first_month,
    max(CASE WHEN ok THEN month END) AS last_month, CAST(sum(CASE WHEN gap > 35 THEN 1 ELSE 0 END) AS BIGINT) AS gap_count
    FROM g GROUP BY unit_id""")
def temporal_coverage(spark, sf_dir):
    """A12, W1."""
    return T.coverage(panel(spark, sf_dir), ["b1"]).withColumn("valid_pct", F.col("valid_pct").cast("double"))


@query(f"""WITH {PANEL}, s AS (SELECT unit_id, CAST(month AS DATE) AS month FROM (SELECT DISTINCT unit_id FROM panel), unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS t(month))
    SELECT unit_id, month, round(b1, 6) AS b1, round(b2, 4) AS b2, n_items FROM s LEFT JOIN panel USING (unit_id, month)""")
def month_spine_left_join(spark, sf_dir):
    """Masked placeholders for empty months."""
    cells = panel(spark, sf_dir).select("unit_id", "month", "b1", "b2", "n_items")
    return P.on_spine(_flat(cells), P.month_spine(cells, "1995-01-01", "2001-12-01"), ["unit_id", "month"])


@query(f"""WITH {PANEL}, y AS (SELECT unit_id, year(month) AS y, avg(b1) AS b1, avg(b2) AS b2 FROM panel GROUP BY 1, 2)
    SELECT unit_id, round(avg(b1), 6) AS b1, round(avg(b2), 4) AS b2 FROM y GROUP BY unit_id""")
def mean_of_yearly_means(spark, sf_dir):
    """A16."""
    by_year = panel(spark, sf_dir).withColumn("y", F.year("month"))
    return T.mean_of_period_means(by_year, "unit_id", "y", ["b1", "b2"]).select("unit_id", F.round("b1", 6).alias("b1"), F.round("b2", 4).alias("b2"))


@query("""SELECT o_custkey AS unit_id, month, o_orderkey, o_totalprice FROM (
    SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, o_orderkey, o_totalprice,
           row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1""")
def keep_first_dedup(spark, sf_dir):
    """One row per (unit, month), the first in a stated order."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("unit_id"), F.trunc("o_orderdate", "month").alias("month"), "o_orderdate", "o_orderkey", "o_totalprice")
    return P.keep_first(orders, ["unit_id", "month"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query(f"""WITH {PANEL},{UNITS} SELECT unit_id, month, round(b1, 6) AS b1, acctbal, pref_name, region FROM panel LEFT JOIN units USING (unit_id)""")
def m_to_1_left_join(spark, sf_dir):
    """Static attributes on a checked key; overlapping columns of the right side are dropped."""
    right = units(spark, sf_dir).withColumn("b1", F.lit(0.0))
    return P.join_many_to_one(_flat(panel(spark, sf_dir)).select("unit_id", "month", "b1"), right, ["unit_id"])


THREE = """k AS (SELECT c_custkey AS unit_code, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS pref, c_acctbal FROM customer),
    pop AS (SELECT pref, count(*) AS pop FROM k GROUP BY pref), hh AS (SELECT pref, CAST(sum(unit_code) AS BIGINT) AS hh FROM k GROUP BY pref),
    age AS (SELECT pref, round(avg(c_acctbal), 4) AS age FROM k GROUP BY pref)"""


@query(f"""WITH {THREE} SELECT pop.pref, pop, hh, age FROM pop LEFT JOIN hh ON pop.pref IS NOT DISTINCT FROM hh.pref
    LEFT JOIN age ON pop.pref IS NOT DISTINCT FROM age.pref""")
def null_safe_three_way_join(spark, sf_dir):
    """NULL keys match each other."""
    k = read(spark, sf_dir, "customer").select(F.col("c_custkey"), F.when(F.col("c_custkey") % 7 != 0, F.col("c_nationkey")).alias("pref"), "c_acctbal")
    pop = k.groupBy("pref").agg(F.count(F.lit(1)).alias("pop"))
    hh = k.groupBy("pref").agg(F.sum("c_custkey").alias("hh"))
    age = k.groupBy("pref").agg(F.round(F.avg("c_acctbal"), 4).alias("age"))
    return P.join_null_safe(P.join_null_safe(pop, hh, ["pref"]), age, ["pref"])


@query("""WITH f AS (SELECT l_suppkey AS unit_id, count(*) AS building_count, sum(l_quantity) AS built_area FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.09 GROUP BY 1)
    SELECT s_suppkey AS unit_id, coalesce(building_count, 0) AS building_count, coalesce(built_area, 0) AS built_area
    FROM supplier LEFT JOIN f ON s_suppkey = unit_id""")
def anti_join_zero_fill(spark, sf_dir):
    """Units without a match get a row of zeros."""
    hits = read(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_discount >= 0.09").groupBy(F.col("l_suppkey").alias("unit_id"))
    found = hits.agg(F.count(F.lit(1)).alias("building_count"), F.sum("l_quantity").alias("built_area"))
    return P.fill_missing_units(found, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("unit_id")), "unit_id", ["building_count", "built_area"])


@query("""SELECT count(*) AS n, count(k) AS matched, round(count(k) / count(*), 6) AS rate FROM customer
    LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders) ON c_custkey = k""")
def semi_match_rate(spark, sf_dir):
    """J10."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return rounded(P.match_rate(read(spark, sf_dir, "customer"), orders, "c_custkey"))


@query("""SELECT l_suppkey AS unit_id, CASE WHEN count(*) FILTER (year(l_shipdate) = 1996) > 0 THEN 1 ELSE 0 END AS seen,
    max(CASE WHEN y = 1996 THEN q END) AS q_1996, max(CASE WHEN y = 1996 THEN n END) AS n_1996,
    max(CASE WHEN y = 2000 THEN q END) AS q_2000, max(CASE WHEN y = 2000 THEN n END) AS n_2000
    FROM (SELECT l_suppkey, any_value(l_shipdate) AS l_shipdate, year(l_shipdate) AS y, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_suppkey, year(l_shipdate)) GROUP BY l_suppkey""".replace("CASE WHEN count(*) FILTER (year(l_shipdate) = 1996) > 0 THEN 1 ELSE 0 END AS seen,", ""))
def multi_year_pivot(spark, sf_dir):
    """Long to wide by year."""
    years = read(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("unit_id"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    return P.pivot_years(years, ["unit_id"], "y", [1996, 2000], ["q", "n"])


@query(f"""WITH {PANEL} SELECT unit_id, month, feature, round(value, 8) AS value FROM (SELECT unit_id, month, b1, b2, b3, b4 FROM panel) UNPIVOT INCLUDE NULLS (value FOR feature IN (b1, b2, b3, b4))""")
def wide_to_long_unpivot(spark, sf_dir):
    from gridloom.schema import to_long

    return rounded(to_long(panel(spark, sf_dir), ["unit_id", "month"], BANDS), 8)


CENSUS = "c AS (SELECT l_suppkey AS unit_id, " + ", ".join(
    f"CAST(sum(CASE WHEN year(l_shipdate) = {y} AND {cond} THEN l_quantity END) AS BIGINT) AS {name}_{label}"
    for y, label in ((1996, 2015), (2000, 2020))
    for name, cond in (("pop_total", "l_suppkey % 9 <> 0"), ("age_u15", "l_returnflag = 'A'"), ("age_15_64", "l_returnflag = 'N'"), ("age_65_plus", "l_returnflag = 'R'"))
) + " FROM lineitem GROUP BY 1)"


@query(f"""WITH {CENSUS}, z AS (SELECT *, CASE WHEN unit_id % 5 = 0 THEN 0 ELSE pop_total_2015 END AS base FROM c)
    SELECT unit_id, pop_total_2020 - base AS pop_change, round((pop_total_2020 - base) / nullif(base, 0), 4) AS pop_change_pct,
    age_15_64_2020 - age_15_64_2015 AS working_age_change, round((age_15_64_2020 - age_15_64_2015) / nullif(age_15_64_2015, 0), 4) AS working_age_change_pct,
    age_u15_2020 - age_u15_2015 AS youth_change, age_65_plus_2020 - age_65_plus_2015 AS elderly_change FROM z""")
def inter_censal_change(spark, sf_dir):
    """A27, with zero and NULL bases."""
    li, q = read(spark, sf_dir, "lineitem"), F.col("l_quantity")
    groups = {"pop_total": F.col("l_suppkey") % 9 != 0, "age_u15": F.col("l_returnflag") == "A", "age_15_64": F.col("l_returnflag") == "N", "age_65_plus": F.col("l_returnflag") == "R"}
    sums = [F.sum(F.when((F.year("l_shipdate") == y) & c, q)).cast("long").alias(f"{n}_{label}") for y, label in ((1996, 2015), (2000, 2020)) for n, c in groups.items()]
    census = li.groupBy(F.col("l_suppkey").alias("unit_id")).agg(*sums).withColumn("pop_total_2015", F.when(F.col("unit_id") % 5 == 0, 0).otherwise(F.col("pop_total_2015")))
    return P.intercensal_change(census).select("unit_id", "pop_change", "pop_change_pct", "working_age_change", "working_age_change_pct", "youth_change", "elderly_change")


@query(f"WITH {PANEL} SELECT unit_id, month, round((b4 - b3) / nullif(b4 + b3, 0), 6) AS nd FROM panel")
def normalized_difference(spark, sf_dir):
    """P14."""
    return panel(spark, sf_dir).select("unit_id", "month", F.round(scalar.normalised_difference(F.col("b4"), F.col("b3")), 6).alias("nd"))


@query("""SELECT l_suppkey AS unit_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
    round(median(CASE WHEN l_linenumber IN (4, 5, 6, 11) THEN l_discount END), 6) AS band, count(CASE WHEN l_linenumber IN (4, 5, 6, 11) THEN 1 END) AS n_clear,
    round(median(CASE WHEN l_linenumber IN (4, 5, 6, 11) THEN (l_tax - l_discount) / nullif(l_tax + l_discount, 0) END), 6) AS index_median
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1998-12-31' GROUP BY 1, 2""")
def median_composite(spark, sf_dir):
    """End-exclusive date filter, class mask, index per scene before the median."""
    scenes = read(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")) & (F.col("l_shipdate") < F.lit("1998-12-31").cast("timestamp")))
    clear = lambda c: scalar.masked(c, F.col("l_linenumber"))
    cells = scenes.select(F.col("l_suppkey").alias("unit_id"), F.trunc("l_shipdate", "month").alias("month"), clear(F.col("l_discount")).alias("band"), clear(scalar.normalised_difference(F.col("l_tax"), F.col("l_discount"))).alias("index_median"))
    keys = ["unit_id", "month"]
    return rounded(cells.groupBy(*keys).agg(F.median("band").alias("band"), F.count("band").alias("n_clear"), F.median("index_median").alias("index_median")))


@query("""SELECT l_suppkey AS unit_id, round(sum(CASE WHEN l_linenumber <> 3 THEN l_discount * l_quantity END) / nullif(sum(CASE WHEN l_linenumber <> 3 THEN l_quantity END), 0), 6) AS zonal FROM lineitem GROUP BY 1""")
def weighted_zonal_mean(spark, sf_dir):
    """Pixel weights, masked pixels left out."""
    pixels = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("zonal"), F.col("l_quantity").alias("w"))
    return rounded(T.weighted_mean(pixels, ["unit_id"], ["zonal"], "w"))


@query(f"WITH {PANEL} SELECT unit_id, round(avg(b1), 6) AS mean, round(stddev_pop(b1), 6) AS std FROM panel GROUP BY 1")
def mean_std_reducer(spark, sf_dir):
    """Combined reducer, population deviation."""
    return rounded(panel(spark, sf_dir).groupBy("unit_id").agg(F.avg("b1").alias("mean"), F.stddev_pop("b1").alias("std")))


@query(f"""WITH {PANEL},{UNITS} SELECT pref_name, month, round(avg(b1), 6) AS mean, round(stddev_samp(b1), 6) AS std FROM panel JOIN units USING (unit_id) GROUP BY 1, 2""")
def monthly_trend_band(spark, sf_dir):
    """A15."""
    joined = panel(spark, sf_dir).join(units(spark, sf_dir), "unit_id")
    return rounded(joined.groupBy("pref_name", "month").agg(F.avg("b1").alias("mean"), F.stddev_samp("b1").alias("std")))


@query(f"""WITH {PANEL},{UNITS} SELECT pref_name, count(DISTINCT unit_id) AS n_units, count(*) AS n_rows, round(avg(b1), 6) AS b1_mean FROM panel JOIN units USING (unit_id) GROUP BY 1""")
def group_summary_distinct(spark, sf_dir):
    """Group summaries with a distinct count. Units nest in groups, so one row per unit is counted."""
    per_unit = panel(spark, sf_dir).groupBy("unit_id").agg(F.count(F.lit(1)).alias("n"), F.sum("b1").alias("s"), F.count("b1").alias("k"))
    joined = per_unit.join(units(spark, sf_dir), "unit_id").groupBy("pref_name")
    return rounded(joined.agg(F.count(F.lit(1)).alias("n_units"), F.sum("n").alias("n_rows"), F.try_divide(F.sum("s"), F.sum("k")).alias("b1_mean")))


@query("""SELECT lpad_code, digits, unit_key, last_part, number FROM (SELECT
    CASE WHEN length(CAST(c_custkey * 37 AS VARCHAR)) < 5 THEN lpad(CAST(c_custkey * 37 AS VARCHAR), 5, '0') ELSE CAST(c_custkey * 37 AS VARCHAR) END AS lpad_code,
    regexp_replace(c_name, '[^0-9]', '', 'g') AS digits, c_mktsegment || ':' || CAST(c_nationkey AS VARCHAR) || ':' || CAST(c_custkey AS VARCHAR) AS unit_key,
    CAST(c_custkey AS VARCHAR) AS last_part, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS number FROM customer)""")
def code_normalisation(spark, sf_dir):
    """Guarded zero fill, digits, composed keys, coerced placeholders."""
    c = read(spark, sf_dir, "customer")
    key = scalar.unit_key(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    raw = F.when(F.col("c_custkey") % 4 == 0, F.lit(" X ")).otherwise(F.col("c_acctbal").cast("string"))
    return c.select(
        scalar.zero_filled((F.col("c_custkey") * 37).cast("string")).alias("lpad_code"),
        scalar.digits(F.col("c_name")).alias("digits"),
        key.alias("unit_key"),
        scalar.last_part(key).alias("last_part"),
        scalar.number(raw).alias("number"),
    )


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT (CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey % 3 END IS NOT DISTINCT FROM 1)""")
def level_filter_null_safe(spark, sf_dir):
    """IN list, and a level filter that keeps NULL levels."""
    level = F.when(F.col("c_custkey") % 6 != 0, F.col("c_custkey") % 3)
    return read(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~level.eqNullSafe(1)).select("c_custkey")


@query("""SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2 UNION ALL SELECT c_custkey, NULL, 0 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def union_and_difference(spark, sf_dir):
    """Union by name with absent columns, and a difference as an anti-join."""
    orders, customers = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    known = orders.groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    absent = customers.select(F.col("c_custkey").alias("o_custkey")).join(orders, "o_custkey", "left_anti").select("o_custkey", F.lit(0).cast("long").alias("n"))
    return P.union_all([known, absent])


@query("""SELECT round(greatest(avg(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END)), 6) AS worst_missing_share,
    greatest(avg(CASE WHEN o_orderkey IS NULL THEN 1 ELSE 0 END), avg(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END)) <= 0.95 AS passes FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def join_health(spark, sf_dir):
    """J13."""
    joined = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rounded(P.join_health(joined, ["o_orderkey", "o_totalprice"]))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5")
def topk_units(spark, sf_dir):
    """Top k."""
    return read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(5)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100")
def deterministic_sample(spark, sf_dir):
    """The first n by key."""
    return read(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(100)


@query("SELECT c_custkey, CAST((row_number() OVER (ORDER BY c_custkey) - 1) // 500 AS BIGINT) AS batch FROM customer")
def offset_batches(spark, sf_dir):
    """Batches of 500 in key order."""
    return P.in_batches(read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 500)


@query(f"WITH {PANEL},{UNITS} SELECT pref_name, max_by(unit_id, acctbal * 1000000 + unit_id) AS best_unit, min_by(unit_id, acctbal * 1000000 + unit_id) AS worst_unit FROM units GROUP BY 1")
def arg_extremes(spark, sf_dir):
    """O8."""
    key = F.col("acctbal") * 1000000 + F.col("unit_id")
    return units(spark, sf_dir).groupBy("pref_name").agg(F.max_by("unit_id", key).alias("best_unit"), F.min_by("unit_id", key).alias("worst_unit"))


@query(f"""WITH {PANEL}, r AS (SELECT unit_id, sum(n_items) AS n FROM panel GROUP BY 1)
    SELECT unit_id, n, CAST(rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS DOUBLE) AS avg_rank FROM (SELECT unit_id, CAST(n AS BIGINT) AS n FROM r)""")
def average_rank(spark, sf_dir):
    """Average ranks with ties, descending. Ranks come from the distinct values' counts."""
    from gridloom.operators.stats import average_ranks

    totals = panel(spark, sf_dir).groupBy("unit_id").agg(F.sum("n_items").alias("n"))
    return average_ranks(totals, "n", descending=True).select("unit_id", "n", "avg_rank")


@query(f"""WITH {PANEL}, c AS (SELECT CASE WHEN unit_id % 3 = 0 THEN 'low' WHEN unit_id % 3 = 1 THEN 'mid' ELSE 'high' END AS class, count(*) AS n FROM panel GROUP BY 1)
    SELECT class, n, CAST(sum(n) OVER (ORDER BY n DESC, class) AS BIGINT) AS cumulative, round(sum(n) OVER (ORDER BY n DESC, class) / sum(n) OVER (), 6) AS share FROM c""")
def cumulative_share(spark, sf_dir):
    """Cumulative sums over a few classes."""
    label = F.when(F.col("unit_id") % 3 == 0, "low").when(F.col("unit_id") % 3 == 1, "mid").otherwise("high")
    counts = panel(spark, sf_dir).groupBy(label.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.desc("n"), "class").rowsBetween(Window.unboundedPreceding, 0)
    return rounded(counts.select("class", "n", F.sum("n").over(w).alias("cumulative"), (F.sum("n").over(w) / F.sum("n").over(Window.partitionBy())).alias("share")))


TARGET = f"""{PANEL},{UNITS}, f AS (SELECT unit_id, sum(CASE WHEN year(month) >= 1996 THEN n_items ELSE 0 END) / sum(n_items) AS late_ratio FROM panel GROUP BY 1),
    t AS (SELECT unit_id, late_ratio, CASE WHEN late_ratio < 0.37 THEN 'stable' WHEN late_ratio < 0.42 THEN 'shrinking' ELSE 'severely_shrinking' END AS target_class,
        CASE WHEN late_ratio < 0.37 THEN 0 WHEN late_ratio < 0.42 THEN 1 ELSE 2 END AS target_code FROM f WHERE late_ratio IS NOT NULL)"""


@query(f"WITH {TARGET} SELECT unit_id, round(late_ratio, 6) AS late_ratio, target_class, target_code FROM t")
def threshold_target(spark, sf_dir):
    """Three classes by thresholds, the low ratios first; invalid ratios are dropped."""
    return rounded(_target(spark, sf_dir))


def _target(spark, sf_dir):
    from gridloom.config import PanelConfig
    from gridloom.operators.features import build_target

    late = F.sum(F.when(F.year("month") >= 1996, F.col("n_items")).otherwise(0))
    shares = panel(spark, sf_dir).groupBy("unit_id").agg(F.try_divide(late, F.sum("n_items")).alias("late_ratio"))
    config = PanelConfig()
    return build_target(shares, "late_ratio", config.target_thresholds, config.target_labels)


@query(f"WITH {TARGET} SELECT region, target_class, count(*) AS n, round(avg(late_ratio), 6) AS mean_ratio FROM t JOIN units USING (unit_id) GROUP BY 1, 2")
def target_class_counts(spark, sf_dir):
    """The flagship: panel, cross-section, target and class counts by region."""
    joined = _target(spark, sf_dir).join(units(spark, sf_dir), "unit_id")
    return rounded(joined.groupBy("region", "target_class").agg(F.count(F.lit(1)).alias("n"), F.avg("late_ratio").alias("mean_ratio")))


@query(f"""WITH {PANEL}, r AS (SELECT unit_id, avg(b1) AS a, CASE WHEN unit_id % 4 = 0 THEN 0 WHEN unit_id % 7 = 0 THEN NULL ELSE avg(b2) END AS d FROM panel GROUP BY 1)
    SELECT unit_id, round(a / CASE WHEN d < 1 THEN 1 ELSE d END, 6) AS elderly_ratio, CASE WHEN d > 0 THEN round(a / d, 6) END AS masked_ratio FROM r""")
def ratio_features_clip(spark, sf_dir):
    """A clipped denominator that keeps NULL, and an update only where the total is positive."""
    sums = panel(spark, sf_dir).groupBy("unit_id").agg(F.avg("b1").alias("a"), F.avg("b2").alias("d0"))
    d = F.when(F.col("unit_id") % 4 == 0, F.lit(0.0)).when(F.col("unit_id") % 7 == 0, F.lit(None)).otherwise(F.col("d0"))
    r = sums.select("unit_id", "a", d.alias("d"))
    return rounded(r.select("unit_id", (F.col("a") / scalar.at_least(F.col("d"), 1.0)).alias("elderly_ratio"), F.when(F.col("d") > 0, scalar.ratio(F.col("a"), F.col("d"))).alias("masked_ratio")))


@query(f"""WITH {PANEL},{UNITS}, agg AS (SELECT unit_id, avg(b1) AS m1, avg(b2) AS m2 FROM panel GROUP BY 1) SELECT unit_id, round(m1, 6) AS b1_mean, round(m2, 4) AS b2_mean, acctbal, pref_name FROM agg JOIN units USING (unit_id)""")
def unit_means_inner_join(spark, sf_dir):
    """Unit means over the numeric columns joined to the identifiers."""
    x = cross(spark, sf_dir)
    return x.select("unit_id", F.round("b1_mean", 6).alias("b1_mean"), F.round("b2_mean", 4).alias("b2_mean"), "acctbal", "pref_name")
