"""Sources and sinks by round trips through the shared folder, and projections by column lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import lineage, scalar
from gridloom.operators import classify, cluster, features, spatial
from gridloom.operators import panel as P
from gridloom.operators import temporal as T
from gridloom.plans.base import BANDS, CROSS, PANEL, POINTS, UNITS, cross, panel, points, query, read, rounded, units
from gridloom.plans.eda_queries import SLOPES
from gridloom.schema import numeric_columns, require_columns, resolve_columns
from gridloom.sources import readers, sinks

MONTHLY = f"{PANEL}, m AS (SELECT lpad(CAST(unit_id AS VARCHAR), 5, '0') AS unit_code, strftime(month, '%Y-%m') AS month, n_items, round(b2, 2) AS b2 FROM panel WHERE year(month) = 1996)"


def _monthly(spark, sf_dir):
    rows = panel(spark, sf_dir).where(F.year("month") == 1996)
    code = scalar.zero_filled(F.col("unit_id").cast("string"))
    return rows.select(code.alias("unit_code"), F.date_format("month", "yyyy-MM").alias("month"), "n_items", F.round("b2", 2).alias("b2"))


SCHEMA = "unit_code string, month string, n_items long, b2 double"


@query(f"WITH {MONTHLY} SELECT unit_code, month, n_items, b2 FROM m")
def csv_pinned_types(spark, sf_dir):
    """A result file read with declared types: codes keep their zeros."""
    path = lineage.scratch(spark, "csv")
    sinks.write_result(_monthly(spark, sf_dir), path)
    return readers.read_csv(spark, path, SCHEMA)


@query(f"WITH {MONTHLY} SELECT 'parquet' AS kind, unit_code, month, n_items, b2 FROM m UNION ALL SELECT 'csv', unit_code, month, n_items, b2 FROM m")
def dual_write(spark, sf_dir):
    """K1: the same rows as Parquet and CSV."""
    path = lineage.scratch(spark, "dual")
    sinks.write_both(_monthly(spark, sf_dir), path)
    sides = [spark.read.parquet(f"{path}.parquet"), readers.read_csv(spark, f"{path}.csv", SCHEMA)]
    return P.union_all([df.select(F.lit(kind).alias("kind"), *df.columns) for kind, df in zip(("parquet", "csv"), sides, strict=True)])


@query(f"WITH {MONTHLY} SELECT month, count(*) AS n, CAST(sum(n_items) AS BIGINT) AS n_items FROM m GROUP BY 1")
def glob_scan(spark, sf_dir):
    """One folder a month, read by a pattern."""
    path = lineage.scratch(spark, "months")
    rows = lineage.cut(_monthly(spark, sf_dir))
    rows.withColumn("part", F.col("month")).write.partitionBy("part").csv(path, header=True)
    return readers.read_glob(spark, f"{path}/part=1996-*/*.csv", SCHEMA).groupBy("month").agg(F.count(F.lit(1)).alias("n"), F.sum("n_items").alias("n_items"))


@query("SELECT * FROM (VALUES (2), (5)) AS t(batch)")
def missing_batches(spark, sf_dir):
    """Batches of a month that a folder does not hold yet."""
    path = lineage.scratch(spark, "batches")
    for b in (1, 3, 4):
        units(spark, sf_dir).select("unit_id").limit(1).write.csv(f"{path}/cells_1996-01_batch_{b}.csv")
    found = readers.missing_batches(spark, path, "1996-01", range(1, 6))
    return spark.createDataFrame([(b,) for b in found], "batch int")


@query(f"WITH {MONTHLY} SELECT count(*) AS row_count, min(month) AS first_month, max(month) AS last_month, 4 AS n_columns FROM m")
def json_manifest(spark, sf_dir):
    """A manifest, without its time of writing."""
    made = sinks.manifest(_monthly(spark, sf_dir))
    return spark.createDataFrame([(made["row_count"], made["first_month"], made["last_month"], len(made["columns"]))], "row_count long, first_month string, last_month string, n_columns int")


@query(f"""WITH {UNITS} SELECT unit_id, '{{"unit_id":' || unit_id || ',"pref_name":"' || pref_name || '"}}' AS json FROM units""")
def json_rows(spark, sf_dir):
    """a JSON text per row, read back for its key."""
    rows = sinks.to_json_rows(units(spark, sf_dir).select("unit_id", "pref_name"))
    return rows.select(F.get_json_object("json", "$.unit_id").cast("long").alias("unit_id"), "json")


@query("SELECT p_partkey AS id, round((p_size / 10) * (p_size / 10), 4) AS area FROM part WHERE p_size >= 10 AND p_partkey % 3 <> 0")
def osm_polygons(spark, sf_dir):
    """Saved elements read and put together to rings: closed ways of four points or more."""
    p = read(spark, sf_dir, "part").where("p_size >= 10")
    side, base = F.col("p_size") / 10, F.col("p_partkey") * 10
    corner = lambda i, x, y: F.struct(F.lit("node").alias("type"), (base + i).alias("id"), y.cast("double").alias("lat"), x.cast("double").alias("lon"), F.lit(None).cast("array<long>").alias("nodes"), F.lit(None).cast("map<string,string>").alias("tags"))
    line = F.when(F.col("p_partkey") % 3 == 0, F.array(base, base + 1, base)).otherwise(F.array(base, base + 1, base + 2, base + 3, base))
    way = F.struct(F.lit("way").alias("type"), F.col("p_partkey").alias("id"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), line.alias("nodes"), F.create_map(F.lit("building"), F.lit("yes")).alias("tags"))
    zero = F.lit(0.0)
    elements = p.select(F.explode(F.array(corner(0, zero, zero), corner(1, side, zero), corner(2, side, side), corner(3, zero, side), way)).alias("e"))
    path = lineage.scratch(spark, "osm")
    elements.groupBy(F.pmod(F.xxhash64("e.id"), F.lit(4)).alias("file")).agg(F.collect_list("e").alias("elements")).write.partitionBy("file").json(path)
    rings = spatial.ways_to_rings(readers.read_osm(spark, path))
    return rounded(rings.select("id", spatial.area(F.col("ring")).alias("area")), 4)


@query(f"WITH {PANEL} SELECT unit_id, month, round(b1, 6) AS b1, n_items FROM panel")
def drop_configured_columns(spark, sf_dir):
    """P5: listed columns go; absent names are passed over."""
    return rounded(P.drop_columns(panel(spark, sf_dir), ["mi", "b2", "b3", "b4", "absent"]))


@query(f"WITH {PANEL} SELECT unit_id, month, round(b1, 6) AS b, round(b3, 6) AS b3_1996 FROM panel WHERE year(month) = 1996")
def suffix_collapse(spark, sf_dir):
    """Of a suffixed pair the left column stays, NULL or not; renames and year suffixes."""
    rows = panel(spark, sf_dir).where(F.year("month") == 1996)
    pair = rows.select(F.col("unit_id").alias("code"), "month", F.col("b1").alias("b_x"), F.col("b2").alias("b_y"))
    year = P.suffixed(rows.select(F.col("unit_id").alias("code"), "month", "b3"), ["code", "month"], "1996")
    return rounded(P.renamed(P.collapse_suffixes(pair).join(year, ["code", "month"]), {"code": "unit_id", "absent": "x"}))


@query(f"WITH {CROSS} SELECT unit_id, round(b1_mean, 6) AS b1_mean, round(b1_std, 6) AS b1_std, round(b3_mean, 6) AS b3_mean, round(b3_std, 6) AS b3_std, n_b1, n_rows, acctbal, pref_name, region FROM xs")
def correlated_drop(spark, sf_dir):
    """P10: listed features go with their means and deviations."""
    return rounded(features.drop_correlated(cross(spark, sf_dir), ["b2", "b4", "absent"]))


COLUMNS = [f"{b}_{s}" for b in BANDS for s in ("mean", "std")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate([*COLUMNS, "n_b1", "n_rows", "acctbal"])) + ") AS t(place, name)")
def numeric_discovery(spark, sf_dir):
    """Numeric columns, keys excluded."""
    return spark.createDataFrame(list(enumerate(numeric_columns(cross(spark, sf_dir)))), "place int, name string")


@query(f"WITH {CROSS} SELECT unit_id, round(b3_mean, 6) AS b3_mean, round(b1_mean, 6) AS b1_mean FROM xs")
def optional_columns(spark, sf_dir):
    """Wanted columns that exist, in the order asked for; required ones are checked."""
    x = require_columns(cross(spark, sf_dir), ["unit_id"])
    return rounded(x.select("unit_id", *resolve_columns(x, ["b3_mean", "absent", "b1_mean"])))


EXPERIMENTS = {"all": ["b1_mean", "b2_mean", "acctbal", "n_rows"], "no_leaky": ["b1_mean", "b2_mean", "acctbal"], "rs_only": ["b1_mean", "b2_mean"], "demo_only": ["acctbal"]}


@query(f"WITH {CROSS}, p AS (" + " UNION ALL ".join(f"SELECT '{e}' AS experiment, '{c}' AS feature, {c} AS v FROM xs" for e, cs in EXPERIMENTS.items() for c in cs) + ") SELECT experiment, feature, count(v) AS n, round(avg(v), 5) AS mean FROM p GROUP BY 1, 2")
def experiment_projections(spark, sf_dir):
    """The feature subsets that experiments see."""
    from gridloom.schema import to_long

    x = cross(spark, sf_dir)
    parts = [to_long(x, [], columns).select(F.lit(name).alias("experiment"), "feature", "value") for name, columns in EXPERIMENTS.items()]
    return rounded(P.union_all(parts).groupBy("experiment", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), 5)


@query(f"WITH {SLOPES}, a AS (SELECT unit_id, avg(b1) AS b1_mean, coalesce(stddev_samp(b1), 0) AS b1_std FROM panel GROUP BY 1), mm AS (SELECT unit_id, month(month) AS m, avg(b1) AS b1 FROM panel GROUP BY 1, 2), s AS (SELECT unit_id, max(b1) - min(b1) AS amp FROM mm GROUP BY 1) SELECT unit_id, round(b1_mean, 5) AS b1_mean, round(b1_std, 5) AS b1_std, round(b1_slope, 6) AS b1_slope, round(amp, 6) AS b1_seasonal_amp FROM a JOIN sl USING (unit_id) LEFT JOIN s USING (unit_id)")
def concat_columns(spark, sf_dir):
    """U4: the cross-section's column families beside each other, by unit; slopes and amplitudes as the operator rounds them."""
    flat = T.cross_section(panel(spark, sf_dir), ["b1"], [])
    return flat.withColumns({c: F.round(c, 5) for c in ("b1_mean", "b1_std")})


@query("SELECT * FROM (VALUES ('acctbal'), ('b1_mean'), ('b2_mean')) AS t(name)")
def name_set_union(spark, sf_dir):
    """Names logged in either list, resolved to the columns there are."""
    _, logged = features.shifted_log1p(cross(spark, sf_dir), ["b1", "b2", "acctbal", "absent"])
    return spark.createDataFrame([(c,) for c in sorted(set(logged) | {"b2_mean"})], "name string")


@query(f"WITH {UNITS} SELECT region, pref_name, unit_id, row_number() OVER (ORDER BY region, pref_name DESC, unit_id) - 1 AS place FROM units")
def multi_key_sort(spark, sf_dir):
    """O1: an export in the order of several keys, with its places."""
    from gridloom.functions.ordering import placed

    return placed(units(spark, sf_dir).select("region", "pref_name", "unit_id"), ["region", F.desc("pref_name"), "unit_id"])


GAPS = f"{POINTS}, g AS (SELECT label AS k, round(avg(x0), 4) AS gap, round(stddev_pop(x0) / 20, 4) AS se FROM pts GROUP BY 1)"


@query(f"WITH {GAPS}, f AS (SELECT k, gap, lead(gap) OVER (ORDER BY k) AS after, lead(se) OVER (ORDER BY k) AS se1 FROM g) SELECT CAST(coalesce((SELECT min(k) FROM f WHERE gap >= after - se1), (SELECT max(k) FROM f)) AS INTEGER) AS k")
def gap_forward(spark, sf_dir):
    """The first k whose gap reaches the next one's less its error."""
    rows = points(spark, sf_dir).groupBy(F.col("label").alias("k")).agg(F.round(F.avg("x0"), 4).alias("gap"), F.round(F.stddev_pop("x0") / 20, 4).alias("se")).orderBy("k").collect()
    return spark.createDataFrame([(int(cluster.gap_choice([tuple(r) for r in rows])),)], "k int")


@query(f"WITH RECURSIVE {POINTS}, v AS (SELECT label AS k, round(max(x1), 4) AS s FROM pts GROUP BY 1), o AS (SELECT k, s, row_number() OVER (ORDER BY k) AS r FROM v), w AS (SELECT r, k AS best, s AS top FROM o WHERE r = 1 UNION ALL SELECT o.r, CASE WHEN o.s > w.top + 0.02 THEN o.k ELSE w.best END, CASE WHEN o.s > w.top + 0.02 THEN o.s ELSE w.top END FROM w JOIN o ON o.r = w.r + 1) SELECT CAST(best AS INTEGER) AS k FROM w ORDER BY r DESC LIMIT 1")
def parsimony_k(spark, sf_dir):
    """A larger k only where its value beats the best so far by more than 0.02."""
    rows = points(spark, sf_dir).groupBy("label").agg(F.round(F.max("x1"), 4).alias("s")).collect()
    return spark.createDataFrame([(int(cluster.primary_k([(r.label, r.s) for r in rows])),)], "k int")


@query(f"WITH {POINTS}, c AS (SELECT t.fold, p.label, count(*) AS n FROM pts p JOIN (SELECT DISTINCT id % 5 AS fold FROM pts) t ON p.id % 5 <> t.fold GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY n DESC, label) AS r FROM c) SELECT pts.id, CAST(pts.id % 5 AS INTEGER) AS fold, CAST(pts.label AS INTEGER) AS y_true, CAST(r.label AS INTEGER) AS y_pred FROM pts JOIN r ON r.fold = pts.id % 5 AND r.r = 1")
def dummy_baseline(spark, sf_dir):
    """The registry's majority baseline through the cross-validation loop."""
    df = points(spark, sf_dir).select("id", "label", "x0", (F.col("id") % 5).cast("int").alias("fold"))
    return classify.cross_validate(df, ["x0"], classify.build_models(["dummy_most_frequent"])).select("id", "fold", "y_true", "y_pred")


@query("SELECT l_suppkey AS unit_id, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, round(median(l_discount), 6) AS l_discount, round(median(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1, 2")
def unmasked_median(spark, sf_dir):
    """The composite of all scenes, without a class mask."""
    scenes = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit_id"), F.trunc("l_shipdate", "month").alias("month"), "l_discount", "l_tax")
    return rounded(T.median_composite(scenes, ["unit_id", "month"], ["l_discount", "l_tax"]))


@query("SELECT l_orderkey AS image_id, l_discount, l_tax FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-02-01' AND l_quantity <= 20")
def scene_selection(spark, sf_dir):
    """Images of a period under a cloud limit, with the bands asked for."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("cloud_pct"), "l_discount", "l_tax")
    return readers.scenes(rows, "1996-01-01", "1996-02-01", 20, ["l_discount", "l_tax"]).drop("ts")


@query(f"WITH {PANEL} SELECT strftime(month, '%Y-%m') AS month, 'b' || band AS band, count(*) AS n, round(sum(v), 3) AS total FROM (SELECT month, 1 AS band, b1 AS v FROM panel UNION ALL SELECT month, 3, b3 FROM panel) WHERE v IS NOT NULL GROUP BY 1, 2")
def pixel_export(spark, sf_dir):
    """K7: a pixel table by month and band."""
    path = lineage.scratch(spark, "pixels")
    rows = panel(spark, sf_dir).select(F.date_format("month", "yyyy-MM").alias("month"), F.col("unit_id").alias("row"), F.col("mi").alias("col"), "b1", "b3")
    sinks.write_pixels(rows, path)
    back = spark.read.schema("row long, col int, value double, month string, band string").parquet(path)
    return rounded(back.groupBy("month", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 3)


@query("""SELECT CAST(l_linenumber AS INTEGER) AS band, CAST(l_orderkey // 16 AS BIGINT) AS row, CAST(l_orderkey % 16 AS BIGINT) AS col, round(l_orderkey % 16 + 0.5, 3) AS x, round(-(l_orderkey // 16) - 0.5, 3) AS y, CAST(max(l_quantity) AS DOUBLE) AS value
    FROM lineitem WHERE l_linenumber <= 3 AND l_orderkey % 16 BETWEEN 2 AND 9 AND l_orderkey // 16 BETWEEN 10 AND 900 GROUP BY ALL""")
def raster_window(spark, sf_dir):
    """Bands written as GeoTIFF files, a window of them read again; tiles outside it are not read."""
    from gridloom.sources import raster

    path = lineage.scratch(spark, "raster")
    row, col = F.floor(F.col("l_orderkey") / 16), F.col("l_orderkey") % 16
    li = read(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("band"), row.alias("row"), col.alias("col")).agg(F.max("l_quantity").alias("value"))
    height = li.agg(F.max("row")).first()[0] + 1
    raster.write_raster(li, path, 16, height, bands=3, block=256)
    back = raster.read_raster(spark, path, bounds=(2.0, -901.0, 10.0, -10.0)).where("value IS NOT NULL")
    return back.select("band", F.floor(-F.col("y")).alias("row"), F.floor("x").alias("col"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "value")
