"""Sources, sinks, streaming and the staged workflows."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from gridloom import workflows
from gridloom.config import PanelConfig, load_config
from gridloom.operators import classify, cluster, spatial
from gridloom.sources import geopackage, readers, shapefile, sinks, wkb
from gridloom.streaming import incremental

HEAD = "unit_id,unit_code,pref_name,month,v\n"


def test_csv_keeps_leading_zeros_and_first_row(spark, tmp_path):
    (tmp_path / "m.csv").write_text(HEAD + "a,0012,p,2020-01,1.5\na,0012,p,2020-01,9.5\nb,7,p,2020-01,\n")
    rows = readers.read_month_csv(spark, str(tmp_path / "m.csv"), ["v"], "village").orderBy("unit_id").collect()
    assert [(r.unit_code, r.v) for r in rows] == [("00012", 1.5), ("00007", None)]


def test_glob_and_batches(spark, tmp_path):
    for b in (1, 2, 7):
        (tmp_path / f"x_2020-01_batch_{b}.csv").write_text(HEAD + f"u{b},1,p,2020-01,{b}\n")
    df = readers.read_glob(spark, f"{tmp_path}/*.csv", "unit_id string, unit_code string, pref_name string, month string, v double", source="path")
    assert df.count() == 3 and df.select("path").distinct().count() == 3
    with pytest.raises(FileNotFoundError):
        readers.read_glob(spark, f"{tmp_path}/none*.csv", "a string")
    assert readers.missing_batches(spark, str(tmp_path), "2020-01", range(1, 4)) == [3]


def test_legacy_encoding(spark, tmp_path):
    for name, encoding in (("a.txt", "cp932"), ("b.txt", "utf-8")):
        (tmp_path / name).write_bytes("市区町村,KEY\n京都,1\n".encode(encoding))
        assert readers.read_legacy_text(spark, str(tmp_path / name), ["市区町村"]).first()["市区町村"] == "京都"
    with pytest.raises(ValueError, match="no known encoding"):
        readers.read_legacy_text(spark, str(tmp_path / "b.txt"), ["missing"])


def test_osm_json(spark, tmp_path):
    elements = [{"type": "node", "id": i, "lat": y, "lon": x} for i, (x, y) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])]
    elements.append({"type": "way", "id": 5, "nodes": [0, 1, 2, 0], "tags": {"building": "yes"}})
    (tmp_path / "o.json").write_text(json.dumps({"elements": elements}))
    df = readers.read_osm(spark, str(tmp_path / "o.json"))
    assert df.where("building = 'yes'").count() == 1
    assert spatial.ways_to_rings(df).select(spatial.area(F.col("ring")).alias("a")).first().a == 0.5


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "u.gpkg")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE units (fid INTEGER PRIMARY KEY, unit_code TEXT, geom BLOB, area REAL)")
        db.executemany("INSERT INTO units VALUES (?, ?, ?, ?)", [(i, f"{i:05d}", b"\x01", i / 2) for i in range(10)])
    geopackage.register(spark)
    df = spark.read.format("gpkg").option("table", "units").option("columns", "unit_code,area").load(path)
    assert geopackage.layers(path) == ["units"] and df.columns == ["unit_code", "area"]
    assert sorted(r.unit_code for r in df.collect()) == [f"{i:05d}" for i in range(10)]


def test_scene_scan_pushes_down(spark, tmp_path):
    spark.sql("SELECT 1L AS image_id, TIMESTAMP'2020-01-01' AS ts, 10.0D AS cloud_pct, 0.1D AS b3, 0.2D AS b4, 0.3D AS b5").write.parquet(f"{tmp_path}/s")
    df = readers.scenes(spark.read.parquet(f"{tmp_path}/s"), "2020-01-01", "2020-12-31", 60.0, ["b3"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "b4" not in plan and df.count() == 1
    assert readers.scenes(spark.read.parquet(f"{tmp_path}/s"), "2019-01-01", "2020-01-01", 60.0, ["b3"]).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("u", "2020-01", 1.0), ("u", "2020-02", 2.0)], "unit_id string, month string, v double")
    sinks.write_both(df, f"{tmp_path}/t")
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == spark.read.csv(f"{tmp_path}/t.csv", header=True).count() == 2
    sinks.write_month(df, f"{tmp_path}/p")
    sinks.write_month(df.where("month = '2020-02'").withColumn("v", F.lit(9.0)), f"{tmp_path}/p")
    assert {(r.month, r.v) for r in spark.read.parquet(f"{tmp_path}/p").select("month", "v").collect()} == {("2020-01", 1.0), ("2020-02", 9.0)}
    sinks.write_json(f"{tmp_path}/m/m.json", sinks.manifest(df, note={1: (1, 2)}))
    made = json.loads((tmp_path / "m/m.json").read_text())
    assert made["row_count"] == 2 and made["first_month"] == "2020-01" and made["note"] == {"1": [1, 2]}
    assert sinks.to_json_rows(df).count() == 2


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"temporal": ["v"], "gap_days": 40}')
    assert load_config(str(tmp_path / "c.json")).gap_days == 40
    with pytest.raises(ValueError, match="unknown settings"):
        PanelConfig.of({"nope": 1})


def test_incremental_cells(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"2024-0{m}-0{d} 00:00:00", float(d)) for m in (1, 2, 4) for d in (1, 2)], "unit_id long, ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    options = {"unit": "unit_id", "ts": "ts", "columns": ["v"], "late": "10 days"}
    incremental.append_cells(stream, f"{tmp_path}/out", f"{tmp_path}/ck", **options)
    static = incremental.cell_stream(rows, **options)
    done = spark.read.parquet(f"{tmp_path}/out")
    assert static.count() == 6 and done.count() == 4 and done.join(static, ["unit_id", "start", "n", "v"]).count() == 4
    incremental.append_cells(stream, f"{tmp_path}/out", f"{tmp_path}/ck", **options)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 4


@pytest.fixture(scope="module")
def golden(spark):
    """Ten units by two years of months, with a census."""
    units = spark.range(10).select(F.format_string("village:p:%05d", "id").alias("unit_id"), "id")
    months = spark.range(24).select(F.add_months(F.lit("2019-01-01").cast("date"), F.col("id").cast("int")).alias("month"), F.col("id").alias("m"))
    cells = units.join(months).select("unit_id", "month", (F.sin("m") + F.col("id")).alias("ndvi"), F.when((F.col("m") + F.col("id")) % 5 != 0, F.col("m") * 0.1).alias("viirs"))
    census = units.select("unit_id", F.lit("p").alias("pref_name"), (F.col("id") * 10 + 5).cast("double").alias("age_65_plus"), (F.col("id") * 100).cast("double").alias("pop_total"), ((F.col("id") - 5) / 20).alias("change"))
    return cells, census


def test_workflow(spark, golden):
    cells, census = golden
    first, rest = cells.where("month < '2020-01-01'"), cells.where("month >= '2019-12-01'")
    built = workflows.build_panel([first, rest], [], census)
    assert built.count() == 240 and built.select("unit_id", "month").distinct().count() == 240
    config = PanelConfig(temporal=["ndvi", "viirs"], static=["pref_name", "age_65_plus", "pop_total", "change"], log1p=["viirs"], target_ratio="change", target_thresholds=(-0.1, 0.0))
    tables = workflows.explore(built, config)
    assert tables["basic_statistics"].count() == 5 and tables["unit_trends"].count() == 10
    checks = {r["check"]: (r["status"], r["n"]) for r in tables["quality_checks"].collect()}
    assert len(checks) == 7 and checks["expected_columns"] == ("warn", 2) and checks["temporal_coverage"] == ("ok", 0)
    assert {r.topic for r in tables["key_findings"].collect()} >= {"missing", "seasonal", "strongest_link"}
    assert {r.feature for r in tables["quality_flags"].where("type = 'high_missing'").collect()} == set()
    assert tables["heatmap"].where("pref_name = 'Overall'").count() == 5
    made = workflows.preprocess(built, config)
    ready = made["ready"]
    assert ready.count() == 10 and {r.target_class for r in ready.select("target_class").collect()} == {"severely_shrinking", "shrinking", "stable"}
    assert ready.where("ndvi_mean IS NULL OR elderly_ratio IS NULL").count() == 0
    with pytest.raises(ValueError, match="matched almost no unit"):
        workflows.build_panel([first], [], census.withColumn("unit_id", F.concat(F.lit("x"), "unit_id")))


def test_evaluate_and_typology(spark):
    df = spark.range(120).select("id", (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 3 * 5 + F.rand(1)).alias("a"), F.rand(2).alias("b")).persist()
    made = workflows.evaluate(df, ["a", "b"], ["dummy_most_frequent", "knn", "logistic_regression"], folds=3)
    best = {r.model: r["mean"] for r in made["model_comparison"].collect()}
    assert best["knn"] == best["logistic_regression"] == 1.0 and best["dummy_most_frequent"] == pytest.approx(1 / 3)
    assert made["pairwise_tests"].count() == 3
    types = workflows.typology(df, ["a", "b"], 3)
    assert types["assignments"].count() == 120 and types["profiles"].count() == 3


def test_first_row_of_a_repeated_month_stays(spark):
    cells = [spark.createDataFrame([("u", "2020-01-01", v)], "unit_id string, month string, v double") for v in (7.0, 1.0)]
    assert workflows.build_panel(cells, [], None).first().v == 7.0


def test_legacy_text_leaves_the_session_as_it_was(spark, tmp_path):
    (tmp_path / "jp.csv").write_bytes("名前,値\n青森,1\n".encode("cp932"))
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbf" + "名前,値\n秋田,2\n".encode())
    setting = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(setting)
    for file, want in (("jp.csv", ("青森", "1")), ("bom.csv", ("秋田", "2"))):
        assert tuple(readers.read_legacy_text(spark, str(tmp_path / file), ["名前", "値"]).first()) == want
        assert spark.conf.get(setting) == before
    with pytest.raises(ValueError, match="no known encoding"):
        readers.read_legacy_text(spark, str(tmp_path / "jp.csv"), ["absent"])
    assert spark.conf.get(setting) == before


def test_wkb_round_trip_and_multipolygon(spark):
    import struct

    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)]
    assert wkb.outer_rings(wkb.polygon(ring)) == wkb.outer_rings(wkb.geopackage_blob(ring)) == [ring]
    hole = struct.pack(">BII", 0, 3, 2) + 2 * (struct.pack(">I", 4) + struct.pack(">8d", 0, 0, 4, 0, 4, 3, 0, 0))
    several = struct.pack("<BII", 1, 6, 2) + hole + wkb.polygon([(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)])
    assert wkb.outer_rings(several) == [ring, [(9.0, 9.0), (10.0, 9.0), (10.0, 10.0)]]
    raised = struct.pack("<BIII", 1, 1003, 1, 2) + struct.pack("<6d", 1, 2, 99, 3, 4, 99)
    assert wkb.outer_rings(raised) == [[(1.0, 2.0), (3.0, 4.0)]]
    assert wkb.outer_rings(None) == wkb.outer_rings(struct.pack("<BIdd", 1, 1, 0, 0)) == []
    df = spark.createDataFrame([(wkb.geopackage_blob(ring),), (None,)], "geom binary").select(wkb.rings_of(F.col("geom")).alias("r"))
    assert [len(r.r) for r in df.collect()] == [1, 0]


def test_geopackage_write_and_read(spark, tmp_path):
    path = str(tmp_path / "out.gpkg")
    rows = spark.createDataFrame([("a", 1, 2.5, True), ("b", None, None, False)], "name string, n long, v double, ok boolean").withColumn("ring", spatial.rectangle(F.lit(0), F.lit(0), F.lit(2), F.lit(1)))
    assert geopackage.write_layer(rows, path, "units") == 2
    geopackage.register(spark)
    back = spark.read.format("gpkg").option("table", "units").load(path)
    got = back.select("name", "n", "v", spatial.area(wkb.rings_of(F.col("geom"))[0]).alias("area")).orderBy("name").collect()
    assert [tuple(r) for r in got] == [("a", 1, 2.5, 2.0), ("b", None, None, 2.0)]
    assert "units" in geopackage.layers(path)


def test_provenance_pixels_and_report(spark, tmp_path):
    made = sinks.provenance(str(tmp_path / "p.json"), "full.gpkg", "golden.gpkg", "bounds.gpkg", ["p"], ["u1", "u2"], 9)
    assert json.loads((tmp_path / "p.json").read_text()) == made and made["aoi_golden"]["unit_count"] == 2
    pixels = spark.createDataFrame([("2020-01", 0, 0, 1.0, None), ("2020-02", 0, 1, 2.0, 3.0)], "month string, row int, col int, b4 double, ndvi double")
    sinks.write_pixels(pixels, str(tmp_path / "px"))
    assert spark.read.parquet(str(tmp_path / "px")).where("band = 'ndvi'").count() == 1
    sinks.write_report(str(tmp_path / "r.html"), "A <title>", {"t": pixels})
    assert "A &lt;title&gt;" in (tmp_path / "r.html").read_text()


def test_shared_folder_is_asked_for_off_local_mode(spark, monkeypatch):
    from types import SimpleNamespace

    from gridloom.functions import lineage

    nowhere = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: default), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(nowhere)
    kept = lineage.stage(spark.range(3), "t")
    assert kept.count() == 3
    path = kept.inputFiles()[0].rsplit("/", 1)[0]
    lineage.remove(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FileNotFound|does not exist"):
        spark.read.parquet(path).count()


def test_shapefile(spark, tmp_path):
    import struct

    def record(number, kind, parts):
        points = [p for part in parts for p in part]
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        body = struct.pack("<i4d2i", kind, 0, 0, 9, 9, len(parts), len(points)) + struct.pack(f"<{len(parts)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in points)
        return struct.pack(">2i", number, len(body) // 2) + body

    square, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 1)]
    null = struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    (tmp_path / "u.shp").write_bytes(bytes(100) + record(1, 5, [square, hole]) + null)
    fields = b"".join(struct.pack("<11sc4xBB14x", name, b"C", width, 0) for name, width in ((b"CODE", 5), ("名".encode("cp932"), 8)))
    rows = b"".join(b" " + code.ljust(5) + name.encode("cp932").ljust(8) for code, name in ((b"02201", "青森"), (b"", "秋田")))
    (tmp_path / "u.dbf").write_bytes(struct.pack("<B3xIHH20x", 3, 2, 32 + len(fields) + 1, 14) + fields + b"\r" + rows)
    got = shapefile.read_shapefile(spark, str(tmp_path / "u.shp")).orderBy("id").collect()
    assert [(p.x, p.y) for p in got[0].rings[0]] == [tuple(map(float, p)) for p in square[:-1]] and len(got[0].rings) == 2
    assert got[1].rings == [] and got[0].attributes == {"CODE": "02201", "名": "青森"} and got[1].attributes == {"名": "秋田"}


def test_chunks_and_models(spark, tmp_path):
    units = spark.range(5).select("id", spatial.rectangle(F.col("id"), F.lit(0), F.col("id") + 1, F.lit(1)).alias("ring"))
    sinks.write_chunks(units, str(tmp_path / "up"), "id", 2, 0.1)
    assert {r.batch: r["count"] for r in spark.read.parquet(str(tmp_path / "up")).groupBy("batch").count().collect()} == {0: 2, 1: 2, 2: 1}
    df = spark.createDataFrame([(i, i % 2, float(i % 2)) for i in range(10)], "id long, label int, x double")
    fitted = classify.fit_all(df, ["x"], classify.build_models(["logistic_regression", "dummy_most_frequent"]))
    with pytest.raises(ValueError, match="dummy_most_frequent"):
        classify.save_models(fitted, str(tmp_path / "models"))
    assert not (tmp_path / "models").exists()
    del fitted["dummy_most_frequent"]
    assert classify.save_models(fitted, str(tmp_path / "models")) == ["logistic_regression"]
    guess = fitted["logistic_regression"].transform(cluster.as_vector(df, ["x"]))
    assert guess.where("prediction <> label").count() == 0


def test_geopackage_filters_reach_the_file(spark, tmp_path):
    path = str(tmp_path / "f.gpkg")
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]
    rows = spark.createDataFrame([(i, f"c{i % 10}", i / 4 if i % 7 else None, ring) for i in range(200)], "n long, code string, area double, ring array<struct<x:double,y:double>>")
    geopackage.write_layer(rows, path, "units")
    geopackage.register(spark)
    whole = rows.drop("ring")
    load = lambda: spark.read.format("gpkg").option("table", "units").option("columns", "n,code,area").load(path)
    for condition in ("n > 150", "n <= 3", "code = 'c3' AND n < 50", "area IS NULL", "area >= 40.25 AND code IN ('c1', 'c2')", "code LIKE 'c4%'", "NOT (code = 'c1')", "n = 5 OR n = 6", "code > 'c7'", "area <> 1.5"):
        assert sorted(map(tuple, load().where(condition).collect()), key=str) == sorted(map(tuple, whole.where(condition).collect()), key=str), condition
    plan = load().where("n > 150 AND code = 'c3'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan.split("BatchScan")[0]  # nothing is left for Spark to test

    from pyspark.sql import datasource as ds

    reader = geopackage._Reader(path, "units", [("n", "long"), ("code", "string")], 2)
    left = list(reader.pushFilters([ds.GreaterThan(("n",), 150), ds.GreaterThan(("code",), "c3"), ds.EqualTo(("code",), "c3")]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"] and left[0].value == "c3"
    read = [r for part in reader.partitions() for r in reader.read(part)]
    assert read == [(n, "c3") for n in (153, 163, 173, 183, 193)]  # no other row leaves the file
