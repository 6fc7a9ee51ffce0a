"""GeoTIFF files written, read, masked and used for texture."""

import struct
import zlib

import numpy as np
import pytest

from gridloom.operators import spatial, texture
from gridloom.sources import raster
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def image():
    rng = np.random.default_rng(0)
    made = rng.integers(0, 8, (2, 70, 50)).astype(float)
    made[0, :5, :5] = np.nan
    return made


@pytest.fixture(scope="module")
def folder(spark, image, tmp_path_factory):
    rows = [(b + 1, r, c, None if np.isnan(v) else float(v)) for (b, r, c), v in np.ndenumerate(image)]
    df = spark.createDataFrame(rows, "band int, row long, col long, value double").repartition(4)
    path = str(tmp_path_factory.mktemp("raster") / "out")
    raster.write_raster(df, f"file://{path}", 50, 70, bands=2, origin=(1000.0, 500.0), step=(10.0, 10.0), epsg=6675, block=32)
    return path


def test_write_and_read(spark, image, folder):
    rows = raster.read_raster(spark, folder).collect()
    assert len(rows) == image.size and len({r.file for r in rows}) == 6
    for r in rows:
        row, col = (500 - r.y) / 10 - 0.5, (r.x - 1000) / 10 - 0.5
        want = image[r.band - 1, round(row), round(col)]
        assert (r.value is None) == bool(np.isnan(want)) and (r.value is None or r.value == want)


def test_directory(folder):
    own = raster.layout(f"{folder}/block-2-1.tif")
    assert (own.width, own.height, own.bands, own.epsg, own.nodata) == (18, 6, 2, 6675, -9999.0)
    assert own.origin == (1000 + 320, 500 - 640) and own.step == (10.0, 10.0)


def test_bounds_prune_tiles(spark, image, tmp_path):
    blob = raster.encode(image, (0.0, 70.0), (1.0, 1.0), -1.0, 4326, tile=16)
    path = str(tmp_path / "one.tif")
    with open(path, "wb") as f:
        f.write(blob)
    own = raster.layout(path)
    assert len(own.tiles(None)) == 5 * 4 and own.tiles((17.0, 30.0, 20.0, 31.0)) == [(2, 1)] and own.epsg == 4326
    got = raster.read_raster(spark, path, bounds=(17.0, 30.0, 20.0, 31.0), bands=[2]).collect()
    assert {(r.row, r.col): r.value for r in got} == {(39, c): image[1, 39, c] for c in (17, 18, 19)}
    reader = raster._Reader({"path": path, "bounds": "17,30,20,31", "tiles": "1"})
    assert [p.value[1:] for p in reader.partitions()] == [(0, [(2, 1)]), (1, [(2, 1)])]  # no task reads more than a tile
    assert raster.read_raster(spark, path, bounds=(500.0, 500.0, 501.0, 501.0)).count() == 0


def strips(values, order, predictor):
    """A file in strips with interleaved bands of 16 bits, as other programs write them."""
    rows, cols, bands = values.shape
    kind = np.dtype(f"{order}u2")
    parts = []
    for r in range(0, rows, 3):
        part = values[r : r + 3].astype(kind)
        if predictor == 2:
            part = np.concatenate([part[:, :1], np.diff(part, axis=1)], 1).astype(kind)
        parts.append(zlib.compress(part.tobytes()))
    at, offsets = 8, []
    for p in parts:
        offsets.append(at)
        at += len(p)
    fields = [(256, 3, [cols]), (257, 3, [rows]), (258, 3, [16] * bands), (259, 3, [32946]), (273, 4, offsets), (277, 3, [bands]), (278, 3, [3]), (279, 4, [len(p) for p in parts]), (284, 3, [1]), (317, 3, [predictor]), (339, 3, [1] * bands)]
    beyond, entries, extra = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind_, vs in fields:
        data = struct.pack(f"{order}{len(vs)}{'H' if kind_ == 3 else 'I'}", *vs)
        place = data.ljust(4, b"\0")
        if len(data) > 4:
            place, extra = struct.pack(f"{order}I", beyond + len(extra)), extra + data
        entries += struct.pack(f"{order}HHI", tag, kind_, len(vs)) + place
    return (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, at) + b"".join(parts) + struct.pack(f"{order}H", len(fields)) + entries + b"\0" * 4 + extra


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_strips_of_other_programs(spark, tmp_path, order, predictor):
    values = np.random.default_rng(1).integers(0, 60_000, (11, 7, 3))
    path = str(tmp_path / "s.tif")
    with open(path, "wb") as f:
        f.write(strips(values, order, predictor))
    got = {(r.row, r.col, r.band): r.value for r in raster.read_raster(spark, path).collect()}
    assert got == {(r, c, b + 1): float(v) for (r, c, b), v in np.ndenumerate(values)}


def test_other_files_are_refused(tmp_path):
    path = tmp_path / "x.tif"
    path.write_bytes(b"not a raster at all")
    with pytest.raises(ValueError):
        raster.layout(str(path))
    with pytest.raises(ValueError):
        raster.local_path("s3a://bucket/x.tif")


def test_mask_and_texture(spark, image, folder):
    """Pixels of a polygon, as levels of a window: the same co-occurrences as those of the array."""
    ring = [{"x": x, "y": y} for x, y in ((1100.0, 300.0), (1300.0, 300.0), (1300.0, 450.0), (1100.0, 450.0))]
    units = spark.createDataFrame([(1, ring)], "unit_id long, ring array<struct<x:double,y:double>>")
    pixels = raster.read_raster(spark, folder, bounds=(1100.0, 300.0, 1300.0, 450.0), bands=[2])
    inside = spatial.pixels_in_rings(pixels, units, "ring", 100.0)
    level = inside.select(F.col("unit_id").alias("window_id"), ((500 - F.col("y")) / 10 - 0.5).cast("long").alias("row"), ((F.col("x") - 1000) / 10 - 0.5).cast("long").alias("col"), F.col("value").cast("int").alias("level"))
    got = {(r.i, r.j): r.p for r in texture.glcm(level, ["window_id"]).where("angle = 0").collect()}
    window = image[1, 5:20, 10:30].astype(int)
    assert level.count() == window.size
    want = np.zeros((8, 8))
    for a, b in zip(window[:, :-1].ravel(), window[:, 1:].ravel(), strict=True):
        want[a, b] += 1
        want[b, a] += 1
    want /= want.sum()
    assert got == pytest.approx({(i, j): want[i, j] for i in range(8) for j in range(8) if want[i, j]})
