"""GeoTIFF rasters as a data source: ``spark.read.format("geotiff")`` gives a row per pixel, ``df.write`` a folder of files.

Reading: a partition is a run of tiles (or strips) of one file and band, and a task seeks to these alone. With
``bounds`` (x0,y0,x1,y1) only tiles that meet the box are read. Pixels that hold the file's nodata value, or NaN, have a
null value. Writing: every task writes the blocks it holds, a file per block, and files get their names on commit; see
:func:`write_raster`. Files are opened by path, so on a cluster they lie in a folder that all executors mount.

Supported: classic TIFF of either byte order, tiles or strips, planar or interleaved bands, 8- to 64-bit numbers, no or
deflate compression, horizontal differencing. Anything else raises.
"""

from __future__ import annotations

import glob
import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Tags of the file format.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, SCALE, TIEPOINT, GEO_KEYS, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 34735, 42113
#: Struct letters of the field types.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
DEFLATE = (8, 32946)
PIXEL = "file string, band int, row long, col long, x double, y double, value double"
TILE = 256


@dataclass
class Layout:
    """What a file's directory says."""

    order: str
    width: int
    height: int
    tile_width: int
    tile_height: int
    bands: int
    planar: bool
    compression: int
    predictor: int
    kind: np.dtype
    offsets: list[int]
    sizes: list[int]
    origin: tuple[float, float]
    step: tuple[float, float]
    nodata: float | None
    epsg: int | None = None
    across: int = field(init=False)
    down: int = field(init=False)

    def __post_init__(self):
        self.across, self.down = -(-self.width // self.tile_width), -(-self.height // self.tile_height)

    def tile(self, band: int, row: int, col: int) -> int:
        return (band if self.planar else 0) * self.across * self.down + row * self.across + col

    def centre(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.origin[0] + (col + 0.5) * self.step[0], self.origin[1] - (row + 0.5) * self.step[1]

    def tiles(self, bounds: tuple[float, float, float, float] | None) -> list[tuple[int, int]]:
        """Rows and columns of the tiles that meet a box."""
        if bounds is None:
            low, high = (0, 0), (self.down - 1, self.across - 1)
        else:
            x0, y0, x1, y1 = bounds
            w, h = self.tile_width * self.step[0], self.tile_height * self.step[1]
            low = (max(0, math.floor((self.origin[1] - y1) / h)), max(0, math.floor((x0 - self.origin[0]) / w)))
            high = (min(self.down - 1, math.floor((self.origin[1] - y0) / h)), min(self.across - 1, math.floor((x1 - self.origin[0]) / w)))
        return [(r, c) for r in range(low[0], high[0] + 1) for c in range(low[1], high[1] + 1)]


def layout(path: str) -> Layout:
    """The directory of a file; pixels are not read."""
    with open(path, "rb") as f:
        head = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None or struct.unpack(order + "H", head[2:4])[0] != 42:
            raise ValueError(f"{path} is not a classic TIFF file")
        f.seek(struct.unpack(order + "I", head[4:])[0])
        (n,) = struct.unpack(order + "H", f.read(2))
        tags = {}
        for tag, kind, count, at in (struct.unpack(order + "HHI4s", f.read(12)) for _ in range(n)):
            if kind not in TYPES:
                continue
            size = struct.calcsize(TYPES[kind]) * count
            data = at[:size]
            if size > 4:
                here = f.tell()
                f.seek(struct.unpack(order + "I", at)[0])
                data = f.read(size)
                f.seek(here)
            tags[tag] = data if kind == 2 else struct.unpack(f"{order}{count}{TYPES[kind]}", data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    bits, kinds = tags.get(BITS, (1,)), tags.get(FORMAT, (1,))
    kind = {1: "u", 2: "i", 3: "f"}.get(kinds[0])
    if kind is None or bits[0] not in (8, 16, 32, 64) or len(set(bits)) > 1 or one(COMPRESSION, 1) not in (1, *DEFLATE) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError(f"{path}: this kind of pixels or compression is not supported")
    width, height, tiled = tags[WIDTH][0], tags[HEIGHT][0], TILES in tags
    keys = tags.get(GEO_KEYS, ())
    codes = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4)}
    tie, step = tags.get(TIEPOINT, (0.0,) * 6), tags.get(SCALE, (1.0, 1.0, 0.0))
    text = tags.get(NODATA, b"").rstrip(b"\0 ").decode()
    return Layout(
        order, width, height,
        one(TILE_WIDTH, width) if tiled else width,
        one(TILE_HEIGHT, height) if tiled else min(one(ROWS_PER_STRIP, height), height),
        one(SAMPLES, 1), one(PLANAR, 1) == 2, one(COMPRESSION, 1), one(PREDICTOR, 1),
        np.dtype(f"{order}{kind}{bits[0] // 8}"),
        list(tags[TILES if tiled else STRIPS]), list(tags[TILE_BYTES if tiled else STRIP_BYTES]),
        (tie[3] - tie[0] * step[0], tie[4] + tie[1] * step[1]), (step[0], step[1]),
        float(text) if text else None, codes.get(3072, codes.get(2048)),
    )


def read_tile(f, own: Layout, band: int, row: int, col: int) -> np.ndarray:
    """The pixels of one tile that lie inside the raster."""
    place = own.tile(band, row, col)
    f.seek(own.offsets[place])
    data = f.read(own.sizes[place])
    if own.compression in DEFLATE:
        data = zlib.decompress(data)
    depth = 1 if own.planar else own.bands
    height = min(own.tile_height, own.height - row * own.tile_height)
    values = np.frombuffer(data, own.kind)
    values = values[: len(values) // (own.tile_width * depth) * own.tile_width * depth].reshape(-1, own.tile_width, depth)
    if own.predictor == 2:
        values = np.cumsum(values, 1, dtype=values.dtype)
    return values[:height, : own.width - col * own.tile_width, 0 if own.planar else band]


class Tiles(InputPartition):
    def __init__(self, path: str, band: int, tiles: list[tuple[int, int]]):
        super().__init__((path, band, tiles))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        path = local_path(options["path"])
        self.paths = sorted(glob.glob(os.path.join(path, "*.tif"))) if os.path.isdir(path) else [path]
        self.bounds = tuple(map(float, options["bounds"].split(","))) if options.get("bounds") else None
        self.bands = set(map(int, options["bands"].split(","))) if options.get("bands") else None
        self.run = int(options.get("tiles", "16"))

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            own = layout(path)
            tiles = own.tiles(self.bounds)
            out += [Tiles(path, b, tiles[i : i + self.run]) for b in range(own.bands) if not self.bands or b + 1 in self.bands for i in range(0, len(tiles), self.run)]
        return out or [Tiles("", 0, [])]

    def read(self, partition: InputPartition) -> Iterator:
        import pyarrow as pa

        path, band, tiles = partition.value
        if not tiles:
            return
        own, name = layout(path), os.path.basename(path)
        with open(path, "rb") as f:
            for row, col in tiles:
                values = read_tile(f, own, band, row, col).astype(float)
                r, c = np.indices(values.shape)
                r, c = r.ravel() + row * own.tile_height, c.ravel() + col * own.tile_width
                x, y = own.centre(r, c)
                v = values.ravel()
                gone = np.isnan(v) if own.nodata is None else np.isnan(v) | (v == own.nodata)
                if self.bounds:
                    x0, y0, x1, y1 = self.bounds
                    keep = (x >= x0) & (x <= x1) & (y >= y0) & (y <= y1)
                    r, c, x, y, v, gone = r[keep], c[keep], x[keep], y[keep], v[keep], gone[keep]
                n = len(r)
                columns = [pa.array([name] * n, pa.string()), pa.array(np.full(n, band + 1, np.int32)), *map(pa.array, (r, c, x, y)), pa.array(v, mask=gone)]
                yield pa.RecordBatch.from_arrays(columns, ["file", "band", "row", "col", "x", "y", "value"])


def encode(tiles: np.ndarray, origin: tuple[float, float], step: tuple[float, float], nodata: float, epsg: int | None, tile: int = TILE) -> bytes:
    """A tiled, deflated GeoTIFF of 32-bit floats from an array (bands, rows, columns)."""
    bands, height, width = tiles.shape
    across, down = -(-width // tile), -(-height // tile)
    whole = np.full((bands, down * tile, across * tile), nodata, "<f4")
    whole[:, :height, :width] = tiles
    blobs = [zlib.compress(whole[b, r * tile : (r + 1) * tile, c * tile : (c + 1) * tile].tobytes(), 6) for b in range(bands) for r in range(down) for c in range(across)]
    geographic = epsg is not None and 4000 <= epsg < 5000
    keys = [1, 1, 0, 2 + (epsg is not None), 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1] + ([2048 if geographic else 3072, 0, 1, epsg] if epsg is not None else [])
    offsets, at = [], 8
    for b in blobs:
        offsets.append(at)
        at += len(b)
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32] * bands), (COMPRESSION, 3, [8]), (262, 3, [1]), (SAMPLES, 3, [bands]), (PLANAR, 3, [2]),
        (TILE_WIDTH, 4, [tile]), (TILE_HEIGHT, 4, [tile]), (TILES, 4, offsets), (TILE_BYTES, 4, [len(b) for b in blobs]), (FORMAT, 3, [3] * bands),
        (SCALE, 12, [*step, 0.0]), (TIEPOINT, 12, [0.0, 0.0, 0.0, *origin, 0.0]), (GEO_KEYS, 3, keys), (NODATA, 2, f"{nodata:g}".encode() + b"\0"),
    ]
    at += at % 2
    beyond, entries = at + 2 + 12 * len(fields) + 4, b""
    extra = b""
    for tag, kind, values in fields:
        data = values if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(data) > 4:
            place, extra = struct.pack("<I", beyond + len(extra)), extra + data + b"\0" * (len(data) % 2)
        else:
            place = data.ljust(4, b"\0")
        entries += struct.pack("<HHI", tag, kind, len(values)) + place
    body = b"".join(blobs)
    return b"II*\0" + struct.pack("<I", at) + body + b"\0" * (at - 8 - len(body)) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + extra


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Rows ``block_row, block_col, band, row, col, value``, all rows of a block in one task and in order of blocks."""

    def __init__(self, options: dict):
        self.path = local_path(options["path"])
        self.origin = (float(options["x"]), float(options["y"]))
        self.step = (float(options["dx"]), float(options["dy"]))
        self.nodata, self.bands, self.block = float(options.get("nodata", "-9999")), int(options["bands"]), int(options["block"])
        self.width, self.height = int(options["width"]), int(options["height"])
        self.epsg = int(options["epsg"]) if options.get("epsg") else None

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        files, now, pixels = [], None, None

        def close() -> None:
            name = os.path.join(self.path, f"block-{now[0]}-{now[1]}.tif")
            made = f"{name}.{uuid.uuid4().hex}"
            origin = (self.origin[0] + now[1] * self.block * self.step[0], self.origin[1] - now[0] * self.block * self.step[1])
            with open(made, "wb") as f:
                f.write(encode(pixels, origin, self.step, self.nodata, self.epsg))
            files.append((made, name))

        for r in rows:
            if (r.block_row, r.block_col) != now:
                if now:
                    close()
                now = (r.block_row, r.block_col)
                pixels = np.full((self.bands, min(self.block, self.height - now[0] * self.block), min(self.block, self.width - now[1] * self.block)), self.nodata)
            if r.value is not None:
                pixels[r.band - 1, r.row - now[0] * self.block, r.col - now[1] * self.block] = r.value
        if now:
            close()
        return Written(files)

    def commit(self, messages: list) -> None:
        for made, name in (f for m in messages if m for f in m.files):
            os.replace(made, name)

    def abort(self, messages: list) -> None:
        for made, _ in (f for m in messages if m for f in m.files):
            if os.path.exists(made):
                os.remove(made)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return PIXEL

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def local_path(path: str) -> str:
    if "://" in path and not path.startswith("file://"):
        raise ValueError(f"{path}: rasters are read and written in folders that executors mount")
    return path.removeprefix("file://")


def register(spark) -> None:
    spark.dataSource.register(GeoTiff)


def read_raster(spark, path: str, bounds: tuple[float, float, float, float] | None = None, bands: list[int] | None = None) -> DataFrame:
    """Pixels of a file, or of all files of a folder: file, band (from 1), row and col in the file, the centre's x and
    y, value."""
    register(spark)
    reader = spark.read.format("geotiff")
    if bounds:
        reader = reader.option("bounds", ",".join(map(repr, bounds)))
    if bands:
        reader = reader.option("bands", ",".join(map(str, bands)))
    return reader.load(path)


def write_raster(pixels: DataFrame, path: str, width: int, height: int, bands: int = 1, origin: tuple[float, float] = (0.0, 0.0), step: tuple[float, float] = (1.0, 1.0), nodata: float = -9999.0, epsg: int | None = None, block: int = 2048) -> None:
    """``band, row, col, value`` as GeoTIFF files of at most ``block`` by ``block`` pixels, one file at a time in a task;
    of pixels that repeat, one is written. ``origin`` is the upper left corner of the raster. Blocks without a pixel
    have no file."""
    register(pixels.sparkSession)
    at = lambda c: F.floor(F.col(c) / block).cast("int")
    inside: Column = F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1) & F.col("band").between(1, bands)
    rows = pixels.where(inside).select(at("row").alias("block_row"), at("col").alias("block_col"), F.col("band").cast("int"), F.col("row").cast("long"), F.col("col").cast("long"), F.col("value").cast("double"))
    dealt = rows.repartition("block_row", "block_col").sortWithinPartitions("block_row", "block_col")
    own = {"x": origin[0], "y": origin[1], "dx": step[0], "dy": step[1], "nodata": nodata, "bands": bands, "block": block, "width": width, "height": height}
    writer = dealt.write.format("geotiff").mode("append").options(**{k: repr(v) for k, v in own.items()})
    (writer.option("epsg", str(epsg)) if epsg else writer).save(path)
