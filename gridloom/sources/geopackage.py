"""GeoPackage files (SQLite) as a data source: ``spark.read.format("gpkg").option("table", ..).load(path)``.

Comparisons, null tests, lists and string prefixes are answered by SQLite, if ``spark.sql.python.filterPushdown.enabled``
is set (:func:`register` sets it where the session has not). The option ``columns`` names what is fetched."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.functions import projection
from gridloom.sources.wkb import geopackage_blob

KINDS = {"INTEGER": "long", "INT": "long", "MEDIUMINT": "long", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "BLOB": "binary", "GEOMETRY": "binary", "POLYGON": "binary", "MULTIPOLYGON": "binary", "BOOLEAN": "boolean"}


def _columns(path: str, table: str) -> list[tuple[str, str]]:
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        info = db.execute(f'PRAGMA table_info("{table}")').fetchall()
    if not info:
        raise ValueError(f"{path} has no table {table}")
    return [(r[1], KINDS.get(r[2].split("(")[0].upper(), "string")) for r in info]


def layers(path: str) -> list[str]:
    """Feature tables of a file."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        return [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'gpkg_%' AND name NOT LIKE 'sqlite_%' ORDER BY 1")]


class GeoPackage(DataSource):
    """Rows of one table, read in ranges of row ids; ``columns`` restricts what is fetched."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _picked(self) -> list[tuple[str, str]]:
        found = _columns(self.options["path"], self.options["table"])
        wanted = self.options.get("columns")
        names = wanted.split(",") if wanted else [c for c, _ in found]
        return [(c, k) for c, k in found if c in names]

    def schema(self) -> str:
        return ", ".join(f"`{c}` {k}" for c, k in self._picked())

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], self._picked(), int(self.options.get("partitions", "4")))


#: Filters with one value and their SQL.
COMPARED = {"EqualTo": "=", "GreaterThan": ">", "GreaterThanOrEqual": ">=", "LessThan": "<", "LessThanOrEqual": "<="}


def predicate(f: ds.Filter, kinds: dict[str, str]) -> tuple[str, list] | None:
    """A filter as SQL and its values, where SQLite and Spark agree: on numbers as they are stored, and on texts that are
    stored as texts (SQLite keeps whatever type a value has, so the type is tested too)."""
    name = type(f).__name__
    if name == "Not":
        return None  # SQL's logic of nulls is left to Spark
    column = f.attribute[0] if len(f.attribute) == 1 else None
    kind = kinds.get(column)
    if kind is None:
        return None
    quoted = '"' + column.replace('"', '""') + '"'
    if name in ("IsNull", "IsNotNull"):
        return (f"{quoted} IS {'NOT ' if name == 'IsNotNull' else ''}NULL", [])
    values = list(f.value) if name == "In" else [f.value]
    stored = {"long": (int,), "double": (int, float), "string": (str,)}.get(kind, ())
    if not all(isinstance(v, stored) and not isinstance(v, bool) for v in values):
        return None
    typed = f"(typeof({quoted}) = 'text' AND " if kind == "string" else "("
    if name == "In":
        return (f"{typed}{quoted} IN ({', '.join('?' * len(values))}))", values)
    if name == "StringStartsWith":
        return (f"{typed}substr({quoted}, 1, ?) = ?)", [len(f.value), f.value])
    if name in COMPARED and (kind != "string" or name == "EqualTo"):
        return (f"{typed}{quoted} {COMPARED[name]} ?)", values)
    return None


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, columns: list[tuple[str, str]], parts: int):
        self.path, self.table, self.columns, self.parts = path, table, columns, parts
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list) -> Iterator:
        """Filters that SQLite answers as Spark does are kept here; the others are returned."""
        kinds = dict(self.columns)
        for f in filters:
            made = predicate(f, kinds)
            if made is None:
                yield f
            else:
                self.where.append(made)

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        names = ", ".join(f'"{c}"' for c, _ in self.columns)
        terms = " AND ".join(["rowid >= ?", "rowid < ?", *(t for t, _ in self.where)])
        values = [low, high, *(v for _, own in self.where for v in own)]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE {terms}', values):
                yield tuple(bool(v) if k == "boolean" and v is not None else str(v) if k == "string" and v is not None else v for v, (_, k) in zip(row, self.columns, strict=True))


def write_layer(df: DataFrame, path: str, table: str, ring: str = "ring", srs: int = 4326, source: int | None = None) -> int:
    """One feature table of ``df`` with its rings as polygons in ``srs``, from the system ``source`` if it is another;
    the number of rows. A file of this kind has one writer: rows come to the driver one by one."""
    if source not in (None, srs):
        df = df.withColumn(ring, projection.reproject(F.col(ring), source, srs))
    names = [c for c in df.columns if c != ring]
    kinds = {"long": "INTEGER", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "BOOLEAN", "binary": "BLOB"}
    types = dict(df.dtypes)
    columns = ", ".join(f'"{c}" {kinds.get(types[c], "TEXT")}' for c in names)
    rows = 0
    with sqlite3.connect(path) as db:
        db.execute("PRAGMA application_id = 1196444487")  # "GPKG"
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        db.execute("CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        db.execute("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        db.execute(f'DROP TABLE IF EXISTS "{table}"')
        db.execute(f'CREATE TABLE "{table}" (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom POLYGON, {columns})')
        db.execute("INSERT OR REPLACE INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (table, table, srs))
        db.execute("INSERT OR REPLACE INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", (table, srs))
        marks = ", ".join("?" * (1 + len(names)))
        quoted = ", ".join(f'"{c}"' for c in names)
        for r in df.toLocalIterator():
            blob = geopackage_blob([(p["x"], p["y"]) for p in r[ring]], srs) if r[ring] else None
            db.execute(f'INSERT INTO "{table}" (geom, {quoted}) VALUES ({marks})', (blob, *(r[c] for c in names)))
            rows += 1
    return rows


def register(spark) -> None:
    setting = "spark.sql.python.filterPushdown.enabled"
    if spark.conf.get(setting, "false") != "true":
        spark.conf.set(setting, "true")
    spark.dataSource.register(GeoPackage)
