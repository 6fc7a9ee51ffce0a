"""URL rules and an exact host list kept as a Bloom filter cascade.

A listed host covers itself and all its subdomains, as a rule's host does: the corpus hosts that a listed name
covers are found when the universe is built, and they are the listed keys.

Level 1 encodes the listed keys; level 2 the unlisted keys of the corpus that level 1 lets through; level 3 the
listed keys that level 2 lets through; and so on until no key of the universe is wrong. A key's verdict is the
parity of the first level that does not hold it. The universe is every host of the table, so the answer is
exact for every row, and rows are judged by a map with the packed filters, without a join.

Keys are dealt by hash into slices of about ``SLICE_KEYS`` keys; a grouped map builds every slice's cascade at once,
so that neither the driver nor a task holds more than one slice's keys. A slice's packed levels are broadcast on
their own (their size is bounded by SLICE_KEYS); where there is more than one slice, a task sorts its rows by slice
and holds one at a time. Lists of any size are judged this way.

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty host may be listed like
any other and covers only itself; repeated rows give repeated verdicts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._hashing import PRIME, mixed
from gridloom.llm._util import ascii_lower, cut

#: Rules as (host and path, verdict); the longest that fits wins.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: The default list of blocked hosts.
LISTED_HOSTS = ["spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org"]
SLICE_KEYS = 2_000_000


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


class Rules:
    """Rules by host. ``find`` tries those of a host and the domains above it, the longest first."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.of: dict[str, list[tuple[str, str, str]]] = {}
        for name, says in rules:
            own, slash, rest = name.partition("/")
            self.of.setdefault(own, []).append((name, slash + rest, says))

    def candidates(self, host: str) -> list[tuple[str, str, str]]:
        labels = host.split(".")
        found = [r for i in range(len(labels)) for r in self.of.get(".".join(labels[i:]), ()) if i == 0 or r[0].partition("/")[0]]
        return sorted(found, key=lambda r: (len(r[0]), r[0]), reverse=True)

    def find(self, hosts: pa.Array, paths: pa.Array) -> tuple[list[str | None], list[str | None]]:
        """The longest fitting rule of every row and its verdict; nulls where none fits."""
        coded = hosts.dictionary_encode()
        tried = [self.candidates(h) for h in coded.dictionary.to_pylist()]
        names, verdicts = [None] * len(hosts), [None] * len(hosts)
        codes = coded.indices.to_numpy()
        for i in np.flatnonzero(np.array([bool(t) for t in tried], bool)[codes]) if len(codes) else ():
            path = paths[i].as_py()
            for name, prefix, says in tried[codes[i]]:
                if path.startswith(prefix):
                    names[i], verdicts[i] = name, says
                    break
        return names, verdicts


def positions(one: np.ndarray, two: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """``k`` bit numbers of each key, different at every level."""
    salt = np.uint64((level + 1) * PRIME & (1 << 64) - 1)
    a, b = mixed(one ^ salt), mixed(two + salt) | np.uint64(1)
    return (a[:, None] + np.arange(k, dtype=np.uint64) * b[:, None]) % np.uint64(bits)


class Cascade:
    """Packed levels: (bits, hashes, bytes of the bitmap)."""

    def __init__(self):
        self.levels: list[tuple[int, int, np.ndarray]] = []

    def holds(self, level: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        bits, k, bitmap = self.levels[level]
        at = positions(one, two, level, k, bits)
        return ((bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)

    def listed(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(one), bool), np.arange(len(one))
        for level in range(len(self.levels)):
            inside = self.holds(level, one[left], two[left])
            out[left[~inside]] = level % 2 == 1
            left = left[inside]
        out[left] = len(self.levels) % 2 == 1
        return out


def unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def shape(level: int, listed: int, others: int) -> tuple[int, int]:
    """Bits and hashes of a level: the first lets through about listed/others of the rest, later ones half."""
    n = max(1, listed)
    if level:
        return max(64, math.ceil(1.4427 * n)), 1
    k = max(1, round(math.log2(max(2.0, others * math.sqrt(2) / n))))
    return max(64, math.ceil(1.4427 * k * n)), k


def cascade_of(one: np.ndarray, two: np.ndarray, listed: np.ndarray, max_levels: int = 200) -> Cascade:
    """The cascade over all keys of a slice."""
    cascade, left = Cascade(), np.arange(len(one))
    for level in range(max_levels):
        side = level % 2 == 0
        own, others = left[listed[left] == side], left[listed[left] != side]
        if level and not len(own):
            return cascade
        bits, k = shape(level, len(own), len(others))
        bitmap = np.zeros(-(-bits // 8), np.uint8)
        for at in range(0, len(own), 1 << 16):
            where = positions(one[own[at : at + (1 << 16)]], two[own[at : at + (1 << 16)]], level, k, bits).ravel()
            np.bitwise_or.at(bitmap, (where >> np.uint64(3)).astype(np.int64), np.uint8(1) << (where & np.uint64(7)).astype(np.uint8))
        cascade.levels.append((bits, k, bitmap))
        left = left[cascade.holds(level, one[left], two[left])]
    raise RuntimeError("listed and unlisted keys share their hashes")


def build(keys: DataFrame, slice_keys: int = SLICE_KEYS) -> list[Broadcast]:
    """The cascades over ``keys (one long, two long, listed boolean)``, one row per key: a broadcast of packed levels
    per slice. Slices are built by a grouped map and staged; the driver passes them on one by one."""
    slices = max(1, -(-keys.count() // slice_keys))

    def packed(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks()
        made = cascade_of(unsigned(batch["one"].combine_chunks()), unsigned(batch["two"].combine_chunks()), batch["listed"].to_numpy())
        return pa.table({"slice": batch["slice"][:1], "levels": pa.array([pickle.dumps(made.levels)], pa.binary())})

    rows = keys.withColumn("slice", F.pmod("one", F.lit(slices)).cast("int")).groupBy("slice").applyInArrow(packed, "slice int, levels binary")
    out = [None] * slices
    for row in cut(rows).toLocalIterator():
        cascade = Cascade()
        cascade.levels = pickle.loads(row.levels)
        out[row.slice] = keys.sparkSession.sparkContext.broadcast(cascade)
    empty = keys.sparkSession.sparkContext.broadcast(Cascade())
    return [shared or empty for shared in out]


def covered(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """Per row of ``hosts (host)``: ``host, listed``, true where the host or a domain above it is in ``listed (host)``.
    Only as many last labels are looked up as the deepest listed name has."""
    labels = F.split("host", "[.]")
    depth = listed.agg(F.max(F.size(labels))).first()[0] or 1
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(depth))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    ended = hosts.select("host", F.explode(ends).alias("end"))
    ended = ended.withColumn("end", F.when((F.col("end") != "") | (F.col("host") == ""), F.col("end")))  # "a." is not under ""
    found = ended.join(listed.select(F.col("host").alias("end"), F.lit(True).alias("listed")), "end", "left")
    return found.groupBy("host").agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))


def judge(pages: DataFrame, listed: DataFrame, page_id: str = "page_id", url: str = "url", rules: list[tuple[str, str]] | None = None, slice_keys: int = SLICE_KEYS) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict``. ``listed`` has one column, ``host``;
    a listed host covers its subdomains. ``rules`` are few enough for the caller's list, and go along as one."""
    parts = pages.select(F.col(page_id).alias("page_id"), host_of(pages[url]).alias("host"), path_of(pages[url]).alias("path"))
    listed = listed.select("host").where("host IS NOT NULL").distinct()
    hashes = {"one": F.xxhash64("host"), "two": F.xxhash64("host", F.lit("two"))}
    keys = cut(covered(parts.select("host").distinct(), listed).withColumns(hashes).select("one", "two", "listed"))
    shared, known = build(keys, slice_keys), Rules(RULES if rules is None else rules)
    rows = parts.withColumns(hashes).withColumn("slice", F.pmod("one", F.lit(len(shared))).cast("int"))
    if len(shared) > 1:
        rows = rows.sortWithinPartitions("slice")
    kind = parts.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, own = None, None
        for batch in batches:
            one, two, where = unsigned(batch.column(3)), unsigned(batch.column(4)), batch.column(5).to_numpy()
            hit = np.zeros(len(one), bool)
            for at in np.unique(where):
                if at != held:
                    held, own = at, loaded(shared[at])
                hit[where == at] = own.listed(one[where == at], two[where == at])
            names, says = known.find(batch.column(1), batch.column(2))
            verdicts = [v or ("block" if h else "allow") for v, h in zip(says, hit, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(names, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.select("page_id", "host", "path", "one", "two", "slice").mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def loaded(shared: Broadcast) -> Cascade:
    """A broadcast's value; one that lies in the worker's file is not kept beside it."""
    value = shared.value
    if getattr(shared, "_path", None) is not None:
        shared.__dict__.pop("_value", None)
    return value
