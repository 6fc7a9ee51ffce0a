"""Shards along a Hilbert curve over metadata.

Every metadata dimension is quantised to ``bits`` bits by cut points that keep its order: a categorical dimension by
the rank of its distinct values, a size by its quantiles. Cells are spread over the whole axis, so that the first
splits of the curve divide every dimension, however few values it has. Rows are put in the order of their index on
the Hilbert curve through that grid and the order is cut into equal runs. A shard then covers a compact region with a
short range of values in several dimensions, and the minima and maxima of its files prune filters on any of them.

Built-in DataFrame functions only. Texts are read once, into narrow rows that are checkpointed; cut points (at most
2**bits a dimension reach the driver) and ranges come from these. The order is a range partitioning on (index, text
hash, doc_id, locator), so that a crowded cell is spread; a row's place is its place in its partition plus the rows
of the partitions before. Law ``rows``: counts of shards differ by one at most.

Defined cases: a null text has size 1 and the checksum of no bytes; null metadata comes before all values; equal
texts with equal metadata are neighbours; repeated rows take one place each; an empty table gives no rows;
extra columns may have any name and are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._util import cut


def part_offsets(sizes: DataFrame) -> DataFrame:
    """Per row of ``sizes (part, own)``, a row per partition: the sum of the parts before and of all."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("offset"), F.sum("own").over(Window.partitionBy()).alias("total"))


def cut_points(rows: DataFrame, dimension: str, bits: int, weighted: bool) -> list:
    """The least value of every cell but the first, in order: cells of equally many distinct values, or of equally
    many rows (``weighted``)."""
    values = rows.where(F.col(dimension).isNotNull()).groupBy(F.col(dimension).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    values = values.select("value", F.col("n") if weighted else F.lit(1).cast("long").alias("n"))
    ordered = values.repartitionByRange("value").sortWithinPartitions("value").select("value", "n", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    ordered = cut(ordered)
    totals = part_offsets(ordered.groupBy("part").agg(F.sum("n").alias("own")))
    earlier = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(F.broadcast(totals), "part").select("value", "total", (F.col("offset") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("before"))
    cells = placed.groupBy(F.expr(f"before * {1 << bits} DIV total").alias("cell")).agg(F.min("value").alias("least"))
    return [(r.cell, r.least) for r in sorted(cells.collect()) if r.cell]  # at most 2**bits


def cell_of(column: Column, points: list) -> Column:
    """The cell of a value; nulls are in cell 0."""
    cell = F.lit(0)
    for number, least in points:
        cell = F.when(column >= F.lit(least), F.lit(number)).otherwise(cell)
    return cell.cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index of a cell on the Hilbert curve through a grid of 2**bits per axis (transposed-axes method)."""
    n, zero = len(axes), F.lit(0)
    steps = F.array(*(F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)))

    def undo(x: Column, s: Column) -> Column:
        low, own = s["q"] - 1, F.get(x, s["i"])
        swap = F.get(x, zero).bitwiseXOR(own).bitwiseAND(low)
        inverted = F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(low)).otherwise(v))
        swapped = F.transform(x, lambda v, j: F.when((j == 0) | (j == s["i"]), v.bitwiseXOR(swap)).otherwise(v))
        return F.when(own.bitwiseAND(s["q"]) != 0, inverted).otherwise(F.when(s["i"] == 0, x).otherwise(swapped))

    def grayed(x: Column) -> Column:
        return F.aggregate(x, F.array().cast("array<int>"), lambda done, v: F.concat(done, F.array(F.when(F.size(done) > 0, v.bitwiseXOR(F.element_at(done, -1))).otherwise(v))))

    def twist(gray: Column) -> Column:
        flips = F.array(*(F.lit(1 << b) for b in range(bits - 1, 0, -1))) if bits > 1 else F.array().cast("array<int>")
        return F.aggregate(flips, zero, lambda t, q: F.when(F.element_at(gray, -1).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

    def interleaved(cell: Column) -> Column:
        order = F.array(*(F.lit(b) for b in range(bits - 1, -1, -1)))
        return F.aggregate(order, F.lit(0).cast("long"), lambda index, b: F.aggregate(cell, index, lambda i, v: i * 2 + F.getbit(v, b).cast("long")))

    undone = F.aggregate(steps, F.array(*axes), undo) if bits > 1 else F.array(*axes)
    turned = bound(grayed(undone), lambda gray: bound(twist(gray), lambda t: F.transform(gray, lambda v: v.bitwiseXOR(t))))
    return bound(turned, interleaved)


def places(docs: DataFrame, doc_id: str, text: str, dimensions: tuple[str, ...], bits: int) -> DataFrame:
    """Every row's place (from 0) in the curve's order, and the ``total`` of rows."""
    body = F.coalesce(F.col(text), F.lit(""))
    named = [d for d in dimensions if d in docs.columns]
    narrow = cut(docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.struct(*(F.col(d).alias(f"d{i}") for i, d in enumerate(named)), F.lit(0).alias("none")).alias("dims"),
        F.monotonically_increasing_id().alias("locator"),
    ))
    axes = [*(cell_of(F.col(f"dims.d{i}"), cut_points(narrow, f"dims.d{i}", bits, False)) for i in range(len(named))), cell_of(F.col("size"), cut_points(narrow, "size", bits, True))]
    narrow = cut(narrow.withColumn("curve", hilbert_index(axes, bits)).drop("dims"))  # sampling for the ranges reads these rows
    order = ["curve", "text_crc32", "doc_id", "locator"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ordered.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    offsets = part_offsets(rows.groupBy("part").agg(F.count(F.lit(1)).alias("own")))
    placed = rows.join(F.broadcast(offsets), "part")  # as many rows as partitions
    return placed.withColumn("place", F.col("row").bitwiseAND((1 << 33) - 1) + F.col("offset"))


def assign(docs: DataFrame, shards: int = 8, doc_id: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("lang", "source"), bits: int = 5) -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, curve, law, shard, slot, grown_shard``."""
    placed = places(docs, doc_id, text, dimensions, bits)
    return placed.select("doc_id", "size", "text_crc32", "curve", F.lit("rows").alias("law"), "place", F.col("total").alias("n")).select(
        "doc_id",
        "size",
        "text_crc32",
        "curve",
        "law",
        F.expr(f"CAST(place * {shards} DIV n AS int)").alias("shard"),
        F.expr(f"place - (((place * {shards} DIV n) * n + {shards - 1}) DIV {shards})").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
