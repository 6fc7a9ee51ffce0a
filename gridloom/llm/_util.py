"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.lineage import cut, remove, scratch, shared_dir, stage  # noqa: F401  (used by the operators)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
FILTER_BITS = 1 << 26
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_texts(df: DataFrame, function: Callable, schema: str | object) -> DataFrame:
    """``df.mapInArrow`` in Arrow batches of about ``BATCH_BYTES``: the default counts rows alone, and ten thousand
    texts may be gigabytes. A session that has a bound of its own keeps it."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(setting, None) is None:
        df.sparkSession.conf.set(setting, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def id_filter(ids: DataFrame, bound: int = FILTER_BITS) -> Callable[..., Column]:
    """A Bloom filter over the rows of ``ids``, as a function from as many columns to a boolean column. It has at
    most ``bound`` bits: with more rows than a sixteenth of that it lets more through, and at last everything."""
    n, names = ids.count(), ids.columns
    bits = min(bound, 1 << max(10, (16 * n).bit_length()))

    def places(*columns: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(*columns, F.lit(j)), F.lit(bits)).cast("int") for j in range(4)]

    words = ids.select(F.explode(F.array(*places(*map(F.col, names)))).alias("at")).groupBy(F.shiftright("at", 6).cast("long").alias("word"))
    words = words.agg(F.bit_or(F.expr("shiftleft(1L, at & 63)")).alias("value"))
    dense = ids.sparkSession.range(bits // 64).join(words, F.col("id") == F.col("word"), "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("value", F.lit(0).cast("long")).alias("value"))))
    held = cut(dense.agg(F.transform(ordered, lambda w: w["value"]).alias("words"))).scalar()  # at most bound / 64 words

    def inside(*columns: Column) -> Column:
        at = places(*columns)
        found = [F.getbit(F.get(held, F.shiftright(a, 6)), a.bitwiseAND(63)) == 1 for a in at]
        return found[0] & found[1] & found[2] & found[3]

    return inside


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``rows`` whose values are not in ``gone``, whose columns ``rows`` has too. Only rows that pass the
    filter of ``gone`` are shuffled; the others are read and kept in place."""
    maybe = id_filter(gone)(*map(F.col, gone.columns))
    return rows.where(~maybe).unionAll(rows.where(maybe).join(gone, gone.columns, "left_anti").select(*rows.columns))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)
