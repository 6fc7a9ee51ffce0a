"""Running totals, ranks and quantiles over orders that may be larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.lineage import cut


def matched(left: list[str], right: list[str]) -> Column:
    """Equality of columns in which NULL equals NULL."""
    on = F.lit(True)
    for a, b in zip(left, right, strict=True):
        on &= F.col(a).eqNullSafe(F.col(b))
    return on


def running_sum(df: DataFrame, order: list[Column | str], amount: Column | str, by: list[str] | None = None, name: str = "before", total: str | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows that precede a row within ``by``, and with the whole sum as
    ``total`` if asked for. Rows are range-partitioned by (by, order); each partition sums its own rows, and totals
    of partitions before it are added."""
    by = by or []
    ordered = df.withColumn("__amount", F.col(amount) if isinstance(amount, str) else amount).repartitionByRange(*by, *order)
    tagged = cut(ordered.withColumn("__part", F.spark_partition_id()))
    keys = [*by, "__part"]
    mine = Window.partitionBy(*by)
    earlier = mine.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = tagged.groupBy(*keys).agg(F.sum("__amount").alias("__total"))  # a row per partition and key
    whole = [F.sum("__total").over(mine).alias(total)] if total else []
    offsets = totals.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)), F.coalesce(F.sum("__total").over(earlier), F.lit(0)).alias("__offset"), *whole)
    on = (F.col("__part") == F.col(f"__k{len(by)}")) & matched(by, [f"__k{i}" for i in range(len(by))])
    joined = tagged.join(offsets, on).drop(*(f"__k{i}" for i in range(len(keys))))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(name, F.coalesce(F.sum("__amount").over(inside), F.lit(0)) + F.col("__offset")).drop("__amount", "__part", "__offset")


def placed(df: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """``df`` with each row's place in the order, from 0: its place in its range partition plus the rows before."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    tagged = cut(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted((r["__part"], r["n"]) for r in tagged.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # a row per partition
    starts, total = [], 0
    for part, n in counts:
        starts.append((part, total))
        total += n
    before = df.sparkSession.createDataFrame(starts, "__part int, __before long")
    return tagged.join(F.broadcast(before), "__part").withColumn(name, F.col("__row") + F.col("__before")).drop("__part", "__row", "__before")


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, descending: bool = False, name: str = "avg_rank") -> DataFrame:
    """Ranks from 1 with ties averaged, among non-NULL values; only distinct values are ordered."""
    by = by or []
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("__ties"))
    order = F.desc(value) if descending else F.asc(value)
    placed = running_sum(sizes, [order], "__ties", by, "__before")
    ranks = placed.select(*(F.col(c).alias(f"__{c}") for c in [*by, value]), (F.col("__before") + (F.col("__ties") + 1) / 2).alias(name), "__ties")
    on = (F.col(value) == F.col(f"__{value}")) & matched(by, [f"__{c}" for c in by])
    return df.join(ranks, on, "left").drop("__ties", *(f"__{c}" for c in [*by, value]))


def exact_quantiles(df: DataFrame, value: str, at: tuple[float, ...], by: list[str] | None = None, name: str = "q") -> DataFrame:
    """Per group with a non-NULL value: its exact quantiles, linearly interpolated, as an array. Quantiles are picked
    by rank from the ordered distinct values, so that no task holds a group's values."""
    by = by or []
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__value")).agg(F.count(F.lit(1)).alias("__ties"))
    ranked = running_sum(sizes, ["__value"], "__ties", by, "__before", "__n")
    wanted = F.array(*(F.struct(F.lit(i).alias("i"), (F.lit(float(q)) * (F.col("__n") - 1)).alias("place")) for i, q in enumerate(at)))
    first, last = F.col("__before"), F.col("__before") + F.col("__ties") - 1
    mine = F.filter(wanted, lambda w: (F.floor(w["place"]).between(first, last)) | (F.ceil(w["place"]).between(first, last)))
    hits = ranked.select(*by, "__value", first.alias("first"), last.alias("last"), F.explode(mine).alias("w"))
    low = F.max(F.when(F.floor("w.place").between(F.col("first"), F.col("last")), F.col("__value")))
    high = F.max(F.when(F.ceil("w.place").between(F.col("first"), F.col("last")), F.col("__value")))
    share = F.max(F.col("w.place") - F.floor("w.place"))
    each = hits.groupBy(*by, F.col("w.i").alias("__i")).agg((low + (high - low) * share).alias("__q"))
    out = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__i", "__q"))).alias("__qs"))  # a value per quantile
    return out.select(*by, F.transform("__qs", lambda s: s["__q"]).alias(name))
