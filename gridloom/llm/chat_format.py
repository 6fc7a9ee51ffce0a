"""Chat formatting with cumulative-snapshot collapse.

Chats are often logged after every turn, so that many conversations are prefixes of longer ones. Every turn gets
a rolling hash of all turns up to it: the XOR of two 64-bit hashes of (position, role, text) over the prefix,
with its length. A conversation whose whole hash is the hash of a proper prefix of another one, or of a
conversation with a smaller id, is dropped; the maximal ones are rendered.

Built-in DataFrame functions only. One order, (turn, role, text), numbers the positions for hashing and for
rendering. It needs the texts only of turns that tie in number and role; these are put in order apart, everything
else moves as hashes. Positions and rolling hashes come from a range-partitioned order, whose partitions are joined
by per-partition totals, so that one very long conversation is spread over partitions. Prefix hashes are made
distinct before the anti-join, so that a common first turn is one row. Rendering goes by runs of ``segment_turns``
positions; texts move once to their positions and once to their segments.

Defined cases: rows without a conversation id belong to none and are left out; a null role or text is empty; a
null turn comes first; equal turn numbers are ordered by role, then text; repeated rows are repeated turns; an empty
table gives no rows; extra columns may have any name and are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._util import cut

OPEN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
#: What makes two turns of a conversation the same.
TURN = ["conv_id", "timed", "turn", "role", "a", "b"]


def tie_order(turns: DataFrame) -> DataFrame:
    """For turns with different texts under one number and role: ``conv_id, timed, turn, role, a, b, tie``, where
    ``tie`` grows with the text."""
    at = ["conv_id", "timed", "turn", "role"]
    ends = turns.groupBy(*at).agg(*(f(c).alias(f"{c}{i}") for c in "ab" for i, f in enumerate((F.min, F.max))))
    tied = cut(ends.where("a0 <> a1 OR b0 <> b1").select(*at))
    if tied.isEmpty():
        return turns.select(*TURN, F.lit(0).cast("long").alias("tie")).limit(0)
    texts = turns.join(tied, at, "left_semi").groupBy(*TURN).agg(F.first("text").alias("text"))
    order = [*at, "text"]
    return cut(texts.repartitionByRange(*order).sortWithinPartitions(*order).select(*TURN, F.monotonically_increasing_id().alias("tie")))


def positions(turns: DataFrame) -> DataFrame:
    """Per turn: its identity, its position ``n`` from 1 and the conversation's ``total``, with the run (part, conv_id)
    of the sorted rows that it is in and its ``row`` there."""
    narrow = turns.select(*TURN).join(tie_order(turns), TURN, "left").withColumn("tie", F.coalesce("tie", F.lit(0)))
    order = ["conv_id", "timed", "turn", "role", "tie"]
    ordered = narrow.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = cut(ordered.select(*TURN, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")))
    by_conv, before = Window.partitionBy("conv_id"), Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("part", "conv_id").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("own"))
    runs = runs.select("part", "conv_id", "first", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"), F.sum("own").over(by_conv).alias("total"))
    return rows.join(runs, ["part", "conv_id"]).withColumn("n", F.col("row") - F.col("first") + F.col("earlier") + 1).drop("first", "earlier")


def prefixes(placed: DataFrame) -> DataFrame:
    """Per turn of ``placed``: ``conv_id, n, total, one, two``, the rolling hash of the turns up to it."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.select("part", "conv_id", "row", "n", "total", F.xxhash64("n", "a").alias("a"), F.xxhash64("n", "b").alias("b"))
    upto = Window.partitionBy("part", "conv_id").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    rolled = own.select("part", "conv_id", "n", "total", F.bit_xor("a").over(upto).alias("a"), F.bit_xor("b").over(upto).alias("b"))
    sums = own.groupBy("part", "conv_id").agg(F.bit_xor("a").alias("xa"), F.bit_xor("b").alias("xb"))
    sums = sums.select("part", "conv_id", F.coalesce(F.bit_xor("xa").over(before), F.lit(0)).alias("xa"), F.coalesce(F.bit_xor("xb").over(before), F.lit(0)).alias("xb"))
    return rolled.join(sums, ["part", "conv_id"]).select("conv_id", "n", "total", F.col("a").bitwiseXOR(F.col("xa")).alias("one"), F.col("b").bitwiseXOR(F.col("xb")).alias("two"))


def maximal(placed: DataFrame) -> DataFrame:
    """Ids of the conversations that are no prefix of another; of equal ones the smallest id."""
    rolled = cut(prefixes(placed))
    whole = rolled.where("n = total").groupBy("one", "two", "n").agg(F.min("conv_id").alias("conv_id"))
    proper = rolled.where("n < total").select("one", "two", "n").distinct()
    return whole.join(proper, ["one", "two", "n"], "left_anti").select("conv_id")


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(END))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment_turns: int = 512) -> DataFrame:
    """Rendered maximal conversations: ``conv_id, segment, n_turns, text``; a segment is a run of positions."""
    kind = conversations.schema[turn].dataType
    turns = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).isNotNull().alias("timed"),
        F.coalesce(F.col(turn), F.lit(0).cast(kind)).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    turns = turns.withColumns({"a": F.xxhash64("role", "text"), "b": F.xxhash64("text", "role", F.lit(1))})
    placed = cut(positions(turns))
    kept = cut(maximal(placed))
    places = placed.join(kept, "conv_id", "left_semi").groupBy(*TURN).agg(F.min("n").alias("at"), F.count(F.lit(1)).alias("times"))
    texts = turns.groupBy(*TURN).agg(F.first("text").alias("text")).join(places, TURN)
    size = F.lit(segment_turns).cast("long")
    first, last = F.expr(f"(at - 1) DIV {segment_turns}"), F.expr(f"(at + times - 2) DIV {segment_turns}")
    spread = texts.select("conv_id", "role", "text", "at", "times", F.explode(F.sequence(first, last)).alias("segment"))
    begin, end = F.greatest("at", F.col("segment") * size + 1), F.least(F.col("at") + F.col("times") - 1, (F.col("segment") + 1) * size)
    own = spread.select("conv_id", "segment", F.struct(begin.alias("at"), (end - begin + 1).cast("int").alias("times"), "role", "text").alias("own"))
    runs = own.groupBy("conv_id", "segment").agg(F.sum("own.times").alias("n_turns"), F.array_sort(F.collect_list("own")).alias("turns"))
    return runs.select("conv_id", "segment", "n_turns", F.array_join(F.transform("turns", lambda t: F.repeat(rendered(t), t["times"])), "").alias("text"))
