"""Exact deduplication with streaming state.

A narrow key table (content locator, doc_id, digest of the normalised text) is staged in the shared folder and
streamed through a keyed aggregation whose state lives in RocksDB, has no expiry and holds, per digest, the group's
size and the stable identifier and locator of the row that stays. The state is read back with the state data source.

A locator is the file and the row in it, so it names the same content in every read; a table that is not read
straight from Parquet files is staged first. On hits, that is for digests with more than one row, the full texts
are fetched by locator and their bytes compared; digests whose texts differ get the whole text as part of their key
and are streamed again. Only hits are shuffled with their texts: a Bloom filter of their locators, of at most
``FILTER_BITS`` bits, lets the other rows stay where they are (beyond some four million hits it lets more through).

Built-in DataFrame functions only. Hot groups: both aggregations combine on the map side, and the join of keys
with state has one state row per digest, so adaptive execution may split a hot digest. An executor has only the
state stores of its running tasks open, whose memory is bounded by ``STATE_MB``.

Defined cases: a null text counts as empty; a null doc_id is the smallest; of repeated rows with one doc_id and
text one stays (the later locator); an empty table gives no rows; extra columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._util import ascii_lower, cut, id_filter, scratch, stage, without

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_MB = 256
KEY, FILE, ROW, DOC = "__gl_key", "__gl_file", "__gl_row", "__gl_doc"


def normalised(text: Column) -> Column:
    return F.coalesce(ascii_lower(text), F.lit(""))


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(F.encode(norm, "UTF-8"), 256))


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the locator of every row."""
    plan = docs._jdf.queryExecution().analyzed().toString().strip()
    if not re.fullmatch(r"Relation \[[^\n]*\] parquet", plan):
        docs = stage(docs, "dedup-docs")
    return docs.select("*", F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def group_state(path: str, kind: str, like: DataFrame) -> DataFrame:
    """Staged keys streamed through the state; then the state: one row per key with size, doc_id and locator."""
    spark = like.sparkSession
    own = spark.newSession()  # the provider is set for this query alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")  # small stores take what they hold
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", str(STATE_MB))
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "8")
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    own.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")  # an executor holds the stores of its running tasks alone
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    at = scratch(spark, "dedup-state")
    stream = own.readStream.schema(f"{FILE} string, {ROW} long, {DOC} {kind}, {KEY} binary").parquet(path)
    groups = stream.groupBy(KEY).agg(F.max(F.struct(DOC, FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("size"))
    query = groups.writeStream.outputMode("update").format("noop").option("checkpointLocation", at).trigger(availableNow=True).start()
    query.awaitTermination()
    state = spark.read.format("statestore").load(at)
    return state.select(F.col(f"key.{KEY}").alias("__gl_group"), F.col("value.max").alias("keep"), F.col("value.count").alias("group_size"))


def grouped(keys: DataFrame) -> DataFrame:
    """Per row of ``keys``: its locator, doc_id and key, its group's size, the doc_id that stays, and whether it does."""
    path = scratch(keys.sparkSession, "dedup-keys")
    keys.select(FILE, ROW, DOC, KEY).write.parquet(path)
    state = group_state(path, keys.schema[DOC].dataType.simpleString(), keys)
    joined = keys.sparkSession.read.schema(keys.schema).parquet(path).join(state, F.col(KEY) == F.col("__gl_group"))
    stays = (F.col(FILE) == F.col(f"keep.{FILE}")) & (F.col(ROW) == F.col(f"keep.{ROW}"))
    return cut(joined.select(FILE, ROW, DOC, KEY, "group_size", F.col(f"keep.{DOC}").alias("keep_id"), stays.alias("kept")))


def fetched(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with the normalised texts at their locators."""
    near = docs.where(id_filter(rows.select(FILE, ROW))(F.col(FILE), F.col(ROW))).select(FILE, ROW, normalised(docs[text]).alias("norm"))
    return rows.join(near, [FILE, ROW])


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> tuple[DataFrame, DataFrame]:
    """``docs`` with locators, and their groups, compared byte by byte."""
    docs = located(docs)
    joined = grouped(docs.select(FILE, ROW, F.col(doc_id).alias(DOC), digest(normalised(docs[text])).alias(KEY)))
    hits = joined.where("group_size > 1").select(FILE, ROW, KEY)
    clash = fetched(docs, hits, text).groupBy(KEY).agg((F.min("norm") != F.max("norm")).alias("differ"))
    clash = cut(clash.where("differ").select(KEY))
    if not clash.isEmpty():
        apart = fetched(docs, joined.join(clash, KEY, "left_semi").select(FILE, ROW, DOC, KEY), text)
        apart = apart.select(FILE, ROW, DOC, F.concat(KEY, F.encode("norm", "UTF-8")).alias(KEY))
        joined = grouped(joined.join(clash, KEY, "left_anti").select(FILE, ROW, DOC, KEY).unionByName(apart))
    return docs, joined


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Per row: ``doc_id, keep_id, group_size, kept, digest`` (the digest alone, without a colliding text)."""
    _, joined = groups(docs, doc_id, text, digest)
    return joined.select(F.col(DOC).alias("doc_id"), "keep_id", "group_size", "kept", F.substring(KEY, 1, 32).alias("digest"))


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found, joined = groups(docs, doc_id, text, digest)
    return without(found, joined.where("NOT kept").select(FILE, ROW)).drop(FILE, ROW)
