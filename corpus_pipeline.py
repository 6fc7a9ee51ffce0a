"""The training-corpus pipeline: language, exact copies, near copies, benchmark passages, packed sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept; all but the last
return the columns of documents.

Defined cases of all stages: an empty table gives no rows; columns beyond doc_id and text are carried along, whatever
their names; texts are taken whole, however long. What a stage does with nulls, empty texts, ties and repeated rows is
said with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from gridloom.llm._util import remove, scratch, table
from gridloom.llm.queries import vocabulary


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected (``und``) go: null and empty texts, and texts without a letter. The
    classifier names a language for every other text, however unsure, so all of these stay. Null ids stay; repeated
    rows are judged alike."""
    return language_id.accepted(docs, language_id.fit(docs))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z as a-z, null as empty) the document with the largest id stays; a null id is the smallest; of
    rows that tie, the one with the later locator."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate group (five-word shingles, similarity 0.8 or more) the smallest id stays. Null texts, texts
    without words and null ids are linked with nothing and stay; rows that repeat an id are one document."""
    return near_dedup.keep_one(docs, k=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts hold none and stay; items with a null
    id or text, or without words, count for nothing; repeated rows are judged alike."""
    return decontamination.remove(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, as pieces of documents. A null or empty text is its end id alone; null ids stay
    null; repeated rows are packed as often as they occur."""
    return packing.pack(docs, vocabulary(), vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", recognised),
    ("exact_dedup", without_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: SQL can't express the language classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's table is deleted once the next one is written; the last one is read by the
    result."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, apply in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        apply(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
