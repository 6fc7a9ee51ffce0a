"""Benchmark decontamination by a prefix-filtered set join.

Every item is cut into windows of ``window`` words (an item of fewer words is one window) and every window into
shingles of up to ``SHINGLE`` words. Shingles are ordered by rarity, counted over all documents. A document run
contains a window exactly only if it contains every shingle of it, so one necessary prefix token is enough: the
window's rarest shingle. Documents are looked up by those tokens alone; a candidate must fit by length and
position (the window has to start and end inside the document) and is then compared word by word.

The benchmark is the stated query set: repeated items are taken once, long items are cut into overlapping pieces, and
blocks of about ``block_bytes`` of pieces are held, one at a time on the driver and in a broadcast, whatever the
benchmark's size. Each block takes two maps over the documents, one
that counts shingles and one that finds windows, and no shuffle of documents; the hits of more than one block are
staged before the next block is read, and its broadcast is destroyed.

Defined cases: null texts have no words; null item ids are ignored with their items; items without words never
occur; repeated items count once per item id; repeated documents give repeated rows; empty tables give no hits
or no rows; extra columns may have any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._hashing import mixed
from gridloom.llm._util import LOWER, UPPER, cut, map_texts, stage, without

#: Fixed value: words after lower-casing A-Z, as bytes of UTF-8 (every byte of a non-ASCII character is >= 0x80).
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SHINGLE = 3
BLOCK_BYTES = 8_000_000


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode().lower()) if text else []


class Index:
    """Windows of one block of items. ``arm`` picks each window's prefix token once shingles are counted."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        numbers: dict[tuple, int] = {}
        owners: dict[int, set] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                owners[numbers.setdefault(tuple(ids[at : at + window]), len(numbers))].add(str(item))
        self.base = len(self.vocabulary) + 1
        self.length = np.array([len(w) for w in numbers], np.int64)
        self.windows = np.full((len(numbers), window), -1, np.int64)
        for row, w in enumerate(numbers):
            self.windows[row, : len(w)] = w
        self.owners = [sorted(owners[i]) for i in range(len(numbers))]
        spread = [self.keys(np.array(w), min(SHINGLE, len(w))) for w in numbers]
        self.widths = sorted({min(SHINGLE, len(w)) for w in numbers})
        self.shingles = {k: np.unique(np.concatenate([s for s, n in zip(spread, self.length, strict=True) if min(SHINGLE, n) == k])) for k in self.widths}
        self.spread = spread

    def keys(self, ids: np.ndarray, k: int) -> np.ndarray:
        """One key per position for the ``k`` words from there; -1 if one is not a word of the block. With so many words
        that their numbers do not fit side by side, keys are hashes: two shingles may then share a key, which adds
        candidates, and these are compared word by word as all are."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key, known = ids[:n].copy(), ids[:n] >= 0
        wide = self.base >= 1 << 21
        for j in range(1, k):
            if wide:
                key = (mixed(key.view(np.uint64)) >> np.uint64(1)).view(np.int64) ^ ids[j : j + n]
            else:
                key = key * self.base + ids[j : j + n]
            known &= ids[j : j + n] >= 0
        return np.where(known, key, -1)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def found(self, ids: np.ndarray, k: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of ``ids`` whose key is in the sorted ``table``, and the places there."""
        key = self.keys(ids, k)
        here = np.flatnonzero(key >= 0)
        at = np.minimum(np.searchsorted(table, key[here]), len(table) - 1)
        same = table[at] == key[here]
        return here[same], at[same]

    def arm(self, counts: dict[int, np.ndarray]) -> Index:
        """Order shingles by their counts over the documents and keep each window's rarest as its prefix token."""
        rows = defaultdict(list)
        for w, keys in enumerate(self.spread):
            k = min(SHINGLE, int(self.length[w]))
            seen = counts[k][np.searchsorted(self.shingles[k], keys)]
            first = min(range(len(keys)), key=lambda i: (seen[i], keys[i]))
            rows[k].append((int(keys[first]), w, first))
        self.prefix = {}
        for k, got in rows.items():
            got.sort()
            key, w, offset = (np.array(x, np.int64) for x in zip(*got, strict=True))
            table, begins = np.unique(key, return_index=True)
            self.prefix[k] = (table, begins, np.diff(np.r_[begins, len(key)]), w, offset)
        del self.spread, self.shingles
        return self

    def hits(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and window numbers of all exact occurrences."""
        starts, numbers = [], []
        for k, (table, begins, sizes, w, offset) in self.prefix.items():
            where, at = self.found(ids, k, table)
            if not len(where):
                continue
            n = sizes[at]
            row = np.repeat(begins[at], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start, number = np.repeat(where, n) - offset[row], w[row]
            fits = (start >= 0) & (start + self.length[number] <= len(ids))
            start, number = start[fits], number[fits]
            for j in range(self.windows.shape[1]):
                word = self.windows[number, j]
                same = (word < 0) | (word == ids[np.minimum(start + j, len(ids) - 1)])
                start, number = start[same], number[same]
            starts.append(start)
            numbers.append(number)
        return (np.concatenate(starts), np.concatenate(numbers)) if starts else (np.zeros(0, np.int64),) * 2

    def judge(self, text: str | None) -> tuple[int, int, list[dict], list[str]]:
        """Words, words hit, hit spans and items of a whole text."""
        words = words_of(text)
        if not words or not len(self.length):
            return len(words), 0, [], []
        start, number = self.hits(self.ids(words))
        if not len(start):
            return len(words), 0, [], []
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start, 1)
        np.add.at(depth, start + self.length[number], -1)
        edge = np.diff(np.r_[0, (np.cumsum(depth) > 0).astype(np.int8)])
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        items = sorted({i for n in np.unique(number) for i in self.owners[n]})
        return len(words), int((end - begin).sum()), [{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)], items


def pieces(benchmark: DataFrame, item_id: str, text: str, window: int, size: int) -> DataFrame:
    """``item, text``, distinct: items in pieces of about ``size`` windows, which overlap by a window less a word, so that
    every window of an item is one of a piece; items of fewer words are one piece, items without words none."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), SEPARATORS, -1), lambda w: w != "")
    rows = benchmark.select(F.col(item_id).alias("item"), words.alias("w")).where("item IS NOT NULL AND size(w) > 0").distinct()
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(size))
    return rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.array_join(F.slice("w", F.col("at") + 1, size + window - 1), " ").alias("text")).distinct()


def blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_bytes: int) -> tuple[int, Iterator[list[tuple]]]:
    """The number of runs of about ``block_bytes`` of text, and the pieces of each; one run at a time is on the driver."""
    items = cut(pieces(benchmark, item_id, text, window, max(1, block_bytes // 80)))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    return n, ([(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == b).toLocalIterator()] for b in range(n))


def counted(docs: DataFrame, text: str, index: Index) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sums = {k: np.zeros(len(own.shingles[k]), np.int64) for k in own.widths}
        for batch in batches:
            for t in batch.column(0):
                ids = own.ids(words_of(t.as_py()))
                for k in own.widths:
                    np.add.at(sums[k], own.found(ids, k, own.shingles[k])[1], 1)
        for k, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["k", "at", "n"])

    totals = {k: np.zeros(len(index.shingles[k]), np.int64) for k in index.widths}
    rows = map_texts(docs.select(F.col(text).alias("text")), count, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most one row per shingle of the block
    k, at, n = (got[c].to_numpy() for c in ("k", "at", "n"))
    for width in totals:
        totals[width][at[k == width]] = n[k == width]
    return totals


def armed(docs: DataFrame, text: str, items: list[tuple], window: int):
    index = Index(items, window)
    return docs.sparkSession.sparkContext.broadcast(index.arm(counted(docs, text, index) if index.widths else {}))


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def judged(docs: DataFrame, text: str, shared, hits_only: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            got = [own.judge(t.as_py()) for t in batch.column(2)]
            made = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), SPANS, pa.list_(pa.string()))))],
                ["doc_id", "same", "n_words", "n_hit", "hit_spans", "items"],
            )
            yield made.filter(pa.array([g[1] > 0 for g in got], pa.bool_())) if hits_only else made

    return map_texts(docs.select("doc_id", "same", text), judge, f"doc_id {kind}, same long, n_words long, n_hit long, hit_spans array<struct<begin:long,end:long>>, items array<string>")


def find(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, hit_spans`` (in words) and ``items`` (sorted ids as strings)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("same"))
    n, runs = blocks(benchmark, item_id, item_text, window, block_bytes)
    if n == 1:
        return judged(docs, "text", armed(docs, "text", next(runs), window), False).drop("same")
    base, more = None, None
    for items in runs:
        shared = armed(docs, "text", items, window)
        part = stage(judged(docs, "text", shared, base is not None), "hits")
        shared.destroy()
        if base is None:
            base = part
        else:
            more = part if more is None else more.unionByName(part)
    extra = more.groupBy("doc_id", "same").agg(F.flatten(F.collect_set("hit_spans")).alias("more_spans"), F.flatten(F.collect_set("items")).alias("more_items"))
    both = base.alias("a").join(extra.alias("b"), F.expr("a.doc_id <=> b.doc_id AND a.same = b.same"), "left")
    merged = F.aggregate(
        F.array_sort(F.concat("hit_spans", F.coalesce("more_spans", F.array()))),
        F.expr("CAST(array() AS array<struct<begin:bigint,end:bigint>>)"),
        lambda done, s: F.when((F.size(done) > 0) & (s["begin"] <= F.element_at(done, -1)["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["begin"].alias("begin"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(done, F.array(s))),
    )
    spans = both.select("a.doc_id", "n_words", merged.alias("hit_spans"), F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.array())))).alias("items"))
    return spans.select("doc_id", "n_words", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"]).alias("n_hit"), "hit_spans", "items")


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns. With one block a map; with more, texts
    with hits are staged as hashes, block by block, and their rows are taken out."""
    n, runs = blocks(benchmark, item_id, item_text, window, block_bytes)
    if n > 1:
        marks = {"__gl_one": F.xxhash64(text), "__gl_two": F.xxhash64(text, F.lit(1))}
        marked, gone = docs.withColumns(marks), None
        plain = marked.select(F.col("__gl_one").alias("doc_id"), F.col("__gl_two").alias("same"), F.col(text).alias("text"))
        for items in runs:
            shared = armed(docs, text, items, window)
            part = stage(judged(plain, "text", shared, True).select(F.col("doc_id").alias("__gl_one"), F.col("same").alias("__gl_two")), "hits")
            shared.destroy()
            gone = part if gone is None else gone.unionByName(part)
        return without(marked, gone.distinct()).drop(*marks)
    shared, at = armed(docs, text, next(runs), window), docs.columns.index(text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            yield batch.filter(pa.array([not own.judge(t.as_py())[1] for t in batch.column(at)], pa.bool_()))

    return map_texts(docs, clean, docs.schema)
