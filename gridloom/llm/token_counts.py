"""Token counts by rank-synchronous merging of ragged arrays.

Pre-tokens of a batch lie in one flat id array with a segment number per symbol. In each round every
unfinished segment finds the lowest merge rank among its adjacent pairs and applies all its occurrences at
once; segments without a mergeable pair leave the array. What survives is the token count. Pre-tokens of more than
``LONG`` bytes would take too many rounds over all of their symbols: theirs lie in linked arrays, with places listed by
rank, and a round takes the lowest rank of all of them and touches its places alone. (A pair with a merged symbol ranks
above that symbol's merge, which is verified when a file is loaded; so ranks come in order.) Counts of distinct
pre-tokens are kept in a bounded per-worker memo, so that frequent pre-tokens are merged once.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); texts of any length are taken whole; repeated
rows give repeated results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._util import map_texts

#: Fixed value: the pre-token pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NO_RANK = np.iinfo(np.int32).max
CHUNK_CHARS = 4_000_000
MEMO_WORDS = 1_000_000
LONG = 256


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankMerger:
    """Merge tables of one byte-level BPE vocabulary file, and the ragged merge itself."""

    def __init__(self, path: str):
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab, model = spec["model"]["vocab"], spec["model"]
        self.first = np.zeros(256, np.int64)
        for symbol, byte in byte_symbols().items():
            self.first[byte] = vocab[symbol]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(vocab[a] << 20) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]
        made_at = np.full(int(max(vocab.values())) + 1, -1, np.int64)
        made_at[self.made] = self.rank
        self.ordered = bool((np.maximum(made_at[self.keys >> 20], made_at[self.keys & ((1 << 20) - 1)]) < self.rank).all())
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.pattern = regex.compile(PATTERN)
        self.memo: dict[str, int] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of each pair of symbols (NO_RANK: none), and its place in the merge tables."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK), at

    def merged(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each (non-empty) word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        out, long = np.zeros(len(words), np.int64), (lengths > LONG) & self.ordered
        for chosen, merge in ((~long, self.merged_in_rounds), (long, self.merged_by_rank)):
            if chosen.any():
                out[chosen] = merge([words[i] for i in np.flatnonzero(chosen)])
        return out

    def merged_by_rank(self, words: list[bytes]) -> np.ndarray:
        """:meth:`merged`, the lowest rank of all words first; a round costs its places."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        n, ends = len(ids), np.cumsum(lengths)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends - 1], before[ends - lengths] = -1, -1
        now, gone = np.full(n, NO_RANK, np.int64), np.zeros(n, bool)
        places: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def listed(at: np.ndarray) -> None:
            """Ranks of the pairs that begin at places, which are listed by them."""
            now[at] = NO_RANK
            at = at[after[at] >= 0]
            rank = self.ranks(ids[at], ids[after[at]])[0]
            now[at] = rank
            at, rank = at[rank != NO_RANK], rank[rank != NO_RANK]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, own in zip(rank[np.r_[0, cuts]].tolist() if len(rank) else [], np.split(at, cuts), strict=False):
                if r not in places:
                    heapq.heappush(heap, r)
                places[r].append(own)

        listed(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            hit = np.unique(np.concatenate(places.pop(r)))
            hit = hit[(now[hit] == r) & ~gone[hit]]
            if not len(hit):
                continue
            # Equal neighbours (x x x) overlap: of a run of hits every other one, from the left, is applied.
            starts = np.r_[True, after[hit[:-1]] != hit[1:]]
            run = np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            eaten = after[hit]
            ids[hit] = self.made[self.ranks(ids[hit], ids[eaten])[1]]
            gone[eaten] = True
            after[hit] = after[eaten]
            follows = after[hit] >= 0
            before[after[hit][follows]] = hit[follows]
            listed(np.unique(np.r_[hit, before[hit][before[hit] >= 0]]))
        return np.add.reduceat((~gone).astype(np.int64), ends - lengths)

    def merged_in_rounds(self, words: list[bytes]) -> np.ndarray:
        """:meth:`merged`, each word's lowest rank in every round."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        left = lengths.copy()
        ids = self.first[np.frombuffer(b"".join(words), np.uint8)]
        segment = np.repeat(np.arange(len(words)), lengths)
        while len(ids) > 1:
            key = (ids[:-1] << 20) | ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.full(len(ids), NO_RANK, np.int32)
            found = (self.keys[at] == key) & (segment[:-1] == segment[1:])
            rank[:-1][found] = self.rank[at[found]]
            begins = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            sizes = np.diff(np.r_[begins, len(ids)])
            lowest = np.minimum.reduceat(rank, begins)
            hit = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != NO_RANK))
            if not len(hit):
                break
            # Equal neighbours (x x x) overlap: of a run of hits every other one, from the left, is applied.
            starts = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(starts, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            ids[hit] = self.made[at[hit]]
            left -= np.bincount(segment[hit], minlength=len(left))
            stay = np.repeat(lowest != NO_RANK, sizes)
            stay[hit + 1] = False
            ids, segment = ids[stay], segment[stay]
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings inside a text count as one token each."""
        memo, out, split = self.memo, [], []
        for text in texts:
            parts = [text]
            for special in self.special:
                parts = [p for part in parts for p in part.split(special)]
            words = self.pattern.findall(parts[0]) if len(parts) == 1 else [w for p in parts for w in self.pattern.findall(p)]
            split.append((len(parts) - 1, words))
        fresh = list(set().union(*(w for _, w in split)).difference(memo)) if split else []
        counts = dict(zip(fresh, self.merged([w.encode() for w in fresh]).tolist(), strict=True)) if fresh else {}
        if len(memo) + len(counts) > MEMO_WORDS:
            known = {w: memo[w] for _, ws in split for w in ws if w in memo}
            memo.clear()
            memo.update(known)
        memo.update(counts)
        for specials, words in split:
            out.append(specials + sum(map(memo.__getitem__, words)))
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return out


_MERGERS: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    """One merger per worker process and file."""
    if path not in _MERGERS:
        _MERGERS[path] = RankMerger(path)
    return _MERGERS[path]


def chunks(texts: Iterable[str], limit: int = CHUNK_CHARS) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters, at least one text each."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def count_tokens(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_bytes, n_tokens, over_limit``. No shuffle: a map over the scan."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = merger(vocabulary)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            n = [c for run in chunks(texts) for c in own.count(run)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    counted = map_texts(picked, count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", over(F.col("n_tokens"), limit))


def over(n: Column, limit: int) -> Column:
    return n > F.lit(limit)
