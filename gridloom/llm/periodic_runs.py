"""Periodic runs of words, found by probing a harmonic grid.

A run is a maximal stretch of words with smallest period p and at least two periods. It holds a grid pair (j p,
(j + 1) p) of its own period, so for each p only n / p pairs of words are compared: n log n in all. A pair that is
equal is extended to both sides: first all survivors together over a few words, which ends nearly all of them, then one
by one in chunks of doubling length. Pairs inside a run that is found already, and whose distance is a multiple of
that run's period, are skipped, as is the rest of the grid up to the end of a stretch that was just measured. Two runs
of one period overlap in less than that period, so a stretch has a smaller period exactly if a run of a divisor of p
has the same ends.

No shuffle: a map over the scan; memory is that of a text and ``BLOCK`` pairs.

Defined cases: null and empty texts and texts without words have no words and no runs, and collapse to ''; texts of
any length are taken whole; null ids are kept; repeated rows give repeated results; extra columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._util import map_texts

BLOCK = 1 << 20
REACH = 64
FEW = 8


def codes(words: list) -> np.ndarray:
    """Equal words, equal numbers."""
    known: dict = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def same_after(w: np.ndarray, i: int, p: int) -> int:
    """How many words from ``i`` on equal the word ``p`` later, in a row."""
    at, step, end = i, 64, len(w) - p
    while at < end:
        upto = min(at + step, end)
        differs = np.flatnonzero(w[at:upto] != w[at + p : upto + p])
        if len(differs):
            return at + int(differs[0]) - i
        at, step = upto, 2 * step
    return at - i


def same_before(w: np.ndarray, i: int, p: int) -> int:
    """How many words before ``i`` equal the word ``p`` later, in a row."""
    at, step = i, 64
    while at > 0:
        low = max(at - step, 0)
        differs = np.flatnonzero(w[low:at] != w[low + p : at + p])
        if len(differs):
            return i - (low + int(differs[-1]) + 1)
        at, step = low, 2 * step
    return i


def grid(n: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (start, period) of the grid pairs, by period, then start; only the period that follows a full block
    may be larger than a block."""
    p = 1
    while p <= longest:
        size = np.cumsum((n - 1) // np.arange(p, min(longest, p + BLOCK) + 1))
        upto = p + max(1, int(np.searchsorted(size, BLOCK, "right")))
        own = np.arange(p, min(upto, longest + 1))
        counts = (n - 1) // own
        period = np.repeat(own, counts)
        j = np.arange(len(period)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield j * period, period
        p = upto


def near(w: np.ndarray, start: np.ndarray, period: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """The pairs that may lie in a stretch of ``needed`` equal pairs: all are extended together, a word at a time to
    each side, until few are left or ``REACH`` words are compared."""
    n, equal, open_ = len(w), np.zeros(len(start), np.int64), np.zeros(len(start), bool)
    for sign, first in ((1, 0), (-1, 1)):
        live = np.arange(len(start))
        for k in range(first, first + REACH):
            at = start[live] + sign * k
            inside = (at >= 0) & (at + period[live] < n)
            live, at = live[inside], at[inside]
            live = live[w[at] == w[at + period[live]]]
            equal[live] += 1
            if len(live) <= FEW:
                break
        open_[live] = True
    return np.flatnonzero(open_ | (equal >= needed))


def runs(w: np.ndarray, least: int = 12) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of at least ``least`` words, by start, then period."""
    n, found, ends = len(w), {}, set()
    if n < max(least, 2):
        return []
    for start, period in grid(n, n // 2):
        hit = np.flatnonzero(w[start] == w[start + period])
        start, period = start[hit], period[hit]
        for q, own in found.items():
            if len(own) == 1 and own[0][1] - own[0][0] > n // 2:  # one run covers most of the text: skip its grid at once
                (first, last), = own
                inside = (period % q == 0) & (start >= first) & (start + period < last)
                start, period = start[~inside], period[~inside]
        stay = near(w, start, period, np.maximum(least - period, period))
        start, period = start[stay], period[stay]
        for p, s in _by_period(start, period):
            k = 0
            while k < len(s):
                at = int(s[k])
                skip = _covered(found, p, at)
                if skip is None:
                    first, last = at - same_before(w, at, p), at + same_after(w, at, p) + p
                    skip = last - p
                    if last - first >= max(least, 2 * p) and (first, last) not in ends:
                        ends.add((first, last))
                        found.setdefault(p, []).append((first, last))
                k = max(k + 1, int(np.searchsorted(s, skip)))
    return sorted((first, last - first, p) for p, own in found.items() for first, last in own)


def _by_period(start: np.ndarray, period: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    cuts = np.flatnonzero(np.diff(period)) + 1
    for own, s in zip(np.split(period, cuts), np.split(start, cuts), strict=True):
        if len(own):
            yield int(own[0]), s


def _covered(found: dict[int, list[tuple[int, int]]], p: int, at: int) -> int | None:
    """The first grid place that lies beyond a found run which holds the pair (at, at + p) and whose period divides p."""
    for q, own in found.items():
        if p % q == 0:
            low, high = 0, len(own)
            while low < high:  # runs of a period are in order of their starts, and of their ends
                middle = (low + high) // 2
                low, high = (middle + 1, high) if own[middle][0] <= at else (low, middle)
            for first, last in own[max(0, low - 2) : low]:
                if first <= at and at + p < last:
                    return last - p
    return None


def collapsed(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that stay when each run keeps only its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    gone = np.cumsum(change)[:-1] > 0
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if found else words


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs`` (start, length, period; by start, then period) and
    ``collapsed``, the text with runs cut to their first period and words joined by one space. Words are runs of bytes
    other than space and 09 to 0D."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, every, texts = [], [], []
            for value in batch.column(1):
                words = value.as_py().split()
                own = runs(codes(words), least)
                n.append(len(words))
                every.append([{"start": s, "length": k, "period": p} for s, k, p in own])
                texts.append(b" ".join(collapsed(words, own)))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(every, pa.list_(one)), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return map_texts(picked, find, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
