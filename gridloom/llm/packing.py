"""Sum-of-squares online packing of token sequences.

Each scan partition packs on its own, in one pass. ``N[h]`` counts the open windows filled to level ``h``; a
document (or what is left of it after whole windows) goes to the level that makes the sum of ``N[h]**2``
smallest, the fuller level on ties. Only at the end of the partition are the emptiest open windows cut to fill the
fullest; the single rest is cut into runs whose lengths are powers of two, which need no padding.

A window closes on an exact fit, so some 700 to 1,000 windows of 1024 levels stay open; their share of all windows,
which the end of the partition fills, falls with the partition's size. A task holds the ids of its open windows, at
most those of its scan partition (``spark.sql.files.maxPartitionBytes``).

Defined cases: a null or empty text is the end-of-document id alone; a null doc_id stays null; repeated rows
are packed as often as they occur; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._util import map_texts
from gridloom.llm.token_counts import PATTERN

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Encoder:
    """Ids of a byte-level BPE vocabulary: the rank file's fast encoder, the library's own where that gives up. The
    library is loaded when it is first needed."""

    def __init__(self, vocabulary: str, ranks: str | None):
        self.vocabulary, self.library, self.fast = vocabulary, None, None
        if ranks:
            import tiktoken

            with open(vocabulary, encoding="utf-8") as file:
                special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special)

    def slow(self, text: str) -> list[int]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.fast is not None:
            try:
                return self.fast.encode(text, allowed_special="all", disallowed_special=())
            except BaseException as error:  # a panic of the native pattern engine on extreme texts
                if isinstance(error, KeyboardInterrupt | SystemExit):
                    raise
        return self.slow(text)


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(vocabulary: str, ranks: str | None) -> Encoder:
    if (vocabulary, ranks) not in _ENCODERS:
        _ENCODERS[vocabulary, ranks] = Encoder(vocabulary, ranks)
    return _ENCODERS[vocabulary, ranks]


class SumOfSquares:
    """Online packer of one partition. ``emit`` gets (document, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, size: int, emit: Callable, first: int = 0):
        self.size, self.emit, self.next = size, emit, first
        self.level = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # windows by level; a window: pieces

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.close([(doc, at, ids[at : at + self.size], len(ids))])
        if whole < len(ids):
            self.place((doc, whole, ids[whole:], len(ids)))

    def best(self, s: int) -> int:
        """The level (0: a new window) whose choice makes the sum of squared counts smallest."""
        n = self.level
        levels = np.flatnonzero(n[1 : self.size - s + 1]) + 1
        if not len(levels):
            return 0
        change = np.where(levels + s == self.size, 1 - 2 * n[levels], 2 * (n[np.minimum(levels + s, self.size)] - n[levels]) + 2)
        least = len(change) - 1 - int(np.argmin(change[::-1]))
        return int(levels[least]) if change[least] <= 2 * n[s] + 1 else 0

    def place(self, piece: tuple) -> None:
        s = len(piece[2])
        h = self.best(s)
        window = self.open[h].pop() if h else []
        if h:
            self.level[h] -= 1
        window.append(piece)
        if h + s == self.size:
            self.close(window)
            return
        self.level[h + s] += 1
        self.open[h + s].append(window)

    def close(self, window: list) -> None:
        at = 0
        for doc, start, ids, total in window:
            self.emit(doc, start, ids, total, self.next, at)
            at += len(ids)
        self.next += 1

    def level_out(self) -> None:
        """Fill the fullest open windows with what the emptiest hold; one open window at most is left."""
        windows = [[sum(len(p[2]) for p in w), w] for stack in self.open for w in stack]
        windows.sort(key=lambda w: w[0])
        self.level[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        low = 0
        high = len(windows) - 1
        while low < high:
            fill, window = windows[high]
            while fill < self.size and low < high:
                donor = windows[low]
                doc, start, ids, total = donor[1].pop()
                take = min(self.size - fill, len(ids))
                window.append((doc, start, ids[:take], total))
                if take < len(ids):
                    donor[1].append((doc, start + take, ids[take:], total))
                fill, donor[0] = fill + take, donor[0] - take
                if not donor[1]:
                    low += 1
            if fill < self.size:  # the donors ran out: this window is the rest
                windows[high][0] = fill
                low = high
                break
            self.close(window)
            high -= 1
        if low == high and windows[high][1]:
            fill, window = windows[high]
            self.level[fill] += 1
            self.open[fill].append(window)

    def finish(self) -> None:
        self.level_out()
        for stack in self.open:
            for window in stack:
                rest = sum(len(p[2]) for p in window)
                while rest:
                    size, run = 1 << (rest.bit_length() - 1), []
                    rest -= size
                    while size:
                        doc, start, ids, total = window.pop(0)
                        take = min(size, len(ids))
                        run.append((doc, start, ids[:take], total))
                        if take < len(ids):
                            window.insert(0, (doc, start + take, ids[take:], total))
                        size -= take
                    self.close(run)
        self.open = [[] for _ in range(self.size + 1)]
        self.level[:] = 0


def pack(docs: DataFrame, vocabulary: str, ranks: str | None = None, doc_id: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0, rows: int = 4_000) -> DataFrame:
    """Pieces of all rows of ``docs``: ``doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset``. A map over the scan, without a shuffle; sequence ids are unique over partitions."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.spark_partition_id().alias("part"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out, packer = encoder(vocabulary, ranks), [], None

        def emit(doc, start, ids, total, sequence, at):
            out.append((doc, start, len(ids), ids.tobytes(), total, sequence, at))

        def flush(types=(pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())):
            columns = list(zip(*out, strict=True)) or [()] * 7
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, t) for c, t in zip(columns[1:], types, strict=True))], names)
            out.clear()
            return made

        for batch in batches:
            id_type = batch.column(0).type
            if packer is None and batch.num_rows:
                packer = SumOfSquares(size, emit, batch.column(2)[0].as_py() << 32)
            for doc, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = own.ids(words.as_py() or "")
                ids.append(end_id)
                packer.add(doc, np.array(ids, "<u4"))
                if len(out) >= rows:
                    yield flush()
        if packer is not None:
            packer.finish()
            while out:
                yield flush()

    return map_texts(picked, run, f"doc_id {kind}, {PIECES}")
