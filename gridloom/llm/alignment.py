"""Alignment of two tokenizers over whole texts, one distinct segment at a time.

A text, with the space that the second tokenizer puts before it, is cut before white-space runs at which neither
vocabulary can join the two sides (:func:`safe_spaces` reads both files to verify that). Every distinct segment of the
corpus is tokenised and aligned once; the alignments travel back to the chunk of documents that holds the segment, and
documents are composed from them.

An alignment is a stream of integers in text order, group by group, first the group's A tokens and then its B tokens:
``id * 4 + 2 * (token of B) + (first of its side in the group)``. Groups end where tokens of A and B end together.

Data flow: documents are read once and coded as places in their chunk's list of distinct segments, frequent ones first
(a chunk is a run of about ``CHUNK_BYTES`` of a task's texts). (chunk, segment) rows are sorted by segment, so that each
distinct one is tokenised where its rows meet, and go back to their chunks with the alignment, where documents are
composed. A frequent segment has a row per chunk, not per occurrence. Links are counted from the segments' counts; what
documents with an unspelt segment put into these is taken out again. The table of linked id
pairs is bounded by the vocabularies, whatever the corpus: the bytes of one token of a pair are a suffix of the
other's, so there are at most as many pairs as both vocabularies have bytes, times the tokens that share their bytes.

Defined cases: texts that are null or empty, and texts whose tokens do not spell them (such as texts with U+2581), have
an empty stream, no groups and zero counts; texts of any length are taken whole; null ids are kept; repeated rows give
repeated results and count each time; extra columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._util import map_texts, scratch
from gridloom.llm.token_counts import byte_symbols

CHUNK_BYTES = 16 << 20
PART = 1 << 20
#: What any of the libraries may take for white space; a cut is only made after another character.
SPACE = "\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200d\\u2028\\u2029\\u202f\\u205f\\u2060\\u3000\\ufeff"
CUTS = " \t\n\x0b\x0c\r"  # space first
PAIR_BITS = 31


class Aligner:
    """Two vocabularies: a byte-level BPE file (A) and a piece model with byte fallback (B)."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of, vocab = byte_symbols(), self.a.get_vocab()
        self.bytes_a = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id("▁")
        self.cuts = self.safe_spaces(json.loads(open(path_a, encoding="utf-8").read()))
        other = f"(?:(?![{re.escape(self.cuts)}])[{SPACE}])" if self.cuts else f"[{SPACE}]"
        self.segment = re.compile(f"[{SPACE}]*[^{SPACE}]*(?:{other}[{SPACE}]*[^{SPACE}]*)*")

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def safe_spaces(self, spec: dict) -> str:
        """The white-space characters before which a text may be cut after any other character. A character is safe if
        no token of A or B holds it right after another kind of character, so that no merge can cross the cut; if no
        piece joins it to the space that B adds (a cut segment gets that space too); and if A's pre-tokens, found by the
        byte-level pattern, end before every white-space run. Without these properties nothing is cut."""
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(self.b.serialized_model_proto())
        form, before = model.normalizer_spec, spec["pre_tokenizer"] or {}
        plain = not form.precompiled_charsmap and form.add_dummy_prefix and not form.remove_extra_whitespaces and form.escape_whitespaces
        plain &= not model.trainer_spec.treat_whitespace_as_suffix and all(p.type != 4 for p in model.pieces)  # 4: matched before merging
        plain &= spec["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before["add_prefix_space"]
        if not plain:
            return ""
        of_a, of_b = ([t.decode(errors="replace") for t in own] for own in (self.bytes_a, self.bytes_b))
        crossed = re.compile(f"[^{SPACE}]([{CUTS}])")
        joined = {c for t in of_a + of_b for c in crossed.findall(t)}
        added = {c for t in of_b for c in re.findall(f" ([{CUTS[1:]}])", t)}
        return "".join(c for c in CUTS if c not in joined | added)

    def segments(self, text: str) -> list[str]:
        """The cut pieces of ``text`` with its leading space; joined they are that text."""
        found = self.segment.findall(" " + text)
        return found[:-1] if not found[-1] else found

    def pieces(self, segments: list[str]) -> list[list[int]]:
        """B's ids of segments that begin with white space: B adds the first space itself."""
        ids = self.b.encode([s[1:] if s[0] == " " else s for s in segments], num_threads=1)
        return [([self.space] if s == " " else got) if s[0] == " " else got[1:] for s, got in zip(segments, ids, strict=True)]

    def streams(self, segments: list[str]) -> list[list[int] | None]:
        """The alignment of each segment; None where the tokens do not spell it."""
        first = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        return [self._aligned(s.encode(), a, b) for s, a, b in zip(segments, first, self.pieces(segments), strict=True)]

    def _aligned(self, data: bytes, a: list[int], b: list[int]) -> list[int] | None:
        spell_a, spell_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(spell_a) != data or b"".join(spell_b) != data:
            return None
        out, i, j, end_a, end_b = [], 0, 0, 0, 0
        while i < len(a):
            from_a, from_b = i, j
            end_a, end_b = end_a + len(spell_a[i]), end_b + len(spell_b[j])
            i, j = i + 1, j + 1
            while end_a != end_b:
                if end_a < end_b:
                    end_a += len(spell_a[i])
                    i += 1
                else:
                    end_b += len(spell_b[j])
                    j += 1
            out += [a[x] * 4 + (x == from_a) for x in range(from_a, i)]
            out += [b[x] * 4 + 2 + (x == from_b) for x in range(from_b, j)]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One aligner per worker process and pair of files."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def packed(places: np.ndarray) -> np.ndarray:
    """Numbers as bytes: seven bits in each, the lowest first, the top bit set on all but the last."""
    width = 1 + sum((places >= 1 << shift).astype(np.int64) for shift in (7, 14, 21, 28))
    start = np.cumsum(width) - width
    out = np.zeros(int(width.sum()), np.uint8)
    for k in range(int(width.max(initial=0))):
        own = width > k
        out[start[own] + k] = ((places[own] >> (7 * k)) & 127) | np.where(width[own] > k + 1, 128, 0)
    return out


def unpacked(data: np.ndarray) -> np.ndarray:
    """The numbers of :func:`packed`."""
    last = data < 128
    begin = np.flatnonzero(np.r_[True, last[:-1]][: len(data)])
    place = np.arange(len(data)) - np.repeat(begin, np.diff(np.r_[begin, len(data)]))
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * place), begin) if len(data) else np.zeros(0, np.int64)


def coded(docs: DataFrame, path_a: str, path_b: str, doc_id: str, text: str) -> DataFrame:
    """Rows of documents ``(chunk, doc_id, codes)`` and of their chunk's segments ``(chunk, code, segment, times)``."""
    picked = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "doc_id", "codes", "code", "segment", "times"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known, size, chunk = aligner(path_a, path_b), {}, 0, TaskContext.get().partitionId() << 32
        ids: list[pa.Array] = []
        rows: list[np.ndarray] = []

        def closed() -> Iterator[pa.RecordBatch]:
            """A chunk's documents, then its segments."""
            times = np.bincount(np.concatenate([*rows, np.zeros(0, np.int32)]), minlength=len(known))
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            at = 0
            for some in ids:
                n = len(some)
                codes = pa.array([packed(place[r]).tobytes() for r in rows[at : at + n]], pa.binary())
                at += n
                empty = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), some, codes, *empty], names)
            n = len(known)
            columns = [pa.array(np.full(n, chunk)), pa.nulls(n, ids[0].type), pa.nulls(n, pa.binary()), pa.array(place.astype(np.int32)), pa.array(list(known), pa.string()), pa.array(times)]
            yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            ids.append(batch.column(0))
            for value in batch.column(1):
                data = value.as_py()
                rows.append(np.array([known.setdefault(s, len(known)) for s in own.segments(data)] if data else [], np.int32))
                size += len(data or "")
            if size >= CHUNK_BYTES:
                yield from closed()
                known, size, chunk, ids, rows = {}, 0, chunk + 1, [], []
        if ids:
            yield from closed()

    return map_texts(picked, code, f"chunk long, doc_id {kind}, codes binary, code int, segment string, times long")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged in the shared folder, tightly compressed."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def aligned_segments(held: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``own, code, times, stream`` of rows ``own, code, segment, times``: all rows of a segment meet, and it is
    tokenised and aligned once. The stream is null where the tokens do not spell the segment."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, stream = aligner(path_a, path_b), None, None
        for batch in batches:
            segments = batch.column(2).to_pylist()
            fresh = [s for s, before in zip(segments, [last, *segments], strict=False) if s != before]
            made, streams = iter(own.streams(fresh)), []
            for s in segments:
                if s != last:
                    last, stream = s, next(made)
                streams.append(stream)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(streams, pa.list_(pa.int32()))], ["own", "code", "times", "stream"])

    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the number of tasks is kept: tokenising is the work
    met = held.repartition(parts, "segment").sortWithinPartitions("segment").select("own", "code", "segment", "times")
    return kept(map_texts(met, aligned, "own long, code int, times long, stream array<int>"), "segments")


def gathered(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of many runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def composed(chunk: pa.Table, segments: pa.Table, unspelt: bool) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Parts of a chunk: ids of documents, their streams joined, and the lengths of these. A document with an unspelt
    segment has length 0; or, if ``unspelt``, it alone has the streams of its other segments."""
    order = np.zeros(segments.num_rows, np.int64)
    order[segments["code"].to_numpy()] = np.arange(segments.num_rows)
    (values, sizes), spelt = _flat(segments["stream"])
    starts, part, lengths, first, size = np.cumsum(sizes) - sizes, [], [], 0, 0
    ids = chunk["doc_id"].combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    for i, data in enumerate(chunk["codes"]):
        own = order[unpacked(np.frombuffer(data.as_py(), np.uint8))]
        if spelt[own].all() == unspelt:
            own = own[:0]
        part.append(values[gathered(starts[own], sizes[own])])
        lengths.append(len(part[-1]))
        size += lengths[-1]
        if size >= PART or i + 1 == chunk.num_rows:
            yield ids.slice(first, i + 1 - first), np.concatenate(part), np.array(lengths, np.int64)
            part, lengths, first, size = [], [], i + 1, 0


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """Values and lengths of a column of lists (null: length 0), and which are not null."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    array = array.chunk(0) if isinstance(array, pa.ChunkedArray) else array
    lengths = array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return (array.flatten().to_numpy(zero_copy_only=False), lengths), array.is_valid().to_numpy(zero_copy_only=False)


def links(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs ``A id << PAIR_BITS | B id`` of tokens that end together in joined streams, and the place of each
    pair's B token: within a group only its last A and its last B token do."""
    opens = np.flatnonzero((stream & 3) == 1)  # first A of a group
    turns = np.flatnonzero((stream & 3) == 3)  # first B of a group
    last_b = np.r_[opens[1:], len(stream)][: len(opens)] - 1
    ids = (stream >> 2).astype(np.int64)
    return (ids[turns - 1] << PAIR_BITS) | ids[last_b], last_b


def counted(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in order, with their times added up."""
    pairs, back = np.unique(pairs, return_inverse=True)
    return pairs, np.bincount(back, times, len(pairs)).astype(np.int64)


def link_counts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """``pair, times``: how often each pair of ids is linked in the whole corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            (stream, sizes), _ = _flat(batch.column(1))
            new, at = links(stream)
            row = np.searchsorted(np.cumsum(sizes), at, "right")
            pairs, times = counted(np.r_[pairs, new], np.r_[times, batch.column(0).to_numpy()[row]])
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(times)], ["pair", "times"])

    def undone(chunk: pa.Table, segments: pa.Table) -> pa.Table:
        pairs = np.concatenate([links(stream)[0] for _, stream, _ in composed(chunk, segments, True)] or [np.zeros(0, np.int64)])
        pairs, times = counted(pairs, np.ones(len(pairs)))
        return pa.table({"pair": pairs, "times": -times})

    schema = "pair long, times long"
    counts = map_texts(found.select("times", "stream"), count, schema)
    bad = found.where("stream IS NULL").select("own").distinct()
    if not bad.isEmpty():
        chunks, segments = texts.join(bad.withColumnRenamed("own", "chunk"), "chunk", "left_semi"), found.join(bad, "own", "left_semi")
        counts = counts.unionAll(chunks.groupBy("chunk").cogroup(segments.groupBy("own")).applyInArrow(undone, schema))
    return counts.groupBy("pair").agg(F.sum("times").alias("times"))


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``; ``groups`` is the
    alignment as text (``a1,a2|b1;a3|b2,b3``). A link is best if its count is the highest of its B id."""
    rows = kept(coded(docs, path_a, path_b, doc_id, text), "coded")
    spark, kind = rows.sparkSession, dict(rows.dtypes)["doc_id"]
    texts = rows.where("segment IS NULL").select("chunk", "doc_id", "codes")
    found = aligned_segments(rows.where("segment IS NOT NULL").select(F.col("chunk").alias("own"), "code", "segment", "times"), path_a, path_b)
    table = link_counts(texts, found).toArrow()  # bounded by the two vocabularies
    order = np.argsort(table["pair"].to_numpy())
    pairs, times = table["pair"].to_numpy()[order], table["times"].to_numpy()[order]
    to = pairs & ((1 << PAIR_BITS) - 1)
    best = np.zeros(int(to.max(initial=0)) + 1, np.int64)
    np.maximum.at(best, to, times)
    shared = spark.sparkContext.broadcast((pairs, times, times == best[to]))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

    def digest(chunk: pa.Table, segments: pa.Table) -> pa.Table:
        (pairs, times, top), shown, parts = shared.value, Shown(), []
        for ids, stream, lengths in composed(chunk, segments, False):
            ends = np.cumsum(lengths)
            new, at = links(stream)
            place = np.searchsorted(pairs, new)

            def totals(values: np.ndarray, where: np.ndarray | None = None, ends: np.ndarray = ends, lengths: np.ndarray = lengths) -> pa.Array:
                upto = np.r_[0, np.cumsum(values)]
                high, low = (ends, ends - lengths) if where is None else (np.searchsorted(where, ends), np.searchsorted(where, ends - lengths))
                return pa.array(upto[high] - upto[low])

            of_b = ((stream >> 1) & 1).astype(np.int64)
            n_links = totals(np.ones(len(at), np.int64), at)
            columns = [totals(1 - of_b), totals(of_b), n_links, n_links, totals(top[place].astype(np.int64), at), totals(times[place], at)]
            parts.append(pa.table([ids, *columns, pa.array(shown.texts(stream, lengths), pa.string())], names))
        return pa.concat_tables(parts)

    schema = f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:-1]) + ", groups string"
    return texts.groupBy("chunk").cogroup(found.select("own", "code", "stream").groupBy("own")).applyInArrow(digest, schema)


class Shown:
    """Streams as text; the text of a code is kept with the sign before it."""

    def __init__(self):
        self.known: dict[int, str] = {}

    def texts(self, stream: np.ndarray, lengths: np.ndarray) -> list[str]:
        fresh = [c for c in np.unique(stream).tolist() if c not in self.known]
        self.known.update((c, ",;,|"[c & 3] + str(c >> 2)) for c in fresh)
        codes, out, at = list(map(self.known.__getitem__, stream.tolist())), [], 0
        for n in lengths.tolist():
            out.append("".join(codes[at : at + n])[1:])
            at += n
        return out
