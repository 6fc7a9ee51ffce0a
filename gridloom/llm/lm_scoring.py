"""Prediction by partial matching over bytes: a context trie learned from all training texts, as tables.

A text is lower-cased (A-Z) and its words (runs of bytes other than space and 09 to 0D) are joined by one space; its
symbols are these bytes and one end symbol, and what is before its first byte counts as tabs. A symbol is coded in the
longest context of at most ``ORDER`` bytes that training has seen. There a symbol with count c has probability
(2 c - 1) / 2 T, for counts of T in all and q kinds, and q / 2 T is the escape to the context shorter by one byte;
kinds that a longer context has offered are excluded there from T and q, as the coder would have used that context for
them. The longest contexts count occurrences; a shorter one counts the contexts longer by a byte that hold the symbol
(updates of it are excluded where the longer one knows the symbol). A context that has only excluded kinds is passed
over at no cost. Below the empty context, kinds that training has not seen share the rest equally. Each context's
probabilities sum to one. Training texts are scored by the same trie.

Data flow: documents are read once and staged in chunks (a run of about ``CHUNK_BYTES`` of a task's texts) with their
chunk's distinct grams (context and symbol in one integer) and words, counted. Grams meet by context in one shuffle,
where windows count them; the trie's shorter levels are aggregations of that, and only grams that training lacks walk
through them, by joins. Code lengths and word counts travel back to chunks, where a frequent gram has a row per chunk,
not per occurrence. No table is collected; the contexts of no and of one byte (257 rows of at most 257 counts) are the
only ones that are broadcast.

Defined cases: null and empty texts and texts without words are the end symbol alone; texts of any length are taken
whole; documents with a null id are scored, but are neither training nor held out; repeated rows give repeated results
and count each time; extra columns are ignored, whatever their names; an empty table gives no rows. Without a training
text every symbol has probability 1 / 257.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._util import map_texts, scratch, stage

CHUNK_BYTES = 64 << 20
ORDER = 5
SYMBOLS = 257
PAD, END = 9, 10  # bytes that no joined text holds


def joined(data: bytes) -> bytes:
    """The words of a text in lower case, one space between them."""
    return b" ".join(data.lower().split())


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of joined texts, one after the other, and how many each text has: ORDER bytes of context (the nearest
    lowest), then nine bits of symbol."""
    data = np.frombuffer(b"".join(b"\t" * ORDER + t + b"\n" for t in texts), np.uint8)
    a = data.astype(np.int64)
    out = np.where(a == END, 256, a)
    for k in range(1, ORDER + 1):
        out[k:] |= a[:-k] << (9 + 8 * (k - 1))
    return out[data != PAD], np.array([len(t) + 1 for t in texts], np.int64)


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their times added up."""
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    return keys[first], np.add.reduceat(times, first) if len(first) else times


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` staged in the shared folder, tightly compressed."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def squeezed(texts: list[bytes]) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress(b"".join(texts))


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of documents, a row per batch ``(chunk, part, ids, held_out, sizes, texts)``, and of a chunk's grams
    ``(chunk, gram, times)`` and words ``(chunk, place, word, times)`` with their training counts, which may be 0. A
    word's place is that of its first occurrence. ``docs`` has doc_id, train, held_out, text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["chunk", "part", "ids", "held_out", "sizes", "texts", "gram", "place", "word", "times"]
    # A chunk is at most what a task reads, so half of the tasks read twice as much, if that leaves every core a task.
    n, cores = docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.coalesce(max(1, min(n, cores), -(-n // 2)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, part, size, known, times, of_id = TaskContext.get().partitionId() << 32, 0, 0, {}, np.zeros(0, np.int64), None
        seen: list[tuple[np.ndarray, np.ndarray]] = []

        def row(n: int, **columns: pa.Array) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.list_(of_id), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]
            columns["chunk"] = pa.array(np.full(n, chunk))
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, k)) for c, k in zip(names, kinds, strict=True)], names)

        def listed() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(*map(np.concatenate, zip(*seen, strict=True)))
            yield row(len(keys), gram=pa.array(keys), times=pa.array(counts))
            yield row(len(known), place=pa.array(np.arange(len(known), dtype=np.int32)), word=pa.array(list(known), pa.binary()), times=pa.array(times))

        for batch in batches:
            of_id = batch.column(0).type
            texts, train = [joined(t.as_py()) for t in batch.column(3)], batch.column(1).to_pylist()
            codes = [[known.setdefault(w, len(known)) for w in t.split()] for t in texts]
            times = np.r_[times, np.zeros(len(known) - len(times), np.int64)]
            for own, learn in zip(codes, train, strict=True):
                if learn:
                    np.add.at(times, own, 1)
            for learn in (True, False):
                keys, counts = np.unique(grams([t for t, is_train in zip(texts, train, strict=True) if is_train == learn])[0], return_counts=True)
                seen.append((keys, counts * learn))
            if len(seen) >= 8:
                seen = [summed(*map(np.concatenate, zip(*seen, strict=True)))]
            if texts:
                sizes = pa.array([list(map(len, texts))], pa.list_(pa.int32()))
                yield row(1, part=pa.array([part], pa.int32()), ids=pa.array([batch.column(0).to_pylist()], pa.list_(of_id)), held_out=pa.array([batch.column(2).to_pylist()]), sizes=sizes, texts=pa.array([squeezed(texts)], pa.binary()))
            part, size = part + 1, size + sum(map(len, texts))
            if size >= CHUNK_BYTES:
                yield from listed()
                chunk, part, size, known, times, seen = chunk + 1, 0, 0, {}, np.zeros(0, np.int64), []
        if seen:
            yield from listed()

    schema = f"chunk long, part int, ids array<{kind}>, held_out array<boolean>, sizes array<int>, texts binary, gram long, place int, word binary, times long"
    return map_texts(docs.select("doc_id", "train", "held_out", "text"), split, schema)


def context(gram: Column, order: int) -> Column:
    """The context of a gram, cut to its ``order`` nearest bytes."""
    return F.shiftright(gram, 9).bitwiseAND((1 << (8 * order)) - 1)


def met(of_grams: DataFrame) -> DataFrame:
    """Rows ``own, gram, times`` with the gram's count over all chunks (``count``), the total and the kinds of its
    context, and ``first`` for one of the gram's rows."""
    rows = of_grams.withColumn("context", F.shiftright("gram", 9)).repartition("context")
    gram, whole = Window.partitionBy("context", "gram"), Window.partitionBy("context")
    rows = rows.withColumns({"count": F.sum("times").over(gram), "first": F.row_number().over(gram.orderBy("own")) == 1})
    rows = rows.withColumns({"total": F.sum("times").over(whole), "kinds": F.sum((F.col("first") & (F.col("count") > 0)).cast("long")).over(whole)})
    return rows.select("own", "gram", "count", "first", "total", "kinds")


def trie(counts: DataFrame) -> DataFrame:
    """The trie of training grams ``(gram, times)``: a row per context of 0 to ``ORDER`` bytes with its total, its
    kinds, the counts of its symbols (at most 257), and ``outer``: the total that its kinds have in the context shorter
    by a byte."""
    levels = counts.withColumn("order", F.lit(ORDER))
    every = levels
    for k in range(ORDER - 1, -1, -1):
        levels = levels.groupBy(F.col("gram").bitwiseAND((1 << (9 + 8 * k)) - 1).alias("gram")).agg(F.count(F.lit(1)).alias("times")).withColumn("order", F.lit(k))
        levels = stage(levels, f"level-{k}") if k >= ORDER - 2 else levels
        every = every.unionByName(levels)
    symbols = F.map_from_entries(F.collect_list(F.struct(F.col("gram").bitwiseAND(511).cast("int").alias("symbol"), "times")))
    nodes = every.groupBy("order", F.shiftright("gram", 9).alias("context")).agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("kinds"), symbols.alias("symbols"))
    nodes = stage(nodes, "trie")
    mask = F.element_at(F.array(*(F.lit((1 << (8 * k)) - 1).cast("long") for k in range(ORDER + 1))), F.greatest("order", F.lit(1)).cast("int"))
    own = nodes.withColumns({"up": F.col("order") - 1, "shorter": F.col("context").bitwiseAND(mask)})
    parent = nodes.select(F.col("order").alias("up"), F.col("context").alias("shorter"), F.col("symbols").alias("theirs"))
    outer = F.aggregate(F.map_keys("symbols"), F.lit(0).cast("long"), lambda t, s: t + F.coalesce(F.element_at("theirs", s), F.lit(0)))
    return own.join(parent, ["up", "shorter"], "left").withColumn("outer", outer).drop("up", "shorter", "theirs")


def step(rows: DataFrame, nodes: DataFrame, order: int) -> DataFrame:
    """Rows ``gram, done, log, kinds_out, total_out`` after the try in their contexts of ``order`` bytes; the last two
    are what that context offered and what its kinds have in the next shorter one."""
    named = nodes.where(F.col("order") == order).select(F.col("context").alias("__context"), F.col("total").alias("__total"), F.col("kinds").alias("__kinds"), F.col("outer").alias("__outer"), "symbols")
    joined = rows.withColumn("__own", context(F.col("gram"), order)).join(F.broadcast(named) if order < 2 else named, F.col("__own") == F.col("__context"), "left")
    known, total, kinds = F.col("__total").isNotNull(), F.col("__total") - F.col("total_out"), F.col("__kinds") - F.col("kinds_out")
    times = F.element_at("symbols", F.col("gram").bitwiseAND(511).cast("int"))
    open_ = known & ~F.col("done")
    log = F.when(times.isNotNull(), share(times, total, F.col("__kinds"))).when(kinds > 0, F.log10(kinds / (2 * total))).otherwise(0.0)
    out = lambda inner: F.when(known, F.col(inner)).otherwise(0)
    return joined.select(
        "gram",
        (F.col("done") | (known & times.isNotNull())).alias("done"),
        (F.col("log") + F.when(open_, log).otherwise(0.0)).alias("log"),
        out("__kinds").cast("long").alias("kinds_out"),
        out("__outer").cast("long").alias("total_out"),
    )


def share(times: Column, total: Column, kinds: Column) -> Column:
    """The log10 probability of a symbol that its context has seen; with all kinds seen, there is no escape."""
    return F.log10(F.when(kinds < SYMBOLS, 2 * times - 1).otherwise(2 * times) / (2 * total))


def code_lengths(grams: DataFrame, nodes: DataFrame) -> DataFrame:
    """``gram, value``: the log10 probability of each gram's symbol after its context, by a walk from the longest
    context to the empty one."""
    nodes = stage(nodes, "trie-outer")  # every step reads it
    zero = F.lit(0).cast("long")
    rows = grams.select("gram", F.lit(False).alias("done"), F.lit(0.0).alias("log"), zero.alias("kinds_out"), zero.alias("total_out"))
    for order in range(ORDER, -1, -1):
        rows = step(rows, nodes, order)
    unseen = F.when(F.col("done"), 0.0).otherwise(-F.log10(SYMBOLS - F.col("kinds_out")))
    return rows.select("gram", (F.col("log") + unseen).alias("value"))


def score(docs: DataFrame, train: Column, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: the words
    and the end, how many of them training has, its tokens, the log10 probability by smoothed token shares, and that by
    the trie. ``train`` tells the rows to learn from."""
    known = lambda c: F.coalesce(c, F.lit(False))
    picked = docs.select(F.col(doc_id).alias("doc_id"), known(train).alias("train"), known(held_out).alias("held_out"), F.encode(F.coalesce(text, F.lit("")), "UTF-8").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    rows = kept(chunked(picked), "scored-chunks")
    of_grams = kept(met(rows.where("gram IS NOT NULL").select(F.col("chunk").alias("own"), "gram", "times")), "met-grams")
    nodes = trie(of_grams.where("first AND count > 0").select("gram", F.col("count").alias("times")))
    lengths = code_lengths(of_grams.where("first AND count = 0").select("gram"), nodes)
    seen = of_grams.where("count > 0").select("own", F.col("gram").alias("key"), share(F.col("count"), F.col("total"), F.col("kinds")).alias("value"))
    unseen = of_grams.where("count = 0").select("own", "gram").join(lengths, "gram").select("own", F.col("gram").alias("key"), "value")
    word = Window.partitionBy("word")
    words = rows.where("word IS NOT NULL").select(F.col("chunk").alias("own"), "place", "word", "times")
    words = words.select("own", "place", F.sum("times").over(word).alias("count"), (F.row_number().over(word.orderBy("own")) == 1).alias("first"))
    words = kept(words, "met-words")
    ends = picked.where("train").count()
    n, kinds = words.where("first AND count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    n, kinds = n + ends, kinds + (ends > 0)
    by_word = words.select("own", (-1 - F.col("place").cast("long")).alias("key"), F.col("count").cast("double").alias("value"))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def summed_up(chunk: pa.Table, values: pa.Table) -> pa.Table:
        import zstandard

        keys, told = values["key"].to_numpy(), values["value"].to_numpy()
        order = np.argsort(keys)
        keys, told = keys[order], told[order]
        of_words = int(np.searchsorted(keys, 0))
        times, keys, logs = told[:of_words][::-1], keys[of_words:], told[of_words:]
        places: dict[bytes, int] = {}
        parts = []
        for row in chunk.sort_by("part").to_batches(1):
            data, sizes = zstandard.decompress(row["texts"][0].as_py()), row["sizes"][0].values.to_numpy()
            ends_at = np.cumsum(sizes)
            texts = [data[e - k : e] for e, k in zip(ends_at.tolist(), sizes.tolist(), strict=True)]
            tokens, common, base, total = [], [], [], []
            for some in _parts(texts):
                found, lengths = grams(some)
                total += np.add.reduceat(logs[np.searchsorted(keys, found)], np.cumsum(lengths) - lengths).tolist()
                for body in some:
                    c = np.r_[times[[places.setdefault(w, len(places)) for w in body.split()]], ends] if body else np.array([float(ends)])
                    tokens.append(len(c))
                    common.append(int((c > 0).sum()))
                    base.append(float(np.log10((c + 0.1) / (n + 0.1 * (kinds + 1))).sum()))
            columns = [pa.array(tokens, pa.int64()), pa.array(common, pa.int64()), pa.array([n] * len(tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(total, pa.float64())]
            parts.append(pa.table([row["ids"][0].values, row["held_out"][0].values, *columns], names))
        return pa.concat_tables(parts)

    bodies = rows.where("texts IS NOT NULL").select("chunk", "part", "ids", "held_out", "sizes", "texts").groupBy("chunk")
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return bodies.cogroup(seen.unionAll(unseen).unionAll(by_word).groupBy("own")).applyInArrow(summed_up, schema)


def _parts(texts: list[bytes], limit: int = 2 << 20) -> Iterator[list[bytes]]:
    """Runs of texts of about ``limit`` bytes, at least one text each."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run
