"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

A document's set is its distinct runs of ``k`` words (fewer words: the whole sequence as one run). One map over
the documents takes ``bands * rows`` minima; band keys come from the full minima, and of each minimum only the
low ``BITS`` bits are kept, packed into longs. Documents with equal sets form one class with one representative.

Candidates come from shared band keys in two rounds, neither of which emits all pairs of a bucket. First every
member meets its bucket's smallest document, its leader: pairs are filtered by set sizes and by the similarity
estimated from counting equal b-bit lanes, corrected for chance collisions (the margin is over five standard
deviations), and confirmed on the full sets of both texts. Then, where the members of one leader are still in
several components, they are dealt into blocks of bounded rows and bytes, with their full sets kept as differences
from their leader's: every block meets itself, and what is still outside the family's largest component meets the
whole family, block by block. A meeting counts exact intersections and gives a spanning forest of the components it
joins, so links are fewer than rows. Components of the links are found by repeated hooking and contraction.

The number of comparisons in the last step is (members outside) x (family) / 2, where a family of documents shares
bands and yet stays unlinked; what is shipped for it is that over BLOCK_ROWS rows.

At a similarity of 0.85 a pair shares none of 32 bands of 5 with probability 7e-9; at 0.8, 3e-6.

Hot keys: classes and buckets aggregate on the map side; joins on band keys, leaders and classes read
checkpointed tables on both sides, which adaptive execution may split. Bloom filters of document ids, of at most ``FILTER_BITS`` bits, only save shuffling:
texts that no pair needs, and rows that stay, are not moved.

Defined cases: null or empty texts, and texts without words, have an empty set and are linked with nothing; a
null doc_id is linked with nothing; rows that repeat a doc_id are one document; an empty table gives no rows;
extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._hashing import PRIME, WHITE, mixed, word_hashes
from gridloom.llm._util import cut, id_filter, map_texts, stage, without

BITS = 4
LANES = 64 // BITS
BLOCK_ROWS, BLOCK_BYTES = 512, 4 << 20


def shingles(text: str | None, k: int) -> np.ndarray:
    """The document's set: sorted distinct 64-bit hashes of its runs of ``k`` words (A-Z as a-z)."""
    words = word_hashes((text or "").encode().lower(), WHITE)
    if not len(words):
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    run = np.full(n, width, np.uint64)
    for j in range(width):
        run = run * np.uint64(PRIME) + words[j : j + n]
    return np.unique(mixed(run))


def salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mixed((np.arange(1, 2 * n + 1, dtype=np.uint64)) * np.uint64(PRIME))
    return seed[:n].astype(np.uint32) | np.uint32(1), seed[n:].astype(np.uint32)


def minima(hashes: np.ndarray, factor: np.ndarray, salt: np.ndarray) -> np.ndarray:
    least = np.full(len(factor), 0xFFFFFFFF, np.uint32)
    low = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 2048):
        np.minimum(least, (((low[at : at + 2048][None, :] ^ salt[:, None]) * factor[:, None])).min(axis=1), out=least)
    return least


def packed(least: np.ndarray) -> np.ndarray:
    """The low bits of each row's minima, in 64-bit words."""
    lanes = (least & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(least), -1, LANES)
    return (lanes << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64)


def band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    groups = least.reshape(len(least), bands, -1).astype(np.uint64)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64), groups.shape[:2]).copy()
    for j in range(groups.shape[2]):
        key = mixed(key * np.uint64(PRIME) + groups[:, :, j])
    return key


def long_lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(np.ascontiguousarray(rows).reshape(-1).view(np.int64)))


def signed(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """Per row of ``docs (id, text)``: set size, set digest, packed b-bit minima and band keys."""
    kind = docs.schema["id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factor, salt = salts(bands * rows)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sets = [shingles(t.as_py(), k) for t in part.column(1)]
                least = np.array([minima(s, factor, salt) for s in sets], np.uint32).reshape(len(sets), bands * rows)
                one = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                two = np.array([np.bitwise_xor.reduce(mixed(s + np.uint64(PRIME))) for s in sets], np.uint64).view(np.int64)
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(one), pa.array(two), long_lists(packed(least)), long_lists(band_keys(least, bands))], ["id", "n", "one", "two", "sig", "bands"])

    return map_texts(docs, sign, f"id {kind}, n long, one long, two long, sig array<long>, bands array<long>")


def estimate(a: Column, b: Column, lanes: int) -> Column:
    """Similarity from the share of equal b-bit lanes, corrected for lanes that are equal by chance."""
    ones = F.lit(sum(1 << (BITS * i) for i in range(LANES)) - (1 << 64 if BITS == 1 else 0)).cast("long")

    def unequal(x: Column) -> Column:
        folded = x
        for i in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, i))
        return F.bit_count(folded.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    chance = 1 / (1 << BITS)
    return ((1 - differ / lanes) - chance) / (1 - chance)


def near(percent: int, lanes: int, x: str, y: str) -> Column:
    """Size and estimate filter on a pair whose columns n and sig have suffixes ``x`` and ``y``."""
    t, chance = percent / 100, 1 / (1 << BITS)
    share = t + (1 - t) * chance
    margin = 5.5 * (share * (1 - share) / lanes) ** 0.5 / (1 - chance)
    sizes = F.least(f"n{x}", f"n{y}") * 100 >= F.greatest(f"n{x}", f"n{y}") * percent
    return sizes & (estimate(F.col(f"sig{x}"), F.col(f"sig{y}"), lanes) >= t - margin)


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs (a, b)`` with the whole texts of both."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = stage(docs.where(id_filter(ids)(F.col("id"))), "near-texts")
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    kind = docs.schema["id"].dataType.simpleString()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = batch.column(2)[i].as_py()
                if a != last:
                    last, own = a, shingles(a, k)
                other = shingles(batch.column(3)[i].as_py(), k)
                common = len(np.intersect1d(own, other, assume_unique=True))
                keep[i] = 100 * common >= percent * (len(own) + len(other) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return cut(map_texts(with_texts(pairs, docs), confirm, f"a {kind}, b {kind}").distinct())


def relative(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Every ``b`` set as a difference from its ``a`` set: ``shared`` has a bit for each shingle of a, ``own`` the
    shingles that a lacks. Two sets relative to one a have an exact intersection without either text."""
    kind = docs.schema["id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base = None, None
        for batch in batches:
            shared, own = [], []
            for i in range(batch.num_rows):
                a = batch.column(2)[i].as_py()
                if a != last:
                    last, base = a, shingles(a, k)
                other = shingles(batch.column(3)[i].as_py(), k)
                bits = np.zeros(-(-len(base) // 64) * 64, np.uint8)
                bits[np.flatnonzero(np.isin(base, other, assume_unique=True))] = 1
                shared.append(np.packbits(bits, bitorder="little").view(np.int64))
                own.append(np.setdiff1d(other, base, assume_unique=True).view(np.int64))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, lists), pa.array(own, lists)], ["a", "b", "shared", "own"])

    return map_texts(with_texts(pairs, docs), encode, f"a {kind}, b {kind}, shared array<long>, own array<long>")


def common_counts(x: pa.Table, y: pa.Table, columns: int = 4096) -> np.ndarray:
    """Intersection sizes of every set of ``x`` with every set of ``y``, all relative to the same base."""
    common = np.zeros((len(x), len(y)), np.float32)
    bits = [np.stack([np.unpackbits(v.view(np.uint8), bitorder="little") for v in t.column("shared").combine_chunks().to_numpy(zero_copy_only=False)]) for t in (x, y)]
    for at in range(0, bits[0].shape[1], columns):
        common += bits[0][:, at : at + columns].astype(np.float32) @ bits[1][:, at : at + columns].T.astype(np.float32)
    own = [t.column("own").combine_chunks() for t in (x, y)]
    values = [o.flatten().to_numpy() for o in own]
    rows = [np.repeat(np.arange(len(o)), o.value_lengths().to_numpy()) for o in own]
    both = np.intersect1d(*values)
    if len(both):
        places = [np.minimum(np.searchsorted(both, v), len(both) - 1) for v in values]
        held = [both[p] == v for p, v in zip(places, values, strict=True)]
        for at in range(0, len(both), columns):
            width, sides = min(columns, len(both) - at), []
            for t, p, h, r in zip((x, y), places, held, rows, strict=True):
                inside = h & (p >= at) & (p < at + width)
                side = np.zeros((len(t), width), np.float32)
                side[r[inside], p[inside] - at] = 1
                sides.append(side)
            common += sides[0] @ sides[1].T
    return common


def forest(similar: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest, by breadth first search, over the components ``x`` (of rows) and ``y`` (of columns)."""
    codes, back = np.unique(np.r_[x, y], return_inverse=True)
    back = back.reshape(-1)
    near_by = np.zeros((len(codes), len(codes)), bool)
    i, j = np.nonzero(similar)
    near_by[back[: len(x)][i], back[len(x) :][j]] = True
    near_by |= near_by.T
    np.fill_diagonal(near_by, False)
    new, out = np.ones(len(codes), bool), []
    for root in np.flatnonzero(near_by.any(axis=1)):
        queue = [root] if new[root] else []
        new[root] = False
        while queue:
            v = queue.pop()
            found = np.flatnonzero(near_by[v] & new)
            new[found] = False
            queue.extend(found)
            out += [(int(codes[v]), int(codes[w])) for w in found]
    return out


def tile(x: pa.Table, y: pa.Table, percent: int) -> tuple[pa.Array, pa.Array]:
    """Components that sets of ``x`` and ``y`` link, as a spanning forest: fewer links than rows."""
    named = pa.chunked_array([*x.column("component").chunks, *y.column("component").chunks]).combine_chunks().dictionary_encode()
    codes = named.indices.to_numpy()
    common = common_counts(x, y)
    sizes = x.column("n").to_numpy()[:, None] + y.column("n").to_numpy()[None, :]
    links = forest(100 * common >= percent * (sizes - common), codes[: len(x)], codes[len(x) :])
    return tuple(named.dictionary.take(pa.array([link[side] for link in links], pa.int64())) for side in (0, 1))


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every end of ``links (a, b)``: the smallest id reachable. Each step hooks every vertex
    to a neighbour and contracts: by turns to the smallest id, which settles stars at once, and to the smallest
    salted hash, which on average removes a fixed share of the vertices of any chain. Steps are written as tables:
    size estimates of checkpoints would multiply from step to step."""
    edges, step = links, 0
    labels = links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    while not edges.isEmpty():
        order = lambda c, step=step: F.struct((F.xxhash64(c, F.lit(step)) if step % 2 else F.lit(0)).alias("rank"), F.col(c).alias("id"))
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy("a").agg(F.min(order("b")).alias("low")).select("a", F.least(order("a"), F.col("low"))["id"].alias("low")), "near-hook")
        of_a, of_b = hook.withColumnRenamed("low", "low_a"), hook.select(F.col("a").alias("b"), F.col("low").alias("low_b"))
        labels = stage(labels.join(hook, labels.component == hook.a, "left").select("id", F.coalesce("low", "component").alias("component")), "near-labels")
        edges = stage(edges.join(of_a, "a").join(of_b, "b").select(F.least("low_a", "low_b").alias("a"), F.greatest("low_a", "low_b").alias("b")).where("a <> b").distinct(), "near-edges")
        step += 1
    if step > 1:  # hashes were used: a component's root need not be its smallest id
        least = stage(labels.groupBy(F.col("component").alias("root")).agg(F.min("id").alias("low")), "near-least")
        labels = stage(labels.join(least, labels.component == least.root).select("id", F.col("low").alias("component")), "near-labels")
    return labels


def relabelled(labels: DataFrame, joined: DataFrame) -> DataFrame:
    """``labels`` after ``joined (a, b)``, links between components; an id without a label is its own component."""
    roots = components(joined).withColumnRenamed("id", "old").withColumnRenamed("component", "new")
    kept = labels.join(roots, labels.component == roots.old, "left").select("id", F.coalesce("new", "component").alias("component"))
    fresh = roots.join(labels, roots.old == labels.id, "left_anti").select(F.col("old").alias("id"), F.col("new").alias("component"))
    return cut(kept.unionByName(fresh))


def opened(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``members (a, b, ...)`` whose family has several components, with their own and ``outside``: not
    in the family's largest one."""
    placed = members.join(labels, members.b == labels.id, "left").withColumn("component", F.coalesce("component", "b")).drop("id")
    sizes = placed.groupBy("a", "component").agg(F.count(F.lit(1)).alias("size"))
    main = cut(sizes.groupBy("a").agg(F.max(F.struct("size", "component")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("a", F.col("main.component").alias("main")))
    return cut(placed.join(main, "a").withColumn("outside", F.col("component") != F.col("main")).drop("main"))


def blocked(rows: DataFrame, block: str) -> DataFrame:
    """``rows`` with a block number: a family's rows are dealt by hash into blocks of about BLOCK_ROWS rows and
    BLOCK_BYTES bytes at most. ``blocks`` is the family's number of blocks."""
    weight = 8 * (F.size("shared") + F.size("own"))
    n = rows.groupBy("a").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(weight) / BLOCK_BYTES)).cast("int").alias(f"{block}s"))
    dealt = rows.join(n, "a").withColumn(block, F.pmod(F.xxhash64("b", F.lit(block)), F.col(f"{block}s")).cast("int"))
    return dealt.repartition("a", block)  # or the join would leave all blocks of a family in one task


def across(families: DataFrame, sizes: DataFrame, labels: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``labels`` after all links between members of one family (documents compared with the same leader). Members
    of families with several components are dealt into blocks. First every block meets itself, which joins nearly
    all that is similar; what is then still outside its family's largest component meets the whole family, block by
    block. A task holds two blocks and gives fewer links than they have rows, however many pairs are similar."""
    rows = opened(families, labels)
    if rows.isEmpty():
        return labels
    coded = cut(rows.select("a", "b").join(sizes.toDF("b", "n"), "b").join(relative(rows.select("a", "b"), docs, k).distinct(), ["a", "b"]))
    kind = docs.schema["id"].dataType.simpleString()

    def own(group: pa.Table) -> pa.Table:
        return pa.table(tile(group, group, percent), ["a", "b"])

    held = blocked(coded.join(rows.select("a", "b", "component"), ["a", "b"]), "block")
    links = cut(held.select("a", "block", "component", "n", "shared", "own").groupBy("a", "block").applyInArrow(own, f"a {kind}, b {kind}"))
    labels = relabelled(labels, links)

    rows = opened(coded.select("a", "b"), labels)
    if rows.isEmpty():
        return labels
    rows = coded.join(rows, ["a", "b"])
    body = F.collect_list(F.struct("component", "n", "shared", "own")).alias("body")  # a block is bounded
    x = cut(blocked(rows.where("outside"), "x").groupBy("a", "x", "xs").agg(body))
    y = cut(blocked(rows, "y").groupBy("a", "y", "ys").agg(body))
    counts = x.select("a", "xs").distinct().join(y.select("a", "ys").distinct(), "a")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    met = x.drop("xs").join(counts.select("a", "ys"), "a").select("a", "x", upto("ys").alias("y"), "body", F.lit(0).alias("side"))
    met = met.unionByName(y.drop("ys").join(counts.select("a", "xs"), "a").select("a", upto("xs").alias("x"), "y", "body", F.lit(1).alias("side")))

    def apart(group: pa.Table) -> pa.Table:
        sides = (group.filter(pc.equal(group["side"], side))["body"].combine_chunks().flatten() for side in (0, 1))
        return pa.table(tile(*(pa.Table.from_struct_array(s) for s in sides), percent), ["a", "b"])

    links = cut(met.groupBy("a", "x", "y").applyInArrow(apart, f"a {kind}, b {kind}"))
    return relabelled(labels, links)


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    lanes = bands * rows
    if lanes % LANES:
        raise ValueError(f"bands * rows must be a multiple of {LANES}")
    every = cut(signed(docs, k, bands, rows))
    classes = cut(every.where("n > 0 AND id IS NOT NULL").groupBy("one", "two", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")))
    members = classes.select("id", F.explode("bands").alias("key"))
    buckets = cut(members.groupBy("key").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1").select("key", "leader"))
    sigs = classes.select("id", "n", "sig")

    families = cut(members.join(buckets, "key").where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct())
    sides = families
    for side in ("a", "b"):
        sides = sides.join(sigs.toDF(side, f"n_{side}", f"sig_{side}"), side)
    stars = cut(sides.where(near(percent, lanes, "_a", "_b")).select("a", "b"))
    links = confirmed(stars, docs, k, percent)
    labels = components(links)

    labels = across(families, classes.select("id", "n"), labels, docs, k, percent)
    named = cut(classes.select("one", "two", F.col("n").alias("size"), "id").join(labels, "id", "left").select("one", "two", "size", F.coalesce("component", "id").alias("component")))
    found = every.select("id", "n", "one", "two").alias("e").join(named.alias("c"), F.expr("e.one = c.one AND e.two = c.two AND e.n = c.size"), "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without those whose near-duplicate group has a document with a smaller id."""
    gone = cut(group(docs, doc_id, text, **options).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(doc_id)).distinct())
    return without(docs, gone)
