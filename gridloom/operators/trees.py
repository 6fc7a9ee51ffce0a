"""Histogram trees for many training sets at once: forests and multiclass boosting, a level of all trees per pass.

Rows are those of :mod:`gridloom.operators.batched` with ``h``, a hash of the id. Features are cut into bins at
quantiles of all rows. A pass sends every row down all trees that it trains and counts it in the cells (tree, node,
feature, bin) it reaches; a task counts a run of trees over a partition of rows in an array of at most ``CELLS`` numbers,
so what it sends on does not depend on the rows. Cells of partitions are added up by one shuffle, and each node's best
cut is found where its cells meet. The driver holds the trees, whose size is a parameter, and no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.lineage import cut
from gridloom.operators.batched import BLOCK, arrays, class_counts, softmax

BINS = 32
PAIRS = 1_000_000
#: Pairs of a row and a tree that are worked on at a time, small enough for a core's cache.
PART = 65_536
#: Numbers that a task counts in at a time.
CELLS = 4_000_000


def mixed(x: np.ndarray) -> np.ndarray:
    """Well spread 64-bit integers of integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def uniform(x: np.ndarray) -> np.ndarray:
    return (mixed(x) >> np.uint64(11)).astype(float) / (1 << 53)


#: Chances of a Poisson variable of mean 1 not to exceed 0, 1, 2..
POISSON = np.cumsum(np.exp(-1) / np.cumprod(np.r_[1.0, np.arange(1, 12)]))


def with_hash(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h", F.xxhash64("id"))


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Per feature, its distinct quantiles over all rows but the largest value: a row of bin b is at most edge b."""
    each = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f").agg(F.percentile_approx("v", [i / BINS for i in range(1, BINS)], 10_000).alias("q"), F.max("v").alias("top"))
    found = {r["f"]: np.unique([v for v in r["q"] if v < r["top"]]) for r in each.collect()}  # a row per feature
    return [found.get(f, np.zeros(0)) for f in range(width)]


def coded(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], 1) if len(edges) else np.zeros((len(x), 0), int)


class Trees:
    """Trees in heap order (root 1): feature (-1: leaf), bin and statistics of each node."""

    def __init__(self, count: int, depth: int, stats: int):
        self.depth = depth
        self.feature = np.full((count, 2 << depth), -1, np.int16)
        self.bin = np.zeros((count, 2 << depth), np.uint8)
        self.stats = np.zeros((count, 2 << depth, stats), np.float32)
        self.covers: Callable = lambda s: s.sum(-1)

    def cover(self) -> np.ndarray:
        """Training weight of each node."""
        return self.covers(self.stats)

    def leaves(self, code: np.ndarray, tree: np.ndarray, levels: int | None = None, row: np.ndarray | None = None) -> np.ndarray:
        """The node that each row of ``code``, or its rows ``row``, reaches in its tree, after at most ``levels`` cuts."""
        width, n = self.feature.shape[1], len(code) if row is None else len(row)
        node, base = np.ones(n, np.int64), np.broadcast_to(tree, n) * width
        own = (np.arange(n) if row is None else row) * code.shape[1]
        feature, bins, codes = self.feature.ravel(), self.bin.ravel(), code.ravel()
        for _ in range(self.depth if levels is None else levels):
            at = base + node
            f = feature.take(at)
            node = np.where(f >= 0, 2 * node + (codes.take(own + np.maximum(f, 0)) > bins.take(at)), node)
        return node


def cell_sums(keys: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(keys, return_inverse=True)
    return keys, np.stack([np.bincount(back, s, len(keys)) for s in stats.T], 1) if len(keys) else stats


def best_cuts(keys: np.ndarray, sums: np.ndarray, width: int, gain: Callable, weight: Callable, least: float) -> tuple:
    """Of ordered cells ((tree * nodes + node) * width + feature) * BINS + bin, each node's best cut: node, feature, bin,
    statistics left and in all; feature -1 if no cut gains with ``least`` on both sides. Ties go to the first."""
    series = keys // BINS
    first = np.flatnonzero(np.r_[True, series[1:] != series[:-1]])
    last = np.r_[first[1:], len(series)] - 1
    upto = np.cumsum(sums, 0)
    of = np.cumsum(np.r_[0, series[1:] != series[:-1]])
    left = upto - (upto[first] - sums[first])[of]
    whole = left[last][of]
    right = whole - left
    found = gain(left) + gain(right) - gain(whole)
    found = np.where((weight(left) >= least) & (weight(right) >= least), found, -np.inf)
    node = series // width
    order = np.lexsort((keys, -found, node))
    top = order[np.flatnonzero(np.r_[True, node[order][1:] != node[order][:-1]])]
    feature = np.where(found[top] > 1e-9, series[top] % width, -1)
    return node[top], feature, keys[top] % BINS, left[top], whole[top]


def dense_cuts(at: np.ndarray, chosen: np.ndarray, counts: np.ndarray, gain: Callable, weight: Callable, least: float) -> tuple:
    """:func:`best_cuts` of :func:`dense_counts` over all rows: nodes that rows reach, feature, bin, statistics left and in
    all. Columns are in order, so ties go to the first here too."""
    stats, n, many, _ = counts.shape
    whole = counts[:, :, 0].sum(-1).T
    some = counts[:, :, 0].any((0, 2))
    at, chosen, counts, whole, n = at[some], chosen[some], counts[:, some], whole[some], int(some.sum())
    left = np.cumsum(counts, -1).transpose(1, 2, 3, 0).reshape(-1, stats)
    right = np.repeat(whole, many * BINS, 0) - left
    found = gain(left) + gain(right) - np.repeat(gain(whole), many * BINS)
    found = np.where((weight(left) >= least) & (weight(right) >= least), found, -np.inf).reshape(n, many * BINS)
    top = found.argmax(1) if n else np.zeros(0, int)
    every = np.arange(n)
    feature = np.where(found[every, top] > 1e-9, chosen[every, top // BINS], -1)
    return at, feature, top % BINS, left.reshape(n, many * BINS, stats)[every, top], whole


@contextmanager
def separate_unions(spark: SparkSession) -> Iterator[None]:
    """Within, the parts of a union stay tasks of their own; Spark else puts those of a lone partition in one task."""
    name = "spark.sql.unionOutputPartitioning"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tree_runs(cells: np.ndarray, least: int) -> np.ndarray:
    """Bounds of runs of neighbouring trees of at most ``CELLS`` cells (a larger tree is alone), ``least`` runs if there
    are as many trees."""
    upto, bounds = np.cumsum(cells), [0]
    limit = max(1, min(CELLS, -(-int(upto[-1]) // max(1, least))))
    while bounds[-1] < len(cells):
        start = bounds[-1]
        bounds.append(max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit, "right"))))
    return np.array(bounds)


def dense_counts(batches: Iterator[pa.RecordBatch], trees: Trees, entries: Callable, first: int, last: int, width: int, mtry: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the trees from ``first`` to before ``last``: the open nodes of the last level, their drawn columns, and the sums
    that the rows of all batches give in each bin of these: (statistics, nodes, columns, bins)."""
    level, stats = trees.depth, trees.stats.shape[2]
    nodes = 1 << level
    live = np.ones((last - first, 1), bool) if level == 0 else np.repeat(trees.feature[first:last, nodes // 2 : nodes] >= 0, 2, 1)
    at = np.flatnonzero(live) + first * nodes
    place = np.cumsum(live.ravel()) - 1
    chosen = np.broadcast_to(np.arange(width), (len(at), width))
    if mtry < width:
        draw = uniform((at[:, None] * width + np.arange(width)) * 64 + level + seed * 7_919)
        chosen = np.sort(np.argsort(draw, 1)[:, :mtry], 1)
    many = chosen.shape[1]
    counts = np.zeros((stats, len(at) * many * BINS))
    for batch in batches:
        for code, row, tree, value in entries(batch, first, last):
            node = trees.leaves(code, tree, level, row)
            if level:
                inside = node >= nodes
                row, tree, value, node = row[inside], tree[inside], value[inside], node[inside]
            mine = place[(tree - first) * nodes + node - nodes]
            if not len(mine):
                continue
            low = int(mine.min())  # a part has neighbouring trees, so its cells lie together
            base, own, codes = (mine - low) * many * BINS, row * code.shape[1], code.ravel()
            for j in range(many):
                cell = base + codes.take(own + chosen[:, j].take(mine)) + j * BINS
                for s in range(stats):
                    sums = np.bincount(cell, value[:, s])
                    counts[s, low * many * BINS : low * many * BINS + len(sums)] += sums
    return at, chosen, counts.reshape(stats, len(at), many, BINS)


def counted(batches: Iterator[pa.RecordBatch], trees: Trees, entries: Callable, first: int, last: int, width: int, mtry: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the cells that the rows of all batches reach on the last level of the trees from ``first`` to before
    ``last``, each key once, and their sums: (statistics, cells)."""
    at, chosen, counts = dense_counts(batches, trees, entries, first, last, width, mtry, seed)
    many, counts = chosen.shape[1], counts.reshape(len(counts), -1)
    hit = np.flatnonzero(counts.any(0))
    slot = hit // BINS
    return (at[slot // many] * width + chosen[slot // many, slot % many]) * BINS + hit % BINS, counts[:, hit]


def grow(rows: DataFrame, trees: Trees, width: int, edges: list[np.ndarray], entries: Callable, gain: Callable, weight: Callable, least: float, mtry: int, seed: int, n: int) -> Trees:
    """All trees, level by level, from ``n`` rows. ``entries(batch, first, last)`` yields parts ``code, row, tree, stats``:
    the bins of a block's rows and, for pairs of a row and a tree from ``first`` to before ``last`` that it trains, the
    place of the row, the tree and its statistics."""
    count, stats = len(trees.feature), trees.stats.shape[2]
    schema = "block long, key long, " + ", ".join(f"s{i} double" for i in range(stats))
    names = ["block", "key", *(f"s{i}" for i in range(stats))]
    chosen_schema = "node long, feature long, bin long, left array<double>, whole array<double>"
    parts, context = max(1, rows.rdd.getNumPartitions()), rows.sparkSession.sparkContext
    side_by_side = min(-(-context.defaultParallelism // parts), -(-n * count // PAIRS))
    for level in range(trees.depth):
        nodes, now = 1 << level, context.broadcast((trees.feature, trees.bin))
        open_ = np.ones((count, 1), bool) if level == 0 else np.repeat(trees.feature[:, nodes // 2 : nodes] >= 0, 2, 1)
        bounds = tree_runs(open_.sum(1) * min(mtry, width) * BINS * stats, side_by_side)

        def reach(batches: Iterator[pa.RecordBatch], block: int, first: int, last: int, level: int = level, now=now) -> Iterator[pa.RecordBatch]:
            own = Trees(0, level, stats)
            own.feature, own.bin = now.value
            keys, counts = counted(batches, own, entries, first, last, width, mtry, seed)
            for some in range(0, len(keys), 100_000):
                part = slice(some, some + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[part]), block)), pa.array(keys[part]), *map(pa.array, counts[:, part])], names)

        def picks(node: np.ndarray, feature: np.ndarray, bin_: np.ndarray, left: np.ndarray, whole: np.ndarray) -> pa.Table:
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * stats), pa.array(v.ravel())) for v in (left, whole)]
            return pa.table([pa.array(node), pa.array(feature), pa.array(bin_), *lists], ["node", "feature", "bin", "left", "whole"])

        def decide(cells: pa.Table) -> pa.Table:
            keys, sums = cell_sums(cells["key"].to_numpy(), np.stack([cells[f"s{i}"].to_numpy() for i in range(stats)], 1))
            return picks(*best_cuts(keys, sums, width, gain, weight, least))

        def alone(batches: Iterator[pa.RecordBatch], block: int, first: int, last: int, level: int = level, now=now) -> Iterator[pa.RecordBatch]:
            own = Trees(0, level, stats)
            own.feature, own.bin = now.value
            yield from picks(*dense_cuts(*dense_counts(batches, own, entries, first, last, width, mtry, seed), gain, weight, least)).to_batches(10_000)

        # A run of trees is a task per partition: small tables keep all cores busy too. The only partition of a table
        # has all rows of a node, so its cells need not meet others.
        task, out = (reach, schema) if parts > 1 else (alone, chosen_schema)
        picked = None
        for block, (first, last) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            part = rows.mapInArrow(lambda batches, b=block, f=first, t=last, task=task: task(batches, b, f, t), out)
            picked = part if picked is None else picked.union(part)
        if parts > 1:
            cells = picked.repartition("block").groupBy("block", "key").agg(*(F.sum(c).alias(c) for c in names[2:]))
            picked = cells.groupBy("block").applyInArrow(decide, chosen_schema)
        with separate_unions(rows.sparkSession):
            found = picked.toArrow()  # a row per open node of the trees
        now.unpersist()
        if not found.num_rows:
            break
        node, feature, bin_ = (found[c].to_numpy() for c in ("node", "feature", "bin"))
        left, whole = (found[c].combine_chunks().flatten().to_numpy().reshape(-1, stats) for c in ("left", "whole"))
        tree, at = node // nodes, node % nodes + nodes
        if level == 0:
            trees.stats[tree, at] = whole
        cuts = feature >= 0
        tree, at, feature, bin_, left, whole = tree[cuts], at[cuts], feature[cuts], bin_[cuts], left[cuts], whole[cuts]
        trees.feature[tree, at], trees.bin[tree, at] = feature, bin_
        trees.stats[tree, 2 * at], trees.stats[tree, 2 * at + 1] = left, whole - left
        if not len(tree):
            break
    return trees


def gini(s: np.ndarray) -> np.ndarray:
    """The sum of squares over the sum, which a cut with less impurity raises."""
    total = s.sum(1)
    return np.divide((s**2).sum(1), total, out=np.zeros(len(s)), where=total > 0)


class Forest:
    """Random forests on bootstrap samples (a Poisson weight per row and tree, by hashes) with a square root of the
    columns drawn per node; a forest's class chances are the means of its leaves' shares."""

    def __init__(self, trees: int = 200, depth: int = 8, least: int = 3, seed: int = 42):
        self.trees, self.depth, self.least, self.seed = trees, depth, least, seed

    def fit_tasks(self, rows: DataFrame, tasks: int, classes: int, width: int) -> Callable:
        rows, b, seed = with_hash(rows), self.trees, self.seed
        edges, n = bin_edges(rows, width), rows.count()

        def entries(batch: pa.RecordBatch, first: int, last: int) -> Iterator[tuple]:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, y, w = arrays(part, tasks)
                code, h = coded(x, edges), part.column(part.schema.get_field_index("h")).to_numpy().view(np.uint64)
                step = max(1, PART // len(y))
                for t in range(first, last, step):
                    tree = np.arange(t, min(t + step, last))
                    u = uniform(h[:, None] + mixed(tree + seed * 104_729)[None])
                    times = np.zeros(u.shape, np.uint8)
                    for chance in POISSON:
                        times += u > chance
                    times[w[:, tree // b] == 0] = 0
                    row, own = np.nonzero(times)
                    yield code, row, tree[own], times[row, own, None] * np.eye(classes)[y[row]]

        grown = Trees(tasks * b, self.depth, classes)
        grown = grow(rows.select("label", "x", "out", "h"), grown, width, edges, entries, gini, lambda s: s.sum(1), self.least, max(1, int(width**0.5)), seed, n)

        def predict(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            code, out = coded(x, edges), np.zeros((len(x), classes))
            for k in range(b):
                own = grown.stats[t * b + k, grown.leaves(code, t * b + k)]
                out += own / np.maximum(own.sum(1, keepdims=True), 1e-12)
            return out / np.maximum(out.sum(1, keepdims=True), 1e-12)

        def parts() -> list[tuple[Trees, np.ndarray, np.ndarray]]:
            """Trees, the chosen ones and their nodes' outputs, for explanations of the first task."""
            shares = grown.stats / np.maximum(grown.stats.sum(2, keepdims=True), 1e-12)
            return [(grown, np.arange(b), shares / b)]

        predict.trees, predict.edges, predict.parts = grown, edges, parts
        return predict


class Boosting:
    """Gradient boosting with the softmax loss: in each round a tree per class on gradients and curvatures, all classes
    and tasks in the same passes. Scores start from log shares; a row's scores are staged every ``staged`` rounds."""

    def __init__(self, rounds: int = 100, rate: float = 0.1, depth: int = 3, least: int = 3, ridge: float = 1.0, staged: int = 10):
        self.rounds, self.rate, self.depth, self.least, self.ridge, self.staged = rounds, rate, depth, least, ridge, staged

    def fit_tasks(self, rows: DataFrame, tasks: int, classes: int, width: int) -> Callable:
        counts, edges, ridge, depth = class_counts(rows, tasks, classes), bin_edges(rows, width), self.ridge, self.depth
        present, every, rate = counts > 0, np.arange(tasks * classes), self.rate
        start = np.log(np.maximum(counts, 1e-300) / np.maximum(counts.sum(1, keepdims=True), 1)).ravel()
        made: list[Trees] = []

        def value(t: Trees) -> np.ndarray:
            return rate * np.divide(-t.stats[..., 0], t.stats[..., 1] + ridge, out=np.zeros(t.stats.shape[:2]), where=t.stats[..., 1] + ridge > 0)

        def added(code: np.ndarray, own: list[Trees]) -> np.ndarray:
            """The scores that trees give every row in every task and class."""
            out, n = np.zeros((len(code), len(every))), len(code)
            row, tree = np.repeat(np.arange(n), len(every)), np.tile(every, n)
            for t in own:
                out += value(t)[tree, t.leaves(code, tree, row=row)].reshape(n, -1)
            return out

        def scores(part: pa.RecordBatch) -> np.ndarray:
            return part.column(part.schema.get_field_index("score")).flatten().to_numpy().reshape(part.num_rows, -1)

        kept = rows.select("label", "x", "out").withColumn("score", F.array(*map(F.lit, start.tolist())))
        kept, since, n = cut(kept), 0, rows.count()
        for r in range(self.rounds):
            recent = made[since:]

            def entries(batch: pa.RecordBatch, first: int, last: int, recent: list[Trees] = recent) -> Iterator[tuple]:
                size = max(1, PAIRS // len(every))
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    x, y, w = arrays(part, tasks)
                    code = coded(x, edges)
                    f = (scores(part) + added(code, recent)).reshape(len(y), tasks, classes)
                    p = softmax(f, present[None])
                    g, h = p - np.eye(classes)[y][:, None], p * (1 - p)
                    row, tree = np.nonzero(np.repeat(w, classes, 1)[:, first:last])
                    tree += first
                    g, h = g.reshape(len(y), -1)[row, tree], h.reshape(len(y), -1)[row, tree]
                    yield code, row, tree, np.stack([g, h, np.ones(len(g))], 1)

            gain = lambda s: np.divide(s[:, 0] ** 2, s[:, 1] + ridge, out=np.zeros(len(s)), where=s[:, 1] + ridge > 0)
            made.append(grow(kept, Trees(len(every), depth, 3), width, edges, entries, gain, lambda s: s[:, 2], self.least, width, 0, n))
            if (r + 1) % self.staged == 0 and r + 1 < self.rounds:
                recent, since = made[since:], r + 1

                def restage(batches: Iterator[pa.RecordBatch], recent: list[Trees] = recent) -> Iterator[pa.RecordBatch]:
                    for batch in batches:
                        x = arrays(batch, tasks)[0]
                        now = scores(batch) + added(coded(x, edges), recent)
                        at = batch.schema.get_field_index("score")
                        yield batch.set_column(at, "score", pa.array(list(now), pa.list_(pa.float64())))

                kept = cut(kept.mapInArrow(restage, kept.schema))

        def predict(x: np.ndarray, t: np.ndarray) -> np.ndarray:
            code, out = coded(x, edges), start.reshape(tasks, classes)[t]
            for own in made:
                leaf = value(own)
                for k in range(classes):
                    out[:, k] += leaf[t * classes + k, own.leaves(code, t * classes + k)]
            return softmax(out, present[t])

        def parts() -> list[tuple[Trees, np.ndarray, np.ndarray]]:
            out = []
            for own in made:
                own.covers = lambda s: s[..., 2]
                nodes = np.zeros((len(every), own.feature.shape[1], classes))
                nodes[every, :, every % classes] = value(own)
                out.append((own, np.arange(classes), nodes))
            return out

        predict.trees, predict.edges, predict.parts = made, edges, parts
        return predict
