"""k-means of many starts at once.

Starts share every pass over the rows: the scores of all their centres are one matrix product, and the sums of all their
clusters another. A group is a number of clusters with its starts, on all rows, on a subsample by the hash of the id, on
some of the columns, or on uniform reference rows in place of the given ones. In memory :func:`fit_many` fits the starts
of a group; :func:`fit_rows` fits groups over rows of any number: tasks hold a block of rows and the centres, the driver
centres alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.lineage import stage

BLOCK = 2048
ROWS = 1024
WIDE = 2048


def sums_of(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of centres (starts, k, columns): members and sums per cluster, and per start the sum of the rows' least scores,
    which are squared distances less the row's own square."""
    s, k, d = centres.shape
    flat = centres.transpose(1, 0, 2).reshape(k * s, d)
    norm, turned = (flat * flat).sum(1), np.ascontiguousarray(-2 * flat.T)
    counts, sums, low = np.zeros(k * s), np.zeros((k * s, d)), np.zeros(s)
    for at in range(0, len(x), BLOCK):
        part = x[at : at + BLOCK]
        score = (part @ turned + norm).reshape(len(part), k, s)
        best, own = score[:, 0].copy(), np.zeros((len(part), s), np.int8 if k < 128 else np.int64)
        for j in range(1, k):
            np.putmask(own, score[:, j] < best, j)
            np.minimum(best, score[:, j], out=best)
        hot = np.empty((len(part), k, s))
        for j in range(k):
            np.equal(own, j, out=hot[:, j])
        hot = hot.reshape(len(part), k * s)
        sums += hot.T @ part
        counts += hot.sum(0)
        low += best.sum(0)
    return counts.reshape(k, s).T, sums.reshape(k, s, d).transpose(1, 0, 2), low


def moved(centres: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres in the middle of their members (of none: where they are), and how far a start's centres went, squared."""
    new = np.where(counts[..., None] > 0, sums / np.maximum(counts, 1)[..., None], centres)
    return new, ((new - centres) ** 2).sum((1, 2))


def seeded(x: np.ndarray, k: int, seeds: list[int]) -> np.ndarray:
    """Distance-weighted starting centres per seed; distances to the last centres of all seeds are taken at once."""
    rngs, squares = [np.random.default_rng(s) for s in seeds], (x * x).sum(1)
    to = lambda c: np.maximum(squares + (c * c).sum(1)[:, None] - 2 * c @ x.T, 0)
    centres = [x[[r.integers(len(x)) for r in rngs]]]
    near = to(centres[0]) if k > 1 else None
    while len(centres) < k:
        pick = [r.choice(len(x), p=v / t) if (t := v.sum()) else r.integers(len(x)) for r, v in zip(rngs, near, strict=True)]
        centres.append(x[pick])
        if len(centres) < k:
            np.minimum(near, to(centres[-1]), out=near)
    return np.stack(centres, 1)


class Single:
    """Rows of a table for steps in single precision: blocks of columns by rows, about their means and over the common
    deviation. ``parts`` are lists of the rows that a subsample has; without any there is one of all rows."""

    def __init__(self, x: np.ndarray, parts: list[np.ndarray] | None = None):
        self.middle, self.scale = x.mean(axis=0), float(np.sqrt(x.var(axis=0).mean())) or 1.0
        self.blocks = [np.ascontiguousarray(((x[at : at + WIDE] - self.middle) / self.scale).T, np.float32) for at in range(0, len(x), WIDE)]
        own = np.ones((len(parts or [0]), len(x)), np.float32)
        for row, part in zip(own, parts or [], strict=False):
            row[:] = 0
            row[part] = 1
        self.own = [np.ascontiguousarray(own[:, at : at + WIDE]) for at in range(0, len(x), WIDE)] if parts else None
        self.total, self.n = sum((own[:, i * WIDE : (i + 1) * WIDE] @ b.T).astype(float) for i, b in enumerate(self.blocks)), own.sum(1, dtype=float)

    def sums_of(self, centres: np.ndarray, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Members and sums per cluster as of :func:`sums_of`, in the part that ``of`` names for each start; the first
        cluster's are what the others leave."""
        s, k, d = centres.shape
        of = np.zeros(s, np.int64) if of is None else of
        c = (centres - self.middle) / self.scale
        norm = (c * c).sum(2)
        turned = (-2 * (c[:, 1:] - c[:, :1])).transpose(1, 0, 2).reshape(-1, d).astype(np.float32)
        shift = (norm[:, 1:] - norm[:, :1]).T.reshape(-1, 1).astype(np.float32)
        counts, sums = np.zeros((k - 1, s)), np.zeros(((k - 1) * s, d))
        for i, part in enumerate(self.blocks):
            score = turned @ part
            score += shift
            score = score.reshape(k - 1, s, -1)
            least = score.min(0)
            np.minimum(least, -np.finfo(np.float32).tiny, out=least)  # the first cluster keeps what no other is nearer to
            hot = (score == least).astype(np.float32)
            if k > 2 and hot.sum(0).max() > 1:  # of equally near ones, the first
                hot *= hot.cumsum(0) == 1
            if self.own:
                hot *= self.own[i][of]
            counts += hot.sum(2)
            sums += hot.reshape((k - 1) * s, -1) @ part.T
        counts, sums = counts.T, sums.reshape(k - 1, s, d).transpose(1, 0, 2)
        counts = np.concatenate([self.n[of, None] - counts.sum(1, keepdims=True), counts], 1)
        sums = np.concatenate([(self.total[of] - sums.sum(1))[:, None], sums], 1)
        return counts, sums * self.scale + counts[..., None] * self.middle


def fit_many(x: np.ndarray, k: int, seeds: list[int], max_iter: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Costs and centres of a k-means per seed, run until its centres stand still."""
    return next(fit_parts(x, k, [seeds], None, max_iter))


def fit_parts(x: np.ndarray, k: int, seeds: list[list[int]], parts: list[np.ndarray] | None, max_iter: int = 300) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """:func:`fit_many` of several subsamples, lists of rows, each from its own seeds. Steps are taken for all of them at
    once and in single precision as long as centres move; the step that no longer moves them, and those after it if it
    does, in double precision."""
    rows = lambda i: x if parts is None else x[parts[i]]
    centres = np.concatenate([seeded(rows(i), k, own) for i, own in enumerate(seeds)])
    limits = np.array([1e-4 * rows(i).var(axis=0).mean() for i in range(len(seeds))])
    of = np.repeat(np.arange(len(seeds)), [len(own) for own in seeds])
    live = np.flatnonzero(limits[of] > 0) if k > 1 else []
    single = Single(x, parts) if len(live) else None
    for _ in range(max_iter - 1):
        if not len(live):
            break
        new, shift = moved(centres[live], *single.sums_of(centres[live], of[live]))
        move = shift > limits[of[live]] * 1.0001
        live = live[move]
        centres[live] = new[move]
    for i, limit in enumerate(limits):
        v, own = rows(i), centres[of == i]
        live = np.arange(len(own))
        for _ in range(max_iter):
            counts, sums, _ = sums_of(v, own[live])
            own[live], shift = moved(own[live], counts, sums)
            live = live[shift > limit]
            if not len(live):
                break
        yield np.maximum((v * v).sum() + sums_of(v, own)[2], 0), own


@dataclass
class Group:
    """``k`` clusters from every seed; ``part`` numbers a subsample, ``columns`` are positions (none: all), and
    ``reference`` numbers a table of uniform rows."""

    k: int
    seeds: list[int]
    part: int | None = None
    columns: list[int] | None = None
    reference: int | None = None


def mixed(h: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """Hashes of hashes."""
    with np.errstate(over="ignore"):
        z = h + (np.asarray(salt).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(h: np.ndarray, salt: int | np.ndarray) -> np.ndarray:
    """Numbers above 0 and below 1."""
    return ((mixed(h, salt) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)


def packed(df: DataFrame, columns: list[str]) -> DataFrame:
    """``h, x``: the hashes of ids and the values of up to ``ROWS`` rows a block, as bytes; staged."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:  # the default counts rows alone
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    rows = df.select(F.xxhash64("id").alias("h"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                h, x = some.column(0).to_numpy().astype(np.int64), some.column(1).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([h.tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["h", "x"])

    # Round-robin dealing orders rows by their hash first, so a block's rows do not depend on how the input was cut.
    return stage(rows.repartition(spark.sparkContext.defaultParallelism).mapInArrow(pack, "h binary, x binary"), "blocks")


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for h, x in zip(batch.column(0), batch.column(1), strict=True):
            ids = np.frombuffer(h.as_buffer(), np.uint64)
            yield ids, np.frombuffer(x.as_buffer(), float).reshape(len(ids), -1)


def added(blocks: DataFrame, count: int, part: Callable, merge: Callable) -> list[np.ndarray]:
    """Per group: what ``part`` gives for a partition's blocks, a list of arrays, merged over the partitions."""
    schema = "place int, value binary"
    table = lambda places, values: pa.RecordBatch.from_arrays([pa.array(places, pa.int32()), pa.array([v.tobytes() for v in values], pa.binary())], ["place", "value"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = part(blocks_of(batches))
        if found is not None:
            for at in range(0, count, 64):
                yield table(list(range(at, min(at + 64, count))), found[at : at + 64])

    def together(group: pa.Table) -> pa.Table:
        out = None
        for v in group["value"]:
            value = np.frombuffer(v.as_buffer(), float)
            out = value if out is None else merge(out, value)
        return pa.Table.from_batches([table([group["place"][0].as_py()], [out])])

    rows = blocks.mapInArrow(local, schema).groupBy("place").applyInArrow(together, schema).toArrow()
    found = {p.as_py(): np.frombuffer(v.as_buffer(), float) for p, v in zip(rows["place"], rows["value"], strict=True)}
    return [found[i] for i in range(count)]


def views(groups: list[Group], h: np.ndarray, x: np.ndarray, share: float, seed: int, box: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every group's rows of a block; those of neighbours that see the same rows are made once."""
    last, own = None, (h, x)
    for g in groups:
        key = (g.reference, g.part, g.columns)
        if key != last:
            ids, rows = h, x
            if g.reference is not None:
                rows = np.random.default_rng([seed, g.reference, int(h[0])]).uniform(*box, x.shape)
            if g.part is not None:
                kept = uniform(h, seed + 7919 * (g.part + 1)) < share
                ids, rows = h[kept], rows[kept]
            last, own = key, (ids, rows if g.columns is None else rows[:, g.columns])
        yield own


def fit_rows(blocks: DataFrame, groups: list[Group], share: float = 1.0, seed: int = 42, box: tuple | None = None, max_iter: int = 300) -> list[tuple[float, np.ndarray]]:
    """Cost and centres of the best start of every group, over :func:`packed` rows. ``box`` holds the lower and upper
    ends of the reference rows."""
    plus = lambda a, b: a + b

    def moments(data: Iterator) -> list[np.ndarray] | None:
        out = None
        for h, x in data:
            found = [np.r_[len(v), v.sum(0), (v * v).sum(0)] for _, v in views(groups, h, x, share, seed, box)]
            out = found if out is None else [a + b for a, b in zip(out, found, strict=True)]
        return out

    sums = added(blocks, len(groups), moments, plus)
    limits, whole = [], []
    for s in sums:
        n, (total, squared) = s[0], s[1:].reshape(2, -1)
        limits.append(1e-4 * float((squared / n - (total / n) ** 2).mean()))
        whole.append(float(squared.sum()))
    widths = [(len(s) - 1) // 2 for s in sums]

    centres: list[np.ndarray] = [np.zeros((len(g.seeds), 0, w)) for g, w in zip(groups, widths, strict=True)]
    wide = 1 + max(widths)

    def farther(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = a.reshape(-1, wide), b.reshape(-1, wide)
        return np.where(a[:, :1] >= b[:, :1], a, b).ravel()

    for step in range(max(g.k for g in groups)):
        open_ = [i for i, g in enumerate(groups) if g.k > step]

        def drawn(data: Iterator, open_=open_, step=step) -> list[np.ndarray] | None:
            out = None  # per start: the largest of log(distance) plus a Gumbel number, and its row
            for h, x in data:
                out = out or [np.repeat(np.r_[-np.inf, np.zeros(wide - 1)][None], len(groups[i].seeds), 0) for i in open_]
                for found, i, (own, v) in zip(out, open_, views([groups[i] for i in open_], h, x, share, seed, box), strict=True):
                    if not len(v):
                        continue
                    squares = (v * v).sum(1)
                    for s, start in enumerate(groups[i].seeds):
                        c = centres[i][s]
                        near = np.maximum(squares + ((c * c).sum(1) - 2 * v @ c.T).min(1), 0) if len(c) else np.ones(len(v))
                        key = np.log(np.maximum(near, 1e-300)) - np.log(-np.log(uniform(own, start * 1009 + step)))
                        at = int(key.argmax())
                        if key[at] > found[s, 0]:
                            found[s, 0], found[s, 1 : 1 + v.shape[1]] = key[at], v[at]
            return out

        for i, f in zip(open_, added(blocks, len(open_), drawn, farther), strict=True):
            centres[i] = np.concatenate([centres[i], f.reshape(-1, wide)[:, None, 1 : 1 + widths[i]]], 1)

    def pass_(places: list[tuple[int, np.ndarray]]) -> list[tuple]:
        now = [centres[i][live] for i, live in places]

        def part(data: Iterator) -> list[np.ndarray] | None:
            out = None
            for h, x in data:
                found = []
                for c, (_, v) in zip(now, views([groups[i] for i, _ in places], h, x, share, seed, box), strict=True):
                    counts, sums, low = sums_of(v, c)
                    found.append(np.concatenate([counts.ravel(), sums.ravel(), low]))
                out = found if out is None else [a + b for a, b in zip(out, found, strict=True)]
            return out

        out = []
        for (i, live), f in zip(places, added(blocks, len(places), part, plus), strict=True):
            s, k, w = len(live), groups[i].k, widths[i]
            out.append((f[: s * k].reshape(s, k), f[s * k : s * k * (1 + w)].reshape(s, k, w), f[s * k * (1 + w) :]))
        return out

    live = [np.arange(len(g.seeds)) for g in groups]
    for _ in range(max_iter):
        places = [(i, own) for i, own in enumerate(live) if len(own)]
        if not places:
            break
        for (i, own), (counts, sums, _) in zip(places, pass_(places), strict=True):
            centres[i][own], shift = moved(centres[i][own], counts, sums)
            live[i] = own[shift > limits[i]]
    out = []
    for i, (_, _, low) in enumerate(pass_([(i, np.arange(len(g.seeds))) for i, g in enumerate(groups)])):
        best = int(low.argmin())
        out.append((max(whole[i] + float(low[best]), 0.0), centres[i][best]))
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every row."""
    return ((centres * centres).sum(1) - 2 * x @ centres.T).argmin(1)


def contingencies(blocks: DataFrame, full: np.ndarray, groups: list[Group], centres: list[np.ndarray], share: float = 1.0, seed: int = 42) -> list[np.ndarray]:
    """Per group: the rows by cluster of ``full`` centres and of the group's own."""
    k = len(full)

    def part(data: Iterator) -> list[np.ndarray] | None:
        out = None
        for h, x in data:
            out = out or [np.zeros(k * len(c)) for c in centres]
            mine = nearest(x, full)
            for total, g, c in zip(out, groups, centres, strict=True):
                own = np.ones(len(x), bool) if g.part is None else uniform(h, seed + 7919 * (g.part + 1)) < share
                v = nearest(x[own] if g.columns is None else x[own][:, g.columns], c)
                total += np.bincount(mine[own] * len(c) + v, minlength=k * len(c))
        return out

    return [t.reshape(k, -1) for t in added(blocks, len(groups), part, lambda a, b: a + b)]
