"""Leave-one-out classes without a fit per row.

A linear model is fitted once, on all rows. Without one of them its coefficients move by a bounded distance: the row's own
gradient over the least curvature on the way. A row whose class no move within that bound can change is settled; the few
others are fitted again. A forest's tree draws the same weights and columns whichever row is left out, so trees differ
along the row's own path alone: left-out rows go down together as long as their best cuts, each taken from the counts
without its row, agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import batched, trees

#: Rows of which tasks hold the bins, a byte per column, to walk trees over them; a forest of more rows is fitted anew.
HELD = 500_000
#: Slacks up to which machines may gain or lose rows on the way.
REACH = np.array([0.003, 0.01, 0.03, 0.1, 0.3])
#: Above the error of a fit.
TOLERANCE = 1e-6


def settled(model, rows: DataFrame, n: int, classes: int, width: int) -> DataFrame | None:
    """``id, y_true, y_pred`` of ``rows (id, label, x, place)``, each left out of the fit; no ``y_pred`` where only a fit without the row
    tells. None if the model has no such way."""
    if isinstance(model, trees.Forest):
        return forest(model, rows, classes, width) if n <= HELD else None
    ways = {batched.Logistic: logistic, batched.LinearMachine: machines, batched.FourierMachine: machines}
    return ways[type(model)](model, rows, classes, width) if type(model) in ways else None


def _sums(rows: DataFrame, size: int, part: Callable) -> np.ndarray:
    """The sum over all blocks of ``part(x, labels)``, an array of ``size`` numbers."""
    return batched.totals(rows, 1, lambda data: sum((part(x, y) for x, y, _ in data), np.zeros(size))[None])[0]


def _largest(rows: DataFrame, part: Callable) -> np.ndarray:
    """The largest values over all blocks of ``part(x, labels)``, an array."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [part(x, y) for x, y, _ in batched.blocks(batches, 1)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([np.max(found, 0)], pa.list_(pa.float64()))], ["found"])

    made = rows.select("label", "x", "out").mapInArrow(local, "found array<double>").toArrow()  # a row per partition
    return np.max(made["found"].to_pylist(), 0)


def _guessed(rows: DataFrame, guess: Callable) -> DataFrame:
    """``guess(x, labels)`` gives classes and whether they are settled."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batched.BLOCK):
                part = batch.slice(at, batched.BLOCK)
                x, y, _ = batched.arrays(part, 1)
                found, sure = guess(x, y)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(y.astype(np.int32)), pa.array(found.astype(np.int32), mask=~sure)], ["id", "y_true", "y_pred"])

    return rows.select("id", "label", "x", "out").mapInArrow(local, f"id {dict(rows.dtypes)['id']}, y_true int, y_pred int")


def _form(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """``v' m v`` of the vectors along the last axis."""
    return np.maximum(((a @ m) * a).sum(-1), 0)


def logistic(model: batched.Logistic, rows: DataFrame, classes: int, width: int) -> DataFrame:
    """Curvatures of the loss change by a factor exp(d) at most where differences of scores change by d."""
    rows = rows.withColumn("out", F.array().cast("array<int>"))
    counts = batched.class_counts(rows, 1, classes)[0]
    beta, p, lone = model.fit_tasks(rows, 1, classes, width).coefficients[0], width + 1, counts == 1
    present = np.flatnonzero(counts)
    k = len(present)
    beta = beta[present]
    ridge = np.tile(np.r_[np.full(width, model.penalty), 0.0], k) * (2.0 if k == 2 else 1.0)

    def scores(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x1 = batched.with_one(x)
        z = x1 @ beta.T
        return x1, z, batched.softmax(z, np.ones(k, bool))

    def curvature(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x1, _, q = scores(x)
        out = np.zeros((k, p, k, p))
        for a in range(k):
            for b in range(k):
                out[a, :, b] = (x1 * (q[:, a] * ((a == b) - q[:, b]))[:, None]).T @ x1
        return out.ravel()

    inverse = np.linalg.pinv(_sums(rows, (k * p) ** 2, curvature).reshape(k * p, k * p) + np.diag(ridge), rcond=1e-12, hermitian=True)
    at = inverse.reshape(k, p, k, p)
    pair = {(a, b): at[a, :, a] + at[b, :, b] - at[a, :, b] - at[b, :, a] for a in range(k) for b in range(k) if a != b}
    steepest = _largest(rows, lambda x, y: np.array([max([_form(batched.with_one(x), m).max() for m in pair.values()], default=0.0)]))[0] ** 0.5

    def guess(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x1, z, q = scores(x)
        own = np.searchsorted(present, y)
        slope = ((q - np.eye(k)[own])[:, :, None] * x1[:, None]).reshape(len(x), -1)
        share = sum(_bilinear(x1, at[a, :, b]) * q[:, a] * ((a == b) - q[:, b]) for a in range(k) for b in range(k))
        # The curvature without the row is at least 1 - share of the whole; the minimum lies within ``far``.
        force = np.divide(_form(slope, inverse) ** 0.5, 1 - share, out=np.full(len(x), np.inf), where=share < 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = np.where(steepest * force < 1, -np.log1p(-steepest * force) / steepest, np.inf) if steepest > 0 else force
        best, sure = z.argmax(1), ~lone[y]
        for a, b in pair:
            of = best == a
            gap = z[of, a] - z[of, b]
            sure[of] &= gap > _form(x1[of], pair[a, b]) ** 0.5 * far[of] + TOLERANCE * (1 + np.abs(gap))
        return present[best], sure

    return _guessed(rows, guess)


def _bilinear(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    return ((x @ m) * x).sum(1)


def machines(model: batched.LinearMachine, rows: DataFrame, classes: int, width: int) -> DataFrame:
    """A row beyond the margin moves nothing; one that its machine gets wrong stays wrong, as leaving it out cannot lower
    its own loss. For the rest, curvature comes from rows whose slack is more than any row's score moves."""
    rows = rows.withColumn("out", F.array().cast("array<int>"))
    counts = batched.class_counts(rows, 1, classes)[0]
    predict = model.fit_tasks(rows, 1, classes, width)
    lift, cost, lone = model.lift, model.cost, counts == 1
    found = {pair: beta[0] for pair, beta in predict.coefficients.items() if counts[list(pair)].all()}
    p = len(lift(np.zeros((1, width)))[0]) + 1
    inverses, steepest = {}, {}
    for (a, b), beta in found.items():

        def trained(x: np.ndarray, y: np.ndarray, a: int = a, b: int = b, beta: np.ndarray = beta) -> tuple[np.ndarray, np.ndarray]:
            own = (y == a) | (y == b)
            x1 = batched.with_one(lift(x[own]))
            return x1, 1 - np.where(y[own] == a, 1.0, -1.0) * (x1 @ beta)

        def curvature(x: np.ndarray, y: np.ndarray, trained: Callable = trained) -> np.ndarray:
            x1, slack = trained(x, y)
            return np.stack([2 * cost * (x1 * (slack > r)[:, None]).T @ x1 for r in REACH]).ravel()

        ridge = np.diag(np.r_[np.ones(p - 1), 0.0])
        own = [np.linalg.pinv(m + ridge, hermitian=True) if m[-1, -1] > 0 else None for m in _sums(rows, len(REACH) * p * p, curvature).reshape(len(REACH), p, p)]

        def spread(x: np.ndarray, y: np.ndarray, trained: Callable = trained, own: list = own) -> np.ndarray:
            x1 = trained(x, y)[0]
            return np.array([np.inf if m is None else _form(x1, m).max(initial=0.0) for m in own])

        inverses[a, b], steepest[a, b] = own, _largest(rows, spread) ** 0.5

    def guess(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sure, x1 = ~lone[y], batched.with_one(lift(x))
        for (a, b), beta in found.items():
            mine = np.flatnonzero((y == a) | (y == b))
            side = np.where(y[mine] == a, 1.0, -1.0) * (x1[mine] @ beta)
            slack, tight = np.maximum(1 - side, 0), TOLERANCE * (1 + np.abs(side))
            good = (side > 1 + tight) | (side < -tight)
            for r, m, most in zip(REACH, inverses[a, b], steepest[a, b], strict=True):
                if m is None:
                    continue
                reach = _form(x1[mine], m)
                left = 1 - 2 * cost * reach
                force = np.divide(2 * cost * slack, left, out=np.full(len(mine), np.inf), where=left > 0)
                good |= (most * force * reach**0.5 < r) & (side > force * reach + tight)
            sure[mine] &= good
        return predict(x, np.zeros(len(x), int)).argmax(1), sure

    return _guessed(rows, guess)


def tree_shares(code: np.ndarray, y: np.ndarray, h: np.ndarray, tree: int, classes: int, model: trees.Forest) -> np.ndarray:
    """Per row the class shares of the leaf that it reaches in the tree grown without it."""
    n, width = code.shape
    mtry, least, bins = max(1, int(width**0.5)), model.least, trees.BINS
    u = trees.uniform(h + trees.mixed(np.array([tree + model.seed * 104_729])))
    times = (u[:, None] > trees.POISSON[None]).sum(1)
    out, every, hot = np.zeros((n, classes), np.float32), np.arange(n), np.eye(classes)
    gain = lambda s: trees.gini(s.reshape(-1, classes)).reshape(s.shape[:-1])
    open_ = [(1, 0, every[times > 0], every)]

    def leaf(whole: np.ndarray, own: np.ndarray) -> None:
        rest = (whole - hot[y[own]] * times[own, None]).astype(np.float32)
        out[own] = rest / np.maximum(rest.sum(1, keepdims=True), 1e-12)

    while open_:
        node, level, rows, tasks = open_.pop()
        labels, weights, nodes = y[rows], times[rows], 1 << level
        whole = np.bincount(labels, weights, classes)
        if level == model.depth or whole.sum() < 2 * least or (whole > 0).sum() < 2:
            leaf(whole, tasks)
            continue
        chosen = np.arange(width)
        if mtry < width:
            draw = trees.uniform(((tree * nodes + node - nodes) * width + chosen) * 64 + level + model.seed * 7_919)
            chosen = np.sort(np.argsort(draw)[:mtry])
        codes = code[tasks][:, chosen].astype(np.int64)
        left = np.stack([np.bincount(code[rows, f].astype(np.int64) * classes + labels, weights, bins * classes).reshape(bins, classes) for f in chosen]).cumsum(1)
        # Rows of the same class, weight and bins leave the same counts; rows that the tree does not train leave all.
        key = (times[tasks] * classes + y[tasks]) * (times[tasks] > 0)
        for j in range(len(chosen)):
            key = np.unique(key * bins + codes[:, j] * (times[tasks] > 0), return_inverse=True)[1]
        first, back = np.unique(key, return_index=True, return_inverse=True)[1:]
        top = np.empty(len(first), np.int64)
        for at in range(0, len(first), 4096):
            some = first[at : at + 4096]
            gone = hot[y[tasks[some]]] * times[tasks[some], None]
            a = (left[None] - (codes[some][:, :, None] <= np.arange(bins))[..., None] * gone[:, None, None]).reshape(len(some), -1, classes)
            all_ = whole - gone
            b = all_[:, None] - a
            found = gain(a) + gain(b) - gain(all_)[:, None]
            found = np.where((a.sum(-1) >= least) & (b.sum(-1) >= least), found, -np.inf)
            best = found.argmax(1)
            top[at : at + 4096] = np.where(found[np.arange(len(some)), best] > 1e-9, best, -1)
        for cut in np.unique(top):
            own = tasks[(top == cut)[back]]
            if cut < 0:
                leaf(whole, own)
                continue
            f, b = chosen[cut // bins], cut % bins
            right, turned = code[rows, f] > b, code[own, f] > b
            for side, mask, mine in ((0, ~right, own[~turned]), (1, right, own[turned])):
                if len(mine):
                    open_.append((2 * node + side, level + 1, rows[mask], mine))
    return out


def forest(model: trees.Forest, rows: DataFrame, classes: int, width: int) -> DataFrame:
    """Trees are dealt to tasks, which hold the rows' bins; sums of shares meet by row."""
    spark, edges = rows.sparkSession, trees.bin_edges(rows, width)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = trees.coded(batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1), edges).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(list(map(bytes, code)), pa.binary())], ["place", "h", "label", "code"])

    held = trees.with_hash(rows).select("place", "h", "label", "x").mapInArrow(bins, "place long, h long, label int, code binary").toArrow()  # at most HELD rows
    place, h, y = (held[c].to_numpy().astype(np.int64) for c in ("place", "h", "label"))
    shared = spark.sparkContext.broadcast((place, np.frombuffer(b"".join(held["code"].to_pylist()), np.uint8).reshape(len(y), width), y, h.view(np.uint64)))
    names = ["place", *(f"s{c}" for c in range(classes))]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, code, y, h = shared.value
        total = np.zeros((len(y), classes))
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                total += tree_shares(code, y, h, tree, classes, model)
        for at in range(0, len(y), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(place[part]), *(pa.array(total[part, c]) for c in range(classes))], names)

    tasks = min(model.trees, 2 * spark.sparkContext.defaultParallelism)
    made = spark.range(model.trees).repartition(tasks).mapInArrow(walk, "place long, " + ", ".join(f"{c} double" for c in names[1:]))
    sums = made.groupBy("place").agg(*(F.sum(c).alias(c) for c in names[1:]))
    best, top = F.lit(0), F.col("s0")
    for c in range(1, classes):
        best, top = F.when(F.col(f"s{c}") > top, c).otherwise(best), F.greatest(top, F.col(f"s{c}"))
    whose = rows.select("place", "id", F.col("label").alias("y_true"))
    return whose.join(sums.select("place", best.cast("int").alias("y_pred")).hint("merge"), "place").select("id", "y_true", "y_pred")
