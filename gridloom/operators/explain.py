"""Shapley values of histogram trees, exactly and for any number of columns.

The game of a tree is its expected value when only some columns are known: at a cut on an unknown column both sides are
taken, in the shares of the training rows that went there. A leaf's part in that game only depends on the columns of
its own path, so its Shapley values follow from the path: per column, whether the row passes all of the path's cuts on
it, and the share of training rows that does. Sums over subsets of the path's columns come from the coefficients of a
polynomial, a product with a factor per column. They are worked out once for each of the ways to pass or fail those
columns, of which a path of m columns has 2**m, and looked up by the rows. Rows are taken in blocks; nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.trees import Trees, coded

#: Rows that are explained at a time.
ROWS = 1_000


def paths(trees: Trees, t: int) -> Iterator[tuple[int, dict[int, tuple[int, int, float]]]]:
    """The leaves of a tree with their path: per column the bins that pass, above ``low`` and at most ``high``, and the
    share of training rows that passes."""
    cover = trees.cover()
    open_: list[tuple[int, dict]] = [(1, {})]
    while open_:
        node, path = open_.pop()
        f = int(trees.feature[t, node])
        if f < 0:
            yield node, path
            continue
        b, whole = int(trees.bin[t, node]), float(cover[t, node])
        low, high, share = path.get(f, (-1, 1 << 30, 1.0))
        for child, bounds in ((2 * node, (low, min(high, b))), (2 * node + 1, (max(low, b), high))):
            part = float(cover[t, child]) / whole if whole else 0.0
            open_.append((child, path | {f: (*bounds, share * part)}))


def weights(m: int) -> np.ndarray:
    """Shapley weights of subsets of 0 to m - 1 of the other m - 1 columns."""
    return np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])


def gains(zero: np.ndarray) -> np.ndarray:
    """Of a path with the shares ``zero`` of its columns: the Shapley value of every column (for a leaf of value 1) in
    each of the ways to pass (bit set) or fail them: (2**m, m)."""
    m = len(zero)
    one = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(float)
    out, w = np.zeros((1 << m, m)), weights(m)
    for i in range(m):
        terms = np.zeros((1 << m, m))
        terms[:, 0] = 1.0
        for k, j in enumerate(x for x in range(m) if x != i):
            grown = terms * zero[j]
            grown[:, 1 : k + 2] += terms[:, : k + 1] * one[:, j, None]
            terms = grown
        out[:, i] = (terms @ w) * (one[:, i] - zero[i])
    return out


def prepared(trees: Trees, chosen: np.ndarray, value: np.ndarray) -> list[tuple]:
    """Per leaf of the trees ``chosen``: its path's columns, their lower and upper bins, their gains and its outputs."""
    out = []
    for t in chosen:
        for leaf, path in paths(trees, t):
            if path:
                low, high, share = (np.array(v) for v in zip(*path.values(), strict=True))
                out.append((np.array(list(path)), low, high, gains(share), value[t, leaf]))
    return out


def shapley(leaves: list[tuple], code: np.ndarray, outputs: int) -> np.ndarray:
    """Sum over the :func:`prepared` leaves of the Shapley values of every row: (rows, columns, outputs)."""
    turned, out = np.ascontiguousarray(code.T), np.zeros((code.shape[1], len(code), outputs))
    for columns, low, high, table, value in leaves:
        way = np.zeros(len(code), np.int64)
        for i, f in enumerate(columns):
            way += ((turned[f] > low[i]) & (turned[f] <= high[i])).astype(np.int64) << i
        live = np.flatnonzero(value)
        for i, f in enumerate(columns):
            gain = table[:, i].take(way)
            if 2 * len(live) < outputs:
                for c in live:
                    out[f][:, c] += gain * value[c]
            else:
                out[f] += (table[:, i, None] * value)[way]
    return out.transpose(1, 0, 2)


def explained(rows: DataFrame, predict: Callable, columns: list[str], classes: int) -> DataFrame:
    """``id, class, feature, value`` of a forest or of boosted trees fitted as one task: the Shapley values of its class
    chances (a forest) or class scores (boosting)."""
    kind, edges, parts = dict(rows.dtypes)["id"], predict.edges, predict.parts()
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast([leaf for part in parts for leaf in prepared(*part)])  # grows with the trees alone

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n, x = part.num_rows, part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                found = shapley(shared.value, coded(x, edges), classes)
                ids = part.column(0).take(pa.array(np.repeat(np.arange(n), len(columns) * classes)))
                names = pa.DictionaryArray.from_arrays(pa.array(np.tile(np.repeat(np.arange(len(columns)), classes), n).astype(np.int32)), pa.array(columns)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(classes, dtype=np.int32), n * len(columns))), names, pa.array(found.ravel())], ["id", "class", "feature", "value"])

    dealt = rows.select("id", "x").repartition(max(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    return dealt.mapInArrow(values, f"id {kind}, class int, feature string, value double")


def importance(values: DataFrame) -> DataFrame:
    """``feature, mean_abs_shap``: over rows and classes, from :func:`explained`."""
    return values.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_shap"))
