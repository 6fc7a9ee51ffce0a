"""Clustering and its evaluation. Points are rows of ``id`` and numeric columns; assignments have ``cluster``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.lineage import cut
from gridloom.functions.ordering import exact_quantiles, placed
from gridloom.operators import starts as together
from gridloom.schema import to_long

TILE = 1024


def as_vector(df: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.array(*(F.col(c).cast("double") for c in columns))))


def compact(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` cut from its lineage, in as few partitions as its size asks for: iterative fits run many short jobs."""
    kept = cut(df)
    return kept.coalesce(max(1, -(-kept.count() // rows)))


def kmeans(df: DataFrame, columns: list[str], k: int, starts: int = 100, max_iter: int = 300, seed: int = 42):
    """The best of several starts by training cost, each fitted over the cluster: the model."""
    vectors = compact(as_vector(df, columns).select("features"))
    fits = (KMeans(k=k, maxIter=max_iter, seed=seed + i).fit(vectors) for i in range(starts))
    return min(fits, key=lambda m: m.summary.trainingCost)


def assigned(df: DataFrame, columns: list[str], model) -> DataFrame:
    return model.transform(as_vector(df, columns)).withColumnRenamed("prediction", "cluster").drop("features")


#: Rows of a cross-section that tasks hold whole, as a broadcast matrix (64 columns: 128 MB); beyond, fits share passes.
SMALL = 250_000

#: Tiles of a side at most: a point is shipped once per tile of the other side, so that shuffles grow with the points.
TILES = 32


def tile_pairs(left: DataFrame, right: DataFrame | None, columns: list[str], work: Callable, schema: str, size: int = TILE) -> DataFrame:
    """``work(a, b)`` for all pairs of tiles of two frames. A side of a pair is a list of blocks of up to ``TILE`` points:
    (table of all columns but ``columns``, matrix of these). Tiles hold blocks, ``size`` points or a share of
    1 / ``TILES`` of them; a pair is a group of its own, and a task holds two tiles as bytes. Without ``right`` two tiles of
    ``left`` meet once, and a tile meets itself as ``work(a, None)``."""
    alone, right = right is None, left if right is None else right
    spark, counts = left.sparkSession, [min(TILES, max(1, -(-df.count() // size))) for df in ((left,) if alone else (left, right))]
    counts = counts * 2 if alone else counts

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("__v")
            for first in range(0, batch.num_rows, TILE):
                some = batch.slice(first, TILE)
                rows = pa.RecordBatch.from_arrays([some.column(k) for k in range(at)], some.schema.names[:at])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema) as out:
                    out.write_batch(rows)
                x = some.column(at).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], ["rows", "x"])

    def side(df: DataFrame, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        kept = df.select("id", *[c for c in df.columns if c not in (*columns, "id")], F.array(*(F.col(c).cast("double") for c in columns)).alias("__v"))
        # Rows are dealt to as many partitions as there are tiles, so that blocks are full and tiles even.
        blocks = kept.repartition(own, F.xxhash64("id")).mapInArrow(pack, "rows binary, x binary")
        if alone:  # a tile's points follow their hashes, however often a side is made
            blocks = blocks.withColumn(names[0], F.pmod(F.spark_partition_id(), F.lit(own)))
            first, last = (F.col(names[0]), F.lit(own - 1)) if names[0] == "__a" else (F.lit(0), F.col(names[0]) - 1)
            met = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
            return blocks.withColumn(names[1], F.explode(met))
        every = F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        tile = F.pmod(F.monotonically_increasing_id() + F.spark_partition_id(), F.lit(own)).cast("int")
        return blocks.withColumn(names[0], tile).withColumn(names[1], every)

    def blocks_of(table: pa.Table) -> list:
        out = []
        for rows, x in zip(table["rows"], table["x"], strict=True):
            found = pa.ipc.open_stream(rows.as_buffer()).read_all()
            out.append((found, np.frombuffer(x.as_buffer(), float).reshape(found.num_rows, -1)))
        return out

    def met(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return work(blocks_of(a), None if alone and key[0] == key[1] else blocks_of(b))

    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None:  # the default counts rows alone
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    a, b = side(left, counts[0], counts[1], ("__a", "__b")), side(right, counts[1], counts[0], ("__b", "__a"))
    return a.groupBy("__a", "__b").cogroup(b.groupBy("__a", "__b")).applyInArrow(met, schema)


def no_rows(schema: str) -> pa.Table:
    """An empty table of a schema."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema)).empty_table()


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all rows of ``b``."""
    out = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    i, j = np.nonzero(out < 1e-6)  # cancellation: take the few very near pairs directly
    out[i, j] = ((a[i] - b[j]) ** 2).sum(1)
    return np.maximum(out, 0)


def both_sums(x: np.ndarray, of_x: np.ndarray, y: np.ndarray, of_y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of distances of every row of ``x`` to the rows of ``y`` by label 0 to ``k`` - 1, and the other way round. Rows
    come ordered by their labels."""
    to_y, to_x, turned = np.zeros((len(x), k)), np.zeros((len(y), k)), np.ascontiguousarray(-2 * y.T)
    own, other = (x * x).sum(1), (y * y).sum(1)
    ends = [np.searchsorted(of, np.arange(k + 1)) for of in (of_x, of_y)]
    for c in np.unique(of_x):
        for at in range(ends[0][c], ends[0][c + 1], 256):
            part = slice(at, min(at + 256, ends[0][c + 1]))
            d = x[part] @ turned
            d += other
            d += own[part, None]
            if d.size and d.min() < 1e-6:  # cancellation: take the few very near pairs directly
                i, j = np.nonzero(d < 1e-6)
                d[i, j] = ((x[part][i] - y[j]) ** 2).sum(1)
            np.sqrt(d, out=d)
            for e in np.unique(of_y):
                to_y[part, e] = d[:, ends[1][e] : ends[1][e + 1]].sum(1)
            to_x[:, c] += d.sum(0)
    return to_y, to_x


def distance_sums(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Per point and cluster: the sum of Euclidean distances and the number of members. Work goes by pairs of
    tiles, each taken once for both sides; only a row per point, cluster and tile leaves a task."""
    points = df.select("id", label, *columns)
    kind, lab = dict(df.dtypes)["id"], dict(df.dtypes)[label]

    def coded(blocks: list, labels: list) -> list:
        """Blocks in order of their labels: table, matrix, codes and the sums of distances to each label."""
        out, at = [], {v: c for c, v in enumerate(labels)}
        for rows, x in blocks:
            code = np.array([at[v] for v in rows[label].to_pylist()], np.int64)
            order = np.argsort(code, kind="stable")
            out.append((rows.take(pa.array(order)), x[order], code[order], np.zeros((len(x), len(labels)))))
        return out

    def measure(a: list, b: list | None) -> pa.Table:
        if not a or b == []:
            return empty
        names = pa.chunked_array([c for rows, _ in a + (b or []) for c in rows[label].chunks]).unique()
        labels = names.to_pylist()
        mine, theirs = coded(a, labels), coded(b or [], labels)
        for i, (_, x, code, total) in enumerate(mine):
            for j, (_, y, other, back) in enumerate(mine if b is None else theirs):
                if b is not None or i <= j:
                    to_y, to_x = both_sums(x, code, y, other, len(labels))
                    total += to_y
                    if b is not None or i < j:
                        back += to_x
        out = []
        for side, other in ((mine, theirs if b else mine), (theirs, mine)):
            n = sum((np.bincount(code, minlength=len(labels)) for _, _, code, _ in other), np.zeros(len(labels), np.int64))
            for rows, x, _, total in side:
                for c in np.flatnonzero(n):
                    out.append(pa.table({"id": rows["id"], "own": rows[label], "cluster": names.take(pa.array([c] * len(x))), "total": total[:, c], "n": np.full(len(x), n[c])}))
        return pa.concat_tables(out)

    schema = f"id {kind}, own {lab}, cluster {lab}, total double, n long"
    empty = no_rows(schema)
    parts = tile_pairs(points, None, columns, measure, schema)
    return parts.groupBy("id", "own", "cluster").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))


def silhouette_samples(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Euclidean silhouette per point; a singleton cluster has 0."""
    sums = distance_sums(df, columns, label)
    own = F.col("own") == F.col("cluster")
    per = sums.groupBy("id", F.col("own").alias(label)).agg(
        F.max(F.when(own, F.try_divide(F.col("total"), F.col("n") - 1))).alias("a"),
        F.max(F.when(own, F.col("n"))).alias("size"),
        F.min(F.when(~own, F.col("total") / F.col("n"))).alias("b"),
    )
    value = F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b"))
    return per.select("id", label, F.when(F.col("size") == 1, 0.0).otherwise(F.coalesce(value, F.lit(0.0))).alias("silhouette"))


def mean_silhouettes(df: DataFrame, columns: list[str], labels: dict[str, int]) -> dict[str, float]:
    """Mean Euclidean silhouette of each of several labellings: columns of codes from 0 below the given numbers. A distance
    is taken once for all of them and for both of its ends, by pairs of tiles."""
    starts_at = dict(zip(labels, np.cumsum([0, *labels.values()]).tolist(), strict=False))
    wide, kind, count = sum(labels.values()), dict(df.dtypes)["id"], df.count()
    sizes = np.zeros(wide)
    for name, at in starts_at.items():
        for r in df.groupBy(name).count().collect():  # a row per cluster
            sizes[at + r[0]] = r[1]

    def coded(blocks: list) -> list:
        out = []
        for rows, x in blocks:
            hot = np.zeros((len(x), wide))
            for name, at in starts_at.items():
                hot[np.arange(len(x)), at + rows[name].to_numpy()] = 1
            out.append((rows, x, (x * x).sum(1), hot, np.zeros((len(x), wide))))
        return out

    def measure(a: list, b: list | None) -> pa.Table:
        if not a or b == []:
            return empty
        mine = coded(a)
        theirs = mine if b is None else coded(b)
        for j, (_, y, other, to, back) in enumerate(theirs):
            turned = np.ascontiguousarray(-2 * y.T)
            for i, (_, x, own, hot, total) in enumerate(mine):
                if b is None and i > j:
                    continue
                for at in range(0, len(x), 256):
                    part = slice(at, at + 256)
                    d = x[part] @ turned
                    d += other
                    d += own[part, None]
                    if d.min() < 1e-6:  # cancellation: take the few very near pairs directly
                        p, q = np.nonzero(d < 1e-6)
                        d[p, q] = ((x[part][p] - y[q]) ** 2).sum(1)
                    np.sqrt(d, out=d)
                    total[part] += d @ to
                    if b is not None or i < j:
                        back += d.T @ hot[part]
        both = mine if b is None else mine + theirs
        return pa.concat_tables([pa.table([rows["id"], *(rows[name] for name in labels), *total.T], schema=empty.schema) for rows, _, _, _, total in both])

    schema = ", ".join([f"id {kind}", *(f"`{name}` int" for name in labels), *(f"t{i} double" for i in range(wide))])
    empty = no_rows(schema)
    parts = tile_pairs(df.select("id", *(F.col(name).cast("int").alias(name) for name in labels), *columns), None, columns, measure, schema, max(TILE, min(8 * TILE, -(-count // 8))))
    sums = parts.groupBy("id", *labels).agg(*(F.sum(f"t{i}").alias(f"t{i}") for i in range(wide)))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, row = [], np.arange(batch.num_rows)
            for at, (name, k) in zip(starts_at.values(), labels.items(), strict=True):
                own = batch[name].to_numpy()
                total, n = np.column_stack([batch[f"t{at + c}"].to_numpy() for c in range(k)]), sizes[at : at + k]
                with np.errstate(divide="ignore", invalid="ignore"):
                    near = np.where(n > 0, total / n, np.inf)
                    near[row, own] = np.inf
                    inner, outer = total[row, own] / (n[own] - 1), near.min(1)
                    value = (outer - inner) / np.maximum(inner, outer)
                out.append(np.where((n[own] > 1) & np.isfinite(value), value, 0.0))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in out], names=list(labels))

    found = sums.mapInArrow(finish, ", ".join(f"`{name}` double" for name in labels)).agg(*(F.avg(name).alias(name) for name in labels)).first()
    return {name: found[name] for name in labels}


def _centres(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m_{c}") for c in columns))


def within_between(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """One row: n, k, within sum of squares (inertia) and between sum of squares, from per-cluster moments."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)))
    p = range(len(columns))
    total = F.sum("n")
    n = F.col("n")

    def add(parts: list[Column]) -> Column:
        out = parts[0]
        for x in parts[1:]:
            out = out + x
        return out

    ssw = F.sum(n * add([F.col(f"v{i}") for i in p]))
    ssb = add([F.sum(n * F.col(f"m{i}") * F.col(f"m{i}")) - F.sum(n * F.col(f"m{i}")) * F.sum(n * F.col(f"m{i}")) / total for i in p])
    return per.agg(total.alias("n"), F.count(F.lit(1)).alias("k"), ssw.alias("ssw"), ssb.alias("ssb"))


def calinski_harabasz(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    w = within_between(df, columns, label)
    return w.select(F.try_divide(F.col("ssb") / (F.col("k") - 1), F.col("ssw") / (F.col("n") - F.col("k"))).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Mean over clusters of the worst (s_i + s_j) / d_ij; the centres are one row per cluster."""
    centres = _centres(df, columns, label).drop("n")

    def distance(pairs: list[tuple[Column, Column]]) -> Column:
        out = F.lit(0.0)
        for a, b in pairs:
            out = out + (a - b) * (a - b)
        return F.sqrt(out)

    spread = df.join(centres, label).groupBy(label).agg(F.avg(distance([(F.col(c), F.col(f"m_{c}")) for c in columns])).alias("s"), *(F.first(f"m_{c}").alias(f"m_{c}") for c in columns))
    a, b = (spread.select(*(F.col(c).alias(f"{x}{c}") for c in spread.columns)) for x in ("a_", "b_"))
    pairs = a.join(b, F.col(f"a_{label}") != F.col(f"b_{label}"))
    ratio = F.try_divide(F.col("a_s") + F.col("b_s"), distance([(F.col(f"a_m_{c}"), F.col(f"b_m_{c}")) for c in columns]))
    return pairs.groupBy(f"a_{label}").agg(F.max(ratio).alias("worst")).agg(F.avg("worst").alias("davies_bouldin"))


def _contingency(df: DataFrame, u: str, v: str) -> DataFrame:
    return df.groupBy(F.col(u).alias("u"), F.col(v).alias("v")).agg(F.count(F.lit(1)).cast("double").alias("c"))


def adjusted_rand(df: DataFrame, u: str, v: str) -> DataFrame:
    table = _contingency(df, u, v)
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    both = table.agg(pairs(F.col("c")).alias("s"), F.sum("c").alias("n"))
    rows = table.groupBy("u").agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("a"))
    cols = table.groupBy("v").agg(F.sum("c").alias("c")).agg(pairs(F.col("c")).alias("b"))
    expected = F.try_divide(F.col("a") * F.col("b"), F.col("n") * (F.col("n") - 1) / 2)
    value = F.try_divide(F.col("s") - expected, (F.col("a") + F.col("b")) / 2 - expected)
    return both.join(rows).join(cols).select(F.coalesce(value, F.lit(1.0)).alias("ari"))


def normalised_mutual_information(df: DataFrame, u: str, v: str) -> DataFrame:
    """Arithmetic normalisation, natural logarithm."""
    table = _contingency(df, u, v)
    n = table.agg(F.sum("c").alias("n"))
    entropy = lambda side, name: table.groupBy(side).agg(F.sum("c").alias("c")).join(n).agg((-F.sum(F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n")))).alias(name))
    joint = table.join(n).agg((-F.sum(F.col("c") / F.col("n") * F.log(F.col("c") / F.col("n")))).alias("huv"))
    mi = F.col("hu") + F.col("hv") - F.col("huv")
    return joint.join(entropy("u", "hu")).join(entropy("v", "hv")).select(F.coalesce(F.try_divide(2 * mi, F.col("hu") + F.col("hv")), F.lit(1.0)).alias("nmi"))


def profiles(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Size, and mean, deviation and median per column."""
    stats = [f(c).alias(f"{c}_{s}") for c in columns for s, f in (("mean", F.avg), ("std", F.stddev_samp))]
    middle = exact_quantiles(to_long(df, [label], columns), "value", (0.5,), [label, "feature"])
    wide = middle.groupBy(label).agg(*(F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(f"{c}_median") for c in columns))
    both = df.groupBy(label).agg(F.count(F.lit(1)).alias("size"), *stats).join(wide, label, "left")
    return both.select(label, "size", *(f"{c}_{s}" for c in columns for s in ("mean", "std", "median")))


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts per row label and the given column values."""
    return df.groupBy(row).agg(*(F.count(F.when(F.col(column) == v, 1)).alias(str(v)) for v in values))


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    from gridloom.operators.stats import moments

    cov, _, n = moments(df, columns)
    return cov * n / (n - 1)


def pca(df: DataFrame, columns: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Variances (largest first) and loadings, signs fixed by the largest entry, from the sample covariance."""
    values, vectors = np.linalg.eigh(covariance(df, columns))
    order = np.argsort(values)[::-1]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(len(columns))])
    return values[order], vectors * signs


def components_needed(variances: np.ndarray, share: float) -> int:
    return int(np.searchsorted(np.cumsum(variances) / variances.sum(), share) + 1)


def scores(df: DataFrame, columns: list[str], loadings: np.ndarray, n: int) -> DataFrame:
    """Centred projections ``pc1..``."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    out = {}
    for j in range(n):
        expr = F.lit(0.0)
        for i, c in enumerate(columns):
            expr = expr + (F.col(c) - F.lit(means[c])) * F.lit(float(loadings[i, j]))
        out[f"pc{j + 1}"] = expr
    return df.withColumns(out)


class Centres:
    """Cluster centres with their training cost; assigns rows to the nearest."""

    def __init__(self, centres: np.ndarray, cost: float):
        self.centres, self.cost = centres, cost

    def transform(self, df: DataFrame) -> DataFrame:
        centres = self.centres

        @F.pandas_udf("int")
        def nearest(v: pd.Series) -> pd.Series:
            x = np.array(v.tolist(), float).reshape(len(v), -1)
            return pd.Series(((x[:, None] - centres[None]) ** 2).sum(2).argmin(1))

        return df.withColumn("prediction", nearest(vector_to_array("features")))


def fit_once(x: np.ndarray, k: int, seed: int, max_iter: int = 300) -> tuple[float, np.ndarray]:
    """Cost and centres of one in-memory k-means from distance-weighted starts, run until the centres stand still."""
    rng, squares = np.random.default_rng(seed), (x * x).sum(1)
    limit = 1e-4 * x.var(axis=0).mean()
    to = lambda c: np.maximum(squares[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
    centres = x[[rng.integers(len(x))]]
    near = to(centres)[:, 0]
    while len(centres) < k:
        pick = rng.choice(len(x), p=near / near.sum()) if near.sum() else rng.integers(len(x))
        centres = np.vstack([centres, x[pick]])
        near = np.minimum(near, to(centres[-1:])[:, 0])
    for _ in range(max_iter):
        own = to(centres).argmin(1)
        n = np.bincount(own, minlength=k)[:, None]
        sums = np.column_stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])])
        moved = np.where(n > 0, sums / np.maximum(n, 1), centres)
        shift, centres = ((moved - centres) ** 2).sum(), moved
        if shift <= limit:
            break
    return float(to(centres).min(1).sum()), centres


def best_fits(df: DataFrame, columns: list[str], ks: list[int], starts: int = 100, seed: int = 42, bound: int = SMALL) -> dict[int, Centres]:
    """The best of ``starts`` k-means per k. Up to ``bound`` rows a start is a row, spread over the cluster; starts on
    larger inputs share their passes over the rows."""
    spark = df.sparkSession
    if df.count() > bound:
        groups = [together.Group(k, list(range(seed, seed + starts))) for k in ks]
        found = together.fit_rows(together.packed(df, columns), groups, seed=seed)
        return {k: Centres(centres, cost) for k, (cost, centres) in zip(ks, found, strict=True)}
    shared = spark.sparkContext.broadcast(small_matrix(df, columns, bound))  # bounded above

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, own in frame.groupby("k"):
                costs, centres = together.fit_many(shared.value, int(k), [seed + int(s) for s in own["start"]])
                yield pd.DataFrame({"k": k, "cost": costs, "centres": [m.ravel().tolist() for m in centres]}).astype({"k": "int32"})

    tasks = spark.createDataFrame([(k, s) for s in range(starts) for k in ks], "k int, start int").repartition(4 * spark.sparkContext.defaultParallelism, "k", F.floor(F.col("start") / 10))
    found = tasks.mapInPandas(run, "k int, cost double, centres array<double>").groupBy("k").agg(F.min(F.struct("cost", "centres")).alias("best"))
    return {r.k: Centres(np.array(r.best.centres).reshape(r.k, -1), r.best.cost) for r in found.collect()}


def best_fits_by_columns(df: DataFrame, sets: dict[str, list[str]], k: int, starts: int = 100, seed: int = 42, bound: int = 100_000) -> dict[str, Centres]:
    """:func:`best_fits` of ``k`` clusters on each of several lists of columns; beyond ``bound`` rows all share their passes."""
    if df.count() <= bound:
        return {name: best_fits(df, columns, [k], starts, seed, bound)[k] for name, columns in sets.items()}
    every = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    groups = [together.Group(k, list(range(seed, seed + starts)), columns=[every.index(c) for c in columns]) for columns in sets.values()]
    found = together.fit_rows(together.packed(df, every), groups, seed=seed)
    return {name: Centres(centres, cost) for name, (cost, centres) in zip(sets, found, strict=True)}


def gap_statistic(df: DataFrame, columns: list[str], ks: list[int], references: int = 50, seed: int = 42, starts: int = 100, reference_starts: int = 10, fits: dict[int, Centres] | None = None, bound: int = SMALL) -> list[tuple[int, float, float]]:
    """(k, gap, standard error) against uniform references between each column's extremes, one reference for all k.
    ``fits`` are the best fits of ``df`` if they are known. Up to ``bound`` rows a reference is a row, spread over
    the cluster; beyond, tasks draw a block of reference rows for a block of rows, and all references share passes."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.min(c).alias(f"l{i}") for i, c in enumerate(columns)), *(F.max(c).alias(f"h{i}") for i, c in enumerate(columns))).first()
    spark, n, p = df.sparkSession, row["n"], range(len(columns))
    low, high = ([float(row[f"{side}{i}"]) for i in p] for side in "lh")
    fits = fits or best_fits(df, columns, ks, starts, seed, bound)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame["reference"]:
                x = np.random.default_rng([seed, int(b)]).uniform(low, high, (n, len(low)))
                logs = [float(np.log(together.fit_many(x, k, [seed + s for s in range(reference_starts)])[0].min())) for k in ks]
                yield pd.DataFrame({"reference": b, "k": ks, "log": logs})

    if n <= bound:
        made = spark.range(references).toDF("reference").repartition(references)
        rows = made.mapInPandas(run, "reference long, k int, log double").collect()
        logs = {k: [r.log for r in sorted(rows) if r.k == k] for k in ks}
    else:
        groups = [together.Group(k, [seed + s for s in range(reference_starts)], reference=b) for b in range(references) for k in ks]
        found = together.fit_rows(together.packed(df, columns), groups, seed=seed, box=(low, high))
        logs = {k: [float(np.log(cost)) for g, (cost, _) in zip(groups, found, strict=True) if g.k == k] for k in ks}
    return [(k, float(np.mean(logs[k]) - np.log(fits[k].cost)), float(np.std(logs[k]) * np.sqrt(1 + 1 / references))) for k in ks]


def gap_choice(table: list[tuple[int, float, float]]) -> int:
    """First k whose gap reaches the next one's less its error; else the last."""
    for (k, gap, _), (_, after, se) in zip(table, table[1:], strict=False):
        if gap >= after - se:
            return k
    return table[-1][0]


def elbow(ks: list[int], inertia: list[float]) -> int:
    """The k after the largest second difference; the first of fewer than three."""
    if len(ks) < 3:
        return ks[0]
    return ks[int(np.argmax(np.diff(inertia, 2))) + 1]


def vote(votes: dict[str, int], cap: int = 5) -> int:
    """Most frequent vote, capped; a tie goes to the silhouette's vote if it is among them, else to the smallest."""
    counts = Counter(min(v, cap) for v in votes.values())
    top = max(counts.values())
    tied = sorted(k for k, c in counts.items() if c == top)
    own = min(votes["silhouette"], cap)
    return tied[0] if len(tied) == 1 or own not in tied else own


def primary_k(solutions: list[tuple[int, float]], gain: float = 0.02) -> int:
    """A larger k only where its silhouette (4 digits) beats the best so far by more than ``gain``."""
    best_k, best = None, None
    for k, value in sorted(solutions):
        value = round(value, 4)
        if best is None or value > best + gain:
            best_k, best = k, value
    return best_k


def ari_of(u: np.ndarray, v: np.ndarray) -> float:
    table = np.zeros((u.max() + 1, v.max() + 1))
    np.add.at(table, (u, v), 1)
    return table_ari(table)


def table_ari(table: np.ndarray) -> float:
    pairs = lambda c: (c * (c - 1) / 2).sum()
    s, a, b, n = pairs(table), pairs(table.sum(1)), pairs(table.sum(0)), table.sum()
    expected = a * b / (n * (n - 1) / 2)
    top = (a + b) / 2 - expected
    return float((s - expected) / top) if top else 1.0


def small_matrix(df: DataFrame, columns: list[str], bound: int = 100_000) -> np.ndarray:
    """A cross-section that is known to be small, in id order; larger ones are refused."""
    if df.count() > bound:
        raise ValueError(f"more than {bound} rows; this operator works on a cross-section")
    rows = df.select("id", F.array(*(F.col(c).cast("double") for c in columns)).alias("x")).toArrow()
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return x[pc.sort_indices(rows["id"]).to_numpy()]


def labels_of(x: np.ndarray, k: int, seed: int, starts: int) -> np.ndarray:
    """Labels of the best of several in-memory k-means."""
    costs, centres = together.fit_many(x, k, [seed + s for s in range(starts)])
    return squares(x, centres[costs.argmin()]).argmin(1)


def bootstrap_stability(df: DataFrame, columns: list[str], k: int, replicates: int = 1000, share: float = 0.8, seed: int = 42, starts: int = 10, bound: int = SMALL) -> DataFrame:
    """ARI of subsample clusterings with the full one. Up to ``bound`` rows a replicate is a row, spread over the
    cluster; replicates of larger inputs are subsamples by the hash of the id and share their passes over the rows."""
    spark = df.sparkSession
    if df.count() > bound:
        blocks, seeds = together.packed(df, columns), lambda first: list(range(first, first + starts))
        full = together.fit_rows(blocks, [together.Group(k, seeds(seed))], seed=seed)[0][1]
        groups = [together.Group(k, seeds(seed + b), part=b) for b in range(replicates)]
        centres = [c for _, c in together.fit_rows(blocks, groups, share, seed)]
        rows = [(b, table_ari(t)) for b, t in enumerate(together.contingencies(blocks, full, groups, centres, share, seed))]
        return spark.createDataFrame(rows, "replicate long, ari double")
    shared = spark.sparkContext.broadcast(small_matrix(df, columns, bound))  # bounded above

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        full = labels_of(x, k, seed, starts)
        for frame in frames:
            out, every = [], frame["replicate"].to_numpy()
            for at in range(0, len(every), 8):  # eight share their passes
                some = [int(b) for b in every[at : at + 8]]
                picks = [np.random.default_rng(seed + b + 1).permutation(len(x))[: int(len(x) * share)] for b in some]
                fits = together.fit_parts(x, k, [[seed + b + s for s in range(starts)] for b in some], picks)
                for pick, (costs, centres) in zip(picks, fits, strict=True):
                    out.append(ari_of(full[pick], squares(x[pick], centres[costs.argmin()]).argmin(1)))
            yield pd.DataFrame({"replicate": frame["replicate"], "ari": out})

    return spark.range(replicates).toDF("replicate").repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(run, "replicate long, ari double")


def perturbation_stability(df: DataFrame, columns: list[str], k: int, seed: int = 42, starts: int = 10, bound: int = 100_000) -> DataFrame:
    """Leave one column out: ARI with the full clustering and the share of changed labels. Up to ``bound`` rows a
    column is a row, spread over the cluster; fits of larger inputs share their passes over the rows."""
    spark = df.sparkSession
    if df.count() > bound:
        blocks, seeds = together.packed(df, columns), list(range(seed, seed + starts))
        groups = [together.Group(k, seeds, columns=[j for j in range(len(columns)) if j != i]) for i in range(len(columns))]
        (_, full), *rest = together.fit_rows(blocks, [together.Group(k, seeds), *groups], seed=seed)
        tables = together.contingencies(blocks, full, groups, [c for _, c in rest], seed=seed)
        rows = [(c, table_ari(t), float(1 - np.trace(t) / t.sum())) for c, t in zip(columns, tables, strict=True)]
        return spark.createDataFrame(rows, "feature string, ari double, fraction_changed double")
    shared = spark.sparkContext.broadcast(small_matrix(df, columns, bound))  # bounded above

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        full = labels_of(x, k, seed, starts)
        for frame in frames:
            labels = [labels_of(np.delete(x, int(i), axis=1), k, seed, starts) for i in frame["position"]]
            yield pd.DataFrame({"feature": [columns[int(i)] for i in frame["position"]], "ari": [ari_of(full, v) for v in labels], "fraction_changed": [float((full != v).mean()) for v in labels]})

    return spark.range(len(columns)).toDF("position").repartition(len(columns)).mapInPandas(run, "feature string, ari double, fraction_changed double")


def biplot(scored: DataFrame, loadings: np.ndarray, columns: list[str]) -> DataFrame:
    """Arrow ends of a biplot: feature, x, y: loadings of the first two components, stretched to 0.8 of the largest
    absolute score."""
    top = scored.agg(F.greatest(F.max(F.abs("pc1")), F.max(F.abs("pc2")))).first()[0]
    rows = [(c, float(loadings[i, 0] * top * 0.8), float(loadings[i, 1] * top * 0.8)) for i, c in enumerate(columns)]
    return scored.sparkSession.createDataFrame(rows, "feature string, x double, y double")


def silhouette_order(samples: DataFrame, label: str = "cluster") -> DataFrame:
    """Silhouette samples with their place in the plot: by cluster, then by value, from the smallest."""
    return placed(samples, [label, "silhouette", "id"])


def profile_heatmap(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Cluster means, standardised over the clusters."""
    from gridloom.operators.eda import standardised

    return standardised(df.groupBy(label).agg(*(F.avg(c).alias(c) for c in columns)), columns)


def parallel_coordinates(df: DataFrame, columns: list[str], label: str = "cluster") -> DataFrame:
    """Every column between 0 and 1, in long form: id, cluster, feature, value."""
    from gridloom.operators.eda import min_max

    return to_long(min_max(df.select("id", label, *columns), columns), ["id", label], columns)


def cheapest_merge(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per cluster with centre ``x`` and size ``n``: Ward's cost of the cheapest merge with one of ``y`` and ``m``, and its
    row, the first of equals. ``own`` is the cluster's own row among them, or -1; without another the cost is infinite."""
    turned, squared, alone = np.ascontiguousarray(-2 * y.T), (y * y).sum(1), (n == 1).all() and (m == 1).all()
    cost, at = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    for first in range(0, len(x), 256):
        part = slice(first, first + 256)
        v, mine = x[part], np.flatnonzero(own[part] >= 0)
        d = v @ turned
        d += squared
        d += (v * v).sum(1)[:, None]
        d[mine, own[part][mine]] = np.inf
        for i in np.flatnonzero(d.min(1) < 1e-6):  # cancellation: take the few rows with a very near one directly
            d[i] = ((y - v[i]) ** 2).sum(1)
            if own[first + i] >= 0:
                d[i, own[first + i]] = np.inf
        d *= 0.5 if alone else m / (n[part, None] + m)
        at[part] = d.argmin(1)
        cost[part] = d[np.arange(len(v)), at[part]] * n[part]
    return cost, at


def ward_merges(x: np.ndarray, sizes: np.ndarray) -> list[tuple[float, int, int]]:
    """All merges of clusters with these centres and sizes: cost, the one that goes, the one that stays. A round merges all
    pairs that are each other's cheapest; only clusters that are new, or whose cheapest went, are compared again."""
    x, n, names, merges = x.astype(float).copy(), sizes.astype(float).copy(), np.arange(len(x)), []
    stale, cost, other = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
    while len(x) > 1:
        cost[stale], other[stale] = cheapest_merge(x[stale], n[stale], x, n, stale)
        place = np.arange(len(x))
        keep = place[(other[other] == place) & (place < other)]
        if not len(keep):
            if len(stale) < len(x):  # a new cluster may be as cheap as the one that is kept in mind
                stale = place
                continue
            a = int(cost.argmin())  # costs that differ by rounding alone between their two directions
            keep, other[other[a]] = np.array([a]), a
        gone = other[keep]
        merges += zip(cost[keep].tolist(), names[gone].tolist(), names[keep].tolist(), strict=True)
        total = n[keep] + n[gone]
        x[keep] = (x[keep] * n[keep, None] + x[gone] * n[gone, None]) / total[:, None]
        n[keep] = total
        touched, live = np.zeros(len(x), bool), np.ones(len(x), bool)
        touched[keep], touched[gone], live[gone] = True, True, False
        again = (touched | touched[other])[live]
        other = (np.cumsum(live) - 1)[other][live]
        x, n, names, cost = x[live], n[live], names[live], cost[live]
        stale = np.flatnonzero(again)
    return merges


def joined_labels(n: int, merges: list[tuple[float, int, int]]) -> np.ndarray:
    """Numbers of the clusters of ``n`` after merges, by first member."""
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for _, a, b in merges:
        parent[root(a)] = root(b)
    roots = [root(i) for i in range(n)]
    names = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    return np.array([names[r] for r in roots])


def ward_labels(x: np.ndarray, k: int) -> np.ndarray:
    """Ward clusters cut to k; for cross-sections."""
    return joined_labels(len(x), sorted(ward_merges(x, np.ones(len(x))))[: len(x) - k])


def ward_nearest(some: DataFrame, state: DataFrame, columns: list[str], count: int) -> DataFrame:
    """``id, cost, other``: for some clusters the one of ``state (id, n, columns)``, of ``count`` rows, that is cheapest to
    merge with, by pairs of tiles."""
    kind = dict(state.dtypes)["id"]

    def whole(blocks: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, n = (np.concatenate([rows[c].to_numpy() for rows, _ in blocks]) for c in ("id", "n"))
        order = np.argsort(ids, kind="stable")  # of equal costs, the smaller id
        return ids[order], n[order], np.concatenate([x for _, x in blocks])[order]

    def cheapest(a: list, b: list) -> pa.Table:
        if not a or not b:
            return empty
        (ids, n, x), (there, m, y) = whole(a), whole(b)
        at = np.minimum(np.searchsorted(there, ids), len(there) - 1)
        cost, best = cheapest_merge(x, n, y, m, np.where(there[at] == ids, at, -1))
        found = np.isfinite(cost)
        return pa.table({"id": ids[found], "cost": cost[found], "other": there[best[found]]}).cast(empty.schema)

    schema = f"id {kind}, cost double, other {kind}"
    empty = no_rows(schema)
    size = max(TILE, min(16 * TILE, -(-count // 8)))
    parts = tile_pairs(some, state, columns, cheapest, schema, size).groupBy("id").agg(F.min(F.struct("cost", "other")).alias("s"))
    return parts.select("id", "s.*")


def ward(df: DataFrame, columns: list[str], k: int, bound: int = 20_000) -> DataFrame:
    """``id, cluster``: Ward clusters cut to k. Equal points are one cluster from the start. Beyond ``bound`` clusters, rounds
    over the cluster merge all pairs that are each other's cheapest, which gives the tree of one-by-one merging, as a merge
    never makes a third cluster cheaper than both were. So only clusters that are new, or whose cheapest went, are compared
    with all again, tile by tile; the last ``bound`` are merged in memory. The k - 1 dearest merges of all are then left out,
    from the top down."""
    kind = dict(df.dtypes)["id"]
    rows = cut(df.select("id", F.array(*(F.col(c).cast("double") for c in columns)).alias("v")))
    places = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("n")))
    state = places.select("id", "n", *(F.col("v")[i].alias(c) for i, c in enumerate(columns)))
    count, rounds, dearest, near = state.count(), [], [], None
    while count > max(bound, k):
        fresh = near is None
        near = cut(ward_nearest(state, state, columns, count)) if fresh else near
        back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = cut(near.where("id < other").join(back, ["id", "other"]).select(F.col("id").alias("keep"), F.col("other").alias("gone"), "cost"))
        merged = pairs.count()
        if not merged and not fresh:  # a new cluster may be as cheap as the one that is kept in mind
            near = None
            continue
        if not merged:  # costs that differ by rounding alone between their two directions
            pairs = cut(near.orderBy("cost", "id").limit(1).select(F.least("id", "other").alias("keep"), F.greatest("id", "other").alias("gone"), "cost"))
            merged = 1
        dearest += [(r["cost"], len(rounds), r["gone"]) for r in pairs.orderBy(F.desc("cost"), "gone").limit(k - 1).collect()]
        side = lambda name: state.select(F.col("id").alias(name), F.col("n").alias(f"{name}_n"), *(F.col(c).alias(f"{name}_{c}") for c in columns))
        both = pairs.join(side("keep"), "keep").join(side("gone"), "gone")
        total = F.col("keep_n") + F.col("gone_n")
        new = both.select(F.col("keep").alias("id"), total.alias("n"), *(((F.col(f"keep_{c}") * F.col("keep_n") + F.col(f"gone_{c}") * F.col("gone_n")) / total).alias(c) for c in columns))
        touched = pairs.select(F.explode(F.array("keep", "gone")).alias("id"))
        state = cut(state.join(touched, "id", "left_anti").unionByName(new))
        rounds.append(pairs)
        count -= merged
        if count > max(bound, k):
            valid = cut(near.join(touched, "id", "left_anti").join(touched.withColumnRenamed("id", "other"), "other", "left_anti").select("id", "cost", "other"))
            near = cut(valid.unionByName(ward_nearest(state.join(valid, "id", "left_anti"), state, columns, count)))
    last = state.orderBy("id").toArrow()  # bounded above
    ids = last["id"].to_pylist()
    merges = sorted(ward_merges(np.column_stack([last[c].to_numpy() for c in columns]), last["n"].to_numpy()))
    every = sorted([*dearest, *((c, len(rounds), i) for i, (c, _, _) in enumerate(merges))], key=lambda m: m[:2])
    out = every[len(every) - (k - 1) :] if 1 < k <= len(every) else every if k > 1 else []
    left = {i for _, r, i in out if r == len(rounds)}
    own = joined_labels(len(ids), [m for i, m in enumerate(merges) if i not in left])
    labels = df.sparkSession.createDataFrame([(i, int(c)) for i, c in zip(ids, own, strict=True)], f"id {kind}, cluster int")
    names = int(own.max()) + 1 if len(own) else 0
    for at in range(len(rounds) - 1, -1, -1):
        cluster = F.col("cluster")
        for _, r, gone in out:
            if r == at:
                cluster, names = F.when(F.col("gone") == gone, F.lit(names)).otherwise(cluster), names + 1
        labels = cut(labels.unionByName(rounds[at].join(labels, F.col("keep") == F.col("id")).select(F.col("gone").alias("id"), cluster.cast("int").alias("cluster"))))
    copies = rows.join(places.select("v", F.col("id").alias("own")), "v").select("id", "own")
    labels = copies.join(labels.withColumnRenamed("id", "own"), "own").select("id", "own", "cluster")
    if names < k:  # fewer places than clusters: copies become clusters of their own
        more = labels.where("id <> own").orderBy(F.desc("id")).limit(k - names).collect()
        for i, r in enumerate(more):
            labels = labels.withColumn("cluster", F.when(F.col("id") == r["id"], F.lit(names + i)).otherwise(F.col("cluster")))
    return labels.select("id", "cluster")


def majority(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Most frequent value per group; ties go to the smallest."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col(value))).alias("majority"), F.max("n").alias("votes"))
