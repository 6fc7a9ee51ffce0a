"""Raster operators on pixel tables: (keys.., row, col, value)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.lineage import cut

#: Neighbour offsets (row, column) of the angles 0, 45, 90 and 135 degrees at distance 1.
ANGLES = {0: (0, 1), 45: (1, 1), 90: (1, 0), 135: (1, -1)}
#: Names of the texture measures.
HARALICK = ("asm", "contrast", "corr", "var", "idm", "savg", "svar", "sent", "ent", "dvar", "dent", "imcorr1", "imcorr2", "diss", "inertia", "shade", "prom")


def glcm(pixels: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Symmetric, normalised co-occurrence of grey levels per angle: keys, angle, i, j, p. One equi-join of pixels
    with their four forward neighbours; missing pixels are level 0."""
    cells = pixels.select(*keys, "row", "col", F.coalesce(level, F.lit(0)).alias("level"))
    steps = F.explode(F.array(*(F.struct(F.lit(a).alias("angle"), F.lit(r).alias("dr"), F.lit(c).alias("dc")) for a, (r, c) in ANGLES.items())))
    ahead = cells.select(*keys, "row", "col", "level", steps.alias("s")).select(*keys, (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), F.col("level").alias("i"), "s.angle")
    met = ahead.join(cells.withColumnRenamed("level", "j"), [*keys, "row", "col"])
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    counts = met.groupBy(*keys, "angle", "i", "j").agg(F.count(F.lit(1)).alias("n")).select(*keys, "angle", "n", both.alias("p")).groupBy(*keys, "angle", F.col("p.i").alias("i"), F.col("p.j").alias("j")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys, "angle"))  # a row per pair of levels
    return counts.select(*keys, "angle", "i", "j", (F.col("n") / total).alias("p"))


def metrics(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Contrast, homogeneity, entropy, dissimilarity, energy and correlation per angle, averaged over angles."""
    p, d = F.col("p"), (F.col("i") - F.col("j")).cast("double")
    i, j = F.col("i").cast("double"), F.col("j").cast("double")
    per = matrix.groupBy(*keys, "angle").agg(
        F.sum(p * d * d).alias("contrast"),
        F.sum(p / (1 + d * d)).alias("homogeneity"),
        (-F.sum(p * F.log2(p))).alias("entropy"),
        F.sum(p * F.abs(d)).alias("dissimilarity"),
        F.sum(p * p).alias("asm"),
        F.sum(p * i).alias("mi"),
        F.sum(p * i * i).alias("ii"),
        F.sum(p * i * j).alias("ij"),
    )
    variance = F.col("ii") - F.col("mi") * F.col("mi")
    correlation = F.coalesce(F.try_divide(F.col("ij") - F.col("mi") * F.col("mi"), variance), F.lit(1.0))
    named = per.withColumn("correlation", correlation)
    names = ("contrast", "homogeneity", "entropy", "dissimilarity", "asm", "correlation")
    return named.groupBy(*keys).agg(*(F.avg(n).alias(n) for n in names))


def haralick(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """The named texture measures of a symmetric matrix per angle, averaged over angles: asm, contrast, corr, var, idm,
    savg, svar, sent, ent, dvar, dent, imcorr1, imcorr2, diss, inertia, shade, prom, and maxcorr of
    :func:`maximal_correlation`. Natural logarithms; a measure whose denominator is 0 is 0."""
    by = [*keys, "angle"]
    m = matrix.withColumns({"i": F.col("i").cast("double"), "j": F.col("j").cast("double")})
    p, i, j = F.col("p"), F.col("i"), F.col("j")
    entropy = lambda c: -F.sum(c * F.log(c))
    margin = m.groupBy(*by, F.col("i").alias("k")).agg(F.sum("p").alias("px"))
    side = margin.groupBy(*by).agg(F.sum(F.col("px") * F.col("k")).alias("mu"), entropy(F.col("px")).alias("hx"))
    sums = m.groupBy(*by, (i + j).alias("k")).agg(F.sum("p").alias("q")).groupBy(*by).agg(F.sum(F.col("q") * F.col("k")).alias("savg"), F.sum(F.col("q") * F.col("k") * F.col("k")).alias("s2"), entropy(F.col("q")).alias("sent"))
    gaps = m.groupBy(*by, F.abs(i - j).alias("k")).agg(F.sum("p").alias("q")).groupBy(*by).agg(F.sum(F.col("q") * F.col("k")).alias("d1"), F.sum(F.col("q") * F.col("k") * F.col("k")).alias("d2"), entropy(F.col("q")).alias("dent"))
    own = lambda name, k: margin.select(*by, F.col("k").alias(k), F.col("px").alias(name))
    rows = m.join(side, by).join(own("pi", "i"), [*by, "i"]).join(own("pj", "j"), [*by, "j"])
    centred = i + j - 2 * F.col("mu")
    per = rows.groupBy(*by).agg(
        F.sum(p * p).alias("asm"),
        F.sum(p * (i - j) * (i - j)).alias("contrast"),
        F.sum(p * (i - F.col("mu")) * (j - F.col("mu"))).alias("cov"),
        F.sum(p * (i - F.col("mu")) * (i - F.col("mu"))).alias("var"),
        F.sum(p / (1 + (i - j) * (i - j))).alias("idm"),
        entropy(p).alias("ent"),
        (-F.sum(p * F.log(F.col("pi") * F.col("pj")))).alias("hxy1"),
        F.sum(p * F.abs(i - j)).alias("diss"),
        F.sum(p * centred * centred * centred).alias("shade"),
        F.sum(p * centred * centred * centred * centred).alias("prom"),
    )
    all_ = per.join(side, by).join(sums, by).join(gaps, by)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    named = all_.withColumns({
        "corr": zero(F.try_divide(F.col("cov"), F.col("var"))),
        "svar": F.col("s2") - F.col("savg") * F.col("savg"),
        "dvar": F.col("d2") - F.col("d1") * F.col("d1"),
        "imcorr1": zero(F.try_divide(F.col("ent") - F.col("hxy1"), F.col("hx"))),
        "imcorr2": F.sqrt(F.greatest(F.lit(0.0), 1 - F.exp(-2 * (2 * F.col("hx") - F.col("ent"))))),
        "inertia": F.col("contrast"),
    })
    return named.groupBy(*keys).agg(*(F.avg(n).alias(n) for n in HARALICK)).join(maximal_correlation(matrix, keys), keys)


def maximal_correlation(matrix: DataFrame, keys: list[str]) -> DataFrame:
    """The maximal correlation coefficient of a symmetric matrix per angle, averaged over angles: the root of the second
    eigenvalue of Q(i, j) = sum of p(i, k) p(j, k) / (p(i) p(k)). Q is the square of p(i, j) / root(p(i) p(j)), which is
    symmetric, so that root is the second largest of that matrix's absolute eigenvalues. A group is at most the squared
    number of grey levels. A single level has 0."""
    by = [*keys, "angle"]
    kinds = dict(matrix.dtypes)

    def second(group: pd.DataFrame) -> pd.DataFrame:
        levels, at = np.unique(np.r_[group["i"], group["j"]], return_inverse=True)
        n = len(group)
        p = np.zeros((len(levels), len(levels)))
        p[at[:n], at[n:]] = group["p"]
        root = np.sqrt(p.sum(1))
        values = np.sort(np.abs(np.linalg.eigvalsh(p / np.outer(root, root))))
        return pd.DataFrame([[*group[by].iloc[0], values[-2] if len(values) > 1 else 0.0]], columns=[*by, "maxcorr"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", maxcorr double"
    return matrix.groupBy(*by).applyInPandas(second, schema).groupBy(*keys).agg(F.avg("maxcorr").alias("maxcorr"))


def usable(pixels: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Windows with at least 9 pixels, 2 rows, 2 columns and a level that is not 0."""
    size = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{e}") for c in ("row", "col") for e, f in (("low", F.min), ("high", F.max))), F.max(level).alias("top"))
    return size.where("n >= 9 AND row_low < row_high AND col_low < col_high AND top > 0").select(*keys)


def window_texture(pixels: DataFrame, keys: list[str], level: str = "level") -> DataFrame:
    """Texture metrics of usable windows. Pixels are staged once, for the guard and for both sides of the join."""
    staged = cut(pixels.select(*keys, "row", "col", level))
    good = staged.join(usable(staged, keys, level), keys, "left_semi")
    return metrics(glcm(good, keys, level), keys)


def replace_texture(panel: DataFrame, texture: DataFrame, keys: list[str]) -> DataFrame:
    """The panel with its texture columns recomputed."""
    new = [c for c in texture.columns if c not in keys]
    return panel.drop(*new).join(texture, keys, "left")


#: Rows of a band of pixels, and pixels of a partition.
BAND, PIXELS = 64, 500_000


def neighbourhood(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every pixel with the values of its 3x3 neighbourhood, as rows to be grouped by ``keys, band, row, col``. Pixels are
    dealt by bands of rows, those at a band's edge to two, into partitions whose number grows with the pixels; a pixel is
    sent to the nine it touches inside a partition, so that neither the shuffle nor a task holds all nine."""
    spark = pixels.sparkSession
    band = lambda r: F.floor(r / BAND)
    own = pixels.select(*keys, "row", "col", F.col(value).alias("v"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-own.count() // PIXELS))
    bands = F.array_distinct(F.array(*(band(F.col("row") + r) for r in (-1, 0, 1))))
    dealt = own.withColumn("band", F.explode(bands)).repartition(parts, *keys, "band")
    offsets = F.explode(F.array(*(F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in (-1, 0, 1) for c in (-1, 0, 1))))
    sent = dealt.select(*keys, "band", "row", "col", "v", offsets.alias("o")).select(*keys, "band", (F.col("row") - F.col("o.dr")).alias("row"), (F.col("col") - F.col("o.dc")).alias("col"), "o.dr", "o.dc", "v")
    return sent.where(band(F.col("row")) == F.col("band"))


def focal_std(pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population deviation over the 3x3 neighbourhood of every existing pixel (ruggedness)."""
    spread = neighbourhood(pixels, keys, value).groupBy(*keys, "band", "row", "col").agg(F.stddev_pop("v").alias("focal_std"), F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), 1)).alias("own"))
    return spread.where("own = 1").drop("own", "band")


def terrain(pixels: DataFrame, keys: list[str], elevation: str, cell: float = 30.0) -> DataFrame:
    """Slope in degrees and aspect (sine, cosine) by Horn's gradient, for pixels with all eight neighbours."""
    at = lambda r, c: F.max(F.when((F.col("dr") == r) & (F.col("dc") == c), F.col("v")))
    n = neighbourhood(pixels, keys, elevation).groupBy(*keys, "band", "row", "col").agg(
        F.count("v").alias("n"),
        ((at(-1, 1) + 2 * at(0, 1) + at(1, 1)) - (at(-1, -1) + 2 * at(0, -1) + at(1, -1))).alias("gx"),
        ((at(1, -1) + 2 * at(1, 0) + at(1, 1)) - (at(-1, -1) + 2 * at(-1, 0) + at(-1, 1))).alias("gy"),
    )
    dx, dy = F.col("gx") / (8 * cell), F.col("gy") / (8 * cell)
    aspect = F.atan2(dy, -dx)
    return n.where("n = 9").select(*keys, "row", "col", F.degrees(F.atan(F.sqrt(dx * dx + dy * dy))).alias("slope"), F.sin(aspect).alias("aspect_sin"), F.cos(aspect).alias("aspect_cos"))
