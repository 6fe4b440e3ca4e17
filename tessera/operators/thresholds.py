"""Automatic thresholds from 256-bin histograms per image.

Bins run from an image's least to its greatest value; a bin stands for its centre. The histogram is one
aggregate (256 rows an image); all searches are windows over it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from tessera.core import Scratch, ship
from tessera.operators import raster

BINS = 256


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = BINS, lim: DataFrame | None = None) -> DataFrame:
    """``keys, bin, n, x`` (centre), ``lo, hi``; empty bins are left out. ``lim``: the limits ``keys, lo, hi``, where they are at hand."""
    lim = df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")) if lim is None else lim
    step = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    h = df.where(F.col(value).isNotNull()).join(lim, keys).groupBy(*keys, "lo", "hi", b.alias("bin")).agg(F.count("*").alias("n"))
    return h.withColumn("x", F.col("lo") + (F.col("bin") + 0.5) * step)


def _pick(h: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Centre of the bin with the greatest score (the lowest such); a flat image's own value."""
    best = h.groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col("bin")).alias("b"), F.col("x").alias("x"))).alias("m"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return best.select(*keys, F.when((F.col("lo") == F.col("hi")) | F.col("m.s").isNull(), F.col("lo")).otherwise(F.col("m.x")).alias("t"))


def otsu(df: DataFrame, keys: list[str], value: str, bins: int = BINS, lim: DataFrame | None = None) -> DataFrame:
    """Greatest between-class variance (Otsu 1979); class 0 holds the bins up to t."""
    up = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    all_ = W.partitionBy(*keys)
    h = histogram(df, keys, value, bins, lim)
    h = h.withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("x")).over(up)).withColumn("w", F.sum("n").over(all_)).withColumn("s", F.sum(F.col("n") * F.col("x")).over(all_))
    w1 = F.col("w") - F.col("w0")
    gap = F.try_divide(F.col("s0"), F.col("w0")) - F.try_divide(F.col("s") - F.col("s0"), w1)
    # rounded, so that equal variances compare equal whatever the order of the sums
    return _pick(h.withColumn("v", F.when(w1 > 0, F.round(F.col("w0") * w1 * gap * gap, 9))), keys, "v")


def yen(df: DataFrame, keys: list[str], value: str, bins: int = BINS, lim: DataFrame | None = None) -> DataFrame:
    """Yen's maximum correlation criterion (Yen et al. 1995)."""
    up = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*keys).orderBy("bin").rowsBetween(1, W.unboundedFollowing)
    h = histogram(df, keys, value, bins, lim).withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(*keys)))
    h = h.withColumn("p1", F.sum("p").over(up)).withColumn("q1", F.sum(F.col("p") * F.col("p")).over(up)).withColumn("q2", F.sum(F.col("p") * F.col("p")).over(down))
    crit = F.log(F.try_divide(F.pow(F.col("p1") * (1 - F.col("p1")), F.lit(2.0)), F.col("q1") * F.col("q2")))
    return _pick(h.withColumn("v", F.when(F.col("q2") > 0, F.round(crit, 9))), keys, "v")


def li(df: DataFrame, keys: list[str], value: str, bins: int = BINS, lim: DataFrame | None = None, tolerance: float = 1e-6, max_rounds: int = 200) -> DataFrame:
    """Minimum cross entropy (Li & Tam 1998): ``(m1 - m0) / (ln m1 - ln m0)`` of the means above and below, until it rests.

    Values are shifted so that the least is 0. The loop runs over the histogram; the driver reads one number a round.
    """
    tmp = Scratch(df.sparkSession, "li")
    h = tmp.save(histogram(df, keys, value, bins, lim).withColumn("y", F.col("x") - F.col("lo")))
    t = tmp.save(h.groupBy(*keys).agg((F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("t")))
    for _ in range(max_rounds):
        m = h.join(t, keys).groupBy(*keys, "t").agg(
            F.try_divide(F.sum(F.when(F.col("y") <= F.col("t"), F.col("y") * F.col("n"))), F.sum(F.when(F.col("y") <= F.col("t"), F.col("n")))).alias("a"),
            F.try_divide(F.sum(F.when(F.col("y") > F.col("t"), F.col("y") * F.col("n"))), F.sum(F.when(F.col("y") > F.col("t"), F.col("n")))).alias("b"),
        )
        new = F.when((F.col("a") > 0) & (F.col("b") > F.col("a")), F.try_divide(F.col("b") - F.col("a"), F.log("b") - F.log("a")))
        nxt = tmp.save(m.select(*keys, F.coalesce(new, F.col("t")).alias("t"), F.abs(F.coalesce(new, F.col("t")) - F.col("t")).alias("moved")))
        far = nxt.agg(F.max("moved")).first()[0] or 0.0
        tmp.drop(t)
        t = nxt.drop("moved")
        t._tessera_path = nxt._tessera_path
        if far <= tolerance:
            break
    lo = h.groupBy(*keys).agg(F.min("lo").alias("lo"))
    return t.join(lo, keys).select(*keys, (F.col("t") + F.col("lo")).alias("t"))


def _on_tissue(df: DataFrame, keys: list[str], valid: str, values: list[str], tmp: Scratch) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Tissue rows (all rows of images without tissue), and for each value its limits on them.

    Limits are written, one row an image: joins by image that follow one another are one stage, and a task would sort the pixels again for each.
    """
    ends = {"lo": F.min, "hi": F.max}
    per = df.groupBy(*keys).agg(F.max(valid).alias("_any"), *[g(F.when(c, F.col(v))).alias(f"_{e}{n}{i}") for i, v in enumerate(values) for e, g in ends.items() for n, c in (("t", F.col(valid)), ("a", F.lit(True)))])
    per = tmp.save(per.select(*keys, "_any", *[F.when(F.col("_any"), F.col(f"_{e}t{i}")).otherwise(F.col(f"_{e}a{i}")).alias(f"_{e}{i}") for i, v in enumerate(values) for e in ends]))
    use = df.join(per.select(*keys, "_any"), keys).where(F.col(valid) | ~F.col("_any")).drop("_any")
    return use, {v: per.select(*keys, *[F.col(f"_{e}{i}").alias(e) for e in ends]) for i, v in enumerate(values)}


def choose_orientation(df: DataFrame, keys: list[str], norm: str, valid: str, low: float = 0.005, high: float = 0.35) -> DataFrame:
    """``keys, invert``: whether 1 - x leaves the more plausible share over its own Otsu threshold.

    Thresholds come from tissue, shares from all pixels. A share in [low, high] wins; else the one nearer the middle.
    """
    tmp = Scratch(df.sparkSession, "orientation")
    d = df.select(*keys, F.col(norm).alias("x"), (1 - F.col(norm)).alias("y"), F.col(valid).alias("ok"))
    use, lim = _on_tissue(d, keys, "ok", ["x", "y"], tmp)
    a, b = (tmp.save(otsu(use, keys, v, lim=lim[v])).withColumnRenamed("t", t) for v, t in (("x", "t1"), ("y", "t2")))
    f = d.join(a, keys).join(b, keys).groupBy(*keys).agg(F.avg((F.col("x") > F.col("t1")).cast("double")).alias("f1"), F.avg((F.col("y") > F.col("t2")).cast("double")).alias("f2"))
    ok1, ok2, mid = F.col("f1").between(low, high), F.col("f2").between(low, high), (low + high) / 2
    near = F.abs(F.col("f1") - mid) <= F.abs(F.col("f2") - mid)
    return f.select(*keys, F.when(ok1 & ~ok2, F.lit(False)).when(ok2 & ~ok1, F.lit(True)).otherwise(~near).alias("invert"))


def threshold(df: DataFrame, keys: list[str], value: str, valid: str, method: str = "otsu") -> DataFrame:
    """``keys, t`` from tissue pixels (all pixels of images without tissue); unknown methods mean Otsu."""
    use, lim = _on_tissue(df.select(*keys, valid, value), keys, valid, [value], Scratch(df.sparkSession, "threshold"))
    return {"yen": yen, "li": li}.get(method, otsu)(use, keys, value, lim=lim[value])


@F.pandas_udf(StructType([StructField("v1", ArrayType(DoubleType())), StructField("v2", ArrayType(DoubleType()))]))
def _main_axes(c: pd.DataFrame) -> pd.DataFrame:
    """Eigenvectors of the two greatest eigenvalues of each 3x3 covariance, signed so that they sum to >= 0."""
    m = c[["rr", "rg", "rb", "rg", "gg", "gb", "rb", "gb", "bb"]].to_numpy(float).reshape(-1, 3, 3)
    _, vec = np.linalg.eigh(np.nan_to_num(m))
    v = vec[:, :, ::-1][:, :, :2].transpose(0, 2, 1)
    v = np.where(v.sum(axis=2, keepdims=True) < 0, -v, v)
    return pd.DataFrame({"v1": list(v[:, 0]), "v2": list(v[:, 1])})


#: Direction of the third stain in optical density (fixed values).
REFERENCE = (0.268, 0.570, 0.776)


def macenko(df: DataFrame, keys: list[str], r: str = "r", g: str = "g", b: str = "b", alpha: float = 1.0, beta: float = 0.15) -> DataFrame:
    """Pixels with ``dab``: optical density along the estimated stain vector nearest REFERENCE (Macenko et al. 2009).

    The vectors lie at the outer percentiles of the angle in the plane of the two main axes of dense pixels (all, if fewer than 100 are dense).
    """
    d = df.withColumns({k: raster.optical_density(F.col(c)) for k, c in (("_r", r), ("_g", g), ("_b", b))})
    dense = (F.col("_r") > beta) | (F.col("_g") > beta) | (F.col("_b") > beta)
    few = d.groupBy(*keys).agg((F.sum(dense.cast("int")) < 100).alias("_few"))
    use = d.join(few, keys).where(dense | F.col("_few"))
    names = ("r", "g", "b")
    cov = use.groupBy(*keys).agg(*[F.covar_samp(f"_{x}", f"_{y}").alias(x + y) for i, x in enumerate(names) for y in names[i:]])
    tmp = Scratch(df.sparkSession, "macenko")  # one row an image each, so that no stage sorts the pixels for all steps at once
    axes = tmp.save(cov.select(*keys, _main_axes(F.struct("rr", "rg", "rb", "gg", "gb", "bb")).alias("v")))
    dot = lambda v, cols: sum((v[i] * c for i, c in enumerate(cols)), F.lit(0.0))
    od = [F.col("_r"), F.col("_g"), F.col("_b")]
    angle = F.atan2(dot(F.col("v.v2"), od), dot(F.col("v.v1"), od))
    ends = use.join(axes, keys).groupBy(*keys).agg(F.percentile(angle, F.array(F.lit(alpha / 100), F.lit(1 - alpha / 100))).alias("a")).join(axes, keys)
    at = lambda k: [F.col("v.v1")[i] * F.cos(F.col("a")[k]) + F.col("v.v2")[i] * F.sin(F.col("a")[k]) for i in range(3)]

    def unit(v: list[Column]) -> list[Column]:
        n = F.sqrt(sum((x * x for x in v), F.lit(0.0))) + 1e-8
        return [x / n for x in v]

    one, two = unit(at(0)), unit(at(1))
    ref = [F.lit(x) for x in REFERENCE]
    near = F.abs(sum((x * y for x, y in zip(one, ref)), F.lit(0.0))) >= F.abs(sum((x * y for x, y in zip(two, ref)), F.lit(0.0)))
    vector = tmp.save(ends.select(*keys, *[F.when(near, x).otherwise(y).alias(f"_s{i}") for i, (x, y) in enumerate(zip(one, two))]))
    return d.join(vector, keys).withColumn("dab", F.greatest(sum((F.col(f"_s{i}") * c for i, c in enumerate(od)), F.lit(0.0)), F.lit(0.0))).select(*df.columns, "dab")


ship(__name__)
