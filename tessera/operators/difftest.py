"""Differential analysis: every feature against every phenotype, in one job over long tables.

Input rows are ``keys..., phenotype, feature, image, level, value``. Levels compare as strings. A value that is
null does not count; a level counts once it has a value.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.core import Scratch, ship
from tessera.operators import scans
from tessera.operators import tiles as TL


def tested(long: DataFrame) -> DataFrame:
    return long.where(F.col("value").isNotNull() & F.col("level").isNotNull()).withColumn("level", F.col("level").cast("string"))


def counted(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per test, level and distinct value: how often it occurs (``c``). A very common value is one row a level."""
    return tested(long).groupBy(*keys, "level", "value").agg(F.count("*").alias("c"))


#: One image in so many gives the bounds of first images.
BOUND = 512


def first_images(t: DataFrame, by: list[str], groups: DataFrame | None = None) -> DataFrame:
    """The smallest image of each group: ``_k0, _k1, ..., first_image``.

    Spark can only sort for an extreme of strings, all rows of a task. So bounds come first, from one image in BOUND by hash; only images below their group's bound (all, where it has none) can be the smallest.

    With a written table of the ``groups``, and a bound for each of them, images above all bounds are left out where they are read: a plain filter, which Spark moves below joins and explosions.
    """
    t = t.select(*by, "image").where("image is not null")
    bound = t.where(F.pmod(F.xxhash64("image"), F.lit(BOUND)) == 0).distinct().groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(F.min("image").alias("_bound"))
    if groups is not None:
        bound = Scratch(t.sparkSession, "first").save(bound)
        if groups.join(bound, scans.same(by), "left_anti").isEmpty():
            t = t.where(F.col("image") < F.lit(bound.agg(F.max("_bound")).first()[0]))
    low = t.join(F.broadcast(bound), scans.same(by), "left").where(F.col("_bound").isNull() | (F.col("image") < F.col("_bound"))).select(*by, "image").distinct()
    low = low.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)], "image").unionByName(bound.withColumnRenamed("_bound", "image"))
    return low.groupBy(*[f"_k{i}" for i in range(len(by))]).agg(F.min("image").alias("first_image"))


def group_stats(long: DataFrame, keys: list[str]) -> DataFrame:
    """Per test and level: ``n, mean, var`` and the first image that has the level."""
    t, by = tested(long), [*keys, "level"]
    stats = t.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("var"))
    return stats.join(first_images(t, by), scans.same(by), "left").drop(*[f"_k{i}" for i in range(len(by))])


def counted_stats(values: DataFrame, keys: list[str], long: DataFrame) -> DataFrame:
    """``group_stats`` from the written counts of values; of the long rows only the images are read."""
    by, names = [*keys, "level"], [f"_k{i}" for i in range(len(keys) + 1)]
    tmp = Scratch(long.sparkSession, "stats")
    c, v = F.col("c"), F.col("value").cast("double")
    mean = tmp.save(values.groupBy(*by).agg(F.sum("c").alias("n"), (F.sum(c * v) / F.sum("c")).alias("mean")))
    far = values.join(mean.select(*[F.col(k).alias(n) for k, n in zip(by, names)], "mean"), scans.same(by)).groupBy(*names).agg(F.sum(c * (v - F.col("mean")) * (v - F.col("mean"))).alias("_far"))
    stats = mean.join(far, scans.same(by)).select(*by, "n", "mean", F.try_divide(F.col("_far"), F.col("n") - 1).alias("var"))
    return stats.join(first_images(tested(long), by, mean), scans.same(by), "left").drop(*names)


def gate(stats: DataFrame, keys: list[str], min_per_group: int = 2) -> DataFrame:
    """Per test: which test applies (``insufficient``, ``welch_t``, ``kruskal``), levels and n."""
    g = stats.groupBy(*keys).agg(F.count("*").alias("levels"), F.min("n").alias("least"), F.sum("n").alias("n"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("level", "mean")))).alias("means"))
    kind = F.when((F.col("n") < 2) | (F.col("levels") < 2) | (F.col("least") < min_per_group), "insufficient").when(F.col("levels") == 2, "welch_t").otherwise("kruskal")
    return g.select(*keys, kind.alias("test"), "levels", "n", "means")


def two_level(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Per test with two levels: Welch's t and degrees of freedom, and Cohen's d (levels by first image)."""
    s = stats.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("level", "n", "mean", "var", "first_image"))).alias("l")).where(F.size("l") == 2)
    by_image = F.array_sort("l", lambda a, b: F.when(a["first_image"] < b["first_image"], -1).when(a["first_image"] > b["first_image"], 1).when(a["level"] < b["level"], -1).otherwise(1))
    s = s.select(*keys, F.col("l")[0].alias("a"), F.col("l")[1].alias("b"), by_image.alias("o"))
    va, vb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    t = F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(va + vb))
    df = F.try_divide((va + vb) * (va + vb), va * va / (F.col("a.n") - 1) + vb * vb / (F.col("b.n") - 1))
    x, y = F.col("o")[0], F.col("o")[1]
    pooled = F.sqrt(((x["n"] - 1) * x["var"] + (y["n"] - 1) * y["var"]) / (x["n"] + y["n"] - 2))
    enough = (F.col("a.n") >= 2) & (F.col("b.n") >= 2)
    return s.select(*keys, F.when(enough, t).alias("t"), F.when(enough, df).alias("df"), F.when(enough, F.try_divide(x["mean"] - y["mean"], pooled)).alias("effect_d"))


def mid_ranks(long: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``rank`` (ties share their mean rank) and ``ties`` (size of the tie) among the values of a test."""
    return scans.mid_ranks(tested(long), keys, "value")


def _rank_sums(keys: list[str]):
    """Of each test's stretch of a range (sorted counted values): per level the count, the sum of ranks inside the stretch, and the tie terms."""

    def run(batches):
        for rows in TL.cut(batches, keys):
            v, c = rows.column("value").to_numpy(), rows.column("c").to_numpy().astype(float)
            first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            t = np.add.reduceat(c, first)
            of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
            rank = (np.cumsum(t) - (t - 1) / 2)[of]
            level = rows.column("level").combine_chunks().dictionary_encode()
            at, k = level.indices.to_numpy(), len(level.dictionary)
            part = rows.column("_part").slice(0, 1).combine_chunks().take(pa.array(np.zeros(k, np.int64)))
            sums = {n: np.bincount(at, w, k) for n, w in (("n", c), ("r", c * rank), ("ties", c * (t[of] ** 2 - 1)))}
            yield from pa.table(TL.repeated(rows, keys, k) | {"_part": part, "level": level.dictionary} | sums).to_batches()

    return run


def kruskal(long: DataFrame, keys: list[str], values: DataFrame | None = None) -> DataFrame:
    """Per test: H with tie correction and its degrees of freedom; H is null if all values are equal. ``values``: the table's ``counted``, if written before.

    Values are counted, cut into ranges of one order and ranked inside them; a level's sum of ranks over a range then only lacks the number of values
    before the range, times the level's count: no row is joined with its rank, and no test is sorted in one task.
    """
    r = scans.Ranged(counted(long, keys) if values is None else values, keys, ["value"], keep=False)
    kinds = TL.schema_of(r.rows, [*keys, "_part", "level"], n="double", r="double", ties="double")
    per = r.tmp.save(r.rows.mapInArrow(_rank_sums(keys), kinds))
    d = r.with_offsets(per, r.offsets(per, F.sum("n")))
    level = d.groupBy(*keys, "level").agg(F.sum("n").alias("n"), F.sum(F.col("r") + F.coalesce("_off", F.lit(0.0)) * F.col("n")).alias("r"), F.sum("ties").alias("ties"))
    whole = level.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), F.sum("ties").alias("ties"))
    n = F.col("n")
    h = F.try_divide(12 * F.col("s"), n * (n + 1)) - 3 * (n + 1)
    fix = 1 - F.try_divide(F.col("ties"), n * n * n - n)
    return whole.select(*keys, F.when(fix > 1e-14, h / fix).alias("h"), (F.col("k") - 1).alias("df"))


def _beta_cf(a, b, x):
    """Continued fraction of the incomplete beta function (Lentz's method), elementwise."""
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
    return h


def t_tail(t, df):
    """Two-sided p of Student's t."""
    from math import lgamma

    t, df = np.asarray(t, float), np.asarray(df, float)
    x = df / (df + t * t)
    a, b = df / 2, np.full_like(df, 0.5)
    lg = np.vectorize(lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(lg(a + b) - lg(a) - lg(b) + a * np.log(x) + b * np.log1p(-x))
        low = front * _beta_cf(a, b, x) / a
        high = 1 - front * _beta_cf(b, a, 1 - x) / b
    p = np.where(x < (a + 1) / (a + b + 2), low, high)
    return np.where(t == 0, 1.0, np.where(np.isinf(t), 0.0, np.clip(p, 0, 1)))


def chi2_tail(h, df):
    """Upper tail of chi-square."""
    from math import lgamma

    a, x = np.asarray(df, float) / 2, np.asarray(h, float) / 2
    lg = np.vectorize(lgamma, otypes=[float])
    with np.errstate(all="ignore"):
        front = np.exp(a * np.log(x) - x - lg(a))
        term = total = 1 / a
        for k in range(1, 1000):
            term = term * x / (a + k)
            total = total + term
        low = 1 - front * total
        tiny = 1e-300
        b = x + 1 - a
        c, d = np.full_like(x, 1 / tiny), 1 / np.where(b == 0, tiny, b)
        q = d.copy()
        for k in range(1, 1000):
            num = -k * (k - a)
            b = b + 2
            d = num * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            q = q * d * c
        high = front * q
    return np.where(x <= 0, 1.0, np.clip(np.where(x < a + 1, low, high), 0, 1))


@F.pandas_udf(DoubleType())
def p_value(test: pd.Series, t: pd.Series, t_df: pd.Series, h: pd.Series, h_df: pd.Series) -> pd.Series:
    """p of the test that applies; runs on one row per test."""
    out = np.full(len(test), np.nan)
    w = ((test == "welch_t") & t.notna() & t_df.notna()).to_numpy()
    k = ((test == "kruskal") & h.notna()).to_numpy()
    if w.any():
        out[w] = t_tail(t[w], t_df[w])
    if k.any():
        out[k] = chi2_tail(h[k], h_df[k])
    return pd.Series(out).where(~np.isnan(out), None)


benjamini_hochberg = scans.benjamini_hochberg


def differential(long: DataFrame, keys: list[str], min_per_group: int = 2) -> DataFrame:
    """Per ``keys..., phenotype, feature``: test, statistics, p, q (within keys and phenotype), effect, n, level means.

    Values are counted once; means, variances and ranks come from the counts. h stands beside t where a test has two levels.
    """
    k = [*keys, "phenotype", "feature"]
    tmp = Scratch(long.sparkSession, "tests")
    values = tmp.save(counted(long, k))
    stats = tmp.save(counted_stats(values, k, long))
    out = gate(stats, k, min_per_group).join(two_level(stats, k), k, "left")
    out = out.join(kruskal(long, k, values).withColumnRenamed("df", "h_df"), k, "left")
    out = out.withColumn("p_value", p_value("test", "t", "df", "h", "h_df"))
    out = benjamini_hochberg(out, [*keys, "phenotype"], "p_value", [F.col("feature")])
    return out.select(*k, "test", "p_value", "q_value", "effect_d", "levels", "n", "t", "df", "h", "h_df", "means")


def ranked(results: DataFrame, keys: list[str]) -> DataFrame:
    return results.orderBy(*keys, "phenotype", F.col("q_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(), "feature")


def top_significant(results: DataFrame, keys: list[str], alpha: float = 0.05, top: int = 24) -> DataFrame:
    """The first ``top`` significant features of each group."""
    w = W.partitionBy(*keys, "phenotype").orderBy(F.col("q_value").asc_nulls_last(), F.col("p_value").asc_nulls_last(), "feature")
    return results.where(F.col("q_value") <= alpha).withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)


ship(__name__)
