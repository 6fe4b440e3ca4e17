"""Aggregate expressions with the engine's rules for undefined values (SQL null) and for one value.

Every function takes a column and returns an aggregate for ``groupBy(...).agg(...)``; values that are
null, NaN or infinite do not count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TINY = 1e-12


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def number(x) -> Column:
    return F.count(finite(x))


def mean(x) -> Column:
    return F.avg(finite(x))


def least(x) -> Column:
    return F.min(finite(x))


def most(x) -> Column:
    return F.max(finite(x))


def percentile(x, q: float) -> Column:
    return F.percentile(finite(x), F.lit(q))


def median(x) -> Column:
    return percentile(x, 0.5)


def sd(x, ddof: int = 1) -> Column:
    """Sample deviation; 0 for one value. ddof 0: population."""
    v = finite(x)
    if ddof == 0:
        return F.stddev_pop(v)
    return F.when(F.count(v) == 1, F.lit(0.0)).otherwise(F.stddev_samp(v))


def iqr(x) -> Column:
    return percentile(x, 0.75) - percentile(x, 0.25)


def cv(x) -> Column:
    """Deviation over mean; null where the mean is (almost) 0, else 0 for one value."""
    v = finite(x)
    m = F.avg(v)
    return F.when(F.abs(m) < TINY, None).when(F.count(v) == 1, F.lit(0.0)).otherwise(F.try_divide(F.stddev_samp(v), m))


def skew(x) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    v = finite(x)
    n = F.count(v).cast("double")
    good = (n >= 3) & (F.max(v) - F.min(v) >= TINY)
    return F.when(good, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(v))


def kurtosis(x) -> Column:
    """Bias-corrected excess kurtosis; null below four values or without spread."""
    v = finite(x)
    n = F.count(v).cast("double")
    good = (n >= 4) & (F.max(v) - F.min(v) >= TINY)
    return F.when(good, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(v) + 6))


def pearson(x, y, where: Column | None = None) -> Column:
    """Correlation of pairs that are both finite; null below three pairs or without spread."""
    a, b = finite(x), finite(y)
    both = a.isNotNull() & b.isNotNull() if where is None else a.isNotNull() & b.isNotNull() & where
    a, b = F.when(both, a), F.when(both, b)
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((F.count(a) >= 3) & (sa >= TINY) & (sb >= TINY), F.try_divide(F.covar_pop(a, b), sa * sb))


def score_bins(x, prefix: str, where: Column | None = None) -> list[Column]:
    """Shares of the four score bins of clip(x, 0, 1) and 100 * (f1 + 2 f2 + 3 f3)."""
    v = finite(x) if where is None else F.when(where, finite(x))
    v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    edges = [0.25, 0.5, 0.75]
    level = sum(((v >= e).cast("int") for e in edges), F.lit(0))
    level = F.when(v.isNotNull(), level)
    shares = [F.avg((level == k).cast("double")).alias(f"{prefix}_frac_{s}") for k, s in enumerate(("0", "1plus", "2plus", "3plus"))]
    return [*shares, (F.avg(level.cast("double")) * 100).alias(f"{prefix}_hscore")]


def with_entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds what ``entropy_of`` sums: the finite values ``_v`` and the terms ``_t`` of the positive ones."""
    p = F.when(finite(value) > 0, finite(value))
    share = F.try_divide(p, F.sum(p).over(W.partitionBy(*keys)))
    return df.withColumns({"_v": finite(value), "_t": share * F.log2(share)})


def entropy_of(v: Column, t: Column) -> Column:
    return F.when(F.count(v) > 0, F.coalesce(-F.sum(t), F.lit(0.0)))


def entropy(df: DataFrame, keys: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Shannon entropy (bits) of the positive values of each group; 0 if none is positive, null if none is finite."""
    t = with_entropy(df.select(*keys, F.col(value)), keys, value)
    return t.groupBy(*keys).agg(entropy_of(F.col("_v"), F.col("_t")).alias(name))


def with_gini(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``_i``, the place of ``_v`` among its group's finite values."""
    w = W.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_last())
    return df.withColumn("_i", F.when(F.col("_v").isNotNull(), F.row_number().over(w)))


def gini_of(v: Column, i: Column) -> Column:
    n, s = F.count(v), F.sum(v)
    top = 2 * F.sum(i * v) - (n + 1) * s
    return F.when(n > 0, F.when(F.max(F.abs(v)) <= 1e-8, F.lit(0.0)).otherwise(F.try_divide(top, n * s)))


def gini(df: DataFrame, keys: list[str], value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient of each group's finite values; 0 if all are (almost) 0."""
    t = with_gini(df.select(*keys, finite(value).alias("_v")), keys)
    return t.groupBy(*keys).agg(gini_of(F.col("_v"), F.col("_i")).alias(name))


SUMMARY = {"mean": mean, "sd": sd, "iqr": iqr, "median": median}


def summarise(df: DataFrame, keys: list[str], columns: list[str], aggs=("iqr", "median"), name="{col}_{agg}") -> DataFrame:
    """One pass over ``df``: each aggregate of each column, named by ``name``."""
    return df.groupBy(*keys).agg(*[SUMMARY[a](c).alias(name.format(col=c, agg=a)) for c in columns for a in aggs])
