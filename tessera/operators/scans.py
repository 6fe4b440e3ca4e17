"""Scans of ordered groups in two levels: ranges of one order, then offsets from the ranges before (or after).

A group may hold any number of rows. The table is cut into ranges by its order, each range is scanned in itself, and what the other ranges of the group add is
one number a range. Rows that are equal in the order lie in one range, so ties are seen whole; where a value may be very common, count it first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.functions import stats as S

#: Rows of a range.
RANGE = 100_000


class Ranged:
    """``df`` cut into ranges by ``keys`` and ``order`` (columns, ascending as given): ``rows`` has ``_part``, which rises with the order.

    ``keep``: the ranges are written, as whoever reads them twice needs; else they are made anew, maybe elsewhere, at each reading, and are sorted.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[Column | str], rows: int | None = None, keep: bool = True):
        self.keys, self.order = keys, [F.col(o) if isinstance(o, str) else o for o in order]
        self.tmp = Scratch(df.sparkSession, "ranges")
        d = df if hasattr(df, "_tessera_path") else self.tmp.save(df)
        parts = -(-d.count() // (rows or RANGE))
        if keep:
            self.rows = d.withColumn("_part", F.lit(0)) if parts <= 1 else self.tmp.save(d.repartitionByRange(parts, *keys, *self.order).withColumn("_part", F.spark_partition_id()))
        else:
            cut = d.repartition(1) if parts <= 1 else d.repartitionByRange(parts, *keys, *self.order)
            self.rows = cut.sortWithinPartitions(*keys, *self.order).withColumn("_part", F.spark_partition_id())

    def within(self) -> W:
        """The rows of a range up to this one, in order (by rows; ``W.partitionBy`` and ``orderBy`` as usual)."""
        return W.partitionBy(*self.keys, "_part").orderBy(*self.order)

    def offsets(self, rows: DataFrame, total: Column, after: bool = False, combine=F.sum) -> DataFrame:
        """``_off`` of each group and range: ``combine`` of ``total`` over the group's ranges before it (``after``: behind it); null for the first."""
        per = rows.groupBy(*self.keys, "_part").agg(total.alias("_t"))
        by = W.partitionBy(*self.keys).orderBy(F.col("_part").desc() if after else F.col("_part")).rowsBetween(W.unboundedPreceding, -1)
        return per.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)], F.col("_part").alias("_p"), combine("_t").over(by).alias("_off"))

    def with_offsets(self, rows: DataFrame, offsets: DataFrame) -> DataFrame:
        """Offsets beside the rows; keys may be null."""
        return rows.join(offsets, same(self.keys) & (F.col("_part") == F.col("_p")), "left").drop("_p", *[f"_k{i}" for i in range(len(self.keys))])


def same(keys: list[str]) -> Column:
    """Each key equals its copy ``_k0, _k1, ...``, nulls too."""
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def mid_ranks(df: DataFrame, keys: list[str], value: str, rows: int | None = None) -> DataFrame:
    """Adds ``rank`` (ties share their mean rank) and ``ties`` (size of the tie) among the values of a group; null values must be gone."""
    r = Ranged(df, keys, [value], rows)
    d = r.rows.withColumn("ties", F.count("*").over(W.partitionBy(*keys, "_part", value))).withColumn("_in", F.rank().over(r.within()))
    d = r.with_offsets(d, r.offsets(r.rows, F.count("*")))
    return d.withColumn("rank", F.col("_in") + F.coalesce("_off", F.lit(0)) + (F.col("ties") - 1) / 2).select(*df.columns, "ties", "rank")


def quantiles(df: DataFrame, keys: list[str], value: Column, qs: list[float], names: list[str], rows: int | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbours, as ``percentile``) of each group's non-null values, from the rows at the wanted places of the ranges: a group may have any number of distinct values."""
    r = Ranged(df.select(*keys, value.alias("_v")).where("_v is not null"), keys, ["_v"], rows)
    m = r.rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_m"))
    d = r.with_offsets(r.rows.withColumn("_i", F.row_number().over(r.within()) - 1), r.offsets(r.rows, F.count("*"))).withColumn("_i", F.col("_i") + F.coalesce("_off", F.lit(0)))
    d = d.join(m, same(keys)).drop(*[f"_k{i}" for i in range(len(keys))])
    place = lambda q: (F.col("_m") - 1) * q
    wanted = F.lit(False)
    for q in qs:
        wanted = wanted | (F.col("_i") == F.floor(place(q))) | (F.col("_i") == F.ceil(place(q)))
    at = lambda q, f: F.max(F.when(F.col("_i") == f(place(q)), F.col("_v")))
    share = lambda q: F.max(place(q) - F.floor(place(q)))
    out = d.where(wanted).groupBy(*keys).agg(*[(at(q, F.floor) * (1 - share(q)) + at(q, F.ceil) * share(q)).alias(n) for q, n in zip(qs, names)])
    out = out.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    return df.select(*keys).distinct().join(out, same(keys), "left").select(*keys, *names)


def counted_quantiles(df: DataFrame, keys: list[str], columns: list[str], qs: dict[str, float], rows: int | None = None) -> DataFrame:
    """``keys`` and ``<column>_<name>`` for each of ``qs`` (name, share): exact quantiles (linear between neighbours, as ``percentile``) of finite values, for few groups of very many rows.

    Values are counted; ranges of the distinct ones carry how many values lie before them. A task holds neither a group's rows nor its distinct values.
    """
    by = [*keys, "_c"]
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), S.finite(c).alias("_v")) for i, c in enumerate(columns)])).alias("_x")).select(*keys, "_x._c", "_x._v")
    r = Ranged(long.where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_n")), by, ["_v"], rows)
    m = r.rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]).agg(F.sum("_n").alias("_m"))
    d = r.rows.withColumn("_end", F.sum("_n").over(r.within().rowsBetween(W.unboundedPreceding, 0)))
    d = r.with_offsets(d, r.offsets(r.rows, F.sum("_n"))).withColumn("_end", F.col("_end") + F.coalesce("_off", F.lit(0))).join(F.broadcast(m), same(by))
    place = lambda q: (F.col("_m") - 1) * q
    holds = lambda at: (F.col("_end") - F.col("_n") <= at) & (at < F.col("_end"))
    value = lambda q, f, i: F.max(F.when((F.col("_c") == i) & holds(f(place(q))), F.col("_v")))
    part = lambda q, i: F.max(F.when(F.col("_c") == i, place(q) - F.floor(place(q))))
    wanted = F.lit(False)
    for q in qs.values():
        wanted = wanted | holds(F.floor(place(q))) | holds(F.ceil(place(q)))
    out = [(value(q, F.floor, i) * (1 - part(q, i)) + value(q, F.ceil, i) * part(q, i)).alias(f"{c}_{n}") for i, c in enumerate(columns) for n, q in qs.items()]
    return d.where(wanted).groupBy(*keys).agg(*out)


def summarise(df: DataFrame, keys: list[str], columns: list[str], aggs=("iqr", "median"), name="{col}_{agg}") -> DataFrame:
    """``stats.summarise`` for few groups of very many rows: medians and quartiles from counted values instead of a map of a group's distinct values."""
    q = counted_quantiles(df, keys, columns, {"_1": 0.25, "_2": 0.5, "_3": 0.75}).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    plain = [(c, a) for c in columns for a in aggs if a not in ("iqr", "median")]
    d = df.groupBy(*keys).agg(F.count("*").alias("_rows"), *[S.SUMMARY[a](c).alias(f"_{a}_{c}") for c, a in plain]).join(q, same(keys), "left")
    of = lambda c, a: F.col(f"{c}__3") - F.col(f"{c}__1") if a == "iqr" else F.col(f"{c}__2") if a == "median" else F.col(f"_{a}_{c}")
    return d.select(*keys, *[of(c, a).alias(name.format(col=c, agg=a)) for c in columns for a in aggs])


def gini(df: DataFrame, keys: list[str], value: Column, name: str = "gini", rows: int | None = None) -> DataFrame:
    """Gini coefficient of each group's non-null values; 0 if all are (almost) 0, null without one. Each range adds its own sums, so no row is joined."""
    r = Ranged(df.select(*keys, value.alias("_v")), keys, [F.col("_v").asc_nulls_last()], rows)
    d = r.rows.where("_v is not null").withColumn("_i", F.row_number().over(r.within()))
    per = d.groupBy(*keys, "_part").agg(F.count("*").cast("double").alias("n"), F.sum("_v").alias("s"), F.sum(F.col("_i") * F.col("_v")).alias("w"), F.max(F.abs("_v")).alias("m"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("w", F.col("w") + before * F.col("s"))
    n, s = F.sum("n"), F.sum("s")
    out = per.groupBy(*keys).agg(F.when(F.max("m") <= 1e-8, F.lit(0.0)).otherwise(F.try_divide(2 * F.sum("w") - (n + 1) * s, n * s)).alias(name))
    return df.select(*keys).distinct().join(out.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}), same(keys), "left").select(*keys, name)


def benjamini_hochberg(df: DataFrame, keys: list[str], p: str, tie: list[str | Column], name: str = "q_value", rows: int | None = None) -> DataFrame:
    """Adds q: from the largest p down, the running minimum of p * m / rank, at most 1; null p keep a null q.

    Ranks run forward over the ranges, minima backward: each needs one number from the other ranges.
    """
    r = Ranged(df, keys, [F.col(p).asc_nulls_last(), *tie], rows)
    d = r.with_offsets(r.rows.withColumn("_in", F.row_number().over(r.within())), r.offsets(r.rows, F.count("*")))
    d = d.withColumn("_rank", F.col("_in") + F.coalesce("_off", F.lit(0))).drop("_in", "_off")
    m = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count(p).alias("_m"))
    d = r.tmp.save(d.join(m, same(keys)).withColumn("_v", F.when(F.col(p).isNotNull(), F.col(p) * F.col("_m") / F.col("_rank"))).drop(*[f"_k{i}" for i in range(len(keys))]))
    back = W.partitionBy(*keys, "_part").orderBy(F.col("_rank").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = r.with_offsets(d.withColumn("_low", F.min("_v").over(back)), r.offsets(d, F.min("_v"), after=True, combine=F.min))
    q = F.least("_low", "_off", F.lit(1.0))
    return out.withColumn(name, F.when(F.col(p).isNotNull(), q)).select(*df.columns, name)
