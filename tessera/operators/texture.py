"""Grey-level co-occurrence of neighbouring pixels and its properties.

Offsets are shifted slices of tiles that have a rim as wide as the largest offset: one exchange of the pixels serves all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Scratch, ship
from tessera.functions import stats as S
from tessera.operators import tiles as TL

#: (distance, angle number, dy, dx): diagonals are rounded, so distance 2 repeats (1, 1) (fixed values).
OFFSETS = (
    (1, 0, 0, 1), (1, 1, 1, 1), (1, 2, 1, 0), (1, 3, 1, -1),
    (2, 0, 0, 2), (2, 1, 1, 1), (2, 2, 2, 0), (2, 3, 1, -1),
    (4, 0, 0, 4), (4, 1, 3, 3), (4, 2, 4, 0), (4, 3, 3, -3),
)
PROPERTIES = ("contrast", "dissimilarity", "homogeneity", "asm", "energy", "correlation", "entropy")


def pairs(v: np.ndarray, inside: np.ndarray, offsets=OFFSETS) -> tuple[np.ndarray, ...]:
    """Array of the stack, offset, level and neighbour's level, of all places inside whose neighbour has a level (-1: none)."""
    out, base = [], inside & (v >= 0)
    for at, (_, _, dy, dx) in enumerate(offsets):
        w = TL.shifted(v, dy, dx, -1)
        good = base & (w >= 0)
        of = np.nonzero(good)[0]
        out.append((of, np.full(len(of), at), v[good], w[good]))
    return tuple(map(np.concatenate, zip(*out)))


def counts(df: DataFrame, keys: list[str], level: str, offsets=OFFSETS) -> DataFrame:
    """``keys, d, a, i, j, n``: how often a masked pixel of level i has a neighbour of level j at each offset, counted tile by tile."""

    def work(t: TL.Tiles) -> pa.Table | None:
        v = t.dense(level, -1, np.int64)
        of, at, i, j = pairs(v, t.inside(), offsets)
        top = int(v.max()) + 1
        code, n = np.unique(((of * len(offsets) + at) * top + i) * top + j, return_counts=True)  # once for all offsets
        at = code // (top * top)
        d, a = np.array([o[:2] for o in offsets], np.int64)[at % len(offsets)].T
        return t.with_keys(keys, at // len(offsets), {"d": d, "a": a, "i": code // top % top, "j": code % top, "n": n}) if len(n) else None

    rim = max(max(abs(dy), abs(dx)) for _, _, dy, dx in offsets)
    schema = TL.schema_of(df, keys, d="long", a="long", i="long", j="long", n="long")
    return TL.over_tiles(df.select(*keys, "row", "col", F.col(level).alias(level)), keys, rim, work, schema)


def glcm(df: DataFrame, keys: list[str], level: str, offsets=OFFSETS) -> DataFrame:
    """Symmetric co-occurrence shares: ``keys, d, a, i, j, p``. ``df`` holds the masked pixels only; levels are whole numbers from 0."""
    p = counts(df, keys, level, offsets)
    both = F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("x")
    both = p.select(*keys, "d", "a", both, "n").groupBy(*keys, "d", "a", "x.i", "x.j").agg(F.sum("n").alias("n"))
    total = both.groupBy(*keys, "d", "a").agg(F.sum("n").alias("t"))
    return both.join(total, [*keys, "d", "a"]).select(*keys, "d", "a", "i", "j", (F.col("n") / F.col("t")).alias("p"))


def properties(g: DataFrame, keys: list[str]) -> DataFrame:
    """The seven properties of each matrix (``keys, d, a``)."""
    i, j, p = F.col("i").cast("double"), F.col("j").cast("double"), F.col("p")
    d = i - j
    s = lambda x: F.sum(x * p)
    var_i, var_j = s(i * i) - s(i) * s(i), s(j * j) - s(j) * s(j)
    return g.groupBy(*keys, "d", "a").agg(
        s(d * d).alias("contrast"), s(F.abs(d)).alias("dissimilarity"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sum(p * p).alias("asm"), F.sqrt(F.sum(p * p)).alias("energy"),
        F.when((var_i > S.TINY) & (var_j > S.TINY), F.try_divide(s(i * j) - s(i) * s(j), F.sqrt(var_i) * F.sqrt(var_j))).alias("correlation"),
        (-F.sum(p * F.log2(p))).alias("entropy"),
    )


def rollup(props: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, scale, property, mean, sd``: per distance (sd null), and over all offsets (scale null)."""
    props = Scratch(props.sparkSession, "texture").save(props)  # read twice, and dear
    long = props.select(*keys, "d", F.explode(F.array(*[F.struct(F.lit(n).alias("property"), F.col(n).alias("value")) for n in PROPERTIES])).alias("x")).select(*keys, "d", "x.property", "x.value")
    per = long.groupBy(*keys, F.col("d").alias("scale"), "property").agg(S.mean("value").alias("mean"), F.lit(None).cast("double").alias("sd"))
    whole = long.groupBy(*keys, F.lit(None).cast("int").alias("scale"), "property").agg(S.mean("value").alias("mean"), S.sd("value").alias("sd"))
    return per.union(whole)


ship(__name__)
