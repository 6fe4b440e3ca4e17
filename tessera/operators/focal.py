"""Focal minimum, maximum, opening and closing over discs, on pixel tables.

Steps run on tiles with a rim (see ``tiles``). A disc of radius r is done row by row: for each row distance dy its half width is
floor(sqrt(r^2 - dy^2)); each distinct half width is one sliding extreme along the rows, and 2r + 1 shifted copies meet. Places
without a pixel do not take part (for a disc smaller than the image this equals a reflected border). A chain of steps, such as an opening or a
whole granularity spectrum, is one exchange whose rim is the sum of the radii.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import ship
from tessera.operators import tiles as TL

_OPS = {"max": (np.maximum, -np.inf), "min": (np.minimum, np.inf)}


def extreme(a: np.ndarray, here: np.ndarray, radius: int, what: str) -> np.ndarray:
    """The extreme of an array, or of each of a stack, over the disc about each place; places that are not ``here`` neither count nor have one."""
    op, fill = _OPS[what]
    if radius <= 0:
        return np.where(here, a, fill)
    a = np.where(here, a, fill)
    h, w = a.shape[-2:]
    reach = {dy: min(isqrt(radius * radius - dy * dy), w) for dy in range(min(radius + 1, h))}
    rows = {half: TL.slide(a, half, op, fill) for half in set(reach.values())}
    out = rows[reach[0]].copy()
    for dy, half in list(reach.items())[1:]:
        op(out[..., :-dy, :], rows[half][..., dy:, :], out=out[..., :-dy, :])
        op(out[..., dy:, :], rows[half][..., :-dy, :], out=out[..., dy:, :])
    return np.where(here, out, fill)


def chain(df: DataFrame, keys: list[str], value: str, steps: list[tuple[str, int]]) -> DataFrame:
    """Rows of ``df`` with ``value`` replaced by the outcome of ``steps`` (``max`` or ``min``, radius), one after the other, in one exchange."""
    steps = [(what, r) for what, r in steps if r > 0]
    if not steps:
        return df
    columns = df.columns
    whole = df.schema[value].dataType.typeName()

    def work(t: TL.Tiles) -> pa.Table:
        a = t.dense(value, np.nan)
        for what, r in steps:
            fill = _OPS[what][1]
            a = extreme(np.where(np.isnan(a), fill, a), t.here, r, what)
            a = np.where(a == fill, np.nan, a)
        out = t.pixels(columns, _new=a)
        new = out.column("_new").cast(pa.int64()) if whole == "boolean" else out.column("_new")
        return out.set_column(columns.index(value), value, new.cast(out.schema.field(value).type)).select(columns)

    return TL.over_tiles(df, keys, sum(r for _, r in steps), work, df.schema)


def focal(df: DataFrame, keys: list[str], value: str, radius: int, what: str) -> DataFrame:
    """Rows of ``df`` with ``value`` replaced by its extreme (``max`` or ``min``) over the disc around each pixel."""
    return chain(df, keys, value, [(what, radius)])


def dilate(df: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    return focal(df, keys, value, radius, "max")


def erode(df: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    return focal(df, keys, value, radius, "min")


def opened(df: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    return chain(df, keys, value, [("min", radius), ("max", radius)])


def closed(df: DataFrame, keys: list[str], value: str, radius: int) -> DataFrame:
    return chain(df, keys, value, [("max", radius), ("min", radius)])


def spectrum(x: np.ndarray, mask: np.ndarray, here: np.ndarray, inside: np.ndarray, radii) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each of a stack: whether its mask has any place inside, and the mass inside the mask before and after the openings that follow one another."""
    mass = lambda a: np.where(inside, a, 0.0).reshape(len(a), -1).sum(1)
    x = np.where(mask, x, 0.0)
    sums = [mass(x)]
    for r in radii:
        x = np.where(mask, extreme(extreme(x, here, r, "min"), here, r, "max"), 0.0)
        sums.append(mass(x))
    return (mask & inside).any((1, 2)), sums


def granularity(df: DataFrame, keys: list[str], norm: str, mask: str, radii=(1, 2, 4, 8), name="granularity_{r}") -> DataFrame:
    """Mass lost to each further opening over the mass inside the mask; null for an empty mask, 0 without mass.

    All openings of a tile follow one another inside it, for many small tiles at once; what leaves it is a sum for each radius.
    """

    def work(t: TL.Tiles) -> pa.Table:
        m = t.dense(mask, 0, np.uint8).astype(bool)
        some, sums = spectrum(np.nan_to_num(t.dense(norm, 0.0)), m, t.here, t.inside(), radii)
        return t.with_keys(keys, np.arange(len(some)), {"_any": some} | {f"_s{r}": v for r, v in zip((0, *radii), sums)})

    kinds = {"_any": "boolean"} | {f"_s{r}": "double" for r in (0, *radii)}
    parts = TL.over_tiles(df.select(*keys, "row", "col", F.col(mask).alias(mask), F.col(norm).alias(norm)), keys, 2 * sum(radii), work, TL.schema_of(df, keys, **kinds))
    sums = parts.groupBy(*keys).agg(F.max("_any").alias("_any"), *[F.sum(f"_s{r}").alias(f"_s{r}") for r in (0, *radii)])
    prev, out = "_s0", []
    for r in radii:
        loss = F.when(F.col("_s0") <= 0, F.lit(0.0)).otherwise(F.try_divide(F.greatest(F.lit(0.0), F.col(prev) - F.col(f"_s{r}")), F.col("_s0")))
        out.append(F.when(F.col("_any"), loss).alias(name.format(r=r)))
        prev = f"_s{r}"
    return sums.select(*keys, *out)


ship(__name__)
