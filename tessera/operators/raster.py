"""Pixel tables: colour and stain columns, tissue, normalisation, tiles, box counts, resampling.

A pixel row has the image key(s), ``row``, ``col`` and value columns; all functions take the names of the keys. Sizes of images are two numbers, or one table
``keys, height, width`` in place of the first (``Size``), as images of one job may differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch, ship
from tessera.functions import stats as S
from tessera.operators import scans
from tessera.operators import tiles as TL

#: A height (with a width beside it), or a table ``keys, height, width``.
Size = int | float | DataFrame

#: Stain vectors of Ruifrok & Johnston (2001) for haematoxylin, eosin and DAB (fixed values).
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))
UNMIX = np.linalg.inv(np.array(STAINS))


def from_arrays(df: DataFrame, image: str, values: str, width: int, *more: str) -> DataFrame:
    """Pixel rows of rasters held as flat arrays, row by row."""
    d = df.select(F.col(image).alias("image"), *more, F.posexplode(values).alias("p", "v"))
    return d.select("image", *more, F.floor(F.col("p") / width).cast("int").alias("row"), (F.col("p") % width).cast("int").alias("col"), F.col("v").cast("double").alias("v"))


def with_size(df: DataFrame, keys: list[str], height: Size, width: float | None = None) -> DataFrame:
    """``df`` with ``_h, _w``, the size of each row's image."""
    if isinstance(height, DataFrame):
        return df.join(height.select(*keys, F.col("height").alias("_h"), F.col("width").alias("_w")), keys)
    return df.withColumn("_h", F.lit(height)).withColumn("_w", F.lit(width))


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue over 180 (0 for grey) scaled by 179, saturation and value by 255; all unrounded, in [0, 1]."""
    hi, lo = F.greatest(r, g, b).cast("double"), F.least(r, g, b).cast("double")
    d = hi - lo
    s = F.when(hi > 0, F.try_divide(d, hi)).otherwise(F.lit(0.0))
    turn = F.when(hi == r, F.try_divide(g - b, d)).when(hi == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4)
    h = F.when(d == 0, F.lit(0.0)).otherwise(F.pmod(turn * 30, F.lit(180.0)) / 179)
    return h, s, hi / 255


def tissue(r: Column, g: Column, b: Column, ignore_black=True, black: int = 60, ignore_white=True, white_v: float = 0.9, white_s: float = 0.1) -> Column:
    """Neither black (all channels low) nor white (bright and pale); each rule can be off."""
    _, s, v = hsv(r, g, b)
    out = F.lit(True)
    if ignore_black:
        out = out & ~(F.greatest(r, g, b) <= black)
    if ignore_white:
        out = out & ~((v >= white_v) & (s <= white_s))
    return out


def stain_range(h: Column, s: Column, v: Column, h_low: float, h_high: float, s_min: float, v_min: float, v_max: float) -> Column:
    """Hue in a range (round the circle where low > high), saturation and value in theirs."""
    hue = (h >= h_low) & (h <= h_high) if h_low <= h_high else (h >= h_low) | (h <= h_high)
    return hue & (s >= s_min) & (v >= v_min) & (v <= v_max)


def optical_density(x: Column) -> Column:
    return -F.log((x + 1) / 256)


def unmix(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Amounts of the three stains: log intensities times the inverse stain matrix, not below 0."""
    floor_ = F.lit(1e-6)
    logs = [F.log(F.greatest(x / 255.0, floor_)) / float(np.log(1e-6)) for x in (r, g, b)]
    return {name: F.greatest(sum(logs[i] * float(UNMIX[i, k]) for i in range(3)), F.lit(0.0)) for k, name in enumerate(("hematoxylin", "eosin", "dab"))}


def limits(df: DataFrame, keys: list[str], value: str, where: Column | None = None, large: bool = False) -> DataFrame:
    """Per image: 1st and 99th percentile and range, of all values and of those ``where`` holds.

    ``large``: percentiles from ordered ranges instead of a map of an image's distinct values, for images that have very many.
    """
    v = F.col(value)
    t = F.when(where, v) if where is not None else v
    ends = [F.min(v).alias("mn"), F.max(v).alias("mx"), F.min(t).alias("tmn"), F.max(t).alias("tmx")]
    if not large:
        return df.groupBy(*keys).agg(F.percentile(v, F.lit(0.01)).alias("lo"), F.percentile(v, F.lit(0.99)).alias("hi"), F.percentile(t, F.lit(0.01)).alias("tlo"), F.percentile(t, F.lit(0.99)).alias("thi"), *ends)
    out = df.groupBy(*keys).agg(*ends)
    for x, names in ((v, ["lo", "hi"]), (t, ["tlo", "thi"])):
        out = out.join(scans.quantiles(df, keys, x, [0.01, 0.99], names), keys, "left")
    return out


def _stretch(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(F.try_divide(v - lo, hi - lo), F.lit(0.0)), F.lit(1.0))


def normalise(df: DataFrame, keys: list[str], value: str, out: str = "norm", where: Column | None = None, robust: bool = False, large: bool = False) -> DataFrame:
    """Percentile stretch to [0, 1].

    Without ``where``: over the image, else min to max, else 0. With it: limits from those pixels; without such pixels, or
    if they are flat, the image's rule (robust: 0).
    """
    lim = limits(df.withColumn("_v", S.finite(value)), keys, "_v", where, large)
    whole = F.when(F.col("hi") > F.col("lo"), _stretch(F.col(value), F.col("lo"), F.col("hi"))).when(F.col("mx") > F.col("mn"), _stretch(F.col(value), F.col("mn"), F.col("mx"))).otherwise(F.lit(0.0))
    if where is None:
        expr = whole
    else:
        flat = F.lit(0.0) if robust else whole
        inside = F.when(F.col("thi") > F.col("tlo"), _stretch(F.col(value), F.col("tlo"), F.col("thi"))).when(F.col("tmx") > F.col("tmn"), _stretch(F.col(value), F.col("tmn"), F.col("tmx"))).otherwise(flat)
        expr = F.when(F.col("tmn").isNull(), whole).otherwise(inside)
    return df.join(lim, keys).withColumn(out, expr).select(*df.columns, out)


def orient(raw: Column, norm: Column, invert: Column) -> tuple[Column, Column]:
    return F.when(invert, -raw).otherwise(raw), F.when(invert, 1 - norm).otherwise(norm)


def over_threshold(value: Column, auto: Column, absolute: Column, scale: float, normalised: bool, valid: Column) -> Column:
    """``value > t`` on tissue; t is the absolute one if set, else the automatic one times ``scale``; clamped for normalised values."""
    t = F.coalesce(absolute, auto * scale)
    if normalised:
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
    return (value > t) & valid


def quantise(norm: Column, levels: int = 32) -> Column:
    return F.least(F.greatest(F.floor(norm * (levels - 1)), F.lit(0)), F.lit(levels - 1)).cast("int")


def pixel_features(df: DataFrame, keys: list[str], mask: str, valid: str, norm: str, raw: str) -> DataFrame:
    """Area shares and distributions of normalised and raw values on tissue and on positive tissue, in one pass."""
    m, t = F.col(mask), F.col(valid)
    both = m & t
    out = [F.avg(m.cast("double")).alias("percent_area_stained"), F.avg(t.cast("double")).alias("percent_tissue_area"), F.try_divide(F.sum(both.cast("double")), F.sum(t.cast("double"))).alias("positive_fraction_in_tissue")]
    for kind, v in (("norm", norm), ("raw", raw)):
        for place, w in (("tissue", t), ("positive", both)):
            x = F.when(w, F.col(v))
            for name, f in (("mean", S.mean), ("sd", S.sd), ("iqr", S.iqr), ("skew", S.skew), ("kurtosis", S.kurtosis)):
                out.append(f(x).alias(f"pixel_{kind}_{place}_{name}"))
    out += S.score_bins(norm, "pixel_norm_tissue", t) + S.score_bins(norm, "pixel_norm_positive", both)
    return df.groupBy(*keys).agg(*out)


def box_dimension(df: DataFrame, keys: list[str], height: Size, width: int | None = None) -> DataFrame:
    """Box-count dimension of the foreground rows ``df`` (row, col): slope of ln N(s) on ln(1/s), s = 2, 4, ... up to the shorter side; null below two sizes.

    Boxes up to the size of a tile are counted inside tiles; larger ones from the tiles that hold anything.
    """
    small = TL.TILE.bit_length() - 1
    if 1 << small != TL.TILE:
        raise ValueError("boxes need tiles whose size is a power of two")

    def work(t: TL.Tiles) -> pa.Table:
        r, c, tiles = t.row - t.tr[t.of] * t.size, t.col - t.tc[t.of] * t.size, len(t.starts)
        side = 1 << int(max(r.max(), c.max())).bit_length()  # beyond it, a tile is in one box
        n, step = np.ones((tiles, small), np.int64), max(TL.PLACES // (side * side), 1)
        for i in range(0, tiles, step):
            part = (t.of >= i) & (t.of < i + step)
            m = np.zeros((min(step, tiles - i), side, side), bool)
            m[t.of[part] - i, r[part], c[part]] = True
            for k in range(side.bit_length() - 1):
                m = m[:, 0::2, 0::2] | m[:, 0::2, 1::2] | m[:, 1::2, 0::2] | m[:, 1::2, 1::2]
                n[i : i + step, k] = m.sum((1, 2))
        which = np.repeat(np.arange(tiles), small)
        return t.with_keys(keys, which, {"tr": t.tr[which], "tc": t.tc[which], "k": np.tile(np.arange(1, small + 1), tiles), "n": n.ravel()})

    p = df.select(*keys, "row", "col")
    tiles = TL.over_tiles(p, keys, 0, work, TL.schema_of(p, keys, tr="long", tc="long", k="long", n="long"))
    tiles = with_size(tiles, keys, height, width).withColumn("most", F.length(F.bin(F.least("_h", "_w").cast("long"))) - 1)
    last = F.col("k") == small
    more = F.when(last & (F.col("most") > small), F.sequence(F.lit(small + 1), F.col("most"))).otherwise(F.array().cast("array<int>"))
    part = lambda k, r, c, n: F.struct(k.cast("long").alias("k"), r.alias("r"), c.alias("c"), n.alias("n"))
    none = F.lit(None).cast("long")
    up = lambda t, k: F.floor(F.col(t) / F.pow(F.lit(2.0), k - small))
    boxes = F.concat(F.array(part(F.col("k"), none, none, F.col("n"))), F.transform(more, lambda k: part(k, up("tr", k), up("tc", k), F.lit(1).cast("long"))))
    each = tiles.select(*keys, "most", F.explode(boxes).alias("b")).where("b.k <= most")
    each = each.groupBy(*keys, "most", "b.k", "b.r", "b.c").agg(F.when(F.col("r").isNull(), F.sum("b.n")).otherwise(F.lit(1)).alias("n"))
    d = each.groupBy(*keys, "most", "k").agg(F.sum("n").alias("n"))
    slope = F.regr_slope(F.log("n"), -F.col("k") * float(np.log(2)))
    return d.groupBy(*keys).agg(F.when(F.max("most") >= 2, slope).alias("fractal_dimension"))


def tile_of(x: Column, size: Column | int, grid: int) -> Column:
    """Tile with edges at floor(k * size / grid)."""
    size = F.lit(size) if isinstance(size, int) else size
    return sum(((x >= F.floor(k * size / grid)).cast("int") for k in range(1, grid)), F.lit(0))


def tile_features(df: DataFrame, keys: list[str], height: Size, width: int | None, mask: str, valid: str, norm: str, grids=(4, 8)) -> DataFrame:
    """Spread of positive mass, positive share and mean intensity over tiles that hold tissue.

    Pixels are summed once, over the cells that all grids cut, and the sums are written; what follows sorts an image's tiles once, for all grids and measures.
    """
    df = with_size(df, keys, height, width).where(valid)
    m = F.col(mask).cast("double")
    cuts = [tile_of(F.col(x), F.col(size), g).alias(f"_{x}{g}") for g in grids for x, size in (("row", "_h"), ("col", "_w"))]
    cells = df.groupBy(*keys, *cuts).agg(F.sum(m).alias("mass"), F.count(m).alias("n"), F.sum(norm).alias("level"), F.count(norm).alias("k"))
    cells = Scratch(df.sparkSession, "cells").save(cells)
    at = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(f"_row{g}").alias("r"), F.col(f"_col{g}").alias("c")) for g in grids]))
    tiles = cells.select(*keys, at.alias("_t"), "mass", "n", "level", "k").groupBy(*keys, "_t.g", "_t.r", "_t.c")
    tiles = tiles.agg(F.sum("mass").alias("mass"), F.try_divide(F.sum("mass"), F.sum("n")).alias("share"), F.try_divide(F.sum("level"), F.sum("k")).alias("level"))
    tiles = S.with_gini(S.with_entropy(tiles, [*keys, "g"], "mass"), [*keys, "g"])
    out = []
    for g in grids:
        of, base = lambda x: F.when(F.col("g") == g, F.col(x)), f"tile_g{g}"  # noqa: B023,E731
        out += [S.mean(of("share")).alias(f"{base}_positive_frac_mean"), S.sd(of("share")).alias(f"{base}_positive_frac_sd"), S.cv(of("share")).alias(f"{base}_positive_frac_cv"), S.iqr(of("share")).alias(f"{base}_positive_frac_iqr")]
        out += [S.sd(of("level")).alias(f"{base}_intensity_mean_sd"), S.iqr(of("level")).alias(f"{base}_intensity_mean_iqr"), S.entropy_of(of("_v"), of("_t")).alias(f"{base}_mass_entropy"), S.gini_of(of("_v"), of("_i")).alias(f"{base}_mass_gini")]
    return tiles.groupBy(*keys).agg(*out)


def downsample(df: DataFrame, keys: list[str], factor: int, height: Size, width: int | None, values: list[str]) -> DataFrame:
    """Block means; incomplete blocks at the edge are dropped."""
    d = with_size(df, keys, height, width)
    whole = lambda size: F.floor(F.col(size) / factor) * factor
    d = d.where((F.col("row") < whole("_h")) & (F.col("col") < whole("_w")))
    return d.groupBy(*keys, F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col")).agg(*[F.avg(v).alias(v) for v in values])


def crop(df: DataFrame, keys: list[str], height: Size, width: int | None, side: int, centre_row: float = 0.5, centre_col: float = 0.5) -> DataFrame:
    """A window of ``side`` pixels about a fractional centre, kept inside the image."""
    d = with_size(df, keys, height, width)
    first = lambda size, at: F.greatest(F.lit(0), F.least(F.col(size) - side, F.floor(at * F.col(size)) - side // 2))
    r0, c0 = first("_h", centre_row), first("_w", centre_col)
    return d.where(F.col("row").between(r0, r0 + side - 1) & F.col("col").between(c0, c0 + side - 1)).select(*df.columns)


def region_pair(df: DataFrame, keys: list[str], a: str, b: str, prefix: str) -> DataFrame:
    """Overlap measures of two masks of the same pixels."""
    x, y = F.col(a), F.col(b)
    n = lambda c: F.sum(c.cast("double"))
    both, either, na, nb = n(x & y), n(x | y), n(x), n(y)
    d = F.try_divide
    return df.groupBy(*keys).agg(
        d(both, either).alias(f"{prefix}_jaccard"), d(2 * both, na + nb).alias(f"{prefix}_dice"), d(both, na).alias(f"{prefix}_frac_self_overlap"),
        d(both, nb).alias(f"{prefix}_frac_other_overlap"), d(na, nb).alias(f"{prefix}_positive_area_ratio"),
    )


def log_histogram(df: DataFrame, keys: list[str], value: str, bins: int = 100) -> DataFrame:
    """Counts of log10(max(value, 1e-12)) in equal bins between each image's extremes."""
    x = F.log10(F.greatest(F.col(value), F.lit(1e-12)))
    w = W.partitionBy(*keys)
    d = df.select(*keys, x.alias("x")).withColumn("lo", F.min("x").over(w)).withColumn("hi", F.max("x").over(w))
    b = F.least(F.floor(F.coalesce(F.try_divide(F.col("x") - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * bins), F.lit(bins - 1))
    return d.groupBy(*keys, b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


ship(__name__)
