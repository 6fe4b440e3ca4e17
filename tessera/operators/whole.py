"""Features of whole images on arrays, many small images at once: texture, granularity, pixel values, tiles and topology.

The same measures as in ``texture``, ``focal``, ``raster`` and ``components``, which take images of any size by tiles and aggregates. An image whose box fits a tile needs neither: its pixels are exchanged once,
and a task works on stacks of images. Undefined values are NaN on arrays and null in rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Scratch, ship
from tessera.functions import stats
from tessera.functions.stats import TINY
from tessera.operators import tiles as TL
from tessera.operators.focal import spectrum
from tessera.operators.raster import Size, with_size
from tessera.operators.texture import OFFSETS, PROPERTIES, pairs

#: Pixels that a task works on, in the mean.
TASK_PIXELS = 500_000
LEVELS, GRIDS = 32, (4, 8)


def larger(pixels: DataFrame, keys: list[str]) -> tuple[DataFrame, bool]:
    """Images whose box is larger than a tile (written), and whether there are any."""
    side = lambda x: F.max(x) - F.min(x)
    box = pixels.groupBy(*keys).agg(F.greatest(side("row"), side("col")).alias("side"))
    out = Scratch(pixels.sparkSession, "larger").save(box.where(F.col("side") >= TL.TILE).select(*keys))
    return out, not out.isEmpty()


def quantiles(of: np.ndarray, v: np.ndarray, n_of: int, shares: tuple[float, ...]) -> list[np.ndarray]:
    """Interpolated quantiles of the values of each group, as Spark's ``percentile`` has them."""
    s = v[np.lexsort((v, of))]
    n = np.bincount(of, minlength=n_of)
    first, some = np.cumsum(n) - n, n > 0
    out = []
    for q in shares:
        at = (n[some] - 1) * q
        lo, hi = np.floor(at), np.ceil(at)
        a, b = (s[first[some] + x.astype(np.int64)] for x in (lo, hi))
        r = np.full(n_of, np.nan)
        r[some] = np.where(a == b, a, (hi - at) * a + (at - lo) * b)
        out.append(r)
    return out


def ends(of: np.ndarray, v: np.ndarray, n_of: int) -> list[np.ndarray]:
    """Least and greatest value of each group."""
    lo, hi = np.full(n_of, np.inf), np.full(n_of, -np.inf)
    np.minimum.at(lo, of, v)
    np.maximum.at(hi, of, v)
    none = hi < lo
    lo[none], hi[none] = np.nan, np.nan
    return [lo, hi]


def _limits(of: np.ndarray, v: np.ndarray, n_of: int) -> list[np.ndarray]:
    good = np.isfinite(v)
    return [*quantiles(of[good], v[good], n_of, (0.01, 0.99)), *ends(of[good], v[good], n_of)]


def _stretch(v: np.ndarray, null: np.ndarray, of: np.ndarray, limits: list[np.ndarray], flat: np.ndarray | float = 0.0) -> np.ndarray:
    """``raster.normalise`` by an image's limits: percentiles, else extremes, else ``flat``. As in SQL, a null counts as 0 and NaN as the greatest number."""
    lo, hi, mn, mx = limits
    use = hi > lo
    a, b = np.where(use, lo, mn)[of], np.where(use, hi, mx)[of]
    wide = b > a
    with np.errstate(invalid="ignore", divide="ignore"):
        x = (v - a) / (b - a)
    x = np.where(null, 0.0, np.where(np.isnan(x), 1.0, np.minimum(np.maximum(x, 0.0), 1.0)))
    return np.where(wide, x, flat)


def _moments(of: np.ndarray, v: np.ndarray, n_of: int) -> dict[str, np.ndarray]:
    """The distribution of each group's finite values, by the rules of ``functions.stats``."""
    good = np.isfinite(v)
    of, v = of[good], v[good]
    n = np.bincount(of, minlength=n_of).astype(float)
    q25, q75 = quantiles(of, v, n_of, (0.25, 0.75))
    lo, hi = ends(of, v, n_of)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.bincount(of, v, n_of) / n
        d = v - mean[of]
        m2, m3, m4 = (np.bincount(of, d**k, n_of) for k in (2, 3, 4))
        wide = hi - lo >= TINY
        skew = np.sqrt(n * (n - 1)) / (n - 2) * np.sqrt(n) * m3 / np.sqrt(m2 * m2 * m2)
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * (n * m4 / (m2 * m2) - 3) + 6)
        sd = np.where(n == 1, 0.0, np.where(n > 1, np.sqrt(m2 / (n - 1)), np.nan))
    return {"mean": mean, "sd": sd, "iqr": q75 - q25, "skew": np.where((n >= 3) & wide, skew, np.nan), "kurtosis": np.where((n >= 4) & wide, kurt, np.nan)}


def _score_bins(of: np.ndarray, v: np.ndarray, where: np.ndarray, n_of: int, prefix: str) -> dict[str, np.ndarray]:
    """``stats.score_bins``: what does not count there (its least and greatest pass over nulls) is in the lowest bin."""
    v = np.where(where & np.isfinite(v), np.minimum(np.maximum(v, 0.0), 1.0), 0.0)
    level = sum((v >= e).astype(np.int64) for e in (0.25, 0.5, 0.75))
    n = np.bincount(of * 4 + level, minlength=4 * n_of).reshape(-1, 4).astype(float)
    with np.errstate(invalid="ignore"):
        share = n / n.sum(1)[:, None]
    return {f"{prefix}_frac_{s}": share[:, k] for k, s in enumerate(("0", "1plus", "2plus", "3plus"))} | {f"{prefix}_hscore": share @ np.arange(4) * 100}


def _entropy_gini(of: np.ndarray, v: np.ndarray, n_of: int) -> tuple[np.ndarray, np.ndarray]:
    """Entropy (bits) of each group's positive values and Gini coefficient of its finite ones."""
    good = np.isfinite(v)
    of, v = of[good], v[good]
    n, total, up = np.bincount(of, minlength=n_of), np.bincount(of, v, n_of), v > 0
    with np.errstate(invalid="ignore", divide="ignore"):
        share = v[up] / np.bincount(of[up], v[up], n_of)[of[up]]
        entropy = np.where(n > 0, -np.bincount(of[up], share * np.log2(share), n_of), np.nan)
        order = np.lexsort((v, of))
        place = np.arange(len(v)) - (np.cumsum(n) - n)[of[order]] + 1
        top = 2 * np.bincount(of[order], place * v[order], n_of) - (n + 1) * total
        gini = np.where(total == 0, np.nan, top / (n * total))
    most = np.zeros(n_of)
    np.maximum.at(most, of, np.abs(v))
    return entropy, np.where(n > 0, np.where(most <= 1e-8, 0.0, gini), np.nan)


def _grids(of: np.ndarray, row: np.ndarray, col: np.ndarray, size: list[np.ndarray], mass: np.ndarray, level: np.ndarray, null: np.ndarray, n_of: int) -> dict[str, np.ndarray]:
    """``raster.tile_features`` of the pixels on tissue; ``mass`` is NaN where there is none."""
    out = {}
    for g in GRIDS:
        tile = lambda x, n: sum((x >= np.floor(k * n / g)).astype(np.int64) for k in range(1, g))  # noqa: B023,E731
        tiles, at = np.unique((of * g + tile(row, size[0][of])) * g + tile(col, size[1][of]), return_inverse=True)
        total = lambda x: np.bincount(at, x, len(tiles))  # noqa: B023,E731
        has = ~np.isnan(mass)
        with np.errstate(invalid="ignore", divide="ignore"):
            sums = np.where(total(has) > 0, total(np.where(has, mass, 0.0)), np.nan)
            share, mean = sums / total(has), total(np.where(null, 0.0, level)) / total(~null)
            t_of, base = tiles // (g * g), f"tile_g{g}"
            s, m = _moments(t_of, share, n_of), _moments(t_of, mean, n_of)
            one = np.bincount(t_of[np.isfinite(share)], minlength=n_of) == 1
            cv = np.where(np.abs(s["mean"]) < TINY, np.nan, np.where(one, 0.0, s["sd"] / s["mean"]))
        entropy, gini = _entropy_gini(t_of, sums, n_of)
        values = {"positive_frac_mean": s["mean"], "positive_frac_sd": s["sd"], "positive_frac_cv": cv, "positive_frac_iqr": s["iqr"], "intensity_mean_sd": m["sd"], "intensity_mean_iqr": m["iqr"], "mass_entropy": entropy, "mass_gini": gini}
        out |= {f"{base}_{n}": v for n, v in values.items()}
    return out


def _box_dimension(of: np.ndarray, row: np.ndarray, col: np.ndarray, most: np.ndarray, n_of: int) -> np.ndarray:
    """``raster.box_dimension`` of the mask's places; ``most``: the power of the largest box of each image."""
    n, k = np.zeros((n_of, max(int(most.max()), 1))), np.arange(1, max(int(most.max()), 1) + 1)
    for i in range(n.shape[1]):
        row, col = row >> 1, col >> 1
        order = np.lexsort((col, row, of))
        of, row, col = of[order], row[order], col[order]
        new = np.append(True, (of[1:] != of[:-1]) | (row[1:] != row[:-1]) | (col[1:] != col[:-1]))[: len(of)]
        of, row, col = of[new], row[new], col[new]
        n[:, i] = np.bincount(of, minlength=n_of)
    use = (k <= most[:, None]) & (n > 0)
    x, y = np.where(use, -k * np.log(2), 0.0), np.log(np.where(use, n, 1.0))
    with np.errstate(invalid="ignore", divide="ignore"):
        dx, dy = (np.where(use, a - (a.sum(1) / use.sum(1))[:, None], 0.0) for a in (x, y))
        return np.where((most >= 2) & (use.sum(1) > 1), (dx * dy).sum(1) / (dx * dx).sum(1), np.nan)


def _topology(t: TL.Tiles, mask: np.ndarray, tissue: np.ndarray, size: list[np.ndarray], pixel_um: float) -> dict[str, np.ndarray]:
    """``components.census``, ``hole_summary`` and ``boundary_length``, and the box dimension; ``mask`` a stack, ``tissue`` the pixels of each image."""
    n_of, area_um2 = len(mask), pixel_um * pixel_um
    of, _, c0, c1, root = TL.label_stack(mask, 1)
    first = np.unique(root)
    area = np.bincount(root, c1 - c0 + 1, len(root))[first]
    o = of[first]
    n, px = np.bincount(o, minlength=n_of), np.bincount(o, area, n_of)
    bh, br, b0, b1, broot = TL.label_stack(t.here & ~mask, 0)
    r, c0, c1 = br + t.r0[bh], b0 + t.c0[bh], b1 + t.c0[bh]
    edge = (r <= 0) | (c0 <= 0) | (r >= size[0][bh] - 1) | (c1 >= size[1][bh] - 1)
    open_ = np.zeros(len(broot), bool)
    open_[broot[edge]] = True
    hole = np.bincount(bh, np.where(open_[broot], 0, b1 - b0 + 1), n_of)
    m = np.pad(mask, ((0, 0), (1, 1), (1, 1))).astype(int)
    code = m[:, :-1, :-1] + 2 * m[:, :-1, 1:] + 4 * m[:, 1:, :-1] + 8 * m[:, 1:, 1:] + 16 * np.arange(n_of)[:, None, None]
    q = np.bincount(code.ravel(), minlength=16 * n_of).reshape(-1, 16)
    q1, q2, qd, q3 = (q[:, list(k)].sum(1) for k in ((1, 2, 4, 8), (3, 12, 5, 10), (6, 9), (7, 11, 13, 14)))
    euler = (q1 - q3 + 2 * qd) / 4
    median, q25, q75 = quantiles(o, area * area_um2, n_of, (0.5, 0.25, 0.75))
    at = np.nonzero(mask)
    most = np.floor(np.log2(np.maximum(np.minimum(*size), 1))).astype(np.int64)
    with np.errstate(invalid="ignore", divide="ignore"):
        mm2 = tissue * area_um2 / 1e6
        return {
            "topology_component_count": n.astype(float), "topology_component_density_per_mm2": np.where(mm2 > 0, n / mm2, np.nan), "topology_largest_component_frac": np.where(n > 0, ends(o, area, n_of)[1] / px, np.nan),
            "topology_component_area_median_um2": median, "topology_component_area_iqr_um2": q75 - q25, "topology_hole_area_frac": np.where(px > 0, hole / px, np.nan), "topology_hole_count": np.maximum(0.0, n - euler),
            "topology_euler_number": euler, "topology_boundary_length_um": (q2 + 2**0.5 / 2 * (q1 + q3 + 2 * qd)) * pixel_um, "topology_fractal_dimension": _box_dimension(at[0], at[1] + t.r0[at[0]], at[2] + t.c0[at[0]], most, n_of),
        }


#: Rows of a group that one task summarises at once.
GROUP = 100_000


def summarise(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``stats.summarise`` by median and IQR, and ``_n`` rows, of groups that are often small: many at a time on arrays; those of over GROUP rows by aggregates."""
    n = Scratch(df.sparkSession, "groups").save(df.groupBy(*keys).agg(F.count("*").alias("_n")))
    large = n.where(F.col("_n") > GROUP)
    some, of = not large.isEmpty(), [f"{c}_{a}" for c in columns for a in ("median", "iqr")]

    def work(rows: pa.Table, starts: np.ndarray) -> dict[str, pa.Array]:
        group, out = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows)))), {}
        for c in columns:
            v = rows.column(c).to_numpy().astype(float)
            good = np.isfinite(v)
            median, q25, q75 = quantiles(group[good], v[good], len(starts), (0.5, 0.25, 0.75))
            out |= {f"{c}_median": median, f"{c}_iqr": q75 - q25}
        return {c: pa.array(v, mask=np.isnan(v)) for c, v in out.items()}

    d = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    out = TL.over_many(d.join(large, keys, "left_anti") if some else d, keys, work, TL.schema_of(df, keys, **dict.fromkeys(of, "double")))
    if some:
        out = out.unionByName(stats.summarise(d.join(large, keys, "left_semi"), keys, columns, ("median", "iqr")))
    return out.join(n, keys)


def _texture(v: np.ndarray, here: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The properties of each array's matrices: arrays, offsets, properties."""
    n_of, k = len(v), len(OFFSETS)
    of, at, i, j = pairs(v, here)
    base = (of * k + at) * LEVELS
    code, n = np.unique(np.concatenate([(base + i) * LEVELS + j, (base + j) * LEVELS + i]), return_counts=True)
    m, i, j = code // LEVELS**2, (code // LEVELS % LEVELS).astype(float), (code % LEVELS).astype(float)
    total = np.bincount(m, n, n_of * k)
    p, d = n / total[m], i - j
    s = lambda x: np.bincount(m, x, n_of * k)
    mi, mj = s(i * p), s(j * p)
    vi, vj, asm = s(i * i * p) - mi * mi, s(j * j * p) - mj * mj, s(p * p)
    with np.errstate(invalid="ignore", divide="ignore"):
        corr = np.where((vi > TINY) & (vj > TINY), (s(i * j * p) - mi * mj) / (np.sqrt(vi) * np.sqrt(vj)), np.nan)
    out = np.stack([s(d * d * p), s(np.abs(d) * p), s(p / (1 + d * d)), asm, np.sqrt(asm), corr, -s(p * np.log2(p))], 1)
    out[total == 0] = np.nan
    return out.reshape(n_of, k, len(PROPERTIES))


def _mean_sd(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation (0 of one value) over the offsets, without undefined ones."""
    good = ~np.isnan(x)
    n = good.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.where(good, x, 0.0).sum(1) / n
        sd = np.sqrt((np.where(good, x - mean[:, None], 0.0) ** 2).sum(1) / (n - 1))
    return mean, np.where(n == 1, 0.0, np.where(n > 1, sd, np.nan))


def names(scale: dict[int, str]) -> dict[str, list[str]]:
    """Columns of ``features`` by family; ``scale``: the label of a distance in pixels."""
    of = ("", *[f"{scale[d]}_" for d in (1, 2, 4)])
    texture = [f"texture_{p}_{v}_{s}{n}_{m}" for p in ("tissue", "positive") for v in ("norm", "raw") for s in of for n in PROPERTIES for m in (("mean", "sd") if not s else ("mean",))]
    pixels = ["percent_area_stained", "percent_tissue_area", "positive_fraction_in_tissue"]
    pixels += [f"pixel_{k}_{p}_{m}" for k in ("norm", "raw") for p in ("tissue", "positive") for m in ("mean", "sd", "iqr", "skew", "kurtosis")]
    pixels += [f"pixel_norm_{p}_{m}" for p in ("tissue", "positive") for m in ("frac_0", "frac_1plus", "frac_2plus", "frac_3plus", "hscore")]
    tiles = [f"tile_g{g}_{n}" for g in GRIDS for n in ("positive_frac_mean", "positive_frac_sd", "positive_frac_cv", "positive_frac_iqr", "intensity_mean_sd", "intensity_mean_iqr", "mass_entropy", "mass_gini")]
    topology = ["component_count", "component_density_per_mm2", "largest_component_frac", "component_area_median_um2", "component_area_iqr_um2", "hole_area_frac", "hole_count", "euler_number", "boundary_length_um", "fractal_dimension"]
    return {"tiles": tiles, "topology": [f"topology_{n}" for n in topology], "texture": texture, "granularity": [f"granularity_{p}_norm_{scale[r]}" for p in ("tissue", "positive") for r in (1, 2, 4, 8)], "pixels": pixels}


def features(pixels: DataFrame, keys: list[str], mask: str, valid: str, norm: str, raw: str, height: Size, width: int | None, scale: dict[int, str], pixel_um: float) -> DataFrame:
    """Texture, granularity, pixel, tile and topology features (``names``) of images that fit a tile, one row an image; pixels are exchanged once for all of them."""
    every = [n for part in names(scale).values() for n in part]
    distances = np.array([o[0] for o in OFFSETS])

    def work(t: TL.Tiles) -> pa.Table:
        of, n_of, out = t.of, len(t.starts), {}
        known, true = {}, {}
        for c in ("_mask", "_valid"):
            v = t.rows.column(c)
            known[c], true[c] = np.asarray(v.is_valid()), np.asarray(v.fill_null(False)).astype(bool)
        value = {k: t.rows.column(c).to_numpy().astype(float) for k, c in (("norm", "_norm"), ("raw", "_raw"))}
        null = {k: np.asarray(t.rows.column(c).is_null()) for k, c in (("norm", "_norm"), ("raw", "_raw"))}
        at = {"tissue": true["_valid"], "positive": true["_valid"] & true["_mask"]}
        at_known = (known["_mask"] & known["_valid"]) | (known["_mask"] & ~true["_mask"]) | (known["_valid"] & ~true["_valid"])
        count = lambda x: np.bincount(of, x, n_of)
        with np.errstate(invalid="ignore", divide="ignore"):
            out["percent_area_stained"] = count(true["_mask"]) / count(known["_mask"])
            out["percent_tissue_area"] = count(true["_valid"]) / count(known["_valid"])
            out["positive_fraction_in_tissue"] = np.where(count(at_known) > 0, count(at["positive"]) / count(at["tissue"]), np.nan)
        out["positive_fraction_in_tissue"][count(at["tissue"]) == 0] = np.nan
        size = [t.rows.column(c).to_numpy().astype(float)[t.starts] for c in ("_h", "_w")]
        on, row, col = at["tissue"], t.row, t.col
        out |= _grids(of[on], row[on], col[on], size, np.where(known["_mask"], true["_mask"], np.nan)[on], value["norm"][on], null["norm"][on], n_of)
        stack = np.zeros(t.shape, bool)
        stack[of, t.r, t.c] = true["_mask"]
        out |= _topology(t, stack, count(at["tissue"]), size, pixel_um)
        every_limit = _limits(of, value["norm"], n_of)
        for place, where in at.items():
            for kind in ("norm", "raw"):
                v, o = value[kind][where], of[where]
                out |= {f"pixel_{kind}_{place}_{n}": x for n, x in _moments(o, v, n_of).items()}
                limits = _limits(o, v, n_of)
                level = np.full(t.shape, -1, np.int64)
                level[o, t.r[where], t.c[where]] = np.minimum(np.floor(_stretch(v, null[kind][where], o, limits) * (LEVELS - 1)), LEVELS - 1)
                x, base = _texture(level, t.here), f"texture_{place}_{kind}_"
                for i, n in enumerate(PROPERTIES):
                    out[f"{base}{n}_mean"], out[f"{base}{n}_sd"] = _mean_sd(x[:, :, i])
                    for d in (1, 2, 4):
                        out[f"{base}{scale[d]}_{n}_mean"] = _mean_sd(x[:, distances == d, i])[0]
                if kind == "norm":
                    inner = limits
            out |= _score_bins(of, value["norm"], where, n_of, f"pixel_norm_{place}")
            whole = _stretch(value["norm"], null["norm"], of, every_limit)
            x = np.where(np.isnan(inner[2])[of], whole, _stretch(value["norm"], null["norm"], of, inner))
            dense, m = np.zeros(t.shape), np.zeros(t.shape, bool)
            dense[of, t.r, t.c], m[of, t.r, t.c] = x, where
            some, sums = spectrum(dense, m, t.here, np.ones(t.shape, bool), (1, 2, 4, 8))
            for r, before, after in zip((1, 2, 4, 8), sums, sums[1:]):
                with np.errstate(invalid="ignore", divide="ignore"):
                    loss = np.where(sums[0] <= 0, 0.0, np.maximum(0.0, before - after) / sums[0])
                out[f"granularity_{place}_norm_{scale[r]}"] = np.where(some, loss, np.nan)
        return t.with_keys(keys, np.arange(n_of), {n: pa.array(out[n], mask=np.isnan(out[n])) for n in every})

    p = pixels.select(*keys, "row", "col", F.col(mask).alias("_mask"), F.col(valid).alias("_valid"), F.col(norm).cast("double").alias("_norm"), F.col(raw).cast("double").alias("_raw"))
    if isinstance(height, DataFrame):
        p = p.join(height.select(*keys, F.col("height").alias("_h"), F.col("width").alias("_w")), keys, "left").na.fill(1, ["_h", "_w"])
    else:
        p = with_size(p, keys, height, width)
    tasks = max(pixels.count() // TASK_PIXELS + 1, pixels.sparkSession.sparkContext.defaultParallelism)
    return TL.over_images(p, keys, work, TL.schema_of(p, keys, **dict.fromkeys(every, "double")), tasks)


ship(__name__)
