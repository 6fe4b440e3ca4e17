"""Connected objects of masks, clean-up by object, and object measures.

Objects are found in two levels: inside tiles on arrays, then over the tiles' edges as components of an edge table. Where only runs of rows are at
hand (holes of an object's box), runs of adjacent rows that overlap are linked, and the run graph's components are the objects. A label
is the object's first pixel in row order (``row * STRIDE + col``), unique within the image keys.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch, ship
from tessera.functions import stats as S
from tessera.operators import focal
from tessera.operators import tiles as TL
from tessera.operators.raster import Size, with_size
from tessera.operators.graph import connected_components

STRIDE = 1 << 24


def runs(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of the foreground rows ``mask``: ``keys, row, c0, c1`` (ends inclusive)."""
    island = F.col("col") - F.row_number().over(W.partitionBy(*keys, "row").orderBy("col"))
    return mask.select(*keys, "row", "col", island.alias("_i")).groupBy(*keys, "row", "_i").agg(F.min("col").alias("c0"), F.max("col").alias("c1")).drop("_i")


def label_runs(r: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Runs (``keys, row, c0, c1``) with ``label``: those of adjacent rows that overlap, or (8-connected) touch at a corner, are one object."""
    tmp = Scratch(r.sparkSession, "label")
    reach = 1 if connectivity == 8 else 0
    r = r.select(*keys, "row", "c0", "c1", (F.col("row").cast("long") * STRIDE + F.col("c0")).alias("first"))
    r = tmp.save(r.withColumn("node", F.struct(*keys, "first")))
    up = r.select(*keys, (F.col("row") + 1).alias("row"), F.col("c0").alias("u0"), F.col("c1").alias("u1"), F.col("node").alias("src"))
    e = r.join(up, [*keys, "row"]).where((F.col("c0") <= F.col("u1") + reach) & (F.col("c1") >= F.col("u0") - reach)).select("src", F.col("node").alias("dst"))
    comp = tmp.save(connected_components(e).select("node", F.col("component.first").alias("label")))
    return r.join(comp, "node", "left").select(*keys, "row", "c0", "c1", F.coalesce("label", "first").alias("label"))


def label(mask: DataFrame, keys: list[str], connectivity: int = 8) -> DataFrame:
    """Foreground pixels with ``label`` (long), in two levels: objects of tiles first, then components of the tiles' touching edges.

    What is joined over tiles grows with the edges of tiles, and its rounds with the number of tiles that an object crosses, not with its pixels.
    """
    tmp = Scratch(mask.sparkSession, "label")
    size, reach = TL.TILE, 1 if connectivity == 8 else 0
    p = mask.select(*keys, "row", "col")

    def work(t: TL.Tiles) -> pa.Table:
        of, r, c0, c1, root = TL.label_stack(t.here, reach)
        first = (r + t.r0[of]) * STRIDE + c0 + t.c0[of]
        out = np.zeros(t.shape, np.int64)
        n = c1 - c0 + 1
        out[np.repeat(of, n), np.repeat(r, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(c0, n)] = np.repeat(first[root], n)
        return t.pixels([*keys, "row", "col"], label=out)

    lab = tmp.save(TL.over_tiles(p, keys, 0, work, TL.schema_of(p, p.columns, label="long"), size))
    at = lambda x: F.pmod(F.col(x), F.lit(size))
    rim = lab.where((at("row") == 0) | (at("row") == size - 1) | (at("col") == 0) | (at("col") == size - 1))
    steps = [(0, 1), (1, 0), *([(1, 1), (1, -1)] if reach else [])]
    moved = rim.select(*keys, F.col("label").alias("from"), F.explode(F.array(*[F.struct((F.col("row") + dy).alias("row"), (F.col("col") + dx).alias("col")) for dy, dx in steps])).alias("m"))
    over = moved.select(*keys, "from", "m.row", "m.col").join(rim, [*keys, "row", "col"]).where("from <> label").select(*keys, "from", "label").distinct()
    node = lambda x: F.struct(*keys, F.col(x).alias("label"))
    edges = tmp.save(over.select(node("from").alias("src"), node("label").alias("dst")))
    if edges.isEmpty():
        return lab
    comp = tmp.save(connected_components(edges).select(*[F.col(f"node.{k}").alias(k) for k in keys], F.col("node.label").alias("label"), F.col("component.label").alias("_to")))
    return lab.join(comp, [*keys, "label"], "left").select(*keys, "row", "col", F.coalesce("_to", "label").alias("label"))


def sizes(labels: DataFrame, keys: list[str]) -> DataFrame:
    return labels.groupBy(*keys, "label").agg(F.count("*").alias("area"), F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))


def _keep(labels: DataFrame, keys: list[str], keep: Column, height: Size = 0, width: int | None = 0) -> DataFrame:
    good = with_size(sizes(labels, keys), keys, height, width).where(keep).select(*keys, "label")
    return labels.join(good, [*keys, "label"], "left_semi").select(*keys, "row", "col")


#: Objects off the border of their image.
INSIDE = "r0 > 0 AND c0 > 0 AND r1 < _h - 1 AND c1 < _w - 1"


def remove_small(mask: DataFrame, keys: list[str], least: int, connectivity: int = 4) -> DataFrame:
    """Objects below ``least`` pixels go."""
    return mask if least <= 0 else _keep(label(mask, keys, connectivity), keys, F.col("area") >= least)


def remove_long(mask: DataFrame, keys: list[str], fraction: float, height: Size, width: int | None = None, reference: int = 0, connectivity: int = 8) -> DataFrame:
    """Objects whose longer box side reaches ``fraction`` of the reference length (the longer image side) go."""
    if fraction <= 0:
        return mask
    span = F.greatest(F.col("r1") - F.col("r0"), F.col("c1") - F.col("c0")) + 1
    side = F.lit(float(reference)) if reference else F.greatest("_h", "_w").cast("double")
    return _keep(label(mask, keys, connectivity), keys, span / side < fraction, height, width)


def clear_border(mask: DataFrame, keys: list[str], height: Size, width: int | None = None, connectivity: int = 8) -> DataFrame:
    """Objects that touch the image border go."""
    return _keep(label(mask, keys, connectivity), keys, F.expr(INSIDE), height, width)


#: Pixels that a task compares with a mask.
TASK_PIXELS = 500_000


def complement(pixels: DataFrame, mask: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels outside the mask. Tasks are as many as the pixels ask for: adaptive execution merges partitions by compressed bytes, of which places have few, so that a task would sort ever more rows."""
    at = [*keys, "row", "col"]
    n = pixels.count() // TASK_PIXELS + 1
    return pixels.select(*at).repartition(n, *at).join(mask.select(*at).repartition(n, *at), at, "left_anti")


def holes(pixels: DataFrame, mask: DataFrame, keys: list[str], height: Size, width: int | None = None, max_area: int = 0) -> DataFrame:
    """Background pixels to fill: background objects (4-connected) off the border; with ``max_area``: all below that area."""
    bg = label(complement(pixels, mask, keys), keys, 4)
    return _keep(bg, keys, F.expr(INSIDE) if max_area <= 0 else F.col("area") < max_area, height, width)


def fill_holes(pixels: DataFrame, mask: DataFrame, keys: list[str], height: Size, width: int | None = None, max_area: int = 0) -> DataFrame:
    return mask.select(*keys, "row", "col").unionByName(holes(pixels, mask, keys, height, width, max_area))


def clean_up(pixels: DataFrame, keys: list[str], mask: str, height: Size, width: int | None = None, open_radius=0, close_radius=0, small=0, long_fraction=0.0, long_reference=0, fill: bool = False, fill_area: int = 64, border: bool = False) -> DataFrame:
    """Mask pixels after opening, closing, small objects, long objects, holes and border, in that order."""
    d = pixels.select(*keys, "row", "col", F.col(mask).cast("int").alias("_m"))
    d = focal.chain(d, keys, "_m", [("min", open_radius), ("max", open_radius), ("max", close_radius), ("min", close_radius)])
    m = d.where("_m = 1").select(*keys, "row", "col")
    m = remove_small(m, keys, small)
    m = remove_long(m, keys, long_fraction, height, width, long_reference)
    if fill:
        m = fill_holes(pixels, m, keys, height, width, fill_area)
    return clear_border(m, keys, height, width) if border else m


def gate(target: DataFrame, pixels: DataFrame, gate_mask: str, keys: list[str], mode: str = "touching", dilate_px: int = 2, min_overlap: float = 0.0) -> DataFrame:
    """Pixels of target objects that meet the gate mask (dilated when touching), at least by ``min_overlap`` of their area if set."""
    g = pixels.select(*keys, "row", "col", F.col(gate_mask).cast("int").alias("_g"))
    if mode != "intersect" and dilate_px > 0:
        g = focal.dilate(g, keys, "_g", dilate_px)
    lab = label(target, keys)
    met = lab.join(g, [*keys, "row", "col"], "left").groupBy(*keys, "label").agg(F.avg(F.coalesce("_g", F.lit(0)).cast("double")).alias("share"))
    good = met.where(F.col("share") >= min_overlap if min_overlap > 0 else F.col("share") > 0)
    return lab.join(good, [*keys, "label"], "left_semi").select(*keys, "row", "col")


def touching(labels: DataFrame, pixels: DataFrame, other: str, keys: list[str], prefix: str, radius: int = 2) -> DataFrame:
    """Shares of objects that touch (within ``radius``) and overlap another mask."""
    near = focal.dilate(pixels.select(*keys, "row", "col", F.col(other).cast("int").alias("_o"), F.col(other).cast("int").alias("_n")), keys, "_n", radius)
    per = labels.join(near, [*keys, "row", "col"]).groupBy(*keys, "label").agg(F.max("_n").alias("n"), F.max("_o").alias("o"))
    return per.groupBy(*keys).agg(F.avg(F.col("n").cast("double")).alias(f"{prefix}_touching_object_fraction"), F.avg(F.col("o").cast("double")).alias(f"{prefix}_overlapping_object_fraction"))


def intensity(labels: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """Nine statistics of the values of each object (deviation with ddof 0)."""
    f = {"mean": S.mean, "std": lambda x: S.sd(x, 0), "median": S.median, "iqr": S.iqr, "integrated": lambda x: F.sum(S.finite(x)), "min": S.least, "max": S.most, "skew": S.skew, "kurtosis": S.kurtosis}
    return labels.groupBy(*keys, "label").agg(*[g(value).alias(f"{prefix}_{n}") for n, g in f.items()])


def geometry(labels: DataFrame, keys: list[str], pixel_width: float = 1.0, pixel_height: float = 1.0) -> DataFrame:
    """Area, centroid, box, extent, equivalent diameter, axes, eccentricity and orientation from moments.

    Second moments have 1/12 added for the pixel's own extent; axes are 4 sqrt(eigenvalue); orientation is the angle of
    the long axis to the row axis, in degrees, in (-90, 90].
    """
    px = pixel_width * pixel_height
    unit = px**0.5
    row, col = F.col("row").cast("double"), F.col("col").cast("double")
    g = labels.groupBy(*keys, "label").agg(
        F.count("*").cast("double").alias("n"), F.avg(row).alias("cr"), F.avg(col).alias("cc"), (F.var_pop(row) + 1 / 12).alias("a"), F.covar_pop(row, col).alias("b"), (F.var_pop(col) + 1 / 12).alias("c"),
        (F.max(row) - F.min(row) + 1).alias("bh"), (F.max(col) - F.min(col) + 1).alias("bw"),
    )
    root = F.sqrt(F.pow((F.col("a") - F.col("c")) / 2, F.lit(2.0)) + F.col("b") * F.col("b"))
    mid = (F.col("a") + F.col("c")) / 2
    g = g.withColumn("l1", mid + root).withColumn("l2", F.greatest(mid - root, F.lit(0.0)))
    turn = F.when((F.abs(F.col("b")) < 1e-9) & (F.abs(F.col("a") - F.col("c")) < 1e-9), F.lit(45.0)).otherwise(F.degrees(F.atan2(F.when(F.abs(F.col("b")) < 1e-9, F.lit(0.0)).otherwise(2 * F.col("b")), F.col("a") - F.col("c")) / 2))
    area, box = F.col("n"), F.col("bh") * F.col("bw")
    return g.select(
        *keys, "label", (F.col("cr") * pixel_height).alias("centroid_row_um"), (F.col("cc") * pixel_width).alias("centroid_col_um"), (area * px).alias("area_um2"),
        (F.sqrt(area * 4 / F.pi()) * unit).alias("equivalent_diameter_um"), (4 * F.sqrt("l1") * unit).alias("major_axis_length_um"), (4 * F.sqrt("l2") * unit).alias("minor_axis_length_um"),
        F.sqrt(F.greatest(1 - F.try_divide(F.col("l2"), F.col("l1")), F.lit(0.0))).alias("eccentricity"), (area / box).alias("extent"), turn.alias("orientation_deg"), (box * px).alias("bbox_area_um2"),
        (area / box).alias("bbox_fill_ratio"), (F.col("bw") / F.col("bh")).alias("bbox_aspect_ratio"), F.try_divide(F.sqrt("l1"), F.sqrt("l2")).alias("elongation"),
    )


def shape_ratios(df: DataFrame, area: str, perimeter: str, filled: str) -> DataFrame:
    """Adds circularity (0 without perimeter), roughness, hole area and hole fraction."""
    a, p, f = F.col(area), F.col(perimeter), F.col(filled)
    four_pi = 4 * F.pi()
    hole = F.greatest(f - a, F.lit(0.0))
    return df.withColumns({"circularity": F.when(p > 0, F.try_divide(four_pi * a, p * p)).otherwise(F.lit(0.0)), "roughness": F.when(a > 0, F.try_divide(p * p, four_pi * a)), "hole_area": hole, "hole_fraction": F.coalesce(F.when(f > 0, F.try_divide(hole, f)), F.lit(0.0))})


SIDES, CORNERS = [(0, 1), (1, 0), (0, -1), (-1, 0)], [(1, 1), (1, -1), (-1, 1), (-1, -1)]
#: Weights of border codes (Benkrid & Crookes 2000; fixed values).
CODES = {1.0: (5, 7, 15, 17, 25, 27), 2**0.5: (21, 33), (1 + 2**0.5) / 2: (13, 23)}


def perimeter(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Perimeter in pixels from border-pixel codes.

    A border pixel has a side neighbour outside its object. Its code counts border pixels of the object beside
    it (2 each) and diagonal (10 each); codes 5, 7, 15, 17, 25, 27 weigh 1, codes 21, 33 weigh sqrt 2, codes 13, 23 weigh
    (1 + sqrt 2) / 2, once 1 is added for the pixel itself (Benkrid & Crookes 2000). Tiles give a sum for each object they hold.
    """
    weight = np.zeros(1 + 2 * 4 + 10 * 4 + 1)
    for w, codes in CODES.items():
        weight[list(codes)] = w

    def work(t: TL.Tiles) -> pa.Table | None:
        lab = t.dense("label", -1, np.int64)
        same = lambda a, moves: sum(((TL.shifted(a, dy, dx, -1) == a) & (a >= 0)).astype(int) for dy, dx in moves)
        edge = np.where(same(lab, SIDES) < 4, lab, -1)
        at = t.inside() & (edge >= 0)
        w = weight[1 + 2 * same(edge, SIDES) + 10 * same(edge, CORNERS)][at]
        names, name = np.unique(edge[at], return_inverse=True)
        object_, where = np.unique(np.nonzero(at)[0] * len(names) + name, return_inverse=True)
        return t.with_keys(keys, object_ // len(names), {"label": names[object_ % len(names)], "perimeter": np.bincount(where, w, len(object_))}) if len(names) else None

    p = labels.select(*keys, "row", "col", "label")
    return TL.over_tiles(p, keys, 2, work, TL.schema_of(p, keys, label="long", perimeter="double")).groupBy(*keys, "label").agg(F.sum("perimeter").alias("perimeter"))


def quads(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: counts of 2x2 patterns of the padded mask: ``q1`` one set, ``q2`` two beside, ``qd`` two diagonal, ``q3`` three set."""
    kinds = {"q1": (1, 2, 4, 8), "q2": (3, 12, 5, 10), "qd": (6, 9), "q3": (7, 11, 13, 14)}

    def work(t: TL.Tiles) -> pa.Table:
        m = np.pad(t.here, ((0, 0), (1, 1), (1, 1))).astype(int)  # a quad is at its upper left place, which may lie above or left of the pixels
        code = m[:, :-1, :-1] + 2 * m[:, :-1, 1:] + 4 * m[:, 1:, :-1] + 8 * m[:, 1:, 1:]
        of = np.arange(len(code))
        n = np.bincount((code + 16 * of[:, None, None])[t.inside(1)], minlength=16 * len(of)).reshape(-1, 16)
        return t.with_keys(keys, of, {k: n[:, list(c)].sum(1) for k, c in kinds.items()})

    p = mask.select(*keys, "row", "col")
    return TL.over_tiles(p, keys, 1, work, TL.schema_of(p, keys, **dict.fromkeys(kinds, "long"))).groupBy(*keys).agg(*[F.sum(k).alias(k) for k in kinds])


def of_images(measure: DataFrame, keys: list[str], images: DataFrame | None) -> DataFrame:
    """A measure of masks for every one of ``images``: 0 where the mask is empty and so has no row."""
    return measure if images is None else images.select(*keys).distinct().join(measure, keys, "left").na.fill(0.0)


def euler(mask: DataFrame, keys: list[str], images: DataFrame | None = None) -> DataFrame:
    """Euler numbers for 4- and 8-connectivity; 0 for those of ``images`` whose mask is empty."""
    q = quads(mask, keys)
    base = F.col("q1") - F.col("q3")
    return of_images(q.select(*keys, ((base + 2 * F.col("qd")) / 4).alias("euler4"), ((base - 2 * F.col("qd")) / 4).alias("euler8")), keys, images)


def boundary_length(mask: DataFrame, keys: list[str], images: DataFrame | None = None) -> DataFrame:
    """Length of all boundaries, outer and of holes: a step of 1 for a straight quad, sqrt(2) / 2 for a corner one; 0 for those of ``images`` whose mask is empty."""
    half = 2**0.5 / 2
    q = quads(mask, keys)
    return of_images(q.select(*keys, (F.col("q2") + half * (F.col("q1") + F.col("q3") + 2 * F.col("qd"))).alias("boundary_length")), keys, images)


#: Runs of an object that one task may hold (24 bytes each); larger objects are filled by components of their background runs.
MOST_RUNS = 4_000_000


def _holes(rows: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Hole area and holes of many objects at once, from their runs: the background runs of each box, 4-connected, that do not reach the ring around it. Boxes are placed one below the other."""
    row, c0, c1 = (rows.column(c).to_numpy().astype(np.int64) for c in ("row", "c0", "c1"))
    of, every = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(row)))), np.arange(len(starts))
    top, left = np.minimum.reduceat(row, starts), np.minimum.reduceat(c0, starts) - 1
    high, width = np.maximum.reduceat(row, starts) - top + 1, np.maximum.reduceat(c1, starts) - left + 2
    base = np.cumsum(high + 3) - (high + 3)  # two rows of the ring, and an empty one
    row, c0, c1 = row - top[of] + 1 + base[of], c0 - left[of], c1 - left[of]
    first, last = np.append(True, row[1:] != row[:-1]), np.append(row[1:] != row[:-1], True)
    g0 = np.where(first, 0, np.append(0, c1[:-1] + 1))  # from the run before, or the ring
    ring = lambda at: np.stack([at, np.zeros_like(at), width - 1, every])
    gaps = np.concatenate([np.stack([row, g0, c0 - 1, of]), np.stack([row[last], c1[last] + 1, width[of[last]] - 1, of[last]]), ring(base), ring(base + high + 1)], 1)
    gaps = gaps[:, gaps[1] <= gaps[2]]
    gaps = gaps[:, np.lexsort(gaps[1::-1])]
    wide = int(width.max()) + 2
    root = TL.join_runs(gaps[0] * wide + gaps[1], gaps[0] * wide + gaps[2], wide, 0)
    area = np.bincount(root, gaps[2] - gaps[1] + 1, len(root)).astype(np.int64)
    inside = np.bincount(root, minlength=len(root)) > 0
    inside[np.searchsorted(gaps[3], every)] = False  # the ring's part holds its box's first run
    in_ = gaps[3][inside]
    return {"hole_area": np.bincount(in_, area[inside], len(starts)).astype(np.int64), "holes": np.bincount(in_, minlength=len(starts))}


def _large_holes(own: DataFrame, box: DataFrame, keys: list[str]) -> DataFrame:
    """The same for objects of any size: background runs as an edge table."""
    k = [*keys, "label"]
    by = W.partitionBy(*k, "row").orderBy("c0")
    span = lambda a, z: F.struct(a.alias("c0"), z.alias("c1"))
    d = own.join(box.select(*k, "b0", "b1"), k).withColumn("left", F.coalesce(F.lag("c1").over(by) + 1, F.col("b0"))).withColumn("last", F.lead("c0").over(by).isNull())
    gaps = F.array(span(F.col("left"), F.col("c0") - 1), F.when(F.col("last"), span(F.col("c1") + 1, F.col("b1"))))
    gaps = d.select(*k, "row", F.explode(F.filter(gaps, lambda g: g["c0"] <= g["c1"])).alias("g")).select(*k, "row", "g.c0", "g.c1")
    rims = box.select(*k, F.explode(F.array(F.col("r0") - 1, F.col("r1") + 1)).alias("row"), F.col("b0").alias("c0"), F.col("b1").alias("c1"))
    bg = label_runs(gaps.unionByName(rims).withColumnRenamed("label", "object"), [*keys, "object"], 4)
    bg = bg.groupBy(*keys, "object", "label").agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area"), F.min("row").alias("h0")).select(*keys, F.col("object").alias("label"), F.col("area").alias("hole"), "h0")
    # the ring around the object is one part; it holds the row above the box
    return bg.join(box.select(*k, "r0"), k).where(F.col("h0") >= F.col("r0")).groupBy(*k).agg(F.sum("hole").alias("hole_area"), F.count("*").alias("holes"))


def filled_area(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per object: area, hole area (4-connected background parts of its box that do not reach the box's edge) and Euler number (8).

    The background of a box, one pixel wider than the object, is taken as row runs: what lies between the object's own runs. So the work grows with
    the object's runs, not with its box.
    """
    k = [*keys, "label"]
    tmp = Scratch(labels.sparkSession, "filled")
    own = tmp.save(runs(labels, k))
    box = tmp.save(own.groupBy(*k).agg(F.sum(F.col("c1") - F.col("c0") + 1).alias("area"), F.count("*").alias("n"), F.min("row").alias("r0"), F.max("row").alias("r1"), (F.min("c0") - 1).alias("b0"), (F.max("c1") + 1).alias("b1")))
    # a hole lies between two runs of a row: objects with a run a row have none
    apart = box.where(F.col("n") > F.col("r1") - F.col("r0") + 1)
    large = apart.where(F.col("n") > MOST_RUNS)
    some = not large.isEmpty()
    small = own.join(apart.where(F.col("n") <= MOST_RUNS), k, "left_semi")
    hole = TL.over_groups(small, k, _holes, TL.schema_of(own, k, hole_area="long", holes="long"), ("row", "c0"), many=True)
    if some:
        hole = hole.unionByName(_large_holes(own.join(large, k, "left_semi"), large, keys))
    out = box.select(*k, "area").join(hole, k, "left").select(*k, "area", F.coalesce("hole_area", F.lit(0)).alias("hole_area"), F.coalesce("holes", F.lit(0)).alias("holes"))
    return out.withColumn("filled_area", F.col("area") + F.col("hole_area")).withColumn("euler", 1 - F.col("holes")).withColumn("euler_reported", F.when(F.col("euler") == 0, F.lit(1)).otherwise(F.col("euler")))


#: Hull vertices of an object whose pairs are taken at once with those of others.
FEW_VERTICES = 32


def _hulls(rows: pa.Table, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Area, convex area (corner points of pixels) and greatest distance between hull vertices, of many objects at once, from their row extremes by row.

    Places are doubled, so that corners are integers. A point that its chain's neighbours leave inside is no vertex, so all such points go at once, until none is left.
    """
    r, c0, c1, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("row", "c0", "c1", "n"))
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(r))))
    of, y = np.repeat(of, 2), np.stack([2 * r - 1, 2 * r + 1], 1).ravel()
    new = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (y[1:] != y[:-1])))
    left, right = np.minimum.reduceat(np.repeat(2 * c0 - 1, 2), new), np.maximum.reduceat(np.repeat(2 * c1 + 1, 2), new)
    of, y = of[new], y[new]
    chain, y, x = np.concatenate([of, of + len(starts)]), np.tile(y, 2), np.concatenate([left, -right])  # a right side is mirrored
    while True:
        same = (chain[2:] == chain[1:-1]) & (chain[1:-1] == chain[:-2])
        inside = same & ((x[1:-1] - x[:-2]) * (y[2:] - y[:-2]) >= (x[2:] - x[:-2]) * (y[1:-1] - y[:-2]))
        if not inside.any():
            break
        keep = np.concatenate([[True], ~inside, [True]])
        chain, y, x = chain[keep], y[keep], x[keep]
    on = chain[1:] == chain[:-1]
    twice = np.zeros(len(starts), np.int64)
    np.add.at(twice, (chain[1:] % len(starts))[on], (-(x[1:] + x[:-1]) * (y[1:] - y[:-1]))[on])
    x, of = np.where(chain < len(starts), x, -x), chain % len(starts)
    order = np.argsort(of, kind="stable")
    x, y, of = x[order], y[order], of[order]
    size = np.bincount(of, minlength=len(starts))
    first, most = np.cumsum(size) - size, np.zeros(len(starts), np.int64)
    few = size[of] <= FEW_VERTICES
    a = np.repeat(np.flatnonzero(few), size[of[few]])
    b = np.arange(len(a)) - np.repeat(np.cumsum(size[of[few]]) - size[of[few]], size[of[few]]) + first[of[a]]
    np.maximum.at(most, of[a], (x[a] - x[b]) ** 2 + (y[a] - y[b]) ** 2)
    for i in np.flatnonzero(size > FEW_VERTICES):
        u, v = x[first[i] : first[i] + size[i]], y[first[i] : first[i] + size[i]]
        most[i] = max(((u - p) ** 2 + (v - q) ** 2).max() for p, q in zip(u, v))
    return {"area": np.add.reduceat(n, starts), "convex_area": twice / 8, "caliper": np.sqrt(most) / 2}


def hulls(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Per object: convex area, solidity and largest caliper. Objects are first reduced to the extremes of their rows; a task takes many objects at once."""
    k = [*keys, "label"]
    ends = labels.groupBy(*k, "row").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))
    h = TL.over_many(ends, k, _hulls, TL.schema_of(labels, k, area="long", convex_area="double", caliper="double"), ("row",))
    return h.select(*k, "area", "convex_area", (F.col("area") / F.col("convex_area")).alias("solidity"), "caliper")


def census(labels: DataFrame, keys: list[str], tissue: DataFrame, pixel_area: float = 1.0) -> DataFrame:
    """Objects per image: count, density per mm2 of tissue (``keys, tissue_px``), share of the largest, median and IQR of area."""
    per = sizes(labels, keys).withColumn("a", F.col("area") * pixel_area)
    g = per.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.max("area"), F.sum("area")).alias("largest"), S.median("a").alias("median"), S.iqr("a").alias("iqr"))
    j = tissue.join(g, keys, "left")
    mm2 = F.col("tissue_px") * pixel_area / 1e6
    n = F.coalesce("n", F.lit(0)).cast("double")
    return j.select(*keys, n.alias("topology_component_count"), F.try_divide(n, F.when(mm2 > 0, mm2)).alias("topology_component_density_per_mm2"), F.col("largest").alias("topology_largest_component_frac"), F.col("median").alias("topology_component_area_median_um2"), F.col("iqr").alias("topology_component_area_iqr_um2"))


def hole_summary(pixels: DataFrame, mask: DataFrame, keys: list[str], height: Size, width: int | None = None) -> DataFrame:
    """Of every image of ``pixels``: hole area over mask area (null for an empty mask), hole count as (8-connected objects - Euler number for 4-connectivity), not below 0, the exact hole count, and that Euler number."""
    tmp = Scratch(pixels.sparkSession, "holes")
    images = pixels.select(*keys).distinct()
    area = mask.groupBy(*keys).agg(F.count("*").alias("n"))
    filled = tmp.save(holes(pixels, mask, keys, height, width))
    parts = label(filled, keys, 4).groupBy(*keys).agg(F.count("*").alias("hole_px"), F.count_distinct("label").alias("hole_count_exact"))
    objects = label(mask, keys).groupBy(*keys).agg(F.count_distinct("label").alias("objects"))
    j = images
    for part in (area, parts, objects, euler(mask, keys)):
        j = j.join(part, keys, "left")
    z = F.lit(0)
    e = F.coalesce("euler4", F.lit(0.0))
    return j.select(*keys, (F.coalesce("hole_px", z) / F.col("n")).alias("topology_hole_area_frac"), F.greatest(F.lit(0.0), F.coalesce("objects", z) - e).alias("topology_hole_count"), F.coalesce("hole_count_exact", z).alias("hole_count_exact"), e.alias("topology_euler_number"))


def largest(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of each group's largest object (of equals the first)."""
    lab = label(mask, keys)
    top = sizes(lab, keys).groupBy(*keys).agg(F.min(F.struct((-F.col("area")).alias("a"), "label"))["label"].alias("label"))
    return lab.join(top, [*keys, "label"], "left_semi").select(*keys, "row", "col")


def log_hu(mask: DataFrame, keys: list[str]) -> DataFrame:
    """Signed-log Hu moments of the mask pixels of a group (area moments); below 1e-12 a moment counts as 0."""
    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    c = mask.groupBy(*keys).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy"), F.count("*").cast("double").alias("_n"))
    d = mask.join(c, keys)
    dx, dy = x - F.col("_cx"), y - F.col("_cy")
    orders = [(2, 0), (1, 1), (0, 2), (3, 0), (2, 1), (1, 2), (0, 3)]
    m = d.groupBy(*keys, "_n").agg(*[(F.sum(F.pow(dx, F.lit(float(p))) * F.pow(dy, F.lit(float(q)))) / F.pow(F.col("_n"), F.lit(1 + (p + q) / 2))).alias(f"e{p}{q}") for p, q in orders])
    e20, e11, e02, e30, e21, e12, e03 = (F.col(f"e{p}{q}") for p, q in orders)
    s, t = e30 + e12, e21 + e03
    hu = [
        e20 + e02, (e20 - e02) ** 2 + 4 * e11**2, (e30 - 3 * e12) ** 2 + (3 * e21 - e03) ** 2, s**2 + t**2,
        (e30 - 3 * e12) * s * (s**2 - 3 * t**2) + (3 * e21 - e03) * t * (3 * s**2 - t**2), (e20 - e02) * (s**2 - t**2) + 4 * e11 * s * t,
        (3 * e21 - e03) * s * (s**2 - 3 * t**2) - (e30 - 3 * e12) * t * (3 * s**2 - t**2),
    ]
    return m.select(*keys, *[F.when(F.abs(h) < 1e-12, F.lit(0.0)).otherwise(-F.signum(h) * F.log10(F.abs(h))).alias(f"hu_{i}") for i, h in enumerate(hu, 1)])


ship(__name__)
