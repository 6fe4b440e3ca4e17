"""Image summaries: feature families as long rows, each written on its own, wide only at the end.

A family is one job with one output folder, so a summary of many images is restartable: families whose folder is complete are not made again. All families start from the same
skeleton of images, so an image without a single object has its zeros (counts, lengths) and its nulls (everything else) like any other.
"""

from __future__ import annotations

import contextvars
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from threading import Lock

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Scratch, exists
from tessera.functions import keys as K
from tessera.functions import stats as S
from tessera.operators import components as C
from tessera.operators import focal as FO
from tessera.operators import raster as R
from tessera.operators import spatial as SP
from tessera.operators import texture as TX
from tessera.operators import whole as WH
from tessera.sources import tables as IO

PIXEL_UM = 0.2738
#: Families whose jobs run side by side: many of them are short jobs that leave executors idle.
AT_ONCE = 4
#: Site columns that are summarised (fixed names).
SITE_COLUMNS = (
    "area_um2", "perimeter_um", "equivalent_diameter_um", "major_axis_length_um", "minor_axis_length_um", "eccentricity", "solidity", "extent", "circularity", "roughness", "feret_diameter_um",
    "bbox_area_um2", "bbox_fill_ratio", "bbox_aspect_ratio", "elongation", "filled_area_um2", "convex_area_um2", "hole_area_um2", "hole_fraction", "euler_number",
    "intensity_mean", "intensity_raw_mean", "intensity_raw_median", "intensity_raw_iqr", "intensity_raw_integrated",
)
#: Features that are 0, not null, where there is nothing to measure.
ZERO = ("num_sites", "density_per_mm2", "topology_component_count", "topology_hole_count", "topology_euler_number", "topology_boundary_length_um")


def long(df: DataFrame, keys: list[str]) -> DataFrame:
    """Wide features as ``keys, feature, value``."""
    names = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double") for c in names]).unpivot(keys, names, "feature", "value")


def on_skeleton(df: DataFrame, keys: list[str], images: DataFrame) -> DataFrame:
    """A wide family for every image: where an image has no row, features of ``ZERO`` are 0 and the others null."""
    zero = [c for c in df.columns if c in ZERO]
    return images.select(*keys).join(df, keys, "left").na.fill(0.0, zero) if zero else images.select(*keys).join(df, keys, "left")


def site_family(sites: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    return long(S.summarise(sites, keys, columns, ("median", "iqr")).join(sites.groupBy(*keys).agg(F.count("*").alias("num_sites")), keys), keys)


def wide_summary(families: list[DataFrame], keys: list[str], names: list[str]) -> DataFrame:
    return IO.wide(reduce(DataFrame.unionByName, families), keys, names)


def site_table(lab: DataFrame, own: DataFrame, k: list[str], norm: str, raw: str, pixel_um: float) -> DataFrame:
    """One row per object: geometry, intensities, perimeter, filled and convex area, ratios; lengths and areas in micrometres."""
    sites = C.geometry(lab, k, pixel_um, pixel_um).join(C.intensity(own, k, norm, "intensity"), [*k, "label"]).join(C.intensity(own, k, raw, "intensity_raw"), [*k, "label"])
    peri = C.perimeter(lab, k).select(*k, "label", (F.col("perimeter") * pixel_um).alias("perimeter_um"))
    fill = C.filled_area(lab, k).select(*k, "label", (F.col("filled_area") * pixel_um**2).alias("filled_area_um2"), F.col("euler_reported").cast("double").alias("euler_number"))
    hull = C.hulls(lab, k).select(*k, "label", (F.col("convex_area") * pixel_um**2).alias("convex_area_um2"), "solidity", (F.col("caliper") * pixel_um).alias("feret_diameter_um"))
    for part in (peri, fill, hull):
        sites = sites.join(part, [*k, "label"], "left")
    return C.shape_ratios(sites, "area_um2", "perimeter_um", "filled_area_um2").withColumnRenamed("hole_area", "hole_area_um2")


def centres(sites: DataFrame, key: str) -> DataFrame:
    return sites.select(F.col(key).alias("grp"), F.col("label").alias("pid"), F.col("centroid_row_um").alias("y"), F.col("centroid_col_um").alias("x"))


def families(pixels: DataFrame, key: str, mask: str, valid: str, norm: str, raw: str, height: R.Size, width: int | None = None, pixel_um: float = PIXEL_UM, others: dict[str, dict[str, str]] | None = None, only: list[str] | None = None) -> list[tuple[str, Callable[[], DataFrame]]]:
    """Name and job of each family; a job gives ``key, feature, value``. Jobs may run side by side: what several of them read is written once, by the first that needs it."""
    k = [key]
    tmp = Scratch(pixels.sparkSession, "summary")
    made: dict[str, DataFrame] = {}
    making = {name: Lock() for name in ("pixels", "images", "labels", "sites", "near", "larger", "whole")}

    def kept(name: str, f) -> DataFrame:
        with making[name]:  # a table's maker waits only for tables named before it
            if name not in made:
                made[name] = tmp.save(f())
            return made[name]

    px = lambda: kept("pixels", lambda: pixels)
    images = lambda: kept("images", lambda: px().select(key).distinct() if not isinstance(height, DataFrame) else height.select(key).distinct())
    fg = lambda: px().where(mask).select(*k, "row", "col")
    lab = lambda: kept("labels", lambda: C.label(fg(), k))
    sites = lambda: kept("sites", lambda: site_table(lab(), lab().join(px(), [*k, "row", "col"]), k, norm, raw, pixel_um))
    points = lambda: centres(sites(), key)
    near = lambda: kept("near", lambda: SP.knn(points(), 5))
    scale = {r: K.scale_label(r * pixel_um) for r in (1, 2, 4, 8)}
    columns = WH.names(scale)
    per_mm2 = pixel_um * pixel_um
    frame = height.select(F.col(key).alias("grp"), (F.col("height") * pixel_um).alias("height"), (F.col("width") * pixel_um).alias("width")) if isinstance(height, DataFrame) else height * pixel_um
    across = None if isinstance(height, DataFrame) else width * pixel_um
    named = lambda *dfs: reduce(lambda a, b: a.join(b, key, "left"), [images(), *[d.withColumnRenamed("grp", key) for d in dfs]])

    def larger() -> tuple[DataFrame, bool]:
        with making["larger"]:
            if "larger" not in made:
                made["larger"] = WH.larger(px(), k)
            return made["larger"]

    def on_arrays(name: str, by_tiles: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A family of pixels: images that fit a tile are measured once for all such families, larger ones each family on its own."""
        far, some = larger()
        out = kept("whole", lambda: WH.features(px().join(far, key, "left_anti") if some else px(), k, mask, valid, norm, raw, height, width, scale, pixel_um)).select(key, *columns[name])
        return out.unionByName(by_tiles(px().join(far, key, "left_semi")).select(key, *columns[name])) if some else out

    def object_sites() -> DataFrame:
        return WH.summarise(sites(), k, list(SITE_COLUMNS)).withColumnRenamed("_n", "num_sites")

    def scores() -> DataFrame:
        s = sites()
        top = s.groupBy(*k).agg(S.most("intensity_integrated").alias("_top"))
        scored = s.join(top, k).withColumn("_share", F.when(F.col("_top") > 0, F.col("intensity_integrated") / F.col("_top")).otherwise(F.col("intensity_integrated")))
        return scored.groupBy(*k).agg(*S.score_bins("intensity_mean", "object_norm_mean"), *S.score_bins("_share", "object_norm_integrated"))

    def burden() -> DataFrame:
        area = px().groupBy(*k).agg((F.sum(F.col(valid).cast("double")) * per_mm2).alias("tissue_area_um2"), (F.sum((F.col(valid) & F.col(mask)).cast("double")) * per_mm2).alias("positive_area_um2"))
        count = sites().groupBy(*k).agg(F.count("*").cast("double").alias("_n"))
        return area.join(count, k, "left").withColumn("num_sites_per_mm2_tissue", F.when(F.col("tissue_area_um2") > 0, F.coalesce("_n", F.lit(0.0)) / (F.col("tissue_area_um2") / 1e6))).drop("_n")

    def topology(px_: DataFrame) -> DataFrame:
        tissue = px_.groupBy(*k).agg(F.sum(F.col(valid).cast("long")).alias("tissue_px"))
        fg_ = px_.where(mask).select(*k, "row", "col")
        edge = C.boundary_length(fg_, k).select(*k, (F.col("boundary_length") * pixel_um).alias("topology_boundary_length_um"))
        box = R.box_dimension(fg_, k, height, width).withColumnRenamed("fractal_dimension", "topology_fractal_dimension")
        parts = [C.census(lab().join(tissue, key, "left_semi"), k, tissue, per_mm2), C.hole_summary(px_, fg_, k, height, width).drop("hole_count_exact"), edge, box]
        return reduce(lambda a, b: a.join(b, key, "left"), parts)

    def texture(px_: DataFrame) -> DataFrame:
        parts = []
        for place, where in (("tissue", F.col(valid)), ("positive", F.col(valid) & F.col(mask))):
            for kind, value in (("norm", norm), ("raw", raw)):
                q = R.normalise(px_.where(where), k, value, "_n", robust=True).select(*k, F.lit(f"texture_{place}_{kind}_").alias("_of"), "row", "col", R.quantise(F.col("_n")).alias("lv"))
                parts.append(q)
        of = [*k, "_of"]
        t = TX.rollup(TX.properties(TX.glcm(reduce(DataFrame.unionByName, parts), of, "lv"), of), of)
        names = F.create_map(*[x for s in (1, 2, 4) for x in (F.lit(s).cast("long"), F.lit(K.scale_label(s * pixel_um)))])
        base = F.concat("_of", F.when(F.col("scale").isNull(), F.lit("")).otherwise(F.concat(F.element_at(names, F.col("scale").cast("long")), F.lit("_"))), "property")
        both = F.explode(F.filter(F.array(F.struct(F.concat(base, F.lit("_mean")).alias("feature"), F.col("mean").alias("value")), F.when(F.col("scale").isNull(), F.struct(F.concat(base, F.lit("_sd")).alias("feature"), F.col("sd").alias("value")))), lambda x: x.isNotNull()))
        return IO.wide(t.select(*k, both.alias("x")).select(*k, "x.feature", "x.value"), k, columns["texture"])

    def granularity(px_: DataFrame) -> DataFrame:
        parts = []
        for place, where in (("tissue", F.col(valid)), ("positive", F.col(valid) & F.col(mask))):
            g = R.normalise(px_.withColumn("_w", where), k, norm, "_n", where=F.col("_w"), robust=True)
            base = f"granularity_{place}_norm_"
            parts.append(FO.granularity(g, k, "_n", "_w", name=base + "{r}").withColumnsRenamed({f"{base}{r}": base + scale[r] for r in scale}))
        return parts[0].join(parts[1], key)

    jobs = {
        "sites": object_sites,
        "pixels": lambda: on_arrays("pixels", lambda p: R.pixel_features(p, k, mask, valid, norm, raw)),
        "scores": scores,
        "burden": burden,
        "topology": lambda: on_arrays("topology", topology),
        "tiles": lambda: on_arrays("tiles", lambda p: R.tile_features(p, k, height, width, mask, valid, norm)),
        "points": lambda: named(SP.nn_stats(points(), near(), frame, across), SP.grid_dispersion(points(), frame, across), SP.knn_means(points(), near())),
        "graph": lambda: SP.proximity_graph(points(), near()).withColumnRenamed("grp", key),
        "tree": lambda: SP.tree_stats(SP.spanning_tree(points())).withColumnRenamed("grp", key),
        "texture": lambda: on_arrays("texture", texture),
        "granularity": lambda: on_arrays("granularity", granularity),
    }
    for name, other in (others or {}).items():
        jobs[f"cross_{name}"] = lambda n=name, o=other: cross_channel(px(), key, mask, valid, norm, raw, lab(), points(), n, o, pixel_um)

    def rows(job: Callable[[], DataFrame]) -> DataFrame:
        out = job()
        return out if "feature" in out.columns else long(on_skeleton(out, k, images()), k)

    return [(name, lambda job=job: rows(job)) for name, job in jobs.items() if only is None or name in only]


def write_channel_summary(root: str, pixels: DataFrame, key: str, *args, resume: bool = False, only: list[str] | None = None, **kw) -> DataFrame:
    """Each family of ``families`` below ``root/family=...``, ``AT_ONCE`` at a time, and all of them as read back (``key, feature, value, family``).

    ``resume``: families that an earlier run has completed stay as they are. If one fails, those not yet begun are left out and its error is raised.
    """
    spark = pixels.sparkSession
    done = lambda name: exists(spark, f"{root}/family={name}/_SUCCESS")
    names = [*FAMILIES, *[f"cross_{n}" for n in kw.get("others") or {}]]
    wanted = [n for n in names if (only is None or n in only)]
    todo = [n for n in wanted if not (resume and done(n))]
    write = lambda name, job: job().select(key, "feature", "value").write.mode("overwrite").parquet(f"{root}/family={name}")
    with ThreadPoolExecutor(AT_ONCE) as pool:
        # each in a copy of this context: the caller's scope owns their scratch tables
        runs = [pool.submit(contextvars.copy_context().run, write, name, job) for name, job in families(pixels, key, *args, only=todo, **kw)]
        try:
            for run in runs:
                run.result()
        finally:
            pool.shutdown(wait=True, cancel_futures=True)
    kind = spark.read.parquet(f"{root}/family={wanted[0]}").schema
    parts = [spark.read.schema(kind).parquet(f"{root}/family={n}").withColumn("family", F.lit(n)) for n in wanted]
    return reduce(DataFrame.unionByName, parts)


FAMILIES = ("sites", "pixels", "scores", "burden", "topology", "tiles", "points", "graph", "tree", "texture", "granularity")


def channel_summary(pixels: DataFrame, key: str, mask: str, valid: str, norm: str, raw: str, height: R.Size, width: int | None = None, pixel_um: float = PIXEL_UM, others: dict[str, dict[str, str]] | None = None, only: list[str] | None = None) -> DataFrame:
    """All feature families of one channel's masks, long: ``key, feature, value``, with every feature of every image.

    Sites, pixel values, object scores, burden, topology, tiles, points, graphs, trees, texture, granularity, and 15 features of each of ``others``: other channels of the
    same pixels, by name, with their columns ``mask, norm, raw``. ``height`` may be a table ``key, height, width``. Families whose definition libraries leave open follow the docstrings of their operators.
    """
    root = Scratch(pixels.sparkSession, "families").root
    return write_channel_summary(root, pixels, key, mask, valid, norm, raw, height, width, pixel_um=pixel_um, others=others, only=only).drop("family")


def cross_channel(pixels: DataFrame, key: str, mask: str, valid: str, norm: str, raw: str, labels: DataFrame, points: DataFrame, name: str, other: dict[str, str], pixel_um: float) -> DataFrame:
    """15 features of one channel against another of the same pixels: overlap, touching objects, nearest sites, correlations, rings around the other mask."""
    k, prefix = [key], f"cross_with_{name}"
    lab = C.label(pixels.where(other["mask"]).select(*k, "row", "col"), k)
    near = SP.nearest(points, centres(C.geometry(lab, k, pixel_um, pixel_um), key), 1).groupBy("grp").agg(F.avg("d").alias(f"{prefix}_nn_other_mean_um")).withColumnRenamed("grp", key)
    either = F.col(valid) & (F.col(mask) | F.col(other["mask"]))
    corr = pixels.groupBy(*k).agg(
        S.pearson(raw, other["raw"], F.col(valid)).alias(f"{prefix}_corr_raw_tissue"), S.pearson(raw, other["raw"], either).alias(f"{prefix}_corr_raw_union"), S.pearson(norm, other["norm"], F.col(valid)).alias(f"{prefix}_corr_norm_tissue"),
    )
    rings = SP.radial(SP.mask_distance(pixels.select(*k, "row", "col", F.col(other["mask"]).alias("_o"), F.col(valid).alias("_w"), F.col(norm).alias("_v")), k, "_o", 30.0, pixel_um, pixel_um), k, "_v", "_w", prefix)
    out = R.region_pair(pixels, k, mask, other["mask"], prefix).join(corr, k).join(rings, k)
    return out.join(C.touching(labels, pixels, other["mask"], k, prefix), k, "left").join(near, k, "left")
