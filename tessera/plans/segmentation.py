"""Segmentation end to end: one stain channel, or the hue-range engine, from RGB pixels to mask pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.operators import components as C
from tessera.operators import focal
from tessera.operators import raster as R
from tessera.operators import thresholds as TH

#: Clean-up defaults (see ``components.clean_up``).
MORPHOLOGY = {"open_radius": 0, "close_radius": 0, "small": 0, "long_fraction": 0.0, "fill": False, "fill_area": 64, "border": False}


def stain_channel(rgb: DataFrame, keys: list[str], channel: str, valid, height: R.Size, width: int | None = None, method: str = "otsu", scale: float = 1.0, absolute: float | None = None, invert: bool | None = None, normalised: bool = True, **morphology) -> tuple[DataFrame, DataFrame]:
    """``(mask, pixels)``: mask pixels of one stain, and all pixels with ``valid, raw, norm`` (oriented).

    Unmix, normalise on tissue, orient (inferred unless given), threshold, keep tissue, clean up. Images without
    tissue have an empty mask.
    """
    tmp = Scratch(rgb.sparkSession, "stain")  # each step reads the one before more than once
    d = rgb.withColumn("valid", valid).withColumn("raw", R.unmix(F.col("r"), F.col("g"), F.col("b"))[channel]) if channel != "macenko" else TH.macenko(rgb, keys).withColumnRenamed("dab", "raw").withColumn("valid", valid)
    d = tmp.save(R.normalise(tmp.save(d), keys, "raw", "norm", where=F.col("valid")))
    flip = d.select(*keys).distinct().withColumn("invert", F.lit(bool(invert))) if invert is not None else TH.choose_orientation(d, keys, "norm", "valid")
    raw, norm = R.orient(F.col("raw"), F.col("norm"), F.col("invert"))
    d = tmp.save(d.join(flip, keys).withColumn("_raw", raw).withColumn("_norm", norm).drop("raw", "norm", "invert").withColumnsRenamed({"_raw": "raw", "_norm": "norm"}))
    value = "norm" if normalised else "raw"
    t = TH.threshold(d, keys, value, "valid", method) if absolute is None else d.select(*keys).distinct().withColumn("t", F.lit(float(absolute)))
    d = d.join(t, keys).withColumn("_hit", R.over_threshold(F.col(value), F.col("t"), F.lit(absolute).cast("double"), scale, normalised, F.col("valid"))).drop("t")
    d = tmp.save(d)
    return C.clean_up(d, keys, "_hit", height, width, **(MORPHOLOGY | morphology)), d.drop("_hit")


def hue_range(rgb: DataFrame, keys: list[str], valid, height: R.Size, width: int | None, h_low: float, h_high: float, s_min: float, v_min: float, v_max: float, **morphology) -> tuple[DataFrame, DataFrame]:
    """``(mask, pixels)`` of the hue-range engine; ``norm`` is the stretched darkness S * (1 - V)."""
    h, s, v = R.hsv(F.col("r"), F.col("g"), F.col("b"))
    d = Scratch(rgb.sparkSession, "hue").save(rgb.withColumn("_hit", R.stain_range(h, s, v, h_low, h_high, s_min, v_min, v_max) & valid).withColumn("raw", s * (1 - v)))
    return C.clean_up(d, keys, "_hit", height, width, **(MORPHOLOGY | morphology)), R.normalise(d, keys, "raw", "norm").drop("_hit")


def apply_rules(masks: DataFrame, pixels: DataFrame, rules: DataFrame) -> DataFrame:
    """``image, channel, row, col`` after each image's gate rules, one after the other: a gate may be the result of an earlier rule.

    pixels: all pixels of the images; rules: ``image, rules`` (array of ``target, by, mode, dilate_px, min_overlap_frac``). A mode other than
    intersect is touching; an empty gate leaves nothing. The loop is over the places of a rule in its list, which people write by hand.
    """
    tmp = Scratch(masks.sparkSession, "rules")
    steps = tmp.save(rules.select("image", F.posexplode("rules").alias("step", "r")).select("image", "step", "r.*"))
    masks = tmp.save(masks.select("image", "channel", "row", "col"))
    last = steps.agg(F.max("step")).first()[0]
    for step in range((-1 if last is None else last) + 1):
        now = steps.where(F.col("step") == step).withColumn("px", F.when(F.col("mode") == "intersect", 0).otherwise(F.greatest("dilate_px", F.lit(0))))
        gate = masks.join(now.select("image", F.col("by").alias("channel"), "px"), ["image", "channel"]).select("image", "row", "col", F.lit(1).alias("_g"))
        grown = []
        for r in now.select("px").distinct().collect():
            here = pixels.join(now.where(F.col("px") == r["px"]).select("image"), "image", "left_semi").join(gate, ["image", "row", "col"], "left").select("image", "row", "col", F.coalesce("_g", F.lit(0)).alias("_g"))
            grown.append(focal.dilate(here, ["image"], "_g", r["px"]) if r["px"] else here)
        on = reduce(DataFrame.unionByName, grown).where("_g = 1")
        target = masks.join(now.select("image", F.col("target").alias("channel"), F.col("min_overlap_frac").alias("f")), ["image", "channel"])
        lab = tmp.save(C.label(target.select("image", "channel", "row", "col"), ["image", "channel"]))
        share = lab.join(on, ["image", "row", "col"], "left").groupBy("image", "channel", "label").agg(F.avg(F.coalesce("_g", F.lit(0)).cast("double")).alias("share"))
        good = share.join(now.select("image", F.col("min_overlap_frac").alias("f")), "image").where(F.when(F.col("f") > 0, F.col("share") >= F.col("f")).otherwise(F.col("share") > 0))
        kept = lab.join(good, ["image", "channel", "label"], "left_semi").select("image", "channel", "row", "col")
        others = masks.join(now.select("image", F.col("target").alias("channel")), ["image", "channel"], "left_anti")
        masks = tmp.save(others.unionByName(kept))
    return masks


def segment(rgb: DataFrame, images: DataFrame, params: DataFrame, height: R.Size, width: int | None = None) -> dict[str, DataFrame]:
    """The job up to its masks, from ``image, row, col, r, g, b``, ``image, type`` and a parameter record per type.

    Returns ``masks`` (``image, channel, row, col``; after the gate rules), ``pixels`` (``image, channel, row, col, valid, raw, norm``) and ``images`` (with
    ``channels_to_output``). Channels that are put out or gate another are segmented. Images of types with equal settings share a plan: the loop is over distinct
    settings, of which there are as many as people have saved. Where a type's engine is ``hsv``, its DAB channel is what lies in the record's hue range, cleaned as DAB is;
    its other channels are unmixed as ever. ``height`` may be a table ``image, height, width``.
    """
    tmp = Scratch(rgb.sparkSession, "segment")
    p = images.join(params if "hsv" in params.columns else params.withColumn("hsv", F.lit(None).cast("struct<h_low:double,h_high:double,s_min:double,v_min:double,v_max:double>")), "type")
    p = p.withColumn("rules", F.when(F.col("gating_enabled"), F.col("gating_rules")).otherwise(F.array().cast(params.schema["gating_rules"].dataType)))
    p = tmp.save(p.withColumn("wanted", F.array_union("channels_to_output", F.transform("rules", lambda r: r["by"]))))
    hue = F.when((F.col("engine") == "hsv") & (F.col("channel") == "dab"), F.col("hsv"))
    each = p.select("image", F.explode("wanted").alias("channel"), "pre_mask", "channels", "engine", "hsv").select("image", "channel", "pre_mask", F.try_element_at("channels", "channel").alias("c"), hue.alias("hue")).where("c.enabled")
    each = tmp.save(each.withColumn("setting", F.xxhash64("channel", "pre_mask", "c", "hue")))
    masks, pixels = [], []
    for s in each.dropDuplicates(["setting"]).select("setting", "channel", "pre_mask", "c", "hue").collect():
        t, m, w = s["c"]["threshold"], s["c"]["morph"], s["pre_mask"]
        valid = R.tissue(F.col("r"), F.col("g"), F.col("b"), w["ignore_black"], w["black_rgb_thresh"], w["ignore_white"], w["white_v_thresh"], w["white_s_max"])
        here = rgb.join(each.where(F.col("setting") == s["setting"]).select("image"), "image", "left_semi")
        absolute = t["absolute_normalized"] if t["normalize"] else t["absolute_raw"]
        large = m["large_area_frac"] if m["remove_large_connected"] else 0.0
        channel = "macenko" if t["stain_estimation"] == "macenko" and s["channel"] == "dab" else s["channel"]
        morph = {"open_radius": m["open_radius"], "close_radius": m["close_radius"], "small": m["remove_small"], "long_fraction": large, "long_reference": m["large_span_ref_dim"] or 0, "fill": m["fill_holes"], "fill_area": m["fill_holes_max_area"] or 0, "border": m["clear_border"]}
        if s["hue"] is not None:
            mask, px = hue_range(here, ["image"], valid, height, width, *[s["hue"][f] for f in ("h_low", "h_high", "s_min", "v_min", "v_max")], **morph)
            px = px.withColumn("valid", valid)
        else:
            mask, px = stain_channel(here, ["image"], channel, valid, height, width, t["method"], t["scale"], absolute, t["invert"], t["normalize"], **morph)
        masks.append(mask.select("image", F.lit(s["channel"]).alias("channel"), "row", "col"))
        pixels.append(px.select("image", F.lit(s["channel"]).alias("channel"), "row", "col", "valid", "raw", "norm"))
    if not masks:
        raise ValueError("no channel to segment")
    masks, pixels = tmp.save(reduce(DataFrame.unionByName, masks)), tmp.save(reduce(DataFrame.unionByName, pixels))
    return {"masks": apply_rules(masks, rgb.select("image", "row", "col"), p.select("image", "rules")), "pixels": pixels, "images": p.select("image", "type", "channels_to_output")}


def sites(job: dict[str, DataFrame], pixel_um: float = 1.0) -> DataFrame:
    """Site rows of the channels that are put out: ``image, type, channel, label``, geometry and intensities."""
    k = ["image", "channel"]
    out = job["images"].select("image", "type", F.explode("channels_to_output").alias("channel"))
    lab = C.label(job["masks"].join(out, k, "left_semi"), k)
    own = lab.join(job["pixels"], [*k, "row", "col"])
    s = C.geometry(lab, k, pixel_um, pixel_um).join(C.intensity(own, k, "norm", "intensity"), [*k, "label"]).join(C.intensity(own, k, "raw", "intensity_raw"), [*k, "label"])
    return s.join(out, k)
