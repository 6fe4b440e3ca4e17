"""Sources, sinks, and the full channel summary."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.operators import components as C
from tessera.operators import raster as R
from tessera.plans import assembly
from tessera.plans import segmentation as SG
from tessera.sources import tables as IO


def test_image_list_is_recursive_and_case_blind(spark, tmp_path):
    for n in ("a/S_212_r1_c2.PNG", "b/c/S_213_r1_c3.tif", "b/readme.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    got = IO.list_images(spark, str(tmp_path)).collect()
    assert [(r["name"], r["type"]) for r in got] == [("S_212_r1_c2.PNG", "212"), ("S_213_r1_c3.tif", "213")]


def put(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode() if isinstance(text, str) else text)


def test_sites_take_channel_and_image_from_files(spark, tmp_path):
    put(tmp_path / "features" / "212" / "dab", one_sites="image,area\nim1,3.5\nim1,4.5\n", none_sites="image,area\n")
    put(tmp_path / "features" / "213", flat_sites="image,area\nim2,1.0\n")
    read = lambda t: {(r["image"], r["channel"], r["area"]) for r in IO.read_sites(spark, str(tmp_path), t, "image string, area double").collect()}
    assert read("212") == {("im1", "dab", 3.5), ("im1", "dab", 4.5)} and read("213") == {("im2", None, 1.0)}


def test_the_header_of_a_site_file_says_where_its_columns_are(spark, tmp_path):
    root = tmp_path / "features" / "t.1"
    put(
        root / "dab", a_sites="label,image,area\n1,im1,3.5\n2,im1,x\n", b_sites="area,more,image\n7,\"a,b\",im2\n", c_sites="label,area\n1,hello\n", notes="hello\n1\n", d_sites="", e_sites="image\n", f_sites="image,area\n,1\nim,2\n",
        g_sites="image,area\nim,1,2\n", h_sites=b"\xff\xfe\x00binary", i_sites="\ufeffimage,area\nim9,9\n\n",
    )
    put(root, flat_sites="image,area\nflat,1\n")
    put(root / "dab" / "deep", x_sites="image,area\ndeep,1\n")
    rows, left = IO.scan_sites(spark, str(tmp_path), "t.1", "image string, area double, label int")
    assert {tuple(r) for r in rows.collect()} == {("im1", 3.5, 1, "dab"), ("im1", None, 2, "dab"), ("im2", 7.0, None, "dab"), ("im9", 9.0, None, "dab")}
    why = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in left.collect()}
    assert why == {
        "c_sites.csv": "no column image", "notes.csv": "not a site file", "e_sites.csv": "no rows", "f_sites.csv": "first row names no image", "g_sites.csv": "rows longer than the header", "h_sites.csv": "no rows",
        "flat_sites.csv": "not in a channel folder", "x_sites.csv": "not in a channel folder",
    }


def test_a_second_run_of_one_type_keeps_the_others(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame(rows, "image string, type string, v double")
    root = f"file://{tmp_path}"
    IO.write_summaries(make(("r2_c1", "212", 1.0), ("r2_c2", "213", 2.0)), root)
    IO.write_summaries(make(("r2_c3", "212", 3.0)), root)
    for d in (spark.read.parquet(f"{root}/summary/by_type"), spark.read.parquet(f"{root}/summary/all_types")):
        assert {(r["image"], str(r["type"]), r["v"]) for r in d.collect()} == {("r2_c3", "212", 3.0), ("r2_c2", "213", 2.0)}
    broken = make(("r2_c9", "213", 9.0)).withColumn("v", F.raise_error(F.lit("stopped")).cast("double"))
    with pytest.raises(Exception, match="stopped"):
        IO.write_summaries(broken, root)
    assert {r["image"] for r in IO.load_summary(spark, root).collect()} == {"r2_c3", "r2_c2"} and {r["image"] for r in spark.read.parquet(f"{root}/summary/by_type").collect()} == {"r2_c3", "r2_c2"}


def test_tables_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("t1", "b", "c/1", 0.5, 0.1, "f"), ("t1", "a", "c/1", None, None, "g")], "type string, channel string, phenotype string, q_value double, p_value double, feature string")
    IO.write_results(d, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.count() == 2 and {r["phenotype"] for r in back.collect()} == {"c_1"}
    IO.write_csv(d, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


def test_metadata_and_clashes(spark, tmp_path):
    (tmp_path / "m.csv").write_text("r,c,Region,image\n1,1,KC,z\n2,x,A,z\n2,3,B,z\n")
    m = IO.read_metadata(spark, str(tmp_path / "m.csv"))
    assert {(r["r"], r["c"], r["Region"]) for r in m.collect()} == {(2, None, "A"), (2, 3, "B")}
    s = spark.createDataFrame([(2, 3, "i")], "r int, c int, image string")
    assert IO.with_metadata(s, m).first()["image_meta"] == "z"


def test_parameters_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", {"dab": (0.5, [1, 2])})], "type string, channels map<string,struct<t:double,r:array<int>>>")
    IO.save_parameters(d, str(tmp_path / "p"))
    assert spark.read.schema(d.schema).json(str(tmp_path / "p")).collect() == d.collect()


def test_gating_defaults(spark):
    d = spark.sql("SELECT * FROM VALUES (1, true, array(1)), (2, cast(null as boolean), array(1)), (3, null, null) AS t(k, gating_enabled, gating_rules)")
    assert [r["g"] for r in d.select("k", IO.gating().alias("g")).orderBy("k").collect()] == [True, True, False]


def test_channel_summary_runs_every_family(spark):
    rng = np.random.default_rng(0)
    rows = [(i, r, c, float(v)) for i in range(2) for r in range(10) for c in range(10) for v in [rng.random()]]
    d = spark.createDataFrame(rows, "image int, row int, col int, v double").withColumn("m", F.col("v") > 0.6).withColumn("ok", F.col("v") > 0.05)
    d = d.withColumn("o", F.col("v") < 0.3)
    got = assembly.channel_summary(d, "image", "m", "ok", "v", "v", 10, 10, others={"dab": {"mask": "o", "norm": "v", "raw": "v"}}).toPandas()
    names = set(got[got.image == 0].feature)
    for n in ("num_sites", "solidity_median", "pixel_raw_tissue_mean", "object_norm_mean_hscore", "topology_component_count", "tile_g4_mass_gini", "clark_evans_R", "graph_components", "mst_edge_mean_um", "texture_tissue_norm_s0p274um_contrast_mean", "texture_positive_raw_entropy_sd", "granularity_positive_norm_s2p19um", "topology_fractal_dimension", "topology_boundary_length_um", "num_sites_per_mm2_tissue", "cross_with_dab_jaccard", "cross_with_dab_annulus_15_30um_norm_mean"):
        assert n in names
    assert not got.duplicated(["image", "feature"]).any()
    # 295 features and 15 of the other channel, less the five of Delaunay triangles
    assert len(names) == 295 + 15 - 5 and sum(n.startswith("cross_with_dab_") for n in names) == 15
    one = got[got.image == 0].set_index("feature").value
    hits = d.where("image = 0").toPandas()
    assert len(got) == 2 * len(names) and {"delaunay_edge_mean_um"} & names == set()
    assert one["cross_with_dab_jaccard"] == 0 and one["percent_area_stained"] == hits.m.mean() and one["tissue_area_um2"] == pytest.approx(hits.ok.sum() * assembly.PIXEL_UM**2)


def test_an_image_is_named_by_its_files_first_row(spark, tmp_path):
    put(tmp_path / "features" / "212" / "dab", one_sites="image,area\nzz,3.5\naa,4.5\n", two_sites="image,area\n,1.0\nbb,2.0\n")
    got = {(r["image"], r["area"]) for r in IO.read_sites(spark, str(tmp_path), "212", "image string, area double").collect()}
    assert got == {("zz", 3.5), ("zz", 4.5)}


def test_grid_position_takes_both_numbers_from_one_form(spark):
    d = spark.createDataFrame([("a_r99999999999_c4_col7_row8",), ("col7_x_ROW8",), ("row3 col4",), ("none",)], "name string")
    r, c = K.grid_position(F.col("name"))
    assert [tuple(x) for x in d.select(r, c).collect()] == [(None, 4), (8, 7), (3, 4), (None, None)]


def test_summaries_fall_back_to_those_by_type(spark, tmp_path):
    d = spark.createDataFrame([("r1_c1", "a", 1.0), ("r1_c2", "a", 2.0), ("r2_c2", "b", 3.0)], "image string, type string, v double")
    IO.write_summaries(d, str(tmp_path / "x"))
    IO.write_table(d, str(tmp_path / "y" / "summary" / "by_type"), ["type"], ["image"])
    for k in "xy":
        assert {(r["image"], r["type"], r["v"], r["r"], r["c"]) for r in IO.load_summary(spark, str(tmp_path / k)).collect()} == {("r1_c2", "a", 2.0, 1, 2), ("r2_c2", "b", 3.0, 2, 2)}


def test_legacy_columns_of_summary_and_site_files(spark, tmp_path):
    for n in ("a/one.csv", "b/two.csv"):
        (tmp_path / n).parent.mkdir()
        (tmp_path / n).write_text("image,Perimeter_PX,area_um2\nx,1,2\n")
    d = spark.createDataFrame([(1, 2)], "density_per_px int, solidity int")
    assert {tuple(r) for r in IO.legacy_outputs(d, str(tmp_path)).collect()} == {("summary", "density_per_px"), ("sites", "Perimeter_PX")}
    assert IO.legacy_outputs(d.select("solidity")).count() == 0


def test_saved_parameters_over_built_in_ones(spark):
    types = spark.createDataFrame([("a",), ("b",), ("c",)], "type string")
    saved = spark.sql("""SELECT * FROM VALUES
      ('a', map('dab', named_struct('morph', named_struct('open_radius', 9), 'enabled', false)), boolean(null), array(named_struct('target', 'dab', 'by', string(null), 'mode', string(null), 'dilate_px', 'x', 'min_overlap_frac', string(null)), named_struct('target', string(null), 'by', 'eosin', 'mode', 'odd', 'dilate_px', '4', 'min_overlap_frac', '0.5'))),
      ('b', NULL, boolean(null), NULL), ('z', NULL, true, NULL) AS t(type, channels, gating_enabled, gating_rules)""")
    got = {r["type"]: r for r in IO.load_parameters(types, saved).collect()}
    assert set(got) == {"a", "b", "c"}
    dab = got["a"]["channels"]["dab"]
    assert (dab["morph"]["open_radius"], dab["morph"]["close_radius"], dab["enabled"], dab["threshold"]["method"]) == (9, 7, False, "otsu")
    assert set(got["a"]["channels"]) == {"hematoxylin", "eosin", "dab"} and got["a"]["channels"]["eosin"]["enabled"]
    assert got["a"]["gating_enabled"] and [tuple(r) for r in got["a"]["gating_rules"]] == [("dab", "eosin", "odd", 4, 0.5)]
    assert not got["b"]["gating_enabled"] and got["b"]["gating_rules"] == []
    assert not got["c"]["gating_enabled"] and [tuple(r) for r in got["c"]["gating_rules"]] == [("dab", "hematoxylin", "touching", 15, 0.0)]
    small = IO.preview_parameters(IO.default_parameters(types).withColumns({"height_scale": F.lit(2.0), "width_scale": F.lit(8.0)})).first()["channels"]
    assert [(m["open_radius"], m["close_radius"], m["remove_small"]) for m in (small[c]["morph"] for c in ("hematoxylin", "dab"))] == [(0, 1, 4), (0, 2, 9)]


def test_the_job_equals_its_operators(spark):
    rng = np.random.default_rng(2)
    rows = [(i, r, c, *(int(x) for x in rng.integers(70, 220, 3))) for i in range(2) for r in range(8) for c in range(8)]
    rgb = spark.createDataFrame(rows, "image int, row int, col int, r int, g int, b int")
    images = spark.createDataFrame([(0, "a"), (1, "b")], "image int, type string")
    keep = {"open_radius": 0, "close_radius": 1, "small": 2, "fill": True, "fill_area": 64, "border": False, "long_fraction": 0.0, "long_reference": 0}
    base = IO.default_parameters(images.select("type")).withColumn("channels_to_output", F.array(F.lit("dab")))
    quiet = lambda k, v: v.withField("threshold", v["threshold"].withField("normalize", F.lit(True))).withField("morph", v["morph"].withField("open_radius", F.lit(0)).withField("close_radius", F.lit(1)).withField("remove_small", F.lit(2)).withField("remove_large_connected", F.lit(False)).withField("clear_border", F.lit(False)))
    params = base.withColumn("channels", F.transform_values("channels", quiet)).withColumn("gating_enabled", F.col("type") == "b").withColumn("gating_rules", F.transform("gating_rules", lambda r: r.withField("dilate_px", F.lit(0)).withField("min_overlap_frac", F.lit(0.2))))
    job = SG.segment(rgb, images, params, 8, 8)
    valid = R.tissue(F.col("r"), F.col("g"), F.col("b"), True, 5, True, 0.9, 0.25)
    dab, px = SG.stain_channel(rgb, ["image"], "dab", valid, 8, 8, **keep)
    by = job["masks"].where("channel = 'hematoxylin'").select("image", "row", "col", F.lit(True).alias("gated"))
    gated = C.gate(dab.where("image = 1"), px.join(by, ["image", "row", "col"], "left").withColumn("gated", F.coalesce("gated", F.lit(False))), "gated", ["image"], dilate_px=0, min_overlap=0.2)
    want = {tuple(r) for r in dab.where("image = 0").unionByName(gated).select("image", "row", "col").collect()}
    masks = job["masks"].where("channel = 'dab'").select("image", "row", "col")
    assert {tuple(r) for r in masks.collect()} == want and any(r[0] == 1 for r in want)
    s = SG.sites(job)
    assert {r["channel"] for r in s.select("channel").distinct().collect()} == {"dab"} and s.agg(F.sum("area_um2")).first()[0] == len(want)


def test_a_summary_goes_on_where_it_was_stopped(spark, tmp_path, monkeypatch):
    """Families that are complete are not made again; images of different sizes and one without objects are in one table."""
    rng = np.random.default_rng(1)
    rows = [(i, r, c, float(rng.random())) for i, (h, w) in enumerate([(9, 12), (16, 7), (5, 5)]) for r in range(h) for c in range(w)]
    d = spark.createDataFrame(rows, "image int, row int, col int, v double").withColumn("m", (F.col("v") > 0.6) & (F.col("image") < 2)).withColumn("ok", F.lit(True))
    sizes = spark.createDataFrame([(0, 9, 12), (1, 16, 7), (2, 5, 5)], "image int, height int, width int")
    root, run = f"file://{tmp_path}/s", lambda **kw: assembly.write_channel_summary(f"file://{tmp_path}/s", d, "image", "m", "ok", "v", "v", sizes, **kw)
    run(only=["burden", "tiles"])
    before = {n: (tmp_path / "s" / f"family={n}" / "_SUCCESS").stat().st_mtime_ns for n in ("burden", "tiles")}
    made = []
    real = assembly.families
    monkeypatch.setattr(assembly, "families", lambda *a, **k: (made.append(n) or (n, x) for n, x in real(*a, **k)))
    got = run(resume=True).toPandas()
    assert set(made) == set(assembly.FAMILIES) - set(before) and before == {n: (tmp_path / "s" / f"family={n}" / "_SUCCESS").stat().st_mtime_ns for n in before}
    assert len(got) == 3 * 290 and not got.duplicated(["image", "feature"]).any()
    empty = got[got.image == 2].set_index("feature").value
    for n in ("num_sites", "topology_component_count", "topology_euler_number", "topology_boundary_length_um", "topology_hole_count", "num_sites_per_mm2_tissue", "density_per_mm2", "positive_area_um2"):
        assert empty[n] == 0, n
    assert np.isnan(empty["area_um2_median"]) and np.isnan(empty["graph_components"]) and np.isnan(empty["texture_positive_raw_entropy_sd"])
    for i, (h, w) in enumerate([(9, 12), (16, 7)]):
        alone = assembly.channel_summary(d.where(F.col("image") == i), "image", "m", "ok", "v", "v", h, w, only=["topology", "tiles", "points"]).toPandas().set_index("feature").value
        both = got[got.image == i].set_index("feature").value
        assert np.allclose(alone, both[alone.index], equal_nan=True)


def test_the_job_over_images_of_two_sizes(spark):
    """Objects at the border of the smaller image are cleared by its own size, and its hue engine is honoured."""
    sizes = [(0, 12, 9), (1, 7, 15)]
    brown = lambda r, c, h, w: (r, c) in {(0, 3), (1, 3), (4, 4), (4, 5), (5, 4), (5, 5), (h - 1, 4), (h - 2, 4)} or c == w - 1 and r in (2, 3)
    rows = [(i, r, c, *((150, 90, 40) if brown(r, c, h, w) else (200, 180, 190))) for i, h, w in sizes for r in range(h) for c in range(w)]
    rgb = spark.createDataFrame(rows, "image int, row int, col int, r int, g int, b int")
    images = spark.createDataFrame([(i, "t") for i, _, _ in sizes], "image int, type string")
    plain = lambda k, v: v.withField("morph", v["morph"].withField("open_radius", F.lit(0)).withField("close_radius", F.lit(0)).withField("remove_small", F.lit(2)).withField("remove_large_connected", F.lit(False)).withField("clear_border", F.lit(True)))
    params = IO.default_parameters(images.select("type").distinct()).withColumn("channels", F.transform_values("channels", plain)).withColumn("engine", F.lit("hsv")).withColumn("channels_to_output", F.array(F.lit("dab"))).withColumn("gating_enabled", F.lit(False))
    job = SG.segment(rgb, images, params, spark.createDataFrame(sizes, "image int, height int, width int"))
    got = {(r["image"], r["row"], r["col"]) for r in job["masks"].collect()}
    inner = {(4, 4), (4, 5), (5, 4), (5, 5)}
    # in the image of seven rows the square reaches the stain at its border
    assert got == {(0, *x) for x in inner}


def test_rows_of_a_large_site_file_are_not_sorted_by_file(spark, tmp_path):
    at = tmp_path / "features" / "9" / "dab"
    at.mkdir(parents=True)
    (at / "a_sites.csv").write_text("\n \nlabel,image,area\n" + "".join(f"{i},im,{i}.5\n" for i in range(500)))
    (at / "b_sites.csv").write_text("image,area\n,2\n")
    rows, left = IO.scan_sites(spark, str(tmp_path), "9", "image string, label int, area double")
    assert [tuple(r) for r in rows.groupBy("image").agg(F.count("*"), F.sum("area")).collect()] == [("im", 500, 500 * 250.0)]
    assert [r["reason"] for r in left.collect()] == ["first row names no image"]
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "SortAggregate" not in plan
