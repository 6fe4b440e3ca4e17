"""What keeps tasks and shuffles small on large inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import core
from tessera.operators import components as CO
from tessera.operators import difftest as DT
from tessera.operators import graph as GR
from tessera.operators import raster as RS
from tessera.operators import spatial as SP
from tessera.operators import texture as TX
from tessera.operators import thresholds as TH
from tessera.operators import tiles as TL
from tessera.plans import fixtures as FX
from tessera.plans import segmentation as SG
from tessera.plans.registry import QUERIES


@pytest.fixture
def written(monkeypatch):
    """Optimised plans of the tables that operators write."""
    plans, save = [], core.Scratch.save

    def spy(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(core.Scratch, "save", spy)
    return plans


def leaves(plan: str) -> int:
    return sum(plan.count(x) for x in ("LogicalRDD", "Relation ", "LocalRelation", "Range ("))


@pytest.mark.parametrize("channel", ["dab", "macenko"])
def test_no_step_of_a_stain_channel_reads_pixels_again_and_again(spark, written, channel):
    rng = np.random.default_rng(3)
    rows = [(i, r, c, *map(int, rng.integers(0, 256, 3))) for i in range(3) for r in range(8) for c in range(8)]
    rgb = spark.createDataFrame(rows, "image int, row int, col int, r int, g int, b int")
    mask, pixels = SG.stain_channel(rgb, ["image"], channel, F.col("r") > 20, 8, 8, scale=0.9)
    assert mask.count() and pixels.count() == len(rows)
    assert max(map(leaves, written)) <= 4  # joins by image are one stage: each leaf is a sort that a task holds


def test_no_step_of_the_hue_engine_makes_its_pixels_anew(spark, written):
    rgb = spark.range(64).selectExpr("1 image", "int(id / 8) row", "int(id % 8) col", "int(id * 3) r", "int(255 - id) g", "int(id) b")
    mask, _ = SG.hue_range(rgb, ["image"], F.lit(True), 8, 8, 0.9, 0.2, 0.05, 0.2, 0.95, small=2, fill=True)
    mask.count()
    assert sum(p.count("Range (") for p in written) == 1


def test_thresholds_of_images_with_and_without_tissue(spark):
    rows = [(i, r, 0, v, ok) for i in range(2) for r, (v, ok) in enumerate([(0.1, True), (0.2, True), (0.8, True), (5.0, False)]) for ok in [ok and i == 0]]
    d = spark.createDataFrame(rows, "image int, row int, col int, v double, ok boolean")
    got = {r["image"]: r["t"] for r in TH.threshold(d, ["image"], "v", "ok").collect()}
    want = {i: {r["image"]: r["t"] for r in TH.otsu(d.where("ok" if i == 0 else "image = 1"), ["image"], "v").collect()}[i] for i in range(2)}
    assert got == want


@pytest.fixture
def exchanged(monkeypatch):
    """Rows that each grouping of points exchanges."""
    rows, over = [], TL.over_groups

    def spy(df, keys, *args, **kw):
        rows.append(df.count())
        return over(df, keys, *args, **kw)

    monkeypatch.setattr(TL, "over_groups", spy)
    monkeypatch.setattr(SP, "SMALL", 50)
    return rows


def points(spark, n=3000, groups=2):
    rng = np.random.default_rng(5)
    xy = np.round(np.concatenate([rng.random((n - n // 4, 2)) * 200, 50 + rng.random((n // 4, 2))]), 3)
    return xy, spark.createDataFrame([(i % groups, i, float(y), float(x)) for i, (y, x) in enumerate(xy)], "grp int, pid long, y double, x double")


def test_neighbours_exchange_points_not_pairs(spark, exchanged):
    xy, p = points(spark)
    got = {(r["pid"], r["rank"]): (r["nid"], r["d"]) for r in SP.knn(p, 5).collect()}
    assert sum(exchanged[1:]) and sum(exchanged) <= 5 * len(xy)
    for i, (y, x) in enumerate(xy):
        d = np.sqrt((xy[:, 0] - y) ** 2 + (xy[:, 1] - x) ** 2)
        d[np.arange(len(xy)) % 2 != i % 2] = np.inf
        d[i] = np.inf
        near = np.lexsort((np.arange(len(xy)), d))[:5]
        assert [got[i, r] for r in range(1, 6)] == [(j, d[j]) for j in near]


def test_means_of_neighbours_are_those_of_one_array(spark, exchanged, monkeypatch):
    xy, p = points(spark, 900)
    rows = lambda: sorted(map(tuple, SP.knn_means(p, SP.knn(p, 5)).collect()))
    got, n = rows(), sum(exchanged)
    assert 900 <= n <= 5 * 900
    monkeypatch.setattr(SP, "SMALL", 4096)
    assert np.allclose(got, rows())


def test_a_graph_exchanges_points_not_cells_around_them(spark, exchanged, monkeypatch):
    xy, p = points(spark)
    p = p.union(spark.createDataFrame([(1, 9000, None, 3.0)], p.schema))
    nn = SP.knn(p, 1).localCheckpoint()
    exchanged.clear()
    rows = lambda: sorted(map(tuple, SP.proximity_graph(p, nn).collect()))
    got, n = rows(), sum(exchanged)
    assert len(xy) <= n <= 3 * len(xy)
    monkeypatch.setattr(SP, "GRAPH_BLOCK", 3)
    assert np.allclose(got, rows())
    monkeypatch.setattr(SP, "SMALL", 4096)
    assert np.allclose(got, rows())


@pytest.mark.parametrize("work", [1_000_000_000, 400])
def test_a_radius_join_exchanges_points_not_nine_of_each(spark, exchanged, monkeypatch, work):
    xy, p = points(spark, 1200)
    monkeypatch.setattr(SP, "JOIN_WORK", work)
    got = {(r["a"], r["b"]): r["d"] for r in SP.within(p, spark.createDataFrame([(0, 4.0), (1, 6.0)], "grp int, radius double")).collect()}
    d = np.sqrt(((xy[:, None] - xy) ** 2).sum(2))
    i, j = np.indices(d.shape)
    hit = (i < j) & (i % 2 == j % 2) & (d <= np.where(i % 2, 6.0, 4.0))
    assert got.keys() == set(zip(*map(np.ndarray.tolist, np.nonzero(hit)))) and all(abs(d[k] - v) < 1e-9 for k, v in got.items())
    assert exchanged and (work < 1000 or sum(exchanged) <= 3 * len(xy))


def test_a_radius_join_has_tasks_for_its_pairs(spark, monkeypatch):
    _, p = points(spark, 1200)
    radius = spark.createDataFrame([(0, 4.0), (1, 6.0)], "grp int, radius double")
    few = SP.within(p, radius)
    monkeypatch.setattr(SP, "JOIN_TASK", 5_000)
    many = SP.within(p, radius)
    least = 1200 * 600 // 4 // 5_000  # two groups of 600 points in four blocks at most
    assert few.rdd.getNumPartitions() < least <= many.rdd.getNumPartitions()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_texture_makes_its_matrices_once(spark, written):
    d = spark.range(64).selectExpr("1 image", "int(id / 8) row", "int(id % 8) col", "int(id % 5) lv")
    out = TX.rollup(TX.properties(TX.glcm(d, ["image"], "lv"), ["image"]), ["image"])
    assert out.count() == 7 * 4
    assert len(written) == 1 and "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_tree_broadcasts_no_table_of_points(spark, monkeypatch):
    rng = np.random.default_rng(8)
    yx = np.round(np.concatenate([rng.normal(c, 1, (30, 2)) for c in (0, 60)] + [rng.random((3, 2)) * 300 - 100]), 4)
    p = spark.createDataFrame([(0, i, float(y), float(x)) for i, (y, x) in enumerate(yx)], "grp int, pid long, y double, x double")
    plans, save = [], core.Scratch.save

    def spy(self, df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return save(self, df)

    monkeypatch.setattr(core.Scratch, "save", spy)
    rows = lambda: sorted(tuple(r)[1:3] for r in SP.spanning_tree(p).collect())
    monkeypatch.setattr(SP, "SMALL", 10)
    got = rows()
    tables = [x for plan in plans for x in plan.splitlines() if "Join " in x and ("comp#" in x or "m#" in x)]
    assert tables and all("strategy=merge" in x or "all#" in x for x in tables)
    monkeypatch.setattr(SP, "SMALL", 4096)
    assert len(got) == len(yx) - 1 and got == rows()


def test_first_images_are_found_without_sorting_all_rows(spark, monkeypatch):
    monkeypatch.setattr(DT, "BOUND", 4)
    rng = np.random.default_rng(2)
    rows = [(None if i % 9 == 0 else "c%d" % (i % 3), "p", "f", "im%03d" % rng.integers(40, 900) if i % 7 else None, "ab"[i % 2], float(i)) for i in range(600)] + [("z", "p", "f", "x", "a", 1.0), ("y", "p", "f", None, "a", 1.0)]
    d = spark.createDataFrame(rows, "channel string, phenotype string, feature string, image string, level string, value double")
    s = DT.group_stats(d, ["channel", "phenotype", "feature"])
    want = {}
    for c, _, _, im, lv, _ in rows:
        n, first = want.get((c, lv), (0, None))
        want[c, lv] = n + 1, im if first is None else first if im is None else min(first, im)
    assert {(r["channel"], r["level"]): (r["n"], r["first_image"]) for r in s.collect()} == want
    plan = s._jdf.queryExecution().sparkPlan().toString()
    assert "avg(value" in plan and not any("SortAggregate" in x and "avg(value" in x for x in plan.splitlines())


@pytest.mark.parametrize("named", [True, False])
def test_an_analysis_counts_its_values_once(spark, written, monkeypatch, named):
    monkeypatch.setattr(DT, "BOUND", 4)
    image = "concat('im', 100 + id % 800)" if named else "if(id % 3 = 0, concat('im', 100 + id % 800), null)"
    long = spark.range(2000).selectExpr("if(id % 3 = 1, null, 'c') channel", "'p' phenotype", "'f' feature", f"{image} image", "if(id % 2 = 0, 'a', 'b') level", "double(id * id % 97 + 1e6) value")
    k = ["channel", "phenotype", "feature"]
    stats = lambda d: sorted(map(tuple, d.select(*k, "level", "n", F.round("mean", 6), F.round("var", 6), "first_image").collect()), key=str)
    want = stats(DT.group_stats(long, k))
    assert stats(DT.counted_stats(core.Scratch(spark, "values").save(DT.counted(long, k)), k, long)) == want
    written.clear()
    assert DT.differential(long.where("channel is not null"), ["channel"]).count() == 1
    assert sum(p.count("Range (") for p in written) == 3  # values, bounds, images below them


def test_grouped_rows_are_joined_without_sorting_them(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = FX.diff(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_tiles_are_summed_once_and_sorted_once(spark, written):
    d = spark.range(3 * 144).selectExpr("id div 144 image", "int(id % 144 div 12) row", "int(id % 12) col", "id % 3 = 0 m", "id % 7 <> 0 AND id div 144 < 2 ok", "if(id % 11 = 0, null, double(id % 13) / 12) n")
    out = RS.tile_features(d, ["image"], 12, 12, "m", "ok", "n", (4, 5))
    rows = sorted(out.collect())
    assert len(rows) == 2 and sum(p.count("Range (") for p in written) == 1
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    for r in rows:
        at = [(y, x) for y in range(12) for x in range(12) if (i := r["image"] * 144 + y * 12 + x) % 7]
        for g in (4, 5):
            tiles = {}
            for y, x in at:
                i = r["image"] * 144 + y * 12 + x
                tile = [max(k for k in range(g) if z >= k * 12 // g) for z in (y, x)]
                tiles.setdefault(tuple(tile), []).append((i % 3 == 0, None if i % 11 == 0 else i % 13 / 12))
            mass = np.sort([sum(m for m, _ in t) for t in tiles.values()]).astype(float)
            level = [np.mean([n for _, n in t if n is not None]) for t in tiles.values()]
            p = mass[mass > 0] / mass.sum()
            got = [r[f"tile_g{g}_{n}"] for n in ("positive_frac_mean", "intensity_mean_sd", "mass_entropy", "mass_gini")]
            k = len(mass)
            gini = (2 * (np.arange(1, k + 1) * mass).sum() - (k + 1) * mass.sum()) / (k * mass.sum())
            assert np.allclose(got, [np.mean([np.mean([m for m, _ in t]) for t in tiles.values()]), np.std(level, ddof=1), -(p * np.log2(p)).sum(), gini])


def test_components_exchange_nodes_not_edges(spark, monkeypatch):
    rows, save = [], core.Scratch.save

    def spy(self, df):
        out = save(self, df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(core.Scratch, "save", spy)
    out = QUERIES["G02_components"](spark, "/root/testdata/sf0.01")
    nodes = out.count()
    assert nodes == out.select("node").distinct().count() and sum(rows) <= 2 * nodes  # its 75,000 edges join 18,600 nodes


@pytest.mark.parametrize("piece", [4, 60, 1 << 20])
def test_components_by_stars_are_those_by_rounds(spark, monkeypatch, piece):
    monkeypatch.setattr(GR, "PIECE", piece)
    rng = np.random.default_rng(4)
    e = [(0, i) for i in range(1, 50)] + [(i + 1, i) for i in range(100, 140)] + [(7, 7), (500, 500), (None, 3)] + [tuple(map(int, x)) for x in rng.integers(1000, 1300, (160, 2))]
    d = spark.createDataFrame([e[i] for i in rng.permutation(len(e))], "src int, dst int").repartition(3)
    rows = lambda **kw: sorted(map(tuple, GR.connected_components(d, **kw).collect()))
    want = rows(finish=0)
    assert want == rows(stars=True) == rows(stars=True, finish=0, merge=True) and len(dict(want)) == len(want)
    assert GR.connected_components(d.where("src < 0"), stars=True).count() == 0


def test_objects_are_measured_many_at_once(spark, exchanged, monkeypatch):
    rng = np.random.default_rng(6)
    d = [(i, i % 3, r, c) for i in range(60) for r, c in np.argwhere(rng.random((1 + i % 12, 9)) < 0.6).tolist()] + [(99, 0, r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    d += [(98, 1, r, c) for r in range(3) for c in range(r, 5)]
    lab = spark.createDataFrame(d, "image int, label long, row int, col int")
    runs = CO.runs(lab, ["image", "label"]).toPandas()
    apart = runs.groupby(["image", "label"]).filter(lambda g: len(g) > np.ptp(g.row) + 1)
    holes = {r["image"]: (r["hole_area"], r["holes"]) for r in CO.filled_area(lab, ["image"]).collect()}
    assert exchanged == [len(apart)] and len(apart) < len(runs)
    assert holes[99] == (1, 1) and all(holes[i] == (0, 0) for i in set(holes) - set(apart.image))
    exchanged.clear()
    for few in (32, 2):
        monkeypatch.setattr(CO, "FEW_VERTICES", few)
        got = {r["image"]: r for r in CO.hulls(lab, ["image"]).collect()}
        assert not exchanged and got.keys() == {r[0] for r in d}
        for i, h in got.items():
            p = np.array([(r, c) for im, _, r, c in d if im == i])
            q = sorted({(r + y, c + x) for r, c in p.tolist() for y in (-0.5, 0.5) for x in (-0.5, 0.5)})
            assert h["area"] == len(p) and h["caliper"] == max(np.hypot(a - c, b - e) for a, b in q for c, e in q)
            hull = []
            for way in (q, q[::-1]):
                side = []
                for a in way:
                    while len(side) > 1 and (side[-1][0] - side[-2][0]) * (a[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (a[0] - side[-2][0]):
                        side.pop()
                    side.append(a)
                hull += side[:-1]
            assert h["convex_area"] == abs(sum(a * e - b * c for (a, b), (c, e) in zip(hull, hull[1:] + hull[:1]))) / 2


def test_whole_groups_are_cut_from_sorted_batches():
    import pyarrow as pa

    t = pa.table({"k": [None, None, 1, 1, 1, 2, 3, 3], "v": range(8)})
    for size in (1, 2, 3, 8):
        got = [(x["v"].to_pylist(), s.tolist()) for x, s in TL.cut_many(iter(t.to_batches(max_chunksize=size)), ["k"])]
        assert [v for x, _ in got for v in x] == list(range(8))
        assert [x[i] for x, s in got for i in s] == [0, 2, 5, 6]


def test_image_files_of_a_type_are_written_by_many_tasks(spark):
    with core.scratch_scope() as made:
        got = {r["folder"]: r["n"] for r in QUERIES["S01_image_list"](spark, "/root/testdata/sf0.01").collect()}
        f = spark.read.schema("id long, name string").csv(f"{made[0][1]}/a/images").withColumn("file", F.col("_metadata.file_name")).withColumn("type", F.regexp_extract("name", r"_(\d+)", 1))
        files = f.groupBy("type", "file").count().toPandas()
        assert f.count() == f.select("id").distinct().count() == 15_000 and files["count"].max() == 100
    for kind, of in files.groupby("type"):
        assert got[kind] == len(of) == -(-of["count"].sum() // 100)
        assert len({x.rsplit("-", 1)[0] for x in of.file}) == 3  # two parts of the session's, and what fills no file; part-00000-... of one task before


def test_a_complement_has_tasks_by_its_pixels(spark, monkeypatch):
    monkeypatch.setattr(CO, "TASK_PIXELS", 300, raising=False)
    p = spark.range(2000).selectExpr("int(id div 100) image", "int(id % 100 div 10) row", "int(id % 10) col", "id % 3 = 0 m")
    out = CO.complement(p, p.where("m"), ["image"])
    sizes = out.groupBy(F.spark_partition_id().alias("task")).count().toPandas()["count"]
    assert out.exceptAll(p.where("not m").select(*out.columns)).isEmpty() and sizes.sum() == 1333
    assert len(sizes) == 7 and sizes.max() < 300  # two tasks, or one, before
