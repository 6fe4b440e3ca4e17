"""Hand-made rasters, invariants, and brute force for what SQL can't express."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import keys as K
from tessera.functions import stats as S
from tessera.operators import components as C
from tessera.operators import difftest as T
from tessera.operators import focal as FO
from tessera.operators import raster as R
from tessera.operators import spatial as SP
from tessera.operators import thresholds as TH
from tessera.operators.graph import connected_components

RING = ["00000", "01110", "01010", "01110", "00000"]
DIAG = ["10", "01"]
SPIRAL = ["11111111", "00000001", "11111101", "10000101", "10110101", "10011101", "11000001", "01111111"]
BORDER = ["1100", "0000", "0110", "0000"]


def raster(spark, *grids):
    rows = [(g, r, c, ch == "1") for g, grid in enumerate(grids) for r, line in enumerate(grid) for c, ch in enumerate(line)]
    return spark.createDataFrame(rows, "image int, row int, col int, m boolean")


def fg(df):
    return df.where("m").select("image", "row", "col")


def flood(grid, conn=8):
    """Labels by flood fill: {(row, col): first pixel of its object}."""
    todo = {(r, c) for r, line in enumerate(grid) for c, ch in enumerate(line) if ch == "1"}
    out = {}
    for p in sorted(todo):
        if p in out:
            continue
        stack = [p]
        while stack:
            q = stack.pop()
            if q in todo and q not in out:
                out[q] = p
                stack += [(q[0] + a, q[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if conn == 8 or abs(a) + abs(b) == 1]
    return out


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_equal_flood_fill(spark, conn):
    rng = np.random.default_rng(3)
    grids = [RING, DIAG, SPIRAL, *[["".join("1" if x else "0" for x in row) for row in rng.random((7, 9)) < 0.5] for _ in range(4)]]
    got = {(r["image"], r["row"], r["col"]): r["label"] for r in C.label(fg(raster(spark, *grids)), ["image"], conn).collect()}
    want = {(i, r, c): p[0] * C.STRIDE + p[1] for i, g in enumerate(grids) for (r, c), p in flood(g, conn).items()}
    assert got == want


def test_ring_topology(spark):
    d = raster(spark, RING)
    e = C.euler(fg(d), ["image"]).first()
    assert (e["euler4"], e["euler8"]) == (0, 0)
    a = C.filled_area(C.label(fg(d), ["image"]), ["image"]).first()
    assert (a["area"], a["filled_area"], a["holes"], a["euler"], a["euler_reported"]) == (8, 9, 1, 0, 1)
    assert C.fill_holes(d, fg(d), ["image"], 5, 5).count() == 9
    h = C.hole_summary(d, fg(d), ["image"], 5, 5).first()
    assert h["topology_hole_area_frac"] == 1 / 8 and h["hole_count_exact"] == 1


def test_diagonal_euler_and_border(spark):
    e = C.euler(fg(raster(spark, DIAG)), ["image"]).first()
    assert (e["euler4"], e["euler8"]) == (2, 1)
    kept = C.clear_border(fg(raster(spark, BORDER)), ["image"], 4, 4).collect()
    assert {(r["row"], r["col"]) for r in kept} == {(2, 1), (2, 2)}


def test_full_and_empty_masks(spark):
    full = raster(spark, ["1" * 8] * 8)
    assert R.box_dimension(fg(full), ["image"], 8, 8).first()["fractal_dimension"] == pytest.approx(2)
    g = C.geometry(C.label(fg(full), ["image"]), ["image"]).first()
    assert g["extent"] == 1 and g["area_um2"] == 64
    empty = raster(spark, ["0" * 8] * 8)
    assert C.label(fg(empty), ["image"]).count() == 0
    assert FO.granularity(empty.withColumn("v", F.lit(0.5)), ["image"], "v", "m").first()["granularity_1"] is None


def test_long_object_goes(spark):
    bar = ["1" * 16] + ["0" * 16] * 15
    assert C.remove_long(fg(raster(spark, bar)), ["image"], 1.0, 16, 16).count() == 0


def test_opening_below_closing_above(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(0, r, c, float(rng.random())) for r in range(9) for c in range(11)], "image int, row int, col int, v double")
    o = FO.opened(d, ["image"], "v", 2).withColumnRenamed("v", "o")
    c = FO.closed(d, ["image"], "v", 2).withColumnRenamed("v", "c")
    j = d.join(o, ["image", "row", "col"]).join(c, ["image", "row", "col"])
    assert j.where("o > v or c < v").count() == 0 and j.count() == 99


def test_hull_of_square_and_l(spark):
    sq, ell = ["111", "111", "111"], ["100", "100", "111"]
    rows = {r["image"]: r for r in C.hulls(C.label(fg(raster(spark, sq, ell)), ["image"]), ["image"]).collect()}
    assert rows[0]["convex_area"] == 9 and rows[0]["solidity"] == 1 and rows[0]["caliper"] == pytest.approx(math.sqrt(18))
    assert rows[1]["convex_area"] == 7 and rows[1]["solidity"] == pytest.approx(5 / 7)


def test_hu_moments_do_not_turn(spark):
    ell, turned = ["1000", "1000", "1110", "0000"], ["0000", "0111", "0100", "0100"]
    a, b = C.log_hu(fg(raster(spark, ell, turned)), ["image"]).orderBy("image").collect()
    assert [a[f"hu_{i}"] for i in range(1, 7)] == pytest.approx([b[f"hu_{i}"] for i in range(1, 7)])


def points(spark, groups):
    return spark.createDataFrame([(g, i, float(y), float(x)) for g, pts in enumerate(groups) for i, (y, x) in enumerate(pts)], "grp int, pid int, y double, x double")


def test_two_points(spark):
    p = points(spark, [[(0, 0), (3, 4)]])
    nn = SP.knn(p, 3)
    assert SP.knn_means(p, nn).first().asDict() == {"grp": 0, "knn_k1_mean_um": 5.0, "knn_k3_mean_um": None, "knn_k5_mean_um": None}
    g = SP.proximity_graph(p, nn).first()
    assert (g["graph_radius_um"], g["graph_mean_degree"], g["graph_components"]) == (7.5, 1, 1)
    assert [(e["a"], e["b"], e["d"]) for e in SP.spanning_tree(p).collect()] == [(0, 1, 5)]


def test_neighbours_and_tree_of_clustered_points(spark):
    rng = np.random.default_rng(5)
    groups = [np.concatenate([rng.normal(0, 1, (25, 2)), rng.normal(60, 1, (20, 2))]), rng.random((30, 2)), np.zeros((4, 2)), [(1.0, 1.0)]]
    p = points(spark, groups)
    got = {}
    for r in SP.knn(p, 4).collect():
        got.setdefault((r["grp"], r["pid"]), []).append((r["rank"], r["d"]))
    for g, pts in enumerate(groups):
        pts = np.asarray(pts)
        for i in range(len(pts)):
            want = np.sort(np.delete(np.sqrt(((pts - pts[i]) ** 2).sum(1)), i))[:4]
            assert [d for _, d in sorted(got.get((g, i), []))] == pytest.approx(list(want))
    edges = SP.spanning_tree(p).toPandas()
    for g, pts in enumerate(groups[:2]):
        pts, seen, total = np.asarray(pts), {0}, []
        dist = np.sqrt(((pts[:, None] - pts[None]) ** 2).sum(2))
        while len(seen) < len(pts):
            d, j = min((dist[i, j], j) for i in seen for j in range(len(pts)) if j not in seen)
            seen.add(j)
            total.append(d)
        assert sorted(edges[edges.grp == g].d) == pytest.approx(sorted(total))
    assert set(edges.grp) == {0, 1}


@pytest.mark.parametrize("finish", [0, 3, None])
def test_components_of_structs(spark, finish):
    """Round by round, and with the last few edges in one task; nodes are structs, null fields first."""
    e = spark.sql("""SELECT named_struct('g', a, 'i', b) AS src, named_struct('g', c, 'i', d) AS dst FROM VALUES ('x', 1, 'x', 2), ('x', 3, 'x', 2), (NULL, 9, 'x', 3), ('y', 1, 'y', 2), ('z', 5, 'z', 5), ('y', 4, 'y', 2), (NULL, 9, 'x', 1) AS t(a, b, c, d)""")
    got = {tuple(r["node"]): tuple(r["component"]) for r in connected_components(e, finish=finish).collect()}
    assert got == {k: (None, 9) for k in [("x", 1), ("x", 2), ("x", 3), (None, 9)]} | {k: ("y", 1) for k in [("y", 1), ("y", 2), ("y", 4)]} | {("z", 5): ("z", 5)}


def test_components_of_stars_paths_and_loops(spark):
    e = [(0, i) for i in range(1, 50)] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (500, 500), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(e, "src long, dst long"), finish=0).collect()}
    assert got == {**{i: 0 for i in range(50)}, **{i: 100 for i in range(100, 141)}, 500: 500}


def test_thresholds_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0.2, 0.05, 300), rng.normal(0.7, 0.1, 200)])
    d = spark.createDataFrame([(0, float(x)) for x in v], "image int, v double")
    n, edges = np.histogram(v, 256)
    mid = (edges[1:] + edges[:-1]) / 2
    best = max(range(255), key=lambda i: n[: i + 1].sum() * n[i + 1 :].sum() * ((n[: i + 1] @ mid[: i + 1]) / max(n[: i + 1].sum(), 1) - (n[i + 1 :] @ mid[i + 1 :]) / max(n[i + 1 :].sum(), 1)) ** 2)
    assert TH.otsu(d, ["image"], "v").first()["t"] == pytest.approx(mid[best])
    y = mid - edges[0]
    t = (y @ n) / n.sum()
    for _ in range(300):
        a, b = (y * n)[y <= t].sum() / n[y <= t].sum(), (y * n)[y > t].sum() / n[y > t].sum()
        t = (b - a) / (math.log(b) - math.log(a))
    assert TH.li(d, ["image"], "v").first()["t"] == pytest.approx(t + edges[0], abs=1e-4)


def test_macenko_against_numpy(spark):
    rng = np.random.default_rng(4)
    px = rng.integers(20, 230, (150, 3))
    d = spark.createDataFrame([(0, int(r), int(g), int(b)) for r, g, b in px], "image int, r int, g int, b int")
    od = -np.log((px + 1) / 256)
    use = od[(od > 0.15).any(1)]
    use = use if len(use) >= 100 else od
    _, vec = np.linalg.eigh(np.cov(use.T))
    v = [x if x.sum() >= 0 else -x for x in (vec[:, 2], vec[:, 1])]
    ang = np.arctan2(use @ v[1], use @ v[0])
    ends = [v[0] * np.cos(a) + v[1] * np.sin(a) for a in np.percentile(ang, [1, 99])]
    ends = [e / (np.linalg.norm(e) + 1e-8) for e in ends]
    pick = max(ends, key=lambda e: abs(e @ np.array(TH.REFERENCE)))
    got = [r["dab"] for r in TH.macenko(d, ["image"]).collect()]
    assert sorted(got) == pytest.approx(sorted(np.maximum(od @ pick, 0)), abs=1e-6)


def test_tails_against_tables():
    assert T.t_tail([2.228139, 12.7062, 0.0], [10, 1, 5]) == pytest.approx([0.05, 0.05, 1.0], abs=1e-5)
    assert T.chi2_tail([5.991465, 18.30704, 0.0], [2, 10, 3]) == pytest.approx([0.05, 0.05, 1.0], abs=1e-5)


def test_differential_edge_cases(spark):
    rows = [("a", "x", "i1", "g1", 1.0), ("a", "x", "i2", "g1", 1.0), ("a", "x", "i3", "g2", 1.0), ("a", "x", "i4", "g2", 1.0), ("a", "y", "i1", "g1", 1.0), ("a", "y", "i2", "g2", None), ("a", "z", "i1", "g2", 5.0), ("a", "z", "i2", "g1", 1.0), ("a", "z", "i3", "g2", 6.0), ("a", "z", "i4", "g1", 2.0), ("a", "z", "i5", None, 9.0)]
    d = spark.createDataFrame(rows, "phenotype string, feature string, image string, level string, value double").withColumn("channel", F.lit("c"))
    r = {x["feature"]: x for x in T.differential(d, ["channel"]).collect()}
    assert r["x"]["test"] == "welch_t" and r["x"]["p_value"] is None and r["x"]["effect_d"] is None
    assert r["y"]["test"] == "insufficient" and r["y"]["q_value"] is None
    assert r["z"]["effect_d"] > 0 and r["z"]["n"] == 4 and r["z"]["q_value"] == r["z"]["p_value"]


def test_statistics_guards(spark):
    d = spark.createDataFrame([(0, 1.0), (1, 1.0), (1, 1.0), (1, 1.0), (2, float("nan")), (2, None), (3, 1.0), (3, 2.0), (3, 4.0), (3, 8.0)], "k int, x double")
    r = {x["k"]: x for x in d.groupBy("k").agg(S.sd("x").alias("sd"), S.cv("x").alias("cv"), S.skew("x").alias("skew"), S.kurtosis("x").alias("kurt"), S.pearson("x", "x").alias("r")).collect()}
    assert r[0]["sd"] == 0 and r[0]["cv"] == 0 and r[1]["skew"] is None and r[1]["r"] is None and r[2]["sd"] is None
    x = np.array([1.0, 2, 4, 8])
    g1 = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert r[3]["skew"] == pytest.approx(g1 * math.sqrt(12) / 2) and r[3]["r"] == pytest.approx(1)


def test_names_of_scales():
    assert [K.scale_label(0.2738 * k) for k in (1, 2, 4, 8)] == ["s0p274um", "s0p548um", "s1p1um", "s2p19um"]


def test_strict_position_raises(spark):
    d = spark.createDataFrame([("nothing.png",)], "n string")
    with pytest.raises(Exception, match="no row and column"):
        d.select(*[c.alias(n) for c, n in zip(K.grid_position(F.col("n"), strict=True), "rc")]).collect()


def test_neighbours_of_crowded_points_equal_brute_force(spark):
    """Two crowds far apart and a few points between: crowds begin with fine cells."""
    rng = np.random.default_rng(9)
    p = np.concatenate([rng.normal(0, 1e-3, (120, 2)), rng.normal(1000, 1e-2, (80, 2)), rng.random((12, 2)) * 1000, [[0.0, 0.0]] * 8])
    d = spark.createDataFrame([(0, i, float(y), float(x)) for i, (y, x) in enumerate(p)], "grp int, pid int, y double, x double")
    got = {(r["pid"], r["rank"]): r["nid"] for r in SP.knn(d, 3).collect()}
    dist = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    for i in range(len(p)):
        order = sorted((j for j in range(len(p)) if j != i), key=lambda j: (dist[i, j], j))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == order


def spread(spark, seed, n, crowd=0):
    rng = np.random.default_rng(seed)
    rows = [(int(i) % 2, int(i), float(y), float(x)) for i, (y, x) in enumerate(rng.random((n, 2)) * 100)]
    rows += [(0, n + i, 50 + float(y), 50 + float(x)) for i, (y, x) in enumerate(rng.random((crowd, 2)) * 0.5)] + [(0, 10 * n + i, 7.0, 7.0) for i in range(crowd // 4)]
    return spark.createDataFrame(rows, "grp int, pid int, y double, x double")


def test_groups_of_any_size_have_the_same_neighbours_graphs_and_trees(spark, monkeypatch):
    """On arrays and by cells: the same rows; points in one spot and at one place included."""
    p = spread(spark, 3, 300, 60)
    measure = lambda: (sorted((*r[:4], round(r["d"], 9)) for r in SP.knn(p, 3).collect()), sorted(tuple(None if v is None else round(v, 9) for v in r) for r in SP.proximity_graph(p, SP.knn(p, 1)).collect()), sorted((r["grp"], round(r["d"], 9)) for r in SP.spanning_tree(p).collect()))
    arrays = measure()
    monkeypatch.setattr(SP, "SMALL", 10)
    monkeypatch.setattr(SP, "PAIRS", 50)
    cells = measure()
    assert arrays[0] == cells[0] and arrays[1] == cells[1] and arrays[2] == cells[2]


def test_a_crowd_of_a_hundred_thousand_has_a_graph_without_its_pairs(spark):
    """10^5 points in one spot and 10^5 spread: five thousand million pairs are counted, not made."""
    p = spark.range(200_000).select(F.lit(1).alias("grp"), F.col("id").alias("pid"), F.when(F.col("id") < 100_000, F.col("id") % 317 * 1e-4).otherwise(F.floor(F.col("id") / 447) * 3.0).alias("y"), F.when(F.col("id") < 100_000, F.col("id") % 331 * 1e-4).otherwise(F.col("id") % 447 * 3.0).alias("x"))
    nn = spark.createDataFrame([(1, 1, 4 / 3)], "grp int, rank int, d double")
    got = SP.proximity_graph(p, nn).first()
    assert got["graph_radius_um"] == pytest.approx(2.0) and got["graph_components"] == pytest.approx(100_001) and got["graph_largest_component_frac"] == 0.5
    assert got["graph_mean_degree"] == pytest.approx(100_000 * 99_999 / 200_000)
