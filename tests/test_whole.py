"""Families of pixels on arrays of whole images against the same families by tiles and aggregates."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators import components as C
from tessera.operators import spatial as SP
from tessera.operators import tiles as TL
from tessera.operators import whole as WH
from tessera.functions import stats as S
from tessera.plans import assembly

PIXELS = ["pixels", "topology", "tiles", "texture", "granularity"]


def odd(spark):
    """Images of several sizes: plain ones, a flat one, one without mask, one without tissue, one pixel, and one with NaN, infinite and null values and null masks."""
    rng = np.random.default_rng(8)
    rows, sizes = [], []
    for i, (h, w) in enumerate([(8, 8), (8, 8), (13, 21), (6, 30), (8, 8), (7, 9), (5, 5), (1, 1), (9, 9)]):
        sizes.append((i, h, w))
        for r in range(h):
            for c in range(w):
                v = 0.5 if i == 4 else float(rng.random())
                m, ok, n = v > 0.45 and i != 5, v > 0.05 and i != 6, v * v
                if i == 8:
                    v = [math.nan, math.inf, -math.inf, None][rng.integers(4)] if rng.random() < 0.3 else v
                    n = [math.nan, None, n, n][rng.integers(4)]
                    m, ok = (None if rng.random() < 0.2 else x for x in (m, ok))
                if i != 1 or (r * c) % 5:
                    rows.append((i, r, c, v, n, m, ok))
    return spark.createDataFrame(rows, "image int, row int, col int, v double, n double, m boolean, ok boolean"), spark.createDataFrame(sizes, "image int, height int, width int")


def test_a_summary_on_arrays_is_that_by_tiles(spark, monkeypatch):
    d, sizes = odd(spark)
    made = lambda: {(r["image"], r["feature"]): r["value"] for r in assembly.channel_summary(d, "image", "m", "ok", "n", "v", sizes, only=PIXELS).collect()}
    arrays = made()
    monkeypatch.setattr(TL, "TILE", 8)
    mixed = made()  # images of over eight pixels a side go by tiles
    assert arrays.keys() == mixed.keys() and len(arrays) == 9 * sum(map(len, WH.names({1: "", 2: "", 4: "", 8: ""}).values()))
    off = {k: (v, mixed[k]) for k, v in arrays.items() if not (v is None and mixed[k] is None) and (v is None or mixed[k] is None or not np.isclose(v, mixed[k], rtol=1e-7, atol=1e-9, equal_nan=True))}
    assert not off


def test_families_of_pixels_read_them_once(spark, monkeypatch):
    d, sizes = odd(spark)
    written, save = [], assembly.Scratch.save
    monkeypatch.setattr(assembly.Scratch, "save", lambda self, df: written.append(df) or save(self, df))
    assembly.channel_summary(d, "image", "m", "ok", "n", "v", sizes, only=PIXELS)
    assert len(written) == 4  # pixels, images, those larger than a tile, features


def test_many_small_tiles_are_few_stacks():
    n = 300
    rows = pa.table({"row": np.tile(np.arange(64) // 8, n), "col": np.tile(np.arange(64) % 8, n), "_tr": np.zeros(64 * n, int), "_tc": np.zeros(64 * n, int), "v": np.arange(64 * n)})
    one, = TL.stacks(rows, np.arange(n) * 64, 512, (0, 0))
    assert one.shape == (n, 8, 8) and np.array_equal(one.dense("v", -1, int).ravel(), np.arange(64 * n)) and one.inside().all()
    wide = pa.concat_tables([rows, pa.table({"row": [0, 500], "col": [0, 3], "_tr": [0, 0], "_tc": [0, 0], "v": [7, 8]})])
    shapes = sorted(t.shape for t in TL.stacks(wide, np.arange(n + 1) * 64, 512, (0, 0)))
    assert shapes == [(1, 501, 4), (n, 8, 8)]


def test_a_rim_copies_no_pixel_of_a_small_image(spark):
    d = spark.range(64).selectExpr("1 image", "int(id / 8) row", "int(id % 8) col")
    out = TL.over_tiles(d, ["image"], 30, lambda t: pa.table({"n": [len(t.row)]}), "n long")
    assert [r["n"] for r in out.collect()] == [64]


def test_summaries_of_small_and_large_groups(spark, monkeypatch):
    rng = np.random.default_rng(4)
    d = spark.createDataFrame([(i % 3 + (i > 50), float(v) if v > 0.1 else math.nan, None if i % 4 else float(v)) for i, v in enumerate(rng.random(90))], "k int, a double, b double")
    want = {r["k"]: r for r in S.summarise(d, ["k"], ["a", "b"], ("median", "iqr")).join(d.groupBy("k").agg(F.count("*").alias("_n")), "k").collect()}
    for most in (100_000, 25):
        monkeypatch.setattr(WH, "GROUP", most)
        assert {r["k"]: r for r in WH.summarise(d, ["k"], ["a", "b"]).collect()} == want


@pytest.mark.parametrize("chunk", [2_000_000, 7])
def test_small_groups_of_points_are_done_together(spark, monkeypatch, chunk):
    monkeypatch.setattr(SP, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    xy = np.round(rng.random((60, 2)) * 9)
    p = spark.createDataFrame([(i % 7, i, float(y), float(x)) for i, (y, x) in enumerate(xy)] + [(9, 99, 0.0, 0.0)], "grp int, pid long, y double, x double")
    got = {(r["pid"], r["rank"]): (r["nid"], r["d"]) for r in SP.knn(p, 3).collect()}
    want = {}
    for i in range(60):
        near = sorted((float(np.hypot(*(xy[i] - xy[j]))), j) for j in range(i % 7, 60, 7) if j != i)[:3]
        want |= {(i, k + 1): (j, d) for k, (d, j) in enumerate(near)}
    assert got.keys() == want.keys() and all(got[k][0] == n and abs(got[k][1] - d) < 1e-12 for k, (n, d) in want.items())
    g = {r["grp"]: r for r in SP.proximity_graph(p, SP.knn(p, 1)).collect()}
    assert set(g) == {*range(7), 9} and g[9]["graph_radius_um"] is None
    assert all(1 <= g[i]["graph_components"] <= len(xy[i::7]) and g[i]["graph_largest_component_frac"] <= 1 for i in range(7))


def test_holes_of_objects_of_many_widths(spark):
    ring = lambda n: [(r, c) for r in range(n) for c in range(n) if min(r, c, n - 1 - r, n - 1 - c) == 0]
    rows = [(n, r, c + 2, 5) for n in (3, 4, 9) for r, c in ring(n)] + [(20, r, c, 1) for r in range(4) for c in range(9) if not (r in (1, 2) and c in (1, 3, 4, 7))] + [(21, 0, c, 1) for c in range(5)] + [(22, r, c, 1) for r, c in ring(5) if (r, c) != (0, 2)]
    got = {r["image"]: (r["area"], r["hole_area"], r["holes"]) for r in C.filled_area(spark.createDataFrame(rows, "image int, row int, col int, label long"), ["image"]).collect()}
    assert got == {3: (8, 1, 1), 4: (12, 4, 1), 9: (32, 49, 1), 20: (28, 8, 3), 21: (5, 0, 0), 22: (15, 0, 0)}
