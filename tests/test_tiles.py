"""Tiles against whole-image arrays: small tiles must give what one array gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import components as C
from tessera.operators import focal as FO
from tessera.operators import spatial as SP
from tessera.operators import texture as TX
from tessera.operators import tiles as TL


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(TL, "TILE", 8)


def table(spark, images: dict, **kinds):
    parts = []
    for name, a in images.items():
        r, c = np.indices(a.shape)
        parts.append(pd.DataFrame({"image": name, "row": r.ravel() - 3, "col": c.ravel() + 5, "v": a.ravel()}))
    return spark.createDataFrame(pd.concat(parts))


def back(df, name, shape, image):
    out = np.full(shape, np.nan)
    for r in df.where(F.col("image") == image).collect():
        out[r["row"] + 3, r["col"] - 5] = np.nan if r[name] is None else r[name]
    return out


def disc(a, radius, what):
    h, w = a.shape
    out = np.empty_like(a)
    for y in range(h):
        for x in range(w):
            near = [a[y + dy, x + dx] for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius and 0 <= y + dy < h and 0 <= x + dx < w]
            out[y, x] = max(near) if what == "max" else min(near)
    return out


def test_focal_chains_over_tiles(spark, small):
    rng = np.random.default_rng(0)
    images = {"a": rng.random((21, 30)), "b": rng.random((5, 4))}
    d = table(spark, images).withColumn("more", F.col("row") * 2)
    got = FO.closed(FO.opened(d, ["image"], "v", 2), ["image"], "v", 3)
    assert got.columns == d.columns and got.where("more <> row * 2").isEmpty()
    for name, a in images.items():
        want = disc(disc(disc(disc(a, 2, "min"), 2, "max"), 3, "max"), 3, "min")
        assert np.array_equal(back(got, "v", a.shape, name), want)


def test_granularity_of_tiles_is_that_of_the_image_and_takes_one_exchange_of_pixels(spark, monkeypatch):
    rng = np.random.default_rng(1)
    d = table(spark, {"a": rng.random((25, 33)), "b": np.zeros((6, 6))}).withColumn("m", (F.col("v") > 0.2) | (F.col("image") == "b"))
    want = {r["image"]: r for r in FO.granularity(d, ["image"], "v", "m").collect()}
    monkeypatch.setattr(TL, "TILE", 8)
    got = FO.granularity(d, ["image"], "v", "m")
    plan = got._jdf.queryExecution().executedPlan().toString()
    for r in got.collect():
        assert list(r)[1:] == pytest.approx(list(want[r["image"]])[1:])
    assert plan.count("Exchange hashpartitioning(image") == 2 and plan.count("_tr") > 0 and "Join" not in plan  # pixels by tile, then sums by image


def spiral(n):
    a = np.zeros((n, n))
    y, x, dy, dx = 0, 0, 0, 1
    a[0, 0] = 1
    while True:
        for _ in range(2):
            ny, nx = y + dy, x + dx
            ahead = (y + 2 * dy, x + 2 * dx)
            if 0 <= ny < n and 0 <= nx < n and not (0 <= ahead[0] < n and 0 <= ahead[1] < n and a[ahead]):
                break
            dy, dx = dx, -dy
        else:
            return a
        y, x = y + dy, x + dx
        if a[y, x]:
            return a
        a[y, x] = 1


def flood(a, conn):
    lab = {}
    for y, x in zip(*np.nonzero(a)):
        if (y, x) in lab:
            continue
        lab[y, x], todo = (y, x), [(y, x)]
        while todo:
            py, px = todo.pop()
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    q = py + dy, px + dx
                    if (conn == 8 or dy * dx == 0) and 0 <= q[0] < a.shape[0] and 0 <= q[1] < a.shape[1] and a[q] and q not in lab:
                        lab[q] = (y, x)
                        todo.append(q)
    return lab


@pytest.mark.parametrize("conn", [4, 8])
def test_labels_of_a_spiral_and_of_noise_over_many_tiles(spark, small, conn):
    rng = np.random.default_rng(2)
    images = {"spiral": spiral(41), "noise": (rng.random((30, 50)) < 0.5).astype(float), "none": np.zeros((4, 4))}
    d = table(spark, images).where("v = 1").withColumn("row", F.col("row") + 3).withColumn("col", F.col("col") - 5)
    got = {(r["image"], r["row"], r["col"]): r["label"] for r in C.label(d, ["image"], conn).collect()}
    want = {(n, y, x): f[0] * C.STRIDE + f[1] for n, a in images.items() for (y, x), f in flood(a, conn).items()}
    assert got == want and len({v for (n, _, _), v in got.items() if n == "spiral"}) == 1


def test_object_sums_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    d = table(spark, {"a": (rng.random((40, 40)) < 0.6).astype(float)}).where("v = 1").withColumn("row", F.col("row") + 3).withColumn("col", F.col("col") - 5)
    measure = lambda: (sorted(map(tuple, C.perimeter(C.label(d, ["image"]), ["image"]).collect())), C.quads(d, ["image"]).first())
    one = measure()
    monkeypatch.setattr(TL, "TILE", 8)
    many = measure()
    assert one[1] == many[1] and [r[:2] for r in one[0]] == [r[:2] for r in many[0]] and [r[2] for r in one[0]] == pytest.approx([r[2] for r in many[0]])


def test_co_occurrence_over_tiles(spark, small):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 5, (19, 23))
    d = table(spark, {"a": a}).where("v > 0")
    want = {}
    for dist, ang, dy, dx in TX.OFFSETS:
        for y in range(19):
            for x in range(23):
                if 0 <= y + dy < 19 and 0 <= x + dx < 23 and a[y, x] > 0 and a[y + dy, x + dx] > 0:
                    k = dist, ang, a[y, x], a[y + dy, x + dx]
                    want[k] = want.get(k, 0) + 1
    got = TX.counts(d, ["image"], "v").groupBy("d", "a", "i", "j").agg(F.sum("n").alias("n")).collect()
    assert {(r["d"], r["a"], r["i"], r["j"]): r["n"] for r in got} == want


def test_distances_of_a_large_image(spark):
    """1,000 x 1,000 pixels over four tiles, reach of 110 pixels and anisotropic pixels, against every mask pixel."""
    rng = np.random.default_rng(5)
    mask = np.zeros((1000, 1000), bool)
    mask[rng.integers(0, 1000, 30), rng.integers(0, 700, 30)] = True
    r, c = np.indices(mask.shape)
    d = spark.createDataFrame(pd.DataFrame({"image": 1, "row": r.ravel(), "col": c.ravel(), "m": mask.ravel()}))
    got = SP.mask_distance(d, ["image"], "m", 30.0, 0.2738, 0.3).toPandas().sort_values(["row", "col"])["dist"].to_numpy(float).reshape(mask.shape)
    want = np.full(mask.shape, np.inf)
    for y, x in zip(*np.nonzero(mask)):
        want = np.minimum(want, np.sqrt(((r - y) * 0.2738) ** 2 + ((c - x) * 0.3) ** 2))
    want[want > 30] = np.nan
    assert np.allclose(got, want, equal_nan=True)


def test_tiles_of_hostile_keys(spark, small):
    """Null keys, composite keys, repeated rows and null values."""
    d = spark.createDataFrame([(None, 1, 0, 0, 1.0), (None, 1, 0, 1, None), ("a", None, 0, 0, 5.0), ("a", None, 0, 0, 5.0), ("a", 2, 100, 7, None)], "k string, g int, row int, col int, v double")
    got = FO.dilate(d, ["k", "g"], "v", 1).collect()
    assert sorted(((r["k"] or "", r["g"] or 0, r["row"], r["col"], r["v"]) for r in got), key=str) == sorted([("", 1, 0, 0, 1.0), ("", 1, 0, 1, 1.0), ("a", 0, 0, 0, 5.0), ("a", 0, 0, 0, 5.0), ("a", 2, 100, 7, None)], key=str)
    assert FO.dilate(d.limit(0), ["k", "g"], "v", 1).isEmpty() and C.label(d.limit(0), ["k"]).isEmpty()
