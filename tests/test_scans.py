"""Scans over many small ranges equal those of whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import stats as S
from tessera.operators import difftest as T
from tessera.operators import scans


def rows(spark, n=3_000, seed=0):
    rng = np.random.default_rng(seed)
    r = [(["a", "b", None][int(i) % 3] if i % 7 else "hot", int(i), None if rng.random() < 0.05 else float(np.round(rng.random() ** 3, 2))) for i in range(n)]
    return spark.createDataFrame(r + [("hot", n + i, 0.5) for i in range(n)], "g string, id int, v double")


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["g"], []).append(r)
    return out


@pytest.mark.parametrize("size", [None, 100])
def test_mid_ranks(spark, size):
    for part in groups(scans.mid_ranks(rows(spark).where("v is not null"), ["g"], "v", size)).values():
        v = np.array([r["v"] for r in part])
        assert np.allclose([r["rank"] for r in part], [(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v]) and [r["ties"] for r in part] == [(v == x).sum() for x in v]


@pytest.mark.parametrize("size", [None, 100])
def test_gini(spark, size):
    d = rows(spark).unionByName(spark.createDataFrame([("zero", 1, 0.0), ("zero", 2, 0.0), ("none", 1, None)], "g string, id int, v double"))
    got = {r["g"]: r["gini"] for r in scans.gini(d, ["g"], F.col("v"), rows=size).collect()}
    for g, part in groups(d).items():
        v = np.sort([r["v"] for r in part if r["v"] is not None])
        i = np.arange(1, len(v) + 1)
        want = None if not len(v) else 0 if not v.any() else ((2 * i - len(v) - 1) * v).sum() / (len(v) * v.sum())
        assert got[g] == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("size", [None, 100])
def test_benjamini_hochberg(spark, size):
    for part in groups(scans.benjamini_hochberg(rows(spark), ["g"], "v", ["id"], rows=size)).values():
        done = sorted((r for r in part if r["v"] is not None), key=lambda r: (r["v"], r["id"]))
        low = 1.0
        for i in range(len(done), 0, -1):
            low = min(low, done[i - 1]["v"] * len(done) / i)
            assert done[i - 1]["q_value"] == pytest.approx(low)
        assert all(r["q_value"] is None for r in part if r["v"] is None)


def test_kruskal_over_ranges(spark, monkeypatch):
    d = rows(spark).withColumn("level", (F.col("id") % 4).cast("string")).withColumnRenamed("v", "value").withColumn("image", F.col("id").cast("string")).na.fill("null", ["g"])
    whole = {r["g"]: (r["h"], r["df"]) for r in T.kruskal(d, ["g"]).collect()}
    monkeypatch.setattr(scans, "RANGE", 50)
    assert {r["g"]: (pytest.approx(r["h"]), r["df"]) for r in T.kruskal(d, ["g"]).collect()} == whole


def test_a_group_of_millions_has_no_window_over_it(spark, monkeypatch):
    """Two million rows of one group: no task of the scan sees more than a few ranges."""
    d = spark.range(2_000_000).select(F.lit("one").alias("g"), "id", ((F.col("id") * 7919) % 1_000_003 / 1e6).alias("v"))
    out = scans.benjamini_hochberg(d, ["g"], "v", ["id"])
    r = scans.Ranged(d, ["g"], ["v"])
    sizes = [x["count"] for x in r.rows.groupBy("_part").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 3 * scans.RANGE
    top = out.where("q_value is not null").agg(F.count("*"), F.max("q_value"), F.min("q_value")).first()
    assert top[0] == 2_000_000 and 0 <= top[2] <= top[1] <= 1


@pytest.mark.parametrize("size", [None, 100])
def test_quantiles_equal_percentiles(spark, size):
    d = rows(spark).unionByName(spark.createDataFrame([("single", 1, 3.0), ("none", 1, None)], "g string, id int, v double"))
    qs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = {r["g"]: list(r)[1:] for r in scans.quantiles(d, ["g"], F.col("v"), qs, [f"q{i}" for i in range(6)], rows=size).collect()}
    want = {r["g"]: list(r)[1:] for r in d.groupBy("g").agg(*[F.percentile("v", F.lit(q)) for q in qs]).collect()}
    assert got.keys() == want.keys() and all(got[g] == (pytest.approx(want[g]) if want[g][0] is not None else want[g]) for g in want)


def test_normalising_large_images(spark, monkeypatch):
    from tessera.operators import raster as R

    d = rows(spark).na.fill("z", ["g"]).withColumn("ok", F.col("id") % 3 == 0)
    monkeypatch.setattr(scans, "RANGE", 200)
    run = lambda large: sorted((r["g"], r["id"], None if r["norm"] is None else round(r["norm"], 9)) for r in R.normalise(d, ["g"], "v", where=F.col("ok"), large=large).collect())
    key = lambda x: str(x)
    assert sorted(run(True), key=key) == sorted(run(False), key=key)


def test_summaries_of_large_groups_are_those_of_small_ones(spark, monkeypatch):
    monkeypatch.setattr(scans, "RANGE", 40)
    rows = [(None if i % 5 == 0 else i % 3, float(i * 7919 % 331) if i % 11 else None, float(i % 4) if i % 13 else float("inf")) for i in range(500)] + [(9, None, 2.0), (8, None, None)]
    d = spark.createDataFrame(rows, "k int, a double, b double")
    aggs = ("mean", "sd", "iqr", "median")
    got, want = (sorted(map(tuple, f(d, ["k"], ["a", "b"], aggs).collect()), key=str) for f in (scans.summarise, S.summarise))
    assert len(got) == 6 and [r[0] for r in got] == [r[0] for r in want]
    for g, w in zip(got, want):
        assert all((x is None) == (y is None) and (x is None or abs(x - y) < 1e-9) for x, y in zip(g[1:], w[1:]))
    assert "percentile" not in scans.summarise(d, ["k"], ["a"], aggs)._jdf.queryExecution().optimizedPlan().toString()
