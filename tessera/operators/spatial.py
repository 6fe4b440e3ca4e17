"""Point operators by grid cells: exact nearest neighbours, radius joins, graphs and spanning trees.

Points are grouped or joined by an equality key (group, cell). Points are ``grp, pid, y, x``.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch, ship
from tessera.functions import stats as S
from tessera.operators import tiles as TL
from tessera.operators.graph import connected_components
from tessera.operators.raster import Size, with_size

#: Halvings of the mean cell, how many times its mean points make a cell full, and how many times k points it has in the mean.
LEVELS, CROWD, BLOCK = 12, 4, 48
#: Points of a group that one task does at once, in the square of their number; distances held at a time.
SMALL, CHUNK = 4_096, 2_000_000
#: Points that have a place.
PLACED = "y IS NOT NULL AND x IS NOT NULL AND NOT isnan(y) AND NOT isnan(x)"


def _cell(v: str, side: str):
    return F.floor(F.col(v) / F.col(side))


def _finest(probes: DataFrame, base: DataFrame, box: DataFrame, many: int, tmp: Scratch) -> DataFrame:
    """``probes`` with the ``side`` to begin with, and the group's ``reach``.

    All begin with the group's mean cell. Cells that hold over CROWD times ``many`` points are halved, with their points only, until none is so full: without crowds
    this is one count.
    """
    p = probes.join(box, "grp").select("grp", "pid", "y", "x", "side", "reach")
    b = base.join(box, "grp").select("grp", "y", "x", "side")
    out = None
    for _ in range(LEVELS):
        cell = lambda t: t.withColumn("cy", _cell("y", "side")).withColumn("cx", _cell("x", "side"))
        full = tmp.save(cell(b).groupBy("grp", "cy", "cx").agg(F.count("*").alias("n")).where(F.col("n") > CROWD * many).select("grp", "cy", "cx"))
        if full.isEmpty():
            break
        at = ["grp", "cy", "cx"]
        ready = cell(p).join(full, at, "left_anti").drop("cy", "cx")
        out = ready if out is None else out.unionByName(ready)
        half = lambda t: cell(t).join(full, at, "left_semi").drop("cy", "cx").withColumn("side", F.col("side") / 2)
        p, b = tmp.save(half(p)), tmp.save(half(b))
    return p if out is None else out.unionByName(p)


def _sizes(tmp: Scratch, *points: DataFrame) -> tuple[DataFrame, bool]:
    """Groups of more than SMALL points (written), and whether there are any."""
    n = reduce(DataFrame.unionByName, [p.select("grp") for p in points]).groupBy("grp").agg(F.count("*").alias("n"))
    large = tmp.save(n.where(F.col("n") > SMALL).select("grp"))
    return large, not large.isEmpty()


def _nearest_small(k: int, exclude_self: bool):
    """All distances of small groups, ``CHUNK`` of them at a time. Rows are probes, then base points in the order of their ids, so that ties go to the smaller one."""

    def work(rows: pa.Table, starts: np.ndarray):
        is_base = np.asarray(rows.column("base")).astype(np.int64)
        y, x = (rows.column(c).cast(pa.float64()).to_numpy() for c in ("y", "x"))
        pid = rows.column("pid")
        ids = np.asarray(pid)
        bases = np.add.reduceat(is_base, starts)
        probes = np.diff(np.append(starts, len(y))) - bases
        for of in TL.alike(probes, bases):
            n, m = int(probes[of[0]]), int(bases[of[0]])
            if not n or not m:
                continue
            step = max(CHUNK // (n * m), 1)
            for i in range(0, len(of), step):
                part = of[i : i + step]
                for j in range(0, n, max(CHUNK // m, 1)):
                    p = starts[part][:, None] + np.arange(j, min(j + max(CHUNK // m, 1), n))
                    b = starts[part][:, None] + n + np.arange(m)
                    g, at, rank, nid, dist = _nearest_of_groups((ids[p], y[p], x[p]), (ids[b], y[b], x[b]), k, exclude_self)
                    yield part[g], {"pid": pid.take(pa.array(p[g, at])), "rank": pa.array(rank, pa.int32()), "nid": pid.take(pa.array(b[g, nid])), "d": pa.array(dist)}

    return work


def _nearest_of_groups(probe: tuple, base: tuple, k: int, exclude_self: bool):
    """``_nearest_of`` for a stack of groups: group and place of the probe, rank, base place and distance."""
    (pid, py, px), (bid, by, bx) = probe, base
    dy, dx = py[:, :, None] - by[:, None, :], px[:, :, None] - bx[:, None, :]
    d = np.sqrt(dy * dy + dx * dx)
    d[np.isnan(d)] = np.inf
    if exclude_self:
        d[pid[:, :, None] == bid[:, None, :]] = np.inf
    top = min(k, d.shape[2])
    g, r, c = np.nonzero((d <= np.partition(d, top - 1, 2)[:, :, top - 1 : top]) & (d < np.inf))
    v = d[g, r, c]
    order = np.lexsort((c, v, r, g))
    g, r, c, v = g[order], r[order], c[order], v[order]
    of = g * d.shape[1] + r
    place = np.arange(len(of)) - np.searchsorted(of, of)
    keep = place < k
    return g[keep], r[keep], place[keep] + 1, c[keep], v[keep]


def nearest(probes: DataFrame, base: DataFrame, k: int, exclude_self: bool = False, max_rounds: int = 40) -> DataFrame:
    """Exact k nearest ``base`` points of each probe of the same group: ``grp, pid, rank, nid, d``; ties go to the smaller id.

    A group of at most SMALL points is done at once on arrays; larger ones by cells.
    """
    tmp = Scratch(probes.sparkSession, "nearest")
    large, some = _sizes(tmp, *([probes] if probes is base else [probes, base]))
    p, b = (t.select("grp", "pid", "y", "x") for t in (probes, base))
    schema = TL.schema_of(p, ["grp", "pid"], rank="integer").add("nid", b.schema["pid"].dataType).add("d", "double")
    both = p.withColumn("base", F.lit(False)).unionByName(b.withColumn("base", F.lit(True)))
    out = TL.over_alike(both.join(large, "grp", "left_anti") if some else both, ["grp"], _nearest_small(k, exclude_self), schema, ("base", "pid"))
    return out.unionByName(_by_cells(*[t.join(large, "grp", "left_semi") for t in (p, b)], k, exclude_self, max_rounds, tmp)) if some else out


def _reach_of(v: str, side, rim):
    """The cells of ``side`` whose rims a point lies in."""
    return F.explode(F.sequence(F.floor((F.col(v) - rim) / side), F.floor((F.col(v) + rim) / side)))


def _nearest_of(probe: tuple, base: tuple, k: int, exclude_self: bool):
    """Place of the probe, rank, base place and distance of the k nearest (ids, y, x; the base in the order of its ids, so that ties go to the smaller), CHUNK distances at a time."""
    (pid, py, px), (bid, by, bx) = probe, base
    at, nid, rank, dist = [], [], [], []
    step = max(CHUNK // len(by), 1)
    for i in range(0, len(py), step):
        dy, dx = py[i : i + step, None] - by, px[i : i + step, None] - bx
        d = np.sqrt(dy * dy + dx * dx)
        d[np.isnan(d)] = np.inf
        if exclude_self:
            d[pid[i : i + step, None] == bid] = np.inf
        top = min(k, d.shape[1])
        r, c = np.nonzero((d <= np.partition(d, top - 1, 1)[:, top - 1 : top]) & (d < np.inf))
        v = d[r, c]
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        at.append(r[keep] + i), nid.append(c[keep]), rank.append(place[keep] + 1), dist.append(v[keep])
    return tuple(map(np.concatenate, (at, rank, nid, dist)))


def _nearest_in_block(k: int, exclude_self: bool):
    """Neighbours of a cell's probes among the points of the cell and its rim. A probe whose k-th is beyond what the rim shows comes back without neighbours."""

    def work(rows: pa.Table) -> pa.Table | None:
        is_base = np.asarray(rows.column("base")).astype(bool)
        base, probe = rows.filter(pa.array(is_base)), rows.filter(pa.array(~is_base))
        if not len(probe):
            return None
        base = base.sort_by("nid")
        side, reach, cy, cx, rim = (rows.column(c)[0].as_py() for c in ("side", "reach", "cy", "cx", "rim"))
        by, bx, py, px = (t.column(c).to_numpy() for t in (base, probe) for c in ("y", "x"))
        at, rank, nid, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(base):
            at, rank, nid, dist = _nearest_of((np.asarray(probe.column("pid")), py, px), (np.asarray(base.column("nid")), by, bx), k, exclude_self)
        shown = np.minimum.reduce([py - (cy * side - rim), (cy + 1) * side + rim - py, px - (cx * side - rim), (cx + 1) * side + rim - px])
        shown = shown - 1e-9 * (np.abs(py) + np.abs(px) + side)  # cells are cut in floating point
        last, n = np.full(len(py), np.inf), np.bincount(at, minlength=len(py))
        last[at[rank == k]] = dist[rank == k]
        ok = (n >= k) & (last <= shown) if side < reach else np.ones(len(py), bool)
        keep, open_ = ok[at], np.flatnonzero(~ok)
        take = lambda name, i: probe.column(name).take(pa.array(i))
        done = {"grp": take("grp", at[keep]), "pid": take("pid", at[keep]), "rank": pa.array(rank[keep], pa.int32()), "nid": base.column("nid").take(pa.array(nid[keep])), "d": pa.array(dist[keep])}
        rest = {c: take(c, open_) for c in ("grp", "pid", "y", "x", "side", "reach")}
        return pa.concat_tables([pa.table(done), pa.table(rest)], promote_options="default")

    return work


def _by_cells(probes: DataFrame, base: DataFrame, k: int, exclude_self: bool, max_rounds: int, tmp: Scratch) -> DataFrame:
    """``nearest`` by blocks: a cell with its probes, and base points up to a rim of a sixth of its side.

    A probe begins with cells that hold some tens of k points in the group's mean, halved where points crowd, so that those do not all share a cell. It is settled when its k-th neighbour is no further
    than the block shows; the few others go on with cells of twice the side until the block covers the group. So what is exchanged is the points, once or twice, not their pairs.
    """
    probes, base = (t.select("grp", "pid", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).where(PLACED) for t in (probes, base))
    box = base.select("grp", "y", "x").union(probes.select("grp", "y", "x")).groupBy("grp").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    box = box.join(base.groupBy("grp").agg(F.count("*").alias("n")), "grp")
    h, w = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    reach = F.greatest(h, w)
    side = F.sqrt(h * w * (BLOCK * k) / F.col("n"))
    box = tmp.save(box.select("grp", F.when(side > 0, F.least(side, reach)).when(reach > 0, reach).otherwise(F.lit(1.0)).alias("side"), reach.alias("reach")))
    todo, done = _finest(probes, base, box, BLOCK * k, tmp), None
    schema = TL.schema_of(probes, ["grp", "pid"], rank="integer").add("nid", base.schema["pid"].dataType)
    for name in ("d", "y", "x", "side", "reach"):
        schema = schema.add(name, "double")
    at = ["grp", "side", "cy", "cx"]
    rim = F.when(F.col("side") < F.col("reach"), F.col("side") / 6).otherwise(F.col("side"))
    for round_ in range(max_rounds):
        todo = tmp.save(todo.withColumn("rim", rim).withColumn("cy", _cell("y", "side")).withColumn("cx", _cell("x", "side")))
        cells = tmp.save(todo.select(*at, "rim", "reach").distinct())
        b = base.join(cells.select("grp", "side", "rim").distinct(), "grp").withColumn("cy", _reach_of("y", F.col("side"), F.col("rim"))).withColumn("cx", _reach_of("x", F.col("side"), F.col("rim")))
        b = b.join(cells.select(*at, "reach"), at)
        columns = [*at, "rim", "reach", "y", "x"]
        both = todo.select(*columns, "pid", F.lit(None).cast(schema["nid"].dataType).alias("nid"), F.lit(False).alias("base"))
        both = both.unionByName(b.select(*columns, F.lit(None).cast(schema["pid"].dataType).alias("pid"), F.col("pid").alias("nid"), F.lit(True).alias("base")))
        out = tmp.save(TL.over_groups(both, at, _nearest_in_block(k, exclude_self), schema))
        part = out.where("nid is not null").select("grp", "pid", "rank", "nid", "d")
        done = part if done is None else done.unionByName(part)
        rest = out.where("nid is null")
        if rest.isEmpty():
            break
        todo = rest.select("grp", "pid", "y", "x", (F.col("side") * 2).alias("side"), "reach")
    return done


def knn(points: DataFrame, k: int) -> DataFrame:
    return nearest(points, points, k, exclude_self=True)


#: Sides of a radius join's blocks in radii at least, their points in the mean, pairs of places that a task compares in a block, and those it has in all its blocks in the mean.
JOIN_BLOCK, JOIN_POINTS, JOIN_WORK, JOIN_TASK = 4, 500, 1_000_000_000, 100_000_000


def _pairs_in_block(rows: pa.Table):
    """Pairs within the radius of a block's own points (``a``) and all its points (``b``), piece by piece; points are in the order of y, so a piece meets a strip."""
    is_own = np.asarray(rows.column("own")).astype(bool)
    own, every = rows.filter(pa.array(is_own)).sort_by("y"), rows.sort_by("y")
    radius = rows.column("radius")[0].as_py()
    (ay, ax), (by, bx) = ([t.column(c).to_numpy() for c in ("y", "x")] for t in (own, every))
    aid, bid = (np.asarray(t.column("pid")) for t in (own, every))
    grp = rows.column("grp").slice(0, 1).combine_chunks()
    i = 0
    while i < len(own):
        first, last = (int(np.searchsorted(by, ay[i] + m * radius * (1 + 1e-9), w)) for m, w in ((-1, "left"), (1, "right")))
        end = min(i + min(max(CHUNK // max(last - first, 1) // 4, 1), 64), len(own))
        last = int(np.searchsorted(by, ay[end - 1] + radius * (1 + 1e-9), "right"))
        dy, dx = ay[i:end, None] - by[first:last], ax[i:end, None] - bx[first:last]
        d = np.sqrt(dy * dy + dx * dx)
        r, c = np.nonzero((d <= radius) & (aid[i:end, None] < bid[first:last]))
        if len(r):
            yield pa.table({"grp": grp.take(pa.array(np.zeros(len(r), np.int64))), "a": own.column("pid").take(pa.array(r + i)), "b": every.column("pid").take(pa.array(c + first)), "d": pa.array(d[r, c])})
        i = end


def within(points: DataFrame, radius: DataFrame) -> DataFrame:
    """Pairs ``grp, a, b, d`` (a < b) no further apart than the group's ``radius`` (``grp, radius``).

    Blocks of at least JOIN_BLOCK radii have a rim of one radius, so points are exchanged about twice and pairs not at all. The points of a crowded block are dealt to several tasks.
    Tasks are as many as the pairs ask for: adaptive execution merges partitions by bytes, of which points have few, so that a task would give ever more pairs.
    """
    tmp = Scratch(points.sparkSession, "within")
    p = points.select("grp", "pid", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).where(PLACED)
    box = p.groupBy("grp").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("h"), (F.max("x") - F.min("x")).alias("w")).join(radius.where("radius > 0"), "grp")
    radius = F.col("radius").cast("double")
    box = tmp.save(box.select("grp", radius.alias("radius"), F.greatest(radius * JOIN_BLOCK, F.sqrt(F.col("h") * F.col("w") * JOIN_POINTS / F.col("n"))).alias("side")))
    p = p.join(box, "grp")
    n = p.groupBy("grp", _cell("y", "side").alias("cy"), _cell("x", "side").alias("cx")).agg(F.count("*").alias("n"))
    n = tmp.save(n.select("grp", "cy", "cx", (F.col("n") * F.col("n")).alias("work")))
    tasks = max(int((n.agg(F.sum(F.col("work").cast("double"))).first()[0] or 0) / JOIN_TASK) + 1, points.sparkSession.sparkContext.defaultParallelism)
    full = n.select("grp", "cy", "cx", F.ceil(F.col("work") / JOIN_WORK).alias("parts")).where("parts > 1")
    at = ["grp", "cy", "cx"]
    home = (F.col("cy") == _cell("y", "side")) & (F.col("cx") == _cell("x", "side"))
    d = p.withColumn("cy", _reach_of("y", F.col("side"), F.col("radius"))).withColumn("cx", _reach_of("x", F.col("side"), F.col("radius"))).withColumn("own", home)
    if full.isEmpty():
        d = d.withColumn("part", F.lit(0).cast("long"))
    else:
        d = d.join(full, at, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        d = d.withColumn("own", F.col("own") & (F.pmod(F.xxhash64("pid"), F.col("parts")) == F.col("part"))).drop("parts")
    schema = TL.schema_of(p, ["grp"]).add("a", p.schema["pid"].dataType).add("b", p.schema["pid"].dataType).add("d", "double")
    return TL.over_groups(d.drop("side"), [*at, "part"], _pairs_in_block, schema, tasks=tasks)


def nn_stats(points: DataFrame, nn: DataFrame, height: Size, width: float | None = None) -> DataFrame:
    """Density, mean and deviation of nearest distances, Clark-Evans R and z, per group; ``height`` may be a table ``grp, height, width``."""
    n = with_size(points.groupBy("grp").agg(F.count("*").cast("double").alias("n")), ["grp"], height, width).withColumn("area", F.col("_h").cast("double") * F.col("_w"))
    g = n.join(nn.where("rank = 1").groupBy("grp").agg(F.avg("d").alias("nn_mean_um"), S.sd("d").alias("nn_sd_um")), "grp", "left")
    lam = F.col("n") / F.col("area")
    expected = F.lit(0.5) / F.sqrt(lam)
    error = F.sqrt(F.lit((4 - math.pi) / (4 * math.pi)) / (lam * F.col("n")))
    return g.select("grp", (F.col("n") / (F.col("area") / 1e6)).alias("density_per_mm2"), "nn_mean_um", "nn_sd_um", (F.col("nn_mean_um") / expected).alias("clark_evans_R"), ((F.col("nn_mean_um") - expected) / error).alias("clark_evans_z"))


def knn_means(points: DataFrame, nn: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """Mean distance to the k-th neighbour; null where a group has no more than k points."""
    n = points.groupBy("grp").agg(F.count("*").alias("n"))
    g = nn.groupBy("grp").agg(*[F.avg(F.when(F.col("rank") == k, F.col("d"))).alias(f"m{k}") for k in ks])
    return n.join(g, "grp", "left").select("grp", *[F.when(F.col("n") > k, F.col(f"m{k}")).alias(f"knn_k{k}_mean_um") for k in ks])


def grid_dispersion(points: DataFrame, height: Size, width: float | None = None, k: int = 10) -> DataFrame:
    """Variance over mean and coefficient of variation of counts on a k x k grid, empty cells included."""
    at = lambda v, size: F.least(F.greatest(F.floor(F.col(v) * k / F.greatest(F.col(size).cast("double"), F.lit(1.0))), F.lit(0)), F.lit(k - 1))
    c = with_size(points, ["grp"], height, width).groupBy("grp", at("y", "_h").alias("r"), at("x", "_w").alias("c")).agg(F.count("*").cast("double").alias("n"))
    g = c.groupBy("grp").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    cells = float(k * k)
    mean = F.col("s") / cells
    var = (F.col("q") - F.col("s") * F.col("s") / cells) / (cells - 1)
    return g.select("grp", (var / mean).alias("grid_vmr"), (F.sqrt(var) / mean).alias("grid_cv"))


_GRAPH = {"graph_mean_degree": "double", "graph_sd_degree": "double", "graph_components": "double", "graph_largest_component_frac": "double", "graph_singleton_frac": "double"}


def _graph_small(rows: pa.Table, starts: np.ndarray):
    """The graphs of small groups (``y, x`` and their ``radius``)."""
    y, x, radius = (rows.column(c).cast(pa.float64()).to_numpy() for c in ("y", "x", "radius"))
    number = np.diff(np.append(starts, len(y)))
    for of in TL.alike(number):
        n = int(number[of[0]])
        step = max(CHUNK // (n * n), 1)
        for i in range(0, len(of), step):
            part = of[i : i + step]
            at, far = starts[part][:, None] + np.arange(n), radius[starts[part]][:, None, None]
            degree, edges, rows_ = np.zeros(len(part) * n, np.int64), [], max(CHUNK // n, 1)
            for j in range(0, n, rows_):
                dy, dx = (v[at][:, j : j + rows_, None] - v[at][:, None, :] for v in (y, x))
                g, a, b = np.nonzero(np.sqrt(dy * dy + dx * dx) <= far)
                a, b = g * n + a + j, g * n + b
                degree += np.bincount(a[a != b], minlength=len(degree))
                edges.append(np.stack([a, b])[:, a < b])
            size = np.bincount(TL.unite(*np.concatenate(edges, 1), len(degree)), minlength=len(degree)).reshape(-1, n)
            degree = degree.reshape(-1, n)
            values = [degree.mean(1), degree.std(1, ddof=1) if n > 1 else np.zeros(len(part)), (size > 0).sum(1).astype(float), size.max(1) / n, (size == 1).sum(1) / n]
            yield part, dict(zip(("radius", *_GRAPH), map(pa.array, [radius[starts[part]], *values])))


#: Side of a graph's blocks in radii, and points that a block may hold: groups with fuller ones are crowds.
GRAPH_BLOCK, GRAPH_FULL = 24, 8_192


def _graph_in_block(rows: pa.Table) -> pa.Table | None:
    """Degree of a block's own points and the first point of the part of the graph that each is in; without degree: points of the rim that such a part meets."""
    is_own = np.asarray(rows.column("own")).astype(bool)
    own = rows.filter(pa.array(is_own)).sort_by("pid")
    n = len(own)
    if not n:
        return None
    every = pa.concat_tables([own, rows.filter(pa.array(~is_own))])
    y, x = (every.column(c).to_numpy() for c in ("y", "x"))
    radius, degree, edges, step = rows.column("radius")[0].as_py(), np.zeros(n, np.int64), [], max(CHUNK // len(y), 1)
    for i in range(0, n, step):
        end = min(i + step, n)
        dy, dx = y[i:end, None] - y, x[i:end, None] - x
        a, b = np.nonzero(np.sqrt(dy * dy + dx * dx) <= radius)
        a = a + i
        degree += np.bincount(a[a != b], minlength=n)
        edges.append(np.stack([a, b])[:, a < b])
    root = TL.unite(*np.concatenate(edges, 1), len(y))
    met = n + np.flatnonzero(root[n:] < n)
    at = np.concatenate([np.arange(n), met])
    take = lambda name, i: every.column(name).take(pa.array(i))
    return pa.table({"grp": take("grp", at), "pid": take("pid", at), "root": take("pid", root[at]), "deg": pa.array(np.append(degree, np.zeros(len(met), np.int64)), mask=at >= n)})


def _graph_blocks(p: DataFrame, tmp: Scratch) -> DataFrame:
    """Graphs of large groups without crowds: degrees and parts inside blocks with a rim of the radius, then components of the parts that meet over rims. Points without a place are alone."""
    p = p.select("grp", "radius", "pid", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).withColumn("side", F.col("radius") * GRAPH_BLOCK)
    d = p.where(PLACED).withColumn("cy", _reach_of("y", F.col("side"), F.col("radius"))).withColumn("cx", _reach_of("x", F.col("side"), F.col("radius")))
    d = d.withColumn("own", (F.col("cy") == _cell("y", "side")) & (F.col("cx") == _cell("x", "side")))
    schema = TL.schema_of(p, ["grp", "pid"]).add("root", p.schema["pid"].dataType).add("deg", "long")
    found = tmp.save(TL.over_groups(d, ["grp", "cy", "cx"], _graph_in_block, schema))
    own = found.where("deg is not null").unionByName(p.where(f"NOT ({PLACED})").select("grp", "pid", F.col("pid").alias("root"), F.lit(0).cast("long").alias("deg")))
    over = found.where("deg is null").select("grp", "pid", F.col("root").alias("from")).join(own.select("grp", "pid", F.col("root").alias("to")), ["grp", "pid"]).where("from <> to")
    comp = connected_components(over.select(F.struct("grp", F.col("from").alias("pid")).alias("src"), F.struct("grp", F.col("to").alias("pid")).alias("dst")))
    comp = comp.select("node.grp", F.col("node.pid").alias("root"), F.col("component.pid").alias("comp"))
    g = own.groupBy("grp").agg(F.avg(F.col("deg").cast("double")).alias("graph_mean_degree"), S.sd("deg").alias("graph_sd_degree"), F.count("*").cast("double").alias("n"))
    c = own.groupBy("grp", "root").agg(F.count("*").alias("s")).join(comp, ["grp", "root"], "left").groupBy("grp", F.coalesce("comp", "root").alias("comp")).agg(F.sum("s").alias("s"))
    c = c.groupBy("grp").agg(F.count("*").cast("double").alias("graph_components"), F.max("s").alias("most"), F.sum((F.col("s") == 1).cast("double")).alias("single"))
    j = p.select("grp", "radius").distinct().join(g, "grp").join(c, "grp")
    return j.select("grp", "radius", "graph_mean_degree", "graph_sd_degree", "graph_components", (F.col("most") / F.col("n")).alias("graph_largest_component_frac"), (F.col("single") / F.col("n")).alias("graph_singleton_frac"))


def proximity_graph(points: DataFrame, nn: DataFrame) -> DataFrame:
    """Graph of points within 1.5 mean nearest distances (at least 1): degrees, components, largest share, singles.

    A group of at most SMALL points is done at once on arrays; larger ones in blocks with a rim, or, where points crowd, by pairs of cells and components of their edges.
    """
    tmp = Scratch(points.sparkSession, "proximity")
    radius = tmp.save(nn.where("rank = 1").groupBy("grp").agg(F.greatest(F.avg("d") * 1.5, F.lit(1.0)).alias("radius")))
    large, some = _sizes(tmp, points)
    p = points.select("grp", "pid", "y", "x").join(radius, "grp")
    schema = TL.schema_of(p, ["grp", "radius"], **_GRAPH)
    out = TL.over_alike(p.join(large, "grp", "left_anti") if some else p, ["grp"], _graph_small, schema)
    if some:
        big = p.join(large, "grp", "left_semi")
        cell = lambda v: F.floor(F.col(v) / (F.col("radius") * GRAPH_BLOCK))
        crowds = tmp.save(big.where(PLACED).groupBy("grp", cell("y").alias("cy"), cell("x").alias("cx")).agg(F.count("*").alias("n")).where(F.col("n") > GRAPH_FULL).select("grp").distinct())
        if crowds.isEmpty():
            out = out.unionByName(_graph_blocks(big, tmp))
        else:
            out = out.unionByName(_graph_blocks(big.join(crowds, "grp", "left_anti"), tmp)).unionByName(_graph_large(big.join(crowds, "grp", "left_semi"), tmp))
    return points.select("grp").distinct().join(out.withColumnRenamed("radius", "graph_radius_um"), "grp", "left")


#: Pairs of points that a pair of cells may hold before both are halved, and how often cells are.
PAIRS, HALVINGS = 1_000_000, 24


def _graph_large(p: DataFrame, tmp: Scratch) -> DataFrame:
    """Degrees and components of groups of any size and crowding, without the pairs of a crowd.

    Cells have half the radius as side, so all points of a cell are neighbours: cells, not points, are the nodes of the components. Pairs of cells that lie wholly within the radius count
    as products, those beyond it not at all; of the others, the points are compared, after both cells were halved as long as they hold over PAIRS pairs.
    """
    radius = tmp.save(p.select("grp", "radius").distinct())
    p = tmp.save(p.withColumn("side", F.col("radius") / 2).withColumn("cy", _cell("y", "side")).withColumn("cx", _cell("x", "side")))
    n = tmp.save(p.groupBy("grp", "radius", "side", "cy", "cx").agg(F.count("*").alias("n")))
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-3, 4) for b in range(-3, 4)])
    probe = n.withColumn("m", F.explode(near)).select("grp", "radius", "side", "cy", "cx", "n", (F.col("cy") + F.col("m.a")).alias("oy"), (F.col("cx") + F.col("m.b")).alias("ox"))
    # pairs of cells at a level: (ay, ax) and (by, bx) in cells of side / 2^level; both orders, and a cell with itself
    pairs = probe.join(n.select("grp", F.col("cy").alias("oy"), F.col("cx").alias("ox"), F.col("n").alias("m")), ["grp", "oy", "ox"])
    pairs = pairs.select("grp", "radius", "side", F.col("cy").alias("ay"), F.col("cx").alias("ax"), F.col("oy").alias("by"), F.col("ox").alias("bx"), "n", "m")
    full, close = [], []
    for level in range(HALVINGS):
        dy, dx = F.abs(F.col("ay") - F.col("by")), F.abs(F.col("ax") - F.col("bx"))
        least = F.sqrt(F.pow(F.greatest(dy - 1, F.lit(0)), F.lit(2.0)) + F.pow(F.greatest(dx - 1, F.lit(0)), F.lit(2.0))) * F.col("side")
        most = F.sqrt(F.pow(dy + 1.0, F.lit(2.0)) + F.pow(dx + 1.0, F.lit(2.0))) * F.col("side")
        slack = 1 + 1e-9  # cells that touch the radius are compared by their points
        state = F.when(most * slack <= F.col("radius"), "full").when(least > F.col("radius") * slack, "far").when(F.col("n") * F.col("m") <= PAIRS, "check").otherwise("split")
        pairs = tmp.save(pairs.withColumn("level", F.lit(level)).withColumn("state", state).where("state <> 'far'"))
        full.append(pairs.where("state = 'full'"))
        close.append(pairs.where("state = 'check'" if level < HALVINGS - 1 else "state <> 'full'"))
        split = pairs.where("state = 'split'")
        if level == HALVINGS - 1 or split.isEmpty():
            break
        half = p.select("grp", (F.col("side") / 2 ** (level + 1)).alias("side"), "y", "x")
        child = tmp.save(half.withColumn("cy", _cell("y", "side")).withColumn("cx", _cell("x", "side")).groupBy("grp", F.floor(F.col("cy") / 2).alias("py"), F.floor(F.col("cx") / 2).alias("px"), "cy", "cx").agg(F.count("*").alias("c")))
        one = child.select("grp", F.col("py").alias("ay"), F.col("px").alias("ax"), F.col("cy").alias("ay2"), F.col("cx").alias("ax2"), F.col("c").alias("n2"))
        two = child.select("grp", F.col("py").alias("by"), F.col("px").alias("bx"), F.col("cy").alias("by2"), F.col("cx").alias("bx2"), F.col("c").alias("m2"))
        pairs = split.join(one, ["grp", "ay", "ax"]).join(two, ["grp", "by", "bx"]).select("grp", "radius", (F.col("side") / 2).alias("side"), F.col("ay2").alias("ay"), F.col("ax2").alias("ax"), F.col("by2").alias("by"), F.col("bx2").alias("bx"), F.col("n2").alias("n"), F.col("m2").alias("m"))
    full, close = (reduce(DataFrame.unionByName, x) for x in (full, close))
    levels = F.explode(F.sequence(F.lit(0), F.lit(level))).alias("level")
    at = p.select("grp", "pid", "y", "x", "side", levels).withColumn("side", F.col("side") / F.pow(F.lit(2.0), F.col("level"))).select("grp", "pid", "y", "x", "level", _cell("y", "side").alias("ay"), _cell("x", "side").alias("ax"))
    counted = full.groupBy("grp", "level", "ay", "ax").agg(F.sum("m").alias("deg"))
    by_cells = at.join(counted, ["grp", "level", "ay", "ax"]).select("grp", "pid", "deg")
    other = at.select("grp", "level", F.col("ay").alias("by"), F.col("ax").alias("bx"), F.col("pid").alias("q"), F.col("y").alias("qy"), F.col("x").alias("qx"))
    c = at.join(close.select("grp", "radius", "level", "ay", "ax", "by", "bx"), ["grp", "level", "ay", "ax"]).join(other, ["grp", "level", "by", "bx"])
    dy, dx = F.col("y") - F.col("qy"), F.col("x") - F.col("qx")
    met = c.where(F.sqrt(dy * dy + dx * dx) <= F.col("radius"))
    found = tmp.save(met.groupBy("grp", "pid", "level", "ay", "ax", "by", "bx").agg(F.count("*").alias("deg")))
    deg = by_cells.unionByName(found.select("grp", "pid", "deg")).groupBy("grp", "pid").agg((F.sum("deg") - 1).alias("deg"))  # itself is met once
    up = lambda y, x: F.struct("grp", F.floor(F.col(y) / F.pow(F.lit(2.0), F.col("level"))).alias("y"), F.floor(F.col(x) / F.pow(F.lit(2.0), F.col("level"))).alias("x"))
    edges = full.unionByName(found, allowMissingColumns=True).select(up("ay", "ax").alias("src"), up("by", "bx").alias("dst")).distinct()
    comp = connected_components(edges).select("node.grp", F.col("node.y").alias("cy"), F.col("node.x").alias("cx"), "component")
    d = p.join(deg, ["grp", "pid"], "left").groupBy("grp").agg(F.avg(F.coalesce("deg", F.lit(0)).cast("double")).alias("graph_mean_degree"), S.sd(F.coalesce("deg", F.lit(0))).alias("graph_sd_degree"), F.count("*").cast("double").alias("n"))
    c = n.join(comp, ["grp", "cy", "cx"], "left").groupBy("grp", F.coalesce("component", F.struct("grp", F.col("cy").alias("y"), F.col("cx").alias("x"))).alias("comp")).agg(F.sum("n").alias("s"))
    c = c.groupBy("grp").agg(F.count("*").cast("double").alias("graph_components"), F.max("s").alias("most"), F.sum((F.col("s") == 1).cast("double")).alias("single"))
    j = radius.join(d, "grp").join(c, "grp")
    return j.select("grp", "radius", "graph_mean_degree", "graph_sd_degree", "graph_components", (F.col("most") / F.col("n")).alias("graph_largest_component_frac"), (F.col("single") / F.col("n")).alias("graph_singleton_frac"))


def _tree_small(rows: pa.Table, starts: np.ndarray):
    """The trees of small groups, point by point from the one with the smallest id (Prim); rows are in the order of ids."""
    every = [rows.column(c).cast(pa.float64()).to_numpy() for c in ("y", "x")]
    ids, number = rows.column("pid"), np.diff(np.append(starts, len(rows)))
    for of in TL.alike(number):
        n, g = int(number[of[0]]), np.arange(len(of))
        if n < 2:
            continue
        at = starts[of][:, None] + np.arange(n)
        y, x = (v[at] for v in every)
        best, source, left = np.full(at.shape, np.inf), np.zeros(at.shape, np.int64), np.ones(at.shape, bool)
        now, a, b, d = np.zeros(len(of), np.int64), [], [], []
        for _ in range(n - 1):
            left[g, now] = False
            dist = np.sqrt((y - y[g, now][:, None]) ** 2 + (x - x[g, now][:, None]) ** 2)
            nearer = left & (dist < best)
            best, source = np.where(nearer, dist, best), np.where(nearer, now[:, None], source)
            now = np.argmin(np.where(left, best, np.inf), 1)
            a.append(at[g, np.minimum(source[g, now], now)]), b.append(at[g, np.maximum(source[g, now], now)]), d.append(best[g, now])
        yield np.tile(of, n - 1), {"a": ids.take(pa.array(np.concatenate(a))), "b": ids.take(pa.array(np.concatenate(b))), "d": pa.array(np.concatenate(d))}


def spanning_tree(points: DataFrame, k: int = 6, max_rounds: int = 60) -> DataFrame:
    """Edges ``grp, a, b, d`` of the Euclidean minimum spanning tree of each group. Coincident points are taken once (the smallest id).

    A group of at most SMALL points is done at once on arrays; larger ones in Boruvka rounds.
    """
    tmp = Scratch(points.sparkSession, "tree")
    pts = tmp.save(points.where("y is not null and x is not null").groupBy("grp", "y", "x").agg(F.min("pid").alias("pid")))
    large, some = _sizes(tmp, pts)
    kind = pts.schema["pid"].dataType
    schema = TL.schema_of(pts, ["grp"]).add("a", kind).add("b", kind).add("d", "double")
    out = TL.over_alike(pts.join(large, "grp", "left_anti") if some else pts, ["grp"], _tree_small, schema, ("pid",))
    return out.unionByName(_boruvka(pts.join(large, "grp", "left_semi"), k, max_rounds)) if some else out


def _boruvka(pts: DataFrame, k: int, max_rounds: int) -> DataFrame:
    """Edges of the trees of ``pts`` (``grp, pid, y, x``; no two at one place), round by round.

    Each component takes its shortest edge out of the neighbour lists. The edge is sure if no point whose list lies wholly
    inside the component could have a shorter one (its k-th distance bounds it). If few are sure, the lists of such points are doubled, except in a group's largest component: what
    leads out of it leads into another one. What is read again in a round are the edges that still lead out. Tables with a row a point are joined by merging: a broadcast goes through the driver.
    """
    tmp = Scratch(pts.sparkSession, "boruvka")
    pts = tmp.save(pts)
    size = tmp.save(pts.groupBy("grp").agg(F.count("*").alias("all")))
    most = size.agg(F.max("all")).first()[0] or 0
    comp = tmp.save(pts.select("grp", "pid", F.col("pid").alias("comp")))
    of = lambda lists: lists.groupBy("grp", "pid").agg(F.max("d").alias("reach"), F.count("*").alias("n"))
    lists = tmp.save(knn(pts, min(k, max(most - 1, 1))))
    seen, tree = tmp.save(of(lists)), None
    out = tmp.save(lists.select("grp", "pid", "nid", "d"))
    for _ in range(max_rounds):
        to = comp.select("grp", F.col("pid").alias("nid"), F.col("comp").alias("to")).hint("merge")
        e = tmp.save(out.select("grp", "pid", "nid", "d").join(comp.hint("merge"), ["grp", "pid"]).join(to, ["grp", "nid"]).where("comp <> to"))
        tmp.drop(out)
        out = e
        inside = seen.join(e.select("grp", "pid").distinct().hint("merge"), ["grp", "pid"], "left_anti").join(size, "grp").where(F.col("n") < F.col("all") - 1)
        inside = tmp.save(inside.join(comp.hint("merge"), ["grp", "pid"]).select("grp", "pid", "comp", "reach", "n"))
        edge = e.select("grp", "comp", F.struct("d", F.least("pid", "nid").alias("a"), F.greatest("pid", "nid").alias("b")).alias("out"), F.lit(None).cast("double").alias("bound"), F.lit(0).cast("long").alias("one"))
        more = inside.select("grp", "comp", F.lit(None).cast(edge.schema["out"].dataType).alias("out"), F.col("reach").alias("bound"), F.lit(0).cast("long").alias("one"))
        every = comp.select("grp", "comp", F.lit(None).cast(edge.schema["out"].dataType).alias("out"), F.lit(None).cast("double").alias("bound"), F.lit(1).cast("long").alias("one"))
        best = tmp.save(edge.unionByName(more).unionByName(every).groupBy("grp", "comp").agg(F.min("out").alias("out"), F.min("bound").alias("bound"), F.sum("one").alias("points")))
        pieces = best.groupBy("grp").agg(F.count("*").alias("c"), F.max(F.struct("points", "comp")).alias("main")).where("c > 1")
        best = tmp.save(best.join(pieces, "grp"))
        if best.isEmpty():
            break
        good = F.col("out").isNotNull() & (F.col("bound").isNull() | (F.col("out.d") < F.col("bound")))
        sure = tmp.save(best.where(good).select("grp", "comp", "out.d", "out.a", "out.b"))
        n = sure.count()
        if n * 4 < best.count():
            short = best.where(~good & (F.col("comp") != F.col("main.comp"))).select("grp", "comp", F.col("out.d").alias("limit"))
            asked = tmp.save(inside.join(short.hint("merge"), ["grp", "comp"]).where("limit IS NULL OR reach <= limit").select("grp", "pid"))
            k = min(k * 2, most - 1)
            lists = tmp.save(nearest(pts.join(asked.hint("merge"), ["grp", "pid"], "left_semi"), pts, k, exclude_self=True))
            seen = tmp.save(seen.join(asked.hint("merge"), ["grp", "pid"], "left_anti").unionByName(of(lists)))
            out = tmp.save(out.select("grp", "pid", "nid", "d").unionByName(lists.select("grp", "pid", "nid", "d")))
        if not n:
            continue
        new = tmp.save(sure.select("grp", "a", "b", "d").distinct())
        tree = new if tree is None else tree.union(new)
        at = comp.select("grp", F.col("pid").alias("a"), F.col("comp").alias("ca")).hint("merge"), comp.select("grp", F.col("pid").alias("b"), F.col("comp").alias("cb")).hint("merge")
        joined = new.join(at[0], ["grp", "a"]).join(at[1], ["grp", "b"]).select(F.struct("grp", F.col("ca").alias("c")).alias("src"), F.struct("grp", F.col("cb").alias("c")).alias("dst"))
        merged = connected_components(joined, merge=True).select("node.grp", F.col("node.c").alias("comp"), F.col("component.c").alias("new"))
        comp = tmp.save(comp.join(merged.hint("merge"), ["grp", "comp"], "left").select("grp", "pid", F.coalesce("new", "comp").alias("comp")))
    else:
        raise RuntimeError("spanning tree did not settle")
    return tree if tree is not None else pts.select("grp", F.col("pid").alias("a"), F.col("pid").alias("b"), F.col("y").alias("d")).where("false")


def tree_stats(tree: DataFrame) -> DataFrame:
    return tree.groupBy("grp").agg(F.avg("d").alias("mst_edge_mean_um"), S.sd("d").alias("mst_edge_sd_um"), S.iqr("d").alias("mst_edge_iqr_um"))


def distance_array(mask: np.ndarray, reach: float, pixel_height: float, pixel_width: float) -> np.ndarray:
    """Distance of each place to the nearest mask place of its array (one, or a stack), exact up to ``reach`` and infinite beyond.

    Separable: first the nearest mask row of each column, by running extremes down and up; then the least sum of squares along each row, within the reach.
    """
    h = mask.shape[-2]
    at = np.arange(h)[:, None]
    above = np.maximum.accumulate(np.where(mask, at, -h - 1), -2)
    below = np.minimum.accumulate(np.where(mask, at, 2 * h + 1)[..., ::-1, :], -2)[..., ::-1, :]
    far = np.minimum(at - above, below - at)
    square = np.where(far <= h, (far * pixel_height) ** 2, np.inf)
    square[square > reach * reach] = np.inf
    best = square.copy()
    dx = 1
    while dx < mask.shape[-1] and dx * pixel_width <= reach:
        step = (dx * pixel_width) ** 2
        np.minimum(best[..., dx:], square[..., :-dx] + step, out=best[..., dx:])
        np.minimum(best[..., :-dx], square[..., dx:] + step, out=best[..., :-dx])
        dx += 1
    dist = np.sqrt(best)
    return np.where(dist <= reach, dist, np.inf)


def mask_distance(pixels: DataFrame, keys: list[str], mask: str, reach: float, pixel_height: float = 1.0, pixel_width: float = 1.0) -> DataFrame:
    """Rows of ``pixels`` with ``dist`` to the nearest mask pixel, null beyond ``reach``; 0 inside.

    A distance transform of tiles whose rim is the reach: one exchange, and work in proportion to the pixels.
    """
    columns = pixels.columns

    def work(t: TL.Tiles) -> pa.Table:
        d = distance_array(t.dense(mask, 0, np.uint8).astype(bool), reach, pixel_height, pixel_width)
        return t.pixels(columns, dist=np.where(np.isinf(d), np.nan, d))

    return TL.over_tiles(pixels, keys, (math.ceil(reach / pixel_height), math.ceil(reach / pixel_width)), work, TL.schema_of(pixels, columns, dist="double"))


def radial(distances: DataFrame, keys: list[str], value: str, valid: str, prefix: str, bands=((0, 5), (5, 15), (15, 30))) -> DataFrame:
    """Mean value on tissue in each distance band [a, b), and near over far (null if far is almost 0)."""
    name = lambda a, b: f"{prefix}_annulus_{a:g}_{b:g}um_norm_mean".replace(".", "p")
    g = distances.groupBy(*keys).agg(*[F.avg(F.when(F.col(valid) & (F.col("dist") >= a) & (F.col("dist") < b), F.col(value))).alias(name(a, b)) for a, b in bands])
    near, far = F.col(name(*bands[0])), F.col(name(*bands[-1]))
    return g.withColumn(f"{prefix}_annulus_near_far_ratio", F.when(F.abs(far) > S.TINY, F.try_divide(near, far)))


ship(__name__)
