"""Connected components of an edge table (large-star / small-star; Kiveris et al. 2014)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch, ship
from tessera.operators.tiles import unite

#: Distinct edges that one task may finish; counted before.
FINISH = 10_000
#: Edges that a task ties to stars at once.
PIECE = 1 << 20


def _order(node):
    """Spark's order of a node: fields one by one, null first."""
    return tuple(_order(x) for x in node.values()) if isinstance(node, dict) else (node is not None, node)


def _finish(batches):
    """Components of a few edges by union-find, each node with the smallest of its component."""
    edges, kind = [], None
    for b in batches:
        edges += zip(b.column(0).to_pylist(), b.column(1).to_pylist())
        kind = b.schema.field(0).type
    if not edges:
        return
    name = {}
    for x in (x for e in edges for x in e):
        name.setdefault(_order(x), x)
    root = {k: k for k in name}

    def find(k):
        while root[k] != k:
            root[k] = k = root[root[k]]
        return k

    for u, v in edges:
        a, b = sorted((find(_order(u)), find(_order(v))))
        root[b] = a
    yield pa.RecordBatch.from_arrays([pa.array(list(name.values()), kind), pa.array([name[find(k)] for k in name], kind)], ["node", "component"])


def _stars(batches):
    """Edges of integers in pieces of a bounded size, as stars: each node of a piece once, with the smallest that it reaches there. Stars of few nodes are taken on to the next piece."""
    held, n, kind = [], 0, None

    def star():
        u, v = (np.concatenate(x) for x in zip(*held))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        return ids, ids[unite(at[: len(u)], at[len(u) :], len(ids))]

    def out(ids, root):
        for i in range(0, len(ids), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000], kind) for x in (ids, root)], ["node", "root"])

    for b in batches:
        kind = b.schema.field(0).type
        held.append(tuple(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))
        n += b.num_rows
        if n >= PIECE:
            ids, root = star()
            few = len(ids) <= PIECE // 2
            if not few:
                yield from out(ids, root)
            held, n = ([(ids, root)], len(ids)) if few else ([], 0)
    if n:
        yield from out(*star())


def _by_stars(e0: DataFrame, tmp: Scratch, max_rounds: int, finish: int | None, merge: bool) -> DataFrame:
    """Components of ``u, v``: tasks tie their edges to stars, the rounds run on roots that share a node, and a node takes the component of its least root.

    A node comes from each piece once, so neither edges nor a hub's neighbours are exchanged: each node is, about once for each task that meets it.
    """
    kind = e0.schema["u"].dataType.simpleString()
    w = W.partitionBy("node").orderBy("root")
    stars = e0.mapInArrow(_stars, f"node {kind}, root {kind}").select("node", "root", F.first("root").over(w).alias("least"), F.row_number().over(w).alias("_n"))
    stars = tmp.save(stars.where("_n = 1 or root <> least").drop("_n"))
    comp = connected_components(stars.where("root <> least"), "root", "least", max_rounds, finish, merge).select(F.col("node").alias("least"), "component")
    return stars.where("root = least").join(comp.hint("merge") if merge else comp, "least", "left").select("node", F.coalesce("component", "least").alias("component"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, finish: int | None = None, merge: bool = False, stars: bool = False) -> DataFrame:
    """``node, component`` for every node that has an edge; component is the smallest reachable node.

    Once at most ``finish`` distinct edges are left (FINISH; 0 for DataFrame functions only), one task ends the work.

    Rows with a null end are ignored; self loops yield a component of their own node. Each half round
    is one min-aggregate (combined map-side, so a hub does not land in one task) and one join against
    the written result, which adaptive execution may split; with ``merge`` it is a merge join, as broadcasts pass through the driver. The driver reads two numbers per round.
    ``stars``, for edges of integers read from files (a repeated task has to meet them in the same order): tasks first tie their own edges together, so that the rounds see few of them.
    """
    spark = edges.sparkSession
    tmp = Scratch(spark, "components")
    e0 = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    if stars:
        return _by_stars(e0, tmp, max_rounds, finish, merge)
    nodes_of_loops = e0.where("u = v").select("u").distinct()
    cur = tmp.save(e0.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = tmp.save(nodes_of_loops)

    def mark(df: DataFrame):
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    few = FINISH if finish is None else finish
    by = lambda t: t.hint("merge") if merge else t
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("component"))
    seen = mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        if seen[0] <= few:
            kind = cur.schema["u"].dataType.simpleString()
            ended = cur.coalesce(1).mapInArrow(_finish, f"node {kind}, component {kind}")
            return ended.union(alone).groupBy("node").agg(F.min("component").alias("component"))
        # large star: every neighbour above u is tied to the smallest of u's neighbourhood
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tmp.save(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        big = tmp.save(both.where("v > u").join(by(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # small star: u and its lower neighbours are tied to the smallest of them
        low2 = tmp.save(big.groupBy("u").agg(F.min("v").alias("m")))
        nxt = tmp.save(big.join(by(low2), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low2.select("u", F.col("m").alias("v"))).distinct())
        tmp.drop(cur, low, big, low2)
        cur, was, seen = nxt, seen, mark(nxt)
        if seen == was:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    low = cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return low.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))


ship(__name__)
