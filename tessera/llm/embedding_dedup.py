"""Embedding near-dedup by NN-descent.

Equal vectors of one label become one node. Each node starts with its nearest nodes in random-hyperplane buckets;
then, round by round, every node's list meets the lists of its neighbours (and of those that
list it), and the K most similar stay. Lists hold only neighbours within twice the threshold angle: two nodes that link with a common
third are no farther apart. Pairs that met before do not meet again. A round ships each vector once to each block of pivots that needs
it, in half precision (it only ranks; links are checked in doubles).

A list that is full of links is saturated: there may be more links than it holds, also to nodes of other components. Saturated
lists are enlarged exactly. Saturated nodes lie in cells of like hyperplane code; a cell has a centre and a radius, and by
the triangle inequality two cells hold no link, or nothing but links, or must be compared node by node. Cells of two components are compared until they
are one or have no link; then cells of one component that hold a saturated node are compared with the other cells of it, so that degrees are
exact there. In components without a saturated node the lists are complete as far as found. What can be missed is a link of two nodes that
neither list holds, one of them not saturated: ``audit`` measures that against brute force.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with
a null label, link with nothing; vectors of different length never link; repeated rows link with each other; rows with a null vec_id
are nodes whose component is the smallest non-null id, or null; ties in a list go by node number; very long vectors are vectors like others; other columns are not read; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.llm import by_value
from tessera.operators.graph import connected_components

COSINE, NEIGHBOURS, TABLES, ROUNDS = 0.93, 10, 12, 8
#: Nodes that a bucket has about and at most (full ones are split at random: the rounds join the parts again), and that a cell has at most.
IN_BUCKET, BUCKET, CELL = 24, 512, 512
#: Error of a cosine in half precision; slack of an angle.
HALF, SLACK = 4e-3, 1e-6


def half(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float16) for x in column]).astype(np.float32)


def full(column) -> np.ndarray:
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def angle(cosine):
    return np.arccos(np.clip(cosine, -1, 1))


def _codes(tables: int, seed: int):
    def run(batches):
        planes: dict = {}
        for b in batches:
            n, dim, bits = len(b), b.column(2).to_numpy(), b.column(3).to_numpy()
            vec = b.column(1)
            out = np.zeros((n, tables), np.int64)
            for d in np.unique(dim):
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, int(d)]).standard_normal((int(d), tables * 24)).astype(np.float32)
                at = np.flatnonzero(dim == d)
                sign = ((half(vec.take(pa.array(at))) @ planes[d]) > 0).reshape(len(at), tables, 24)
                code = (sign * (1 << np.arange(24))).sum(axis=2)
                out[at] = code & ((1 << bits[at]) - 1)[:, None]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(out), pa.list_(pa.int64()))], ["node", "codes"])

    return run


def pairs_over(v: np.ndarray, least):
    """Pairs of rows (both orders) over ``least``, and their cosines: a pair has the same one in every task, so that it is one entry of a list."""
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    i, j = np.nonzero(sim > least)
    return i, j, (v[i] * v[j]).sum(axis=1).astype(np.float64)


def most_similar(src, dst, sim, k: int):
    """The k most similar of each ``src``, each once."""
    order = np.lexsort((dst, -sim, src))
    src, dst, sim = src[order], dst[order], sim[order]
    keep = np.ones(len(src), bool)
    keep[1:] = (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])
    src, dst, sim = src[keep], dst[keep], sim[keep]
    new = np.ones(len(src), bool)
    new[1:] = src[1:] != src[:-1]
    place = np.arange(len(src)) - np.maximum.accumulate(np.where(new, np.arange(len(src)), 0))
    return src[place < k], dst[place < k], sim[place < k]


EDGES = "src long, dst long, sim double"


def _edges(src, dst, sim):
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "sim": pa.array(sim, pa.float64())})


def _bucket(k: int, near: float):
    """Lists of the nodes of many buckets (column ``bucket``)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("bucket", "ascending"), ("node", "ascending")])
        node, bucket, v = table.column("node").to_numpy(), table.column("bucket").to_numpy(), half(table.column("vec"))
        cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(node)]])
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a, b in zip(cut[:-1], cut[1:]):
            i, j, sim = pairs_over(v[a:b], near)
            if len(i):
                parts.append(most_similar(node[a + i], node[a + j], sim, k))
        return _edges(*(np.concatenate(x) for x in zip(*parts)))

    return run


def _local_join(k: int):
    """Pairs among each pivot's members that would enter one of the two lists; pairs of two members that met before are left out."""

    def run(need: pa.Table, pivots: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(need):
            node = need.column("node").to_numpy()
            order = np.argsort(node)
            node, floor, v = node[order], need.column("floor").to_numpy()[order], half(need.column("vec").take(pa.array(order)))
            for ids, fresh in zip(pivots.column("ids"), pivots.column("fresh")):
                at = np.searchsorted(node, ids.values.to_numpy())
                new = fresh.values.to_numpy(zero_copy_only=False)
                i, j, sim = pairs_over(v[at], floor[at][:, None])
                some = new[i] | new[j]
                if some.any():
                    parts.append((node[at[i[some]]], node[at[j[some]]], sim[some]))
        return _edges(*most_similar(*(np.concatenate(x) for x in zip(*parts)), k))

    return run


def _cells(table: pa.Table) -> pa.Table:
    """Centre and radius of one cell."""
    v = full(table.column("vec"))
    centre = v.sum(axis=0)
    size = np.sqrt(centre @ centre)
    centre = centre / size if size > 1e-9 else v[0]
    many, hard = table.column("copies").to_numpy(), table.column("saturated").to_numpy(zero_copy_only=False)
    return pa.table({**{c: table.column(c).slice(0, 1) for c in ("part", "component", "cell")}, "centre": pa.array([centre.tobytes()], pa.binary()), "radius": [float(angle(v @ centre).max())], "many": [int(many.sum())], "saturated": [bool(hard.any())]})


def _meet(cosine: float, across: bool):
    """Of pairs of cells those that may hold a link, and whether they hold nothing else: of two components (across), or of one with a saturated cell."""

    def run(table: pa.Table) -> pa.Table:
        most = float(np.arccos(cosine))
        comp, cell, block, reach = (table.column(c).to_numpy() for c in ("component", "cell", "block", "radius"))
        hard, v = table.column("saturated").to_numpy(zero_copy_only=False), full(table.column("centre"))
        bi, bj = (table.column(c)[0].as_py() for c in ("bi", "bj"))
        x, y = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        apart, around = angle(v[x] @ v[y].T), reach[x][:, None] + reach[y][None, :]
        ok = apart - around <= most + SLACK
        if bi == bj:
            np.fill_diagonal(apart, 0)
            ok = np.triu(ok | np.eye(len(x), dtype=bool))
        ok &= comp[x][:, None] != comp[y][None, :] if across else hard[x][:, None] | hard[y][None, :]
        i, j = np.nonzero(ok)
        sure = apart[i, j] + around[i, j] < most - SLACK
        return pa.table({"ca": comp[x[i]], "cb": comp[y[j]], "ka": cell[x[i]], "kb": cell[y[j]], "sure": sure})

    return run


def _cell_pairs(cells: DataFrame, by: str, cosine: float, tmp: Scratch) -> DataFrame:
    """Pairs of cells of one part, or of one component, that may hold a link; in blocks of about CELL cells."""
    blocks = cells.groupBy(by).agg(F.ceil(F.count("*") / CELL).alias("blocks"))
    dealt = tmp.save(cells.join(blocks, by).withColumn("block", F.pmod(F.xxhash64("component", "cell"), F.col("blocks"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")})
    dealt = dealt.select(F.col(by).alias("by"), "bi", "bj", "block", "component", "cell", "centre", "radius", "saturated")
    return tmp.save(dealt.groupBy("by", "bi", "bj").applyInArrow(_meet(cosine, by == "part"), "ca long, cb long, ka long, kb long, sure boolean"))


def _touch(cosine: float):
    """A link between two cells, if there is one (of one component each)."""

    def run(table: pa.Table) -> pa.Table:
        node, side, v = table.column("node").to_numpy(), table.column("side").to_numpy(), full(table.column("vec"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        i, j = np.nonzero(v[x] @ v[y].T >= cosine)
        return pa.table({"src": node[x[i[:1]]], "dst": node[y[j[:1]]]})

    return run


def _degrees(cosine: float):
    """Links between two cells of one component, counted at both ends."""

    def run(table: pa.Table) -> pa.Table:
        node, side, many, v = table.column("node").to_numpy(), table.column("side").to_numpy(), table.column("copies").to_numpy(), full(table.column("vec"))
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(y):  # a cell with itself
            links = v[x] @ v[x].T >= cosine
            np.fill_diagonal(links, False)
            return pa.table({"node": node[x], "n": (links * many[x][None, :]).sum(axis=1)})
        links = v[x] @ v[y].T >= cosine
        return pa.table({"node": np.concatenate([node[x], node[y]]), "n": np.concatenate([(links * many[y][None, :]).sum(axis=1), (links * many[x][:, None]).sum(axis=0)])})

    return run


def _united(cells: DataFrame, links: DataFrame, comp: DataFrame, members: DataFrame, cosine: float, tmp: Scratch) -> DataFrame:
    """Components after an exact comparison of the saturated cells of different components."""
    met = _cell_pairs(cells.where("saturated"), "part", cosine, tmp)
    one = members.groupBy("component", "cell").agg(F.min("node").alias("node"))
    ends = lambda t: one.select(F.col("component").alias(f"c{t}"), F.col("cell").alias(f"k{t}"), F.col("node").alias(f"n{t}"))
    sure = met.where("sure").join(ends("a"), ["ca", "ka"]).join(ends("b"), ["cb", "kb"]).select(F.col("na").alias("src"), F.col("nb").alias("dst"))
    links = tmp.save(links.union(sure))
    comp = tmp.save(connected_components(links))
    now = comp.select(F.col("node"), F.col("component").alias("now"))
    to = tmp.save(one.join(now, "node").groupBy("component").agg(F.min("now").alias("now")))
    of = lambda t: to.select(F.col("component").alias(f"c{t}"), F.col("now").alias(f"o{t}"))
    open_ = tmp.save(met.where("not sure").join(of("a"), "ca").join(of("b"), "cb").where("oa <> ob").select("ca", "cb", "ka", "kb"))
    found = _compare(open_, members, _touch(cosine), "src long, dst long", tmp)
    return tmp.save(connected_components(links.union(found)))


def _compare(pairs: DataFrame, members: DataFrame, f, schema: str, tmp: Scratch) -> DataFrame:
    """``f`` over the members of each pair of cells (``ca, cb, ka, kb``); side 0 is cell a, side 1 cell b."""
    m = members.select("component", "cell", "node", "copies", "vec")
    sides = []
    for side, t in enumerate("ab"):
        here = pairs if side == 0 else pairs.where("ka <> kb or ca <> cb")
        sides.append(here.join(m.withColumnsRenamed({"component": f"c{t}", "cell": f"k{t}"}), [f"c{t}", f"k{t}"]).select("ca", "cb", "ka", "kb", F.lit(side).alias("side"), "node", "copies", "vec"))
    return tmp.save(sides[0].union(sides[1]).groupBy("ca", "cb", "ka", "kb").applyInArrow(f, schema))


def _links(cosine: float):
    def run(batches):
        for b in batches:
            good = [float(np.frombuffer(x.as_buffer(), np.float64) @ np.frombuffer(y.as_buffer(), np.float64)) >= cosine for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["src", "dst"]).filter(pa.array(good, pa.bool_()))

    return run


def _unit(batches):
    for b in batches:
        exact, rough = [], []
        for x in b.column(1):
            v = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
            v = v / np.abs(v).max()
            v /= np.sqrt(v @ v)
            exact.append(v.tobytes())
            rough.append(v.astype(np.float16).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(exact, pa.binary()), pa.array(rough, pa.binary()), b.column(2)], ["node", "vec", "rough", "dim"])


def usable():
    """Vectors that may link."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    return F.col("label").isNotNull() & x.isNotNull() & F.coalesce(fine, F.lit(False))


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, k: int = NEIGHBOURS, tables: int = TABLES, rounds: int = ROUNDS, seed: int = 7) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    spark = embeddings.sparkSession
    tmp = Scratch(spark, "nndescent")
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").withColumn("ok", usable())
    e = e.withColumn("h", F.when(F.col("ok"), F.sha2(F.to_json(F.struct("label", "embedding")), 256)))
    rows = tmp.save(e.select("vec_id", "h"))
    nodes = e.where("ok").groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = tmp.save(nodes.withColumn("node", F.monotonically_increasing_id()))
    units = nodes.select("node", F.col("embedding").cast("array<double>"), F.size("embedding").alias("dim")).mapInArrow(_unit, "node long, vec binary, rough binary, dim int")
    units = tmp.save(units.join(nodes.select("node", "copies", F.xxhash64("label", F.size("embedding")).alias("part")), "node"))
    near = max(2 * cosine * cosine - 1 - HALF, -1.0) if cosine > 0 else -1.0

    # first lists: nearest nodes in hyperplane buckets of about IN_BUCKET nodes, many buckets in a call
    parts = tmp.save(units.groupBy("part").agg(F.count("*").alias("n")))
    total = parts.agg(F.sum("n")).first()[0] or 0
    bits = F.least(F.lit(24), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / IN_BUCKET)))).cast("int")
    coded = units.join(parts.select("part", bits.alias("bits")), "part").select("node", "rough", "dim", "bits").mapInArrow(_codes(tables, seed), "node long, codes array<long>")
    coded = tmp.save(coded.join(units.select("node", "part"), "node"))
    flat = coded.select("node", "part", F.posexplode("codes").alias("t", "code"))
    size = tmp.save(flat.groupBy("part", "t", "code").agg(F.count("*").alias("n")).where("n > 1").select("part", "t", "code", F.ceil(F.col("n") / BUCKET).alias("cuts")))
    dealt = flat.join(size, ["part", "t", "code"]).select("node", F.xxhash64("part", "t", "code", F.pmod(F.xxhash64("node", "t"), F.col("cuts"))).alias("bucket"))
    dealt = dealt.join(units.select("node", F.col("rough").alias("vec")), "node").withColumn("bin", F.pmod(F.xxhash64("bucket"), F.lit(1 + total * tables // 8192)))
    edges = dealt.groupBy("bin").applyInArrow(_bucket(k, near), EDGES)
    # blocks of pivots: some buckets of the first table
    wide = F.xxhash64("part", F.floor(F.element_at("codes", 1) / 16))
    blocks = coded.select("node", wide.alias("wide"))
    cuts = blocks.groupBy("wide").agg(F.ceil(F.count("*") / CELL).alias("cuts"))
    blocks = tmp.save(blocks.join(cuts, "wide").select("node", F.xxhash64("wide", F.pmod(F.xxhash64("node"), F.col("cuts"))).alias("block")))

    def best(of: DataFrame, key: str, other: str) -> DataFrame:
        """The k most similar of each list; salted, since a list of listers has no bound."""
        pick = lambda g: F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(g))), asc=False), 1, k)
        first = of.groupBy(key, F.pmod(F.xxhash64(other), F.lit(8)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set(F.struct("sim", other)), asc=False), 1, k).alias("l"))
        return first.groupBy(key).agg(pick("l").alias("l"))

    entry = lambda known: lambda x: F.struct(x["sim"].alias("sim"), x["dst"].alias("dst"), (~F.array_contains(known, x["dst"])).alias("fresh"))
    lists = tmp.save(best(edges, "src", "dst").select("src", F.transform("l", entry(F.array().cast("array<long>"))).alias("l")))
    for _ in range(rounds):
        flat = lists.select("src", F.explode("l").alias("x")).select("src", "x.dst", "x.sim", "x.fresh")
        back = best(flat, "dst", "src").select(F.col("dst").alias("pivot"), F.explode("l").alias("x")).select("pivot", F.col("x.src").alias("node"))
        back = back.join(flat.select(F.col("dst").alias("pivot"), F.col("src").alias("node"), "fresh"), ["pivot", "node"])
        members = flat.select(F.col("src").alias("pivot"), F.col("dst").alias("node"), "fresh").union(back).groupBy("pivot", "node").agg(F.max("fresh").alias("fresh"))
        met = members.groupBy("pivot").agg(F.collect_list(F.struct("node", "fresh")).alias("m"), F.max("fresh").alias("any")).where(F.col("any") & (F.size("m") > 1))
        met = tmp.save(met.join(blocks.select(F.col("node").alias("pivot"), "block"), "pivot").select("block", F.col("m.node").alias("ids"), F.col("m.fresh").alias("fresh")))
        floor = lists.select(F.col("src").alias("node"), F.when(F.size("l") < k, F.lit(near)).otherwise(F.element_at("l", -1)["sim"]).alias("floor"))
        need = met.select(F.xxhash64("block").alias("home"), F.explode("ids").alias("node")).distinct().join(units.select("node", F.col("rough").alias("vec")), "node").join(floor, "node", "left").select("home", "node", "vec", F.coalesce("floor", F.lit(near)).alias("floor"))
        found = need.groupBy("home").cogroup(met.withColumn("at", F.xxhash64("block")).groupBy("at")).applyInArrow(_local_join(k), EDGES)
        after = best(flat.select("src", "dst", "sim").union(flat.select("dst", "src", "sim")).union(found), "src", "dst")
        after = after.join(lists.select("src", F.col("l.dst").alias("known")), "src", "left").select("src", F.transform("l", entry(F.coalesce("known", F.array().cast("array<long>")))).alias("l"))
        after = tmp.save(after)
        moved = after.where(F.exists("l", lambda x: x["fresh"])).count()
        tmp.drop(met, lists)
        lists = after
        if moved * 100 < total:
            break

    # threshold edges, checked in double precision
    pairs = lists.select("src", F.explode("l").alias("x")).where(F.col("x.sim") >= cosine - HALF).select(F.least("src", F.col("x.dst")).alias("src"), F.greatest("src", F.col("x.dst")).alias("dst")).distinct()
    pairs = pairs.join(units.select(F.col("node").alias("src"), F.col("vec").alias("a")), "src").join(units.select(F.col("node").alias("dst"), F.col("vec").alias("b")), "dst").select("src", "dst", "a", "b")
    links = tmp.save(pairs.mapInArrow(_links(cosine), "src long, dst long"))
    comp = tmp.save(connected_components(links))
    copies = nodes.select("node", "copies")
    counted = links.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(links.select("dst", "src")).join(copies.withColumnsRenamed({"node": "other", "copies": "c"}), "other").groupBy("node").agg(F.sum("c").alias("n"))
    degree = tmp.save(counted)

    # saturated lists
    hard = tmp.save(lists.where((F.size("l") >= k) & (F.element_at("l", -1)["sim"] >= cosine - HALF)).select(F.col("src").alias("node")))
    if not hard.isEmpty():

        def celled(comp: DataFrame):
            """Nodes of components that hold a saturated node, and their cells."""
            which = comp.join(hard, "node", "left_semi").select("component").distinct()
            m = comp.join(which, "component", "left_semi").join(hard.withColumn("saturated", F.lit(True)), "node", "left").join(blocks, "node").join(units.select("node", "part", "copies", "vec"), "node")
            # a cell is saturated or not as a whole
            m = tmp.save(m.select("node", "part", "component", F.xxhash64("block", F.col("saturated").isNotNull()).alias("cell"), F.col("saturated").isNotNull().alias("saturated"), "copies", "vec"))
            return m, tmp.save(m.groupBy("part", "component", "cell").applyInArrow(_cells, "part long, component long, cell long, centre binary, radius double, many long, saturated boolean"))

        members, cells = celled(comp)
        comp = _united(cells, links, comp, members, cosine, tmp)
        members, cells = celled(comp)
        met = _cell_pairs(cells, "component", cosine, tmp)
        some = _compare(met.where("not sure"), members, _degrees(cosine), "node long, n long", tmp)
        # nothing but links: a node gains all of the other cell (of its own cell, all but itself)
        sure = met.where("sure")
        both = sure.select(F.col("ca").alias("component"), F.col("ka").alias("cell"), F.col("kb").alias("other")).union(sure.where("ka <> kb").select("ca", "kb", "ka"))
        gain = both.join(cells.select("component", F.col("cell").alias("other"), "many"), ["component", "other"]).groupBy("component", "cell").agg(F.sum("many").alias("many"), F.max((F.col("cell") == F.col("other")).cast("int")).alias("own"))
        all_ = members.join(gain, ["component", "cell"]).select("node", (F.col("many") - F.col("own") * F.col("copies")).alias("n"))
        exact = some.union(all_).groupBy("node").agg(F.sum("n").alias("exact"))
        degree = tmp.save(degree.join(exact.join(hard, "node", "left_semi"), "node", "full").select("node", F.coalesce("exact", "n").alias("n")))

    known = nodes.select("h", "node", "rep", "copies").join(comp, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = tmp.save(known.groupBy("component").agg(F.min("rep").alias("component_id")))
    known = tmp.save(known.join(least, "component").select("h", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    out = rows.join(known, "h", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(embeddings: DataFrame, found: DataFrame, cosine: float = COSINE, every: int = 50):
    """Links found and links there are, over query rows whose vec_id is divisible by ``every``, against all rows (in blocks of one label)."""
    e = embeddings.where(usable()).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("q"), "label", F.col("v").alias("u"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    near = dot(F.col("u"), F.col("v")) >= cosine * F.sqrt(dot(F.col("u"), F.col("u")) * dot(F.col("v"), F.col("v")))
    real = q.join(e, "label").where(F.col("q") != F.col("vec_id")).where(near).groupBy("q").agg(F.count("*").alias("n"))
    r = found.where(F.col("vec_id") % every == 0).join(real, found["vec_id"] == real["q"], "left").agg(F.sum("n_links").alias("found"), F.sum(F.coalesce("n", F.lit(0))).alias("real")).first()
    return int(r["found"] or 0), int(r["real"] or 0)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP6_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS m FROM r GROUP BY node),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, m AS component_id, vec_id = m AS kept FROM embeddings JOIN c ON node = vec_id LEFT JOIN n ON a = vec_id
"""

by_value(__name__)
