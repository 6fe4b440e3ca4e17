"""N-gram Jaccard join by a forest of count-vector R-trees.

A text's set is its distinct 5-word shingles (64-bit hashes). Equal sets become one node. A node is a
point: its shingles hashed into groups, and the number in each group. Two sets share at most the sum
of the coordinate minima of their points; the same sum over the upper corners of two boxes bounds every
pair below them, so a dual traversal of an R-tree skips box pairs whose bound is under the overlap that
the threshold asks for, ``t / (1 + t) * (a + b)``. Surviving pairs are checked on the whole sets. Trees are loaded by
recursive splits between two far seeds, so that like points share a box.

One tree over all points does not scale: the counts of unlike texts of one size look alike in every group, so a box of
several unlike points bounds nothing. So points are first dealt to blocks by KEYS pairs of independent minimum hashes (a text is in
KEYS blocks) and each block has its own tree. Two sets at the threshold miss all KEYS blocks with probability
``(1 - 0.75 ** 2) ** 36 < 2e-13``, the order of a hash collision; nothing else is approximate and no block is capped.
Candidates come from the trees. A unit of at most ALL points is a tree of one box: its pairs are not skipped box by box, each is bounded by its own minima.

1. Nearest pass: of the pairs that a block's tree lets through, each point takes three: with the point before it that has the highest
   bound, with the point that most others may link to, and with the block's most central one (that with the largest blocks). This
   ties copies together, also those that only their common original links, without checking all pairs. A block over NEAR points is cut into
   tiles, and its most central point is in all of them.
2. Full pass: only blocks that then still hold two components, cut by size band and into pairs of tiles where they are large.
   All pairs whose bound suffices are checked, but for those inside one component.

Many small blocks share a task-side call (a bin); a bin has about BIN points however the block sizes are spread.

Defined results: null or blank text: empty set, linked with nothing; null id: shingles counted, component
null, never linked; rows with one id and several texts: every row keeps its own set, and its component is
the smallest id among rows reachable from that row; repeated rows are one set with one component; ties between candidates go by node number and change no component; very long texts have points of at
most MAX_GROUPS counts, and their whole sets are compared; other columns, whatever their names, are not read; empty tables give empty tables.
"""

from __future__ import annotations

import contextlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.llm import by_value
from tessera.llm import kernels as K
from tessera.operators.graph import connected_components

WIDTH, NUM, DEN, KEYS = 5, 75, 100, 36
#: Points of one tree (a larger block is cut into tiles) in the nearest and in the full pass.
NEAR, TILE = 256, 1024
#: Points of a box, and of a bin; units up to ALL points are one box.
LEAF, BIN, ALL = 16, 4096, 24
#: Boxes in one of the level above.
FAN = 4
MAX_GROUPS = 8192
#: Ids (of 8 bytes) that may be broadcast.
BROADCAST_IDS = 100_000


def text_sets(buf: np.ndarray, off: np.ndarray, width: int):
    """Sorted distinct shingle hashes of each text: hashes and the first of each text."""
    _, low = K.tables()
    buf = low[buf]
    starts, ends, first = K.word_spans(buf, off)
    words = K.span_hashes(buf, starts, ends)
    h, _, text = K.window_hashes(words, first, width)
    many = np.diff(first)
    parts, texts = [h], [text]
    for k in range(1, width):
        some = np.flatnonzero(many == k)
        if len(some):
            up, _ = K.powers(K.P_WORD, k + 1)
            total = np.full(len(some), k, np.uint64)
            for i in range(k):
                total += words[first[:-1][some] + i] * up[i + 1]
            parts.append(K.mix(total))
            texts.append(some)
    h, text = np.concatenate(parts), np.concatenate(texts)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.searchsorted(text, np.arange(len(off)))


def groups_for(n: int) -> int:
    """Number of groups (a power of two): about one shingle in each, so that few unlike shingles meet in one."""
    return min(MAX_GROUPS, 1 << max(3, int(n).bit_length()))


def point_of(h: np.ndarray) -> bytes:
    """Group counts, in as many bytes each as the largest needs."""
    g = groups_for(len(h))
    count = np.bincount((h >> np.uint64(20)).astype(np.int64) & (g - 1), minlength=g)
    return count.astype(np.min_scalar_type(int(count.max()))).tobytes()


def set_sums(h: np.ndarray, at: np.ndarray):
    return np.add.reduceat(K.mix(h + np.uint64(1)), at), np.bitwise_xor.reduceat(K.mix(h ^ np.uint64(0xA5A5A5A5)), at)


def _sketch(width: int, keys: int):
    def run(batches):
        salt = K.mix(np.arange(1, 2 * keys + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            buf, off = K.buffer(b.column(1))
            for i, j in K.chunks(off):
                h, first = text_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                n = np.diff(first)
                full = np.flatnonzero(n > 0)
                out_n = pa.array(n, pa.int64())
                hi, lo = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                mins, points = [None] * (j - i), [None] * (j - i)
                if len(full):
                    at = first[:-1][full]
                    hi[full], lo[full] = set_sums(h, at)
                    low = np.stack([np.minimum.reduceat((h ^ s) * s, at) for s in salt], axis=1)
                    low = (K.mix(low[:, :keys]) + low[:, keys:]).view(np.int64)
                    for r, d in enumerate(full):
                        mins[d], points[d] = low[r], point_of(h[first[d] : first[d + 1]])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), out_n, pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(mins, pa.list_(pa.int64())), pa.array(points, pa.binary())], ["doc_id", "n", "hi", "lo", "mins", "point"])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            buf, off = K.buffer(b.column(0))
            for i, j in K.chunks(off):
                h, first = text_sets(buf[off[i] : off[j]], off[i : j + 1] - off[i], width)
                full = np.flatnonzero(np.diff(first) > 0)
                if len(full):
                    hi, lo = set_sums(h, first[:-1][full])
                    yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array([h[first[d] : first[d + 1]].tobytes() for d in full], pa.binary())], ["hi", "lo", "shingles"])

    return run


def _check(num: int, den: int):
    def run(batches):
        for b in batches:
            src, dst = b.column(0).to_numpy(), b.column(1).to_numpy()
            good = np.zeros(len(src), bool)
            for r, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                good[r] = den * both >= num * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([pa.array(src[good]), pa.array(dst[good])], ["src", "dst"])

    return run


class Points:
    """Count vectors of one bin. Two of unlike width are compared at the lesser one: groups are low bits, so halves of a vector add up."""

    def __init__(self, raw, n: np.ndarray):
        self.n = n
        self.width = np.array([groups_for(x) for x in n], np.int64)
        self.raw = raw
        self.at: dict = {}

    def matrix(self, rows: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(rows), width), np.uint16 if self.n[rows].max() < 1 << 16 else np.int64)
        for k, r in enumerate(rows.tolist()):
            w = int(self.width[r])
            out[k] = np.frombuffer(self.raw[r], f"u{len(self.raw[r]) // w}").reshape(-1, width).sum(axis=0)
        return out

    def bounds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most that the sets of each pair share."""
        out = np.zeros(len(a), np.int64)
        least = np.minimum(self.width[a], self.width[b])
        for w in np.unique(least):
            here = np.flatnonzero(least == w)
            rows, place = np.unique(np.concatenate([a[here], b[here]]), return_inverse=True)
            m = self.matrix(rows, int(w))
            x, y = place[: len(here)], place[len(here) :]
            step = max(1, (1 << 21) // int(w))
            for i in range(0, len(here), step):
                out[here[i : i + step]] = np.minimum(m[x[i : i + step]], m[y[i : i + step]]).sum(axis=1, dtype=np.int64)
        return out


def loading_order(points: np.ndarray):
    """Rows in tree order, and where boxes begin: recursive splits between two far seeds, at a wide gap that leaves both sides many."""
    todo, out = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        part = points[rows]
        common = lambda r: np.minimum(part, part[r]).sum(axis=1, dtype=np.int64)
        one = common(common(0).argmin())
        side = one - common(one.argmin())
        order = np.argsort(side, kind="stable")
        at = np.arange(1, len(rows))
        gap = np.diff(side[order]) * np.sqrt(np.minimum(at, len(rows) - at))
        cut = int(gap.argmax()) + 1 if gap.max() > 0 else len(rows) // 2
        todo += [rows[order[cut:]], rows[order[:cut]]]
    return np.concatenate(out), np.cumsum([0, *map(len, out)])[:-1]


def tree_join(points: np.ndarray, sizes: np.ndarray, num: int, den: int, seen: list | None = None):
    """Pairs of rows whose bound reaches the overlap that the threshold asks for. seen: gets (pairs, kept) of each level, points last."""
    order, starts = loading_order(points)
    corner, least = points[order], sizes[order]
    levels = [(corner, least, starts)]
    while len(corner) > 1:
        starts = levels[-1][2]
        corner, least = np.maximum.reduceat(corner, starts, axis=0), np.minimum.reduceat(least, starts)
        levels.append((corner, least, np.arange(0, len(corner), FAN)))
    i = j = np.zeros(1, np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        corner, least, _ = levels[depth]
        if depth == 0:
            i, j = i[i != j], j[i != j]
        keep = np.zeros(len(i), bool)
        step = max(1, (1 << 21) // max(corner.shape[1], 1))
        for a in range(0, len(i), step):
            x, y = i[a : a + step], j[a : a + step]
            bound = np.minimum(corner[x], corner[y]).sum(axis=1, dtype=np.int64)
            keep[a : a + step] = bound * (num + den) >= num * (least[x] + least[y])
        if seen is not None:
            seen.append((len(i), int(keep.sum())))
        i, j = i[keep], j[keep]
        if depth:
            begin = levels[depth - 1][2]
            end = np.append(begin[1:], len(levels[depth - 1][1]))
            wide = int((end - begin).max())
            ci, cj = begin[i][:, None, None] + np.arange(wide)[None, :, None], begin[j][:, None, None] + np.arange(wide)[None, None, :]
            fine = (ci < end[i][:, None, None]) & (cj < end[j][:, None, None]) & (ci <= cj)
            i, j = np.broadcast_to(ci, fine.shape)[fine], np.broadcast_to(cj, fine.shape)[fine]
    return order[i], order[j]


def candidates(points: Points, unit: np.ndarray, num: int, den: int, keep=None):
    """Row pairs (a before b, of one unit) that sizes, ``keep`` and bounds allow, and their bounds. Rows are sorted by unit; a large unit is finished before the next."""
    cut = np.concatenate([[0], np.flatnonzero(np.diff(unit)) + 1, [len(unit)]])
    many = np.diff(cut)
    n = points.n

    def left(a, b):
        ok = den * np.minimum(n[a], n[b]) >= num * np.maximum(n[a], n[b])
        if keep is not None:
            ok &= keep(a, b)
        a, b = a[ok], b[ok]
        bound = points.bounds(a, b)
        ok = bound * (num + den) >= num * (n[a] + n[b])
        return a[ok], b[ok], bound[ok]

    # small units: one box each, all of them at once
    row = np.flatnonzero(np.repeat(many <= ALL, many))
    reps = np.repeat(cut[1:], many)[row] - row - 1
    a = np.repeat(row, reps)
    parts = [left(a, a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(reps) - reps, reps))]
    for u in np.flatnonzero(many > ALL):
        rows = np.arange(cut[u], cut[u + 1])
        i, j = tree_join(points.matrix(rows, int(points.width[rows].min())), n[rows], num, den)
        parts.append(left(rows[np.minimum(i, j)], rows[np.maximum(i, j)]))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _sorted_bin(table: pa.Table):
    table = table.sort_by([("unit", "ascending"), ("node", "ascending")])
    columns = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("point", "mins")}
    mins = table.column("mins") if "mins" in table.column_names else None
    return columns, Points([x.as_buffer() for x in table.column("point")], columns["n"].astype(np.int64)), mins


def _nearest(num: int, den: int):
    """Of each point the pairs with the one before it that has the highest bound, with the unit's most linked one, and with its hub."""

    def run(table: pa.Table) -> pa.Table:
        c, points, _ = _sorted_bin(table)
        a, b, bound = candidates(points, c["unit"], num, den)
        like = bound / (points.n[a] + points.n[b] - bound)
        order = np.lexsort((-like, b))
        take = np.zeros(len(a), bool)
        take[order] = np.append(True, b[order][1:] != b[order][:-1])[: len(a)]
        degree = np.bincount(np.concatenate([a, b]), minlength=len(points.n))
        start = np.flatnonzero(np.append(True, c["unit"][1:] != c["unit"][:-1]))
        most = np.maximum.reduceat(degree, start)
        group = np.cumsum(np.append(False, c["unit"][1:] != c["unit"][:-1]))
        centre = (degree == most[group]) & (degree > 1)
        centre[np.flatnonzero(centre)[1:]] &= np.diff(group[np.flatnonzero(centre)]) > 0  # one a unit
        centre |= c["node"] == c["hub"]
        take |= centre[a] | centre[b]
        return pa.table({"src": c["node"][a[take]], "dst": c["node"][b[take]]})

    return run


def _full(num: int, den: int):
    """All pairs of two components, in the first of the blocks that hold both."""

    def run(table: pa.Table) -> pa.Table:
        c, points, mins = _sorted_bin(table)

        def keep(a, b):
            # the pair belongs to the band of its smaller member, and to two tiles only where they differ
            ok = (c["component"][a] != c["component"][b]) & (~c["banded"][a] | (np.minimum(c["band"][a], c["band"][b]) == c["at"][a]))
            return ok & ((c["ti"][a] == c["tj"][a]) | (c["tile"][a] != c["tile"][b]))

        a, b, _ = candidates(points, c["unit"], num, den, keep)
        keys = np.stack([x.values.to_numpy() for x in mins])
        ok = np.zeros(len(a), bool)
        for i in range(0, len(a), 1 << 15):
            x, y = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            ok[i : i + (1 << 15)] = (keys[x] == keys[y]).argmax(axis=1) == c["k"][x]
        return pa.table({"src": c["node"][a[ok]], "dst": c["node"][b[ok]]})

    return run


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 256):
    """A pair carries two whole sets: the default of 10,000 rows a batch would be hundreds of MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def jaccard_components(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id``.

    Rows link when ``den * |A and B| >= num * |A or B|``; components take the smallest id.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "jaccard")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = tmp.save(d.mapInArrow(_sketch(width, KEYS), "doc_id long, n long, hi long, lo long, mins array<long>, point binary"))
    nodes = tmp.save(
        rows.where("n > 0 and doc_id is not null").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("point").alias("point")).withColumn("node", F.monotonically_increasing_id())
    )

    def checked(pairs: DataFrame, few: bool) -> DataFrame:
        """The pairs that link. few: ids that fit a checked broadcast are expected; else one plan at every size."""
        pairs = tmp.save(pairs.distinct())
        ends = pairs.select(F.explode(F.array("src", "dst")).alias("node")).distinct().join(nodes.select("node", "rep", "hi", "lo"), "node")
        ends = tmp.save(ends)
        ids = ends.select(F.col("rep").alias("doc_id")).distinct()
        ids = F.broadcast(ids) if few and ids.count() <= BROADCAST_IDS else ids.hint("merge")
        texts = d.join(ids, "doc_id", "left_semi").select("text")
        sets = texts.mapInArrow(_sets(width), "hi long, lo long, shingles binary")
        sets = tmp.save(sets.join(ends.select("hi", "lo", "node"), ["hi", "lo"]).select("node", "shingles").dropDuplicates(["node"]))
        left = pairs.join(sets.select(F.col("node").alias("src"), F.col("shingles").alias("a")), "src")
        both = left.join(sets.select(F.col("node").alias("dst"), F.col("shingles").alias("b")), "dst").select("src", "dst", "a", "b")
        with few_rows_a_batch(spark):
            out = tmp.save(both.mapInArrow(_check(num, den), "src long, dst long"))
        tmp.drop(pairs, ends, sets)
        return out

    def binned(d: DataFrame, unit: list[str], columns: list[str], *more: str) -> DataFrame:
        """Points (and ``more``) of the units (blocks, tiles or pairs of tiles), about BIN of them in a bin."""
        d = tmp.save(d.select(F.xxhash64(*unit).alias("unit"), *columns))
        bins = -(-d.count() // BIN) or 1
        return d.join(nodes.select("node", "n", "point", *more), "node").withColumn("bin", F.pmod(F.xxhash64("unit"), F.lit(bins))).groupBy("bin")

    keyed = nodes.select("node", F.posexplode("mins").alias("k", "key"))
    sizes = tmp.save(keyed.groupBy("k", "key").agg(F.count("*").alias("size")).where("size > 1"))
    keyed = tmp.save(keyed.join(sizes, ["k", "key"]))
    central = tmp.save(keyed.groupBy("node").agg(F.sum("size").alias("weight")))
    hubs = keyed.join(central, "node").groupBy("k", "key").agg(F.max(F.struct("weight", "node"))["node"].alias("hub"))
    keyed = tmp.save(keyed.join(hubs, ["k", "key"]).withColumn("tiles", F.ceil(F.col("size") / NEAR)))
    every = F.sequence(F.lit(0), F.col("tiles") - 1)
    tile = F.explode(F.when(F.col("node") == F.col("hub"), every).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("tiles")))))
    links = checked(binned(keyed.withColumn("tile", tile), ["k", "key", "tile"], ["node", "hub"]).applyInArrow(_nearest(num, den), "src long, dst long"), few=False)
    comp = tmp.save(connected_components(links))

    # full pass: blocks with more than one component
    blocks = tmp.save(keyed.select("node", "k", "key", "size").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")))
    open_ = tmp.save(blocks.groupBy("k", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("k", "key"))
    base = float(np.log(den / num))
    # a pair's sizes differ by the factor den / num at most, so it lies in one band or in two neighbours
    blocks = blocks.join(open_, ["k", "key"]).join(nodes.select("node", F.floor(F.log(F.col("n").cast("double")) / base + 1e-9).cast("long").alias("band")), "node")
    blocks = blocks.withColumn("banded", F.col("size") > TILE)
    dealt = blocks.withColumn("at", F.explode(F.when(F.col("banded"), F.array("band", F.col("band") - 1)).otherwise(F.array(F.lit(0).cast("long")))))
    large = tmp.save(dealt.groupBy("k", "key", "at").agg(F.count("*").alias("points"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("k", "key", "at", F.ceil(F.col("points") / TILE).alias("tiles")))
    dealt = dealt.join(large, ["k", "key", "at"]).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("other", F.explode(every))
    dealt = dealt.withColumn("ti", F.least("tile", "other")).withColumn("tj", F.greatest("tile", "other"))
    more = binned(dealt, ["k", "key", "at", "ti", "tj"], ["node", "k", "component", "banded", "band", "at", "tile", "ti", "tj"], "mins").applyInArrow(_full(num, den), "src long, dst long")
    links = links.union(checked(more, few=True))

    comp = tmp.save(connected_components(links))
    known = nodes.select("hi", "lo", "node", "rep").join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = tmp.save(known.join(tmp.save(least), "component").select("hi", "lo", "component_id"))
    out = rows.select("doc_id", "n", "hi", "lo").join(known, ["hi", "lo"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id"),
    )


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP2_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS m FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id
"""

by_value(__name__)
