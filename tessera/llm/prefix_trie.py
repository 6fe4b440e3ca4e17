"""The prefix trie of conversations, built from their sorted order.

A conversation is a row of turns; a node of depth d is a distinct sequence of first d turns. In sorted order the conversations below a node are
neighbours, and the longest common prefix (LCP) of two neighbours is the depth of the node where they part. So the forest of branching nodes follows from
the LCP edges alone: union-find takes the edges in descending depth, and every merge of components creates (or widens) a branching node.

* A turn is 16 bytes of the SHA-256 of its role and text, a conversation the concatenation of its turns: bytes sort as turns do, and an LCP is counted in
  multiples of 16. Equal conversations are one row before anything is sorted, so a hot conversation is one item.
* Items are range-partitioned. Each partition builds its own forest. A component that reaches the first or the last item may go on in the
  neighbouring partition: it stays open. The partition is then *contracted* to its open nodes, at most one per branching depth of its first and last item.
* The contracted partitions, ``FAN`` to a task, are a shorter sequence of items of the same kind; the same function merges them over the
  boundary edges, level by level, until one sequence without open ends is left. No task ever holds more than a partition or ``FAN`` contracted ones.
* Children of a node that was still open when they were finished know it by a handle; handles are resolved from the last level down.

Between two branching nodes lie nodes with one child; they are laid out last, by one join with the words of a member.

Defined results: turns are ordered by turn (null first), ties by role and then by the turn's hash; null role or text is empty; repeated rows stay repeated
turns; rows without conversation id have no number to be hashed or listed by and are left out; ``%`` keeps the sign, as in SQL; extra columns are
ignored; a conversation is one row of 24 bytes a turn, however long its texts; without conversations there is no node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.llm import by_value

#: Bytes of a turn's key.
WIDTH = 16
#: Distinct conversations to a partition (as many partitions as the session shuffles to, within these bounds), and contracted partitions to a task.
LEAST, MOST, FAN = 1_000, 100_000, 64
EMPTY = hashlib.sha256(b"").hexdigest()
#: What an item brings to the node at its depth (``length``): members, smallest of them, finished children, leaves and savings below them, words up to that depth and the digest of those
#: that end there. ``lcp`` and ``lcp_words`` belong to the edge to the next item. The first and the last item of a sequence also carry their key and running word counts.
ITEM = "handle long, length long, n long, least long, children long, leaves long, saved long, words long, ends string, lcp long, lcp_words long, key binary, running array<long>"
NODE = "depth long, above long, conv_id long, n_convs long, n_children long, n_leaves long, saved_below long, ends_sha256 string, parent_conv_id long, parent_handle long"
ROW = f"kind string, part long, place long, {ITEM}, {NODE}"
_ITEM, _NODE = ([f.strip().split(" ")[0] for f in s.split(",")] for s in (ITEM, NODE))


def turn_key() -> Column:
    role = F.coalesce("role", F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.coalesce("text", F.lit(""))), 256)), 1, WIDTH)


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, key, words``: the turns of each conversation as one binary, and the number of words of each turn."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    t = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), turn_key().alias("key"), words.alias("words")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return t.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["key"])), "")).alias("key"), F.transform("t", lambda x: x["words"]).alias("words"))


def rebuild(seq: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c with its first h turns taken from conversation c - c % group, h = crc32(c) % most."""
    heads = seq.select(F.col("conv_id").alias("_base"), F.substring("key", 1, WIDTH * (most - 1)).alias("_key"), F.slice("words", 1, most - 1).alias("_words"))
    own = seq.withColumn("_base", F.col("conv_id") - F.col("conv_id") % group).withColumn("_h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))
    j = own.join(heads, "_base", "left")
    key = F.concat(F.coalesce(F.substring(F.col("_key"), F.lit(1), F.col("_h") * WIDTH), F.lit(b"")), F.substring(F.col("key"), F.col("_h") * WIDTH + 1, F.length("key")))
    none = F.array().cast("array<bigint>")
    words = F.concat(F.coalesce(F.slice(F.col("_words"), F.lit(1), F.col("_h")), none), F.slice(F.col("words"), F.col("_h") + 1, F.size("words")))
    return j.select("conv_id", key.alias("key"), words.alias("words"))


def _digests(batches):
    """Rows sorted by (id of the sequence, conv_id): one digest of the comma-joined numbers for each sequence; the state lives across batches."""
    now, h, n, least, out = None, None, 0, None, []
    for b in batches:
        for s, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if s != now:
                if now is not None:
                    out.append((now, n, least, h.hexdigest()))
                now, h, n, least = s, hashlib.sha256(str(c).encode()), 1, c
            else:
                h.update(b",%d" % c)
                n += 1
        if len(out) > 10_000:
            yield _batch(out, "seq binary, n long, least long, ends string")
            out = []
    if now is not None:
        out.append((now, n, least, h.hexdigest()))
    if out:
        yield _batch(out, "seq binary, n long, least long, ends string")


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def distinct_sequences(rebuilt: DataFrame) -> DataFrame:
    """One row per distinct sequence: ``key, words``, members ``n``, smallest member ``least`` and the digest ``ends`` of all of them.

    The digest is one hash over a sorted list, so the numbers of equal conversations pass through one task, one by one, sorted by Spark; none is kept.
    """
    r = rebuilt.withColumn("seq", F.unhex(F.sha2("key", 256)))
    ids = r.select("seq", "conv_id").repartition("seq").sortWithinPartitions("seq", "conv_id").mapInArrow(_digests, "seq binary, n long, least long, ends string")
    return r.groupBy("seq").agg(F.first("key").alias("key"), F.first("words").alias("words")).join(ids, "seq").drop("seq")


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common from their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // WIDTH


class _Node:
    """A branching node (or the end of a sequence) while its members are gathered. ``up`` leads to the node it was united with."""

    __slots__ = ("depth", "words", "n", "least", "children", "leaves", "saved", "ends", "up", "parent", "handle")

    def __init__(self, depth: int, words: int, n=0, least=None, children=0, leaves=0, saved=0, ends=None):
        self.depth, self.words, self.n, self.least, self.children, self.leaves, self.saved, self.ends = depth, words, n, least, children, leaves, saved, ends
        self.up = self.parent = self.handle = None

    def find(self) -> _Node:
        x = self
        while x.up is not None:
            if x.up.up is not None:
                x.up = x.up.up
            x = x.up
        return x

    def unite(self, other: _Node) -> None:
        """``other`` stands for the same sequence of turns."""
        other.up = self
        self.n, self.children, self.leaves, self.saved = self.n + other.n, self.children + other.children, self.leaves + other.leaves, self.saved + other.saved
        self.least = other.least if self.least is None or other.least is not None and other.least < self.least else self.least
        self.ends = self.ends or other.ends

    def adopt(self, child: _Node) -> None:
        """``child`` is finished, and no branching node lies between."""
        child.parent = self
        self.n += child.n
        self.least = child.least if self.least is None or child.least < self.least else self.least
        self.children += 1
        self.leaves += child.leaves if child.children else 1
        self.saved += child.saved + (child.n - 1) * (child.words - self.words)


def forest(items: list[dict], part: int, last: bool) -> list[dict]:
    """Finished nodes, open nodes as items of the next level, and the aliases of the items given; ``last``: nothing lies before or after.

    Edges are taken in descending depth. A component is a range of items with the node at its top; union-find over items finds it. A component that
    holds the first or the last item is not finished by a merge at a lesser depth: its top is set aside, as the next piece of the left or right spine.
    """
    m = len(items)
    nodes = [_Node(x["length"], x["words"], x["n"], x["least"], x["children"], x["leaves"], x["saved"], x["ends"]) for x in items]
    top, root = list(nodes), list(range(m))
    left, right, done = [], [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    depth = np.array([x["lcp"] for x in items[:-1]], np.int64)
    first, end = 0, m - 1  # items on the borders
    for e in np.argsort(-depth, kind="stable").tolist():
        d, a, b = int(depth[e]), find(e), find(e + 1)
        at_left, at_right = not last and find(first) == a, not last and find(end) == b
        here = None
        for c, is_open, spine in ((a, at_left, left), (b, at_right, right)):
            t = top[c]
            if t.depth == d:
                if here is None:
                    here = t
                else:
                    here.unite(t)
        if here is None:
            here = _Node(d, items[e]["lcp_words"])
        for c, is_open, spine in ((a, at_left, left), (b, at_right, right)):
            t = top[c]
            if t.depth > d:
                if is_open:
                    spine.append(t)
                else:
                    here.adopt(t)
                    done.append(t)
        root[b] = a
        top[a] = here
    apex = top[find(0)]
    if last:
        if apex.depth > 0:
            base = _Node(0, 0)
            base.adopt(apex)
            done.append(apex)
            apex = base
        done.append(apex)
        kept = []
    else:
        kept = [*left, apex, *reversed(right)]
        for i, t in enumerate(kept):
            t.handle = part << 32 | i
    out = []
    for i, t in enumerate(kept):
        edge = min(t, kept[i + 1], key=lambda x: x.depth) if i + 1 < len(kept) else None
        row = {"kind": "item", "place": i, "handle": t.handle, "length": t.depth, "n": t.n, "least": t.least, "children": t.children, "leaves": t.leaves, "saved": t.saved, "words": t.words, "ends": t.ends}
        row |= {"lcp": edge.depth, "lcp_words": edge.words} if edge is not None else {}
        source = items[0] if i == 0 else items[-1] if i == len(kept) - 1 else None
        out.append(row | ({"key": source["key"], "running": source["running"]} if source is not None else {}))
    if len(kept) == 1:  # the only item is first and last
        out[0] |= {"key": items[0]["key"], "running": items[0]["running"]}
    for t in done:
        p = t.parent.find() if t.parent is not None else None
        row = {"kind": "node", "depth": t.depth, "above": p.depth if p is not None else -1, "conv_id": t.least, "n_convs": t.n, "n_children": t.children, "n_leaves": t.leaves if t.children else 1, "saved_below": t.saved, "ends_sha256": t.ends or EMPTY}
        out.append(row | ({} if p is None else {"parent_handle": p.handle} if p.handle is not None else {"parent_conv_id": p.least}))
    for x, t in zip(items, nodes):
        if x["handle"] is not None:
            p = t.find()
            out.append({"kind": "alias", "handle": x["handle"]} | ({"parent_handle": p.handle} if p.handle is not None else {"parent_conv_id": p.least}))
    for row in out:
        row["part"] = part
    return out


def _rows(rows: list[dict]):
    for i in range(0, len(rows), 5_000):
        yield _batch([tuple(r.get(c) for c in _COLUMNS) for r in rows[i : i + 5_000]], ROW)


_COLUMNS = [f.strip().split(" ")[0] for f in ROW.split(",")]


def _first_level(last: bool):
    """Sorted distinct sequences of a partition (``part, key, words, n, least, ends``) to its rows."""

    def run(batches):
        items, part = [], 0
        for b in batches:
            p, keys, words, n, least, ends = (b.column(i).to_pylist() for i in range(6))
            for i, key in enumerate(keys):
                part, run_ = p[i], np.cumsum(words[i])
                if items:
                    d = common(items[-1]["key"], key)
                    items[-1] |= {"lcp": d, "lcp_words": int(run_[d - 1]) if d else 0}
                    if len(items) > 1:
                        items[-1]["key"] = None  # only neighbours are compared
                items.append({"handle": None, "length": len(key) // WIDTH, "n": n[i], "least": least[i], "children": 0, "leaves": 0, "saved": 0, "words": int(run_[-1]) if len(run_) else 0, "ends": ends[i], "lcp": None, "lcp_words": None, "key": key, "running": run_})
                if len(items) > 2:
                    items[-2]["running"] = None
        if items:
            for x in (items[0], items[-1]):
                x["running"] = np.asarray(x["running"]).tolist()
            yield from _rows(forest(items, part, last))

    return run


def _next_level(last: bool):
    """Contracted partitions of one task, in order, to its rows."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["part"], r["place"]))
        for x, y in zip(rows, rows[1:]):
            if x["part"] != y["part"]:
                d = common(x["key"], y["key"])
                x |= {"lcp": d, "lcp_words": y["running"][d - 1] if d else 0}
        return pa.Table.from_batches(list(_rows(forest(rows, rows[0]["part"] // FAN if not last else 0, last))))

    return run


def branching(s: DataFrame, partitions: int | None = None) -> DataFrame:
    """Branching nodes and ends of sequences, from ``key, words, n, least, ends``: the columns of ``NODE`` with ``parent_conv_id`` resolved."""
    spark = s.sparkSession
    tmp = Scratch(spark, "trie")
    n = 0 if partitions else s.count()
    parts = partitions or max(-(-n // MOST), min(-(-n // LEAST), int(spark.conf.get("spark.sql.shuffle.partitions"))), 1)
    order = s.repartition(1) if parts == 1 else s.repartitionByRange(parts, "key")
    order = order.sortWithinPartitions("key").select(F.spark_partition_id().cast("long").alias("part"), "key", "words", "n", "least", "ends")
    levels = [tmp.save(order.mapInArrow(_first_level(parts == 1), ROW))]
    while parts > 1:
        parts = -(-parts // FAN)
        group = F.floor(F.col("part") / FAN) if parts > 1 else F.lit(0)
        items_ = levels[-1].where("kind = 'item'").select("part", "place", *_ITEM)
        levels.append(tmp.save(items_.groupBy(group.alias("_g")).applyInArrow(_next_level(parts == 1), ROW)))
    known, out = None, None
    for level in reversed(levels):
        nodes, alias = (level.where(F.col("kind") == k) for k in ("node", "alias"))
        if known is not None:
            at = known.select(F.col("handle").alias("parent_handle"), F.col("conv").alias("_conv"))
            nodes, alias = (t.join(at, "parent_handle", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_conv")) for t in (nodes, alias))
        known = tmp.save(alias.select("handle", F.col("parent_conv_id").alias("conv")))
        nodes = nodes.select(*_NODE[:-1])
        out = nodes if out is None else out.unionByName(nodes)
    return out


TRIE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _pieces(b: pa.RecordBatch, rows: int = 100_000):
    """Slices of a batch that give about so many rows each."""
    upto = np.cumsum(b.column("depth").to_numpy() - b.column("above").to_numpy())
    cuts = [0, *np.flatnonzero(np.diff(upto // rows)) + 1, b.num_rows]
    for x, y in zip(cuts, cuts[1:]):
        if y > x:
            yield b.slice(x, y - x)


def _lay_out(batches):
    """Branching nodes with the words of a member: one row for each depth from below the upper branching node (``above``) down to their own."""
    for b in (part for whole in batches for part in _pieces(whole)):
        c = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        above, depth, n = (c[x].to_numpy(zero_copy_only=False) for x in ("above", "depth", "n_convs"))
        size = depth - above
        of = np.repeat(np.arange(len(size)), size)  # the node of each row
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + above[of] + 1  # its depth
        below = np.concatenate([np.zeros(0, np.int64), *(np.append(np.cumsum(w[max(x, 0) : d][::-1])[::-1], np.zeros(int(d == 0), np.int64)) for w, x, d in zip(map(_numbers, c["words"]), above, depth))]).astype(np.int64)
        low, high = at == depth[of], at == above[of] + 1
        take = lambda x: c[x].take(pa.array(of))
        pick = lambda where, x, y: pa.compute.if_else(pa.array(where), x, y)
        yield pa.RecordBatch.from_arrays(
            [
                take("conv_id"), pa.array(at), pick(high, take("parent_conv_id"), take("conv_id")), take("n_convs"), pick(low, take("n_children"), pa.scalar(1, pa.int64())), take("n_leaves"),
                pa.array(take("saved_below").to_numpy(zero_copy_only=False) + (n[of] - 1) * below), pick(low, take("ends_sha256"), pa.scalar(EMPTY)),
            ],
            [f.strip().split(" ")[0] for f in TRIE.split(",")],
        )


def _numbers(words: pa.ListScalar) -> np.ndarray:
    return words.values.to_numpy(zero_copy_only=False) if len(words.values) else np.zeros(0, np.int64)


def trie(rebuilt: DataFrame, partitions: int | None = None) -> DataFrame:
    """Every node of the trie of ``conv_id, key, words`` (from ``sequences`` or ``rebuild``)."""
    tmp = Scratch(rebuilt.sparkSession, "trie")
    seq = tmp.save(distinct_sequences(tmp.save(rebuilt)))
    nodes = branching(seq, partitions)
    return nodes.join(seq.select(F.col("least").alias("conv_id"), "words"), "conv_id").mapInArrow(_lay_out, TRIE)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuild(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


#: Every prefix of every conversation as a row; the checksum of a number is taken bit by bit, as SQL has no function for it.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, k) AS p, k, w FROM (
  SELECT conv_id, turn, coalesce(role, '') AS role, substring(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END, CAST(4294967295 AS BIGINT)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS src, p, k, w FROM c JOIN t ON t.conv_id = c.base AND p <= h UNION ALL SELECT c.conv_id, 1, p, k, w FROM c JOIN t ON t.conv_id = c.conv_id AND p > h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY src, p) AS d, count(*) OVER (PARTITION BY conv_id) AS l FROM r),
x AS (SELECT conv_id, d, l, w, sha256(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY d)) AS pre FROM o UNION ALL SELECT c.conv_id, 0, coalesce(max(o.l), 0), 0, '' FROM c LEFT JOIN o USING (conv_id) GROUP BY c.conv_id),
n AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = l), '')) AS ends_sha256 FROM x GROUP BY d, pre),
u AS (SELECT n.*, p.pre AS up FROM n LEFT JOIN x p ON p.conv_id = n.conv_id AND p.d = n.d - 1),
k AS (SELECT d - 1 AS d, up AS pre, count(*) AS n_children FROM u WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.d, a.pre, count(*) FILTER (k.pre IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved FROM n LEFT JOIN k ON k.d = n.d AND k.pre = n.pre JOIN x a ON a.conv_id = n.conv_id AND a.d <= n.d GROUP BY a.d, a.pre)
SELECT u.conv_id, u.d AS depth, p.conv_id AS parent_conv_id, u.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, u.ends_sha256
FROM u LEFT JOIN n p ON p.d = u.d - 1 AND p.pre = u.up LEFT JOIN k ON k.d = u.d AND k.pre = u.pre JOIN s ON s.d = u.d AND s.pre = u.pre
"""


by_value(__name__)
