"""Line dedup by a segment-partition edit join, in DataFrame functions only.

Lines of at least ``min_chars`` characters are compared; two are near copies when at most ``edits`` character edits apart.
A line is split into ``edits + 1`` segments, so that one of them survives in any near copy. Its segments are indexed by
length and segment number; a line of equal or greater length probes the substrings that may hold each
segment (multi-match-aware positions: a segment shifts by no more than the edits to its left and
right allow). A line's own segments are probes of its own length at the same time, so they are sent once. Lines that share a
signature and nearly the same letter counts (``edits`` edits move at most twice that many) are verified by a banded
bit-parallel automaton: one bit per diagonal, one word per number of edits.

A signature with more than HOT_SHARE of all (found on one line in SAMPLE, which decides the route only) is not gathered by key. Its
lines get longer signatures: each segment is two halves, so that beside the segment that they share two more halves of a near
copy survive; those are probed in the same way.

Lines of crowded signatures (CROWD lines or more) are first compared with the line before them in the order of texts and in that of reversed texts. Numbered boilerplate, of which every line
is near many others, thereby falls into few classes after about two checks a line; a signature whose lines are all of one class is done with, and
pairs inside a class are left out.

Near copies, and equal lines of any length that are not blank, are joined into classes; the class's first occurrence (by doc_id, then
line) stays in its document and all others are removed. Lines are keyed by 96 bits of hash.

Defined results: null text has no lines; blank lines always stay; rows equal in id and text are
treated alike; a null doc_id comes last in the order, then texts go by hash; very long lines are lines like others; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.operators.graph import connected_components

EDITS, MIN_CHARS = 2, 30
#: Letter groups of the count filter (fixed split of the alphabet; other characters are the last group).
GROUPS = ("ae", "io", "tn", "rs", "hd", "lu", "cmfgyp")
#: A signature is hot with this share of the sampled ones and HOT_LEAST of them: so there are at most 1 / HOT_SHARE.
SAMPLE, HOT_SHARE, HOT_LEAST = 64, 1e-4, 64
#: Lines that make a signature crowded.
CROWD = 1024


def segment(length: Column, i: Column, parts: int):
    """0-based start and length of segment ``i`` of ``parts``: the last ``length % parts`` are one longer."""
    base = F.floor(length / parts).cast("int")
    plain = F.lit(parts) - F.pmod(length, F.lit(parts))
    return base * i + F.greatest(F.lit(0), i - plain), base + (i >= plain).cast("int")


def shifts(i: int, delta: int, edits: int):
    """Positions of segment ``i`` relative to its own, in a line longer by ``delta``."""
    return [s for s in range(-i, i + 1) if abs(s - delta) <= edits - i]


def piece(start: Column, size: Column) -> Column:
    """Characters of ``utf32``: four bytes each, so that a substring is a slice and need not be searched for."""
    return F.substring("utf32", start * 4 + 1, size * 4)


def literals(rows: list, names: tuple) -> Column:
    """A constant array to explode: the expressions over its fields are compiled once, not once per element."""
    return F.explode(F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, names)]) for r in rows])).alias("p")


def signatures(lines: DataFrame, edits: int) -> DataFrame:
    """``node, len, utf32, sig, probe, p (i, delta, shift)``: the segments of a line (index and probe), and substrings that only probe."""
    every = [(i, delta, s) for delta in range(edits + 1) for i in range(edits + 1) for s in shifts(i, delta, edits)]
    d = lines.select("node", "len", "utf32", literals(every, ("i", "delta", "shift")))
    own = F.col("len") - F.col("p.delta")
    start, size = segment(own, F.col("p.i"), edits + 1)
    sig = F.xxhash64(own, "p.i", piece(start + F.col("p.shift"), size))
    return d.select("node", "len", "utf32", sig.alias("sig"), ((F.col("p.delta") != 0) | (F.col("p.shift") != 0)).alias("probe"), "p")


def longer_signatures(hot: DataFrame, edits: int) -> DataFrame:
    """``node, sig, probe`` in place of rows of ``signatures`` whose signature is hot.

    Half ``h`` of the indexed line is half ``h % 2`` of its segment ``h // 2``. Where the lines share segment ``i`` at its shift, the edits
    left of it, between it and the half, and beyond are the budget together; they bound the shift of the half.
    """
    parts = edits + 1
    every = [(h // 2, h % 2, s) for h in range(2 * parts) for s in range(-edits, edits + 1)]
    d = hot.select("node", "len", "utf32", "sig", "probe", F.col("p").alias("q"), literals(every, ("i", "half", "shift")))
    d = d.where("p.i <> q.i")
    shift, delta, s = F.col("q.shift"), F.col("q.delta"), F.col("p.shift")
    left = F.abs(s) + F.abs(shift - s) + F.abs(delta - shift)
    right = F.abs(shift) + F.abs(s - shift) + F.abs(delta - s)
    start, size = segment(F.col("len") - delta, F.col("p.i"), parts)
    first = F.floor(size / 2).cast("int")
    start, size = start + first * F.col("p.half"), F.when(F.col("p.half") == 0, first).otherwise(size - first)
    d = d.where(F.when(F.col("p.i") < F.col("q.i"), left).otherwise(right) <= edits).where((start + s >= 0) & (start + s + size <= F.col("len")))
    return d.select("node", F.xxhash64("sig", "p.i", "p.half", piece(start + s, size)).alias("sig"), (F.col("probe") | (s != 0)).alias("probe"))


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are at most ``edits`` apart.

    After j characters of b, bit d of word e says that the first ``j + d - edits`` characters of a are
    within e edits of them. One step per character of b moves all diagonals at once.
    """
    width = 2 * edits + 1
    full = (1 << width) - 1
    start = F.struct(*[F.lit((((1 << (e + 1)) - 1) << edits) & full).cast("int").alias(f"r{e}") for e in range(edits + 1)])
    # each character of b beside the characters of a on all diagonals, built once per pair
    none = F.array_repeat(F.lit(None).cast("string"), edits)
    padded = F.concat(none, F.split(a, ""), none)
    rows = F.arrays_zip(F.split(b, "").alias("ch"), *[F.slice(padded, d + 1, F.length(b)).alias(f"x{d}") for d in range(width)])

    def step(acc: Column, z: Column) -> Column:
        match = None
        for d in range(width):
            hit = F.when(z[f"x{d}"] == z["ch"], F.lit(1 << d)).otherwise(F.lit(0))
            match = hit if match is None else match.bitwiseOR(hit)
        new = [acc["r0"].bitwiseAND(match)]
        for e in range(1, edits + 1):
            low = acc[f"r{e - 1}"]
            one = acc[f"r{e}"].bitwiseAND(match).bitwiseOR(low).bitwiseOR(F.shiftright(low, 1))
            new.append(one.bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(F.lit(full)))
        return F.struct(*[c.cast("int").alias(f"r{e}") for e, c in enumerate(new)])

    last = F.aggregate(rows, start, step)[f"r{edits}"]
    end = F.length(a) - F.length(b) + edits
    bit = F.element_at(F.array(*[F.lit(1 << d) for d in range(width)]), F.least(F.greatest(end + 1, F.lit(1)), F.lit(width)))
    return F.when((end < 0) | (end >= width), F.lit(False)).when(F.length(b) == 0, F.length(a) <= edits).otherwise(last.bitwiseAND(bit) != 0)


def line_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    d = d.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    owner = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "pos")
    return d.select("line", F.xxhash64("line").alias("k"), F.hash("line").alias("k2"), owner.alias("own"))


def shared_signatures(lines: DataFrame, edits: int, tmp: Scratch) -> DataFrame:
    """``sig, node, probe, crowded`` of the signatures (of ``lines``: ``node, line, len``) that two lines hold and one of them indexes."""
    every = signatures(lines.select("node", "len", F.encode("line", "UTF-32").alias("utf32")), edits)
    part = every.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE)) == 0)
    seen = tmp.save(part.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") >= HOT_LEAST))
    total = part.count() if not seen.isEmpty() else 0

    by = W.partitionBy("sig")
    twice = (F.min("node").over(by) != F.max("node").over(by)) & ~F.min("probe").over(by)
    sigs = every.select("node", "sig", "probe")
    if total:
        hot = F.broadcast(seen.where(F.col("n") >= HOT_SHARE * total).select("sig"))  # at most 1 / HOT_SHARE rows
        sigs = sigs.join(hot, "sig", "left_anti").select("node", "sig", "probe").union(longer_signatures(every.join(hot, "sig"), edits))
    return tmp.save(sigs.withColumns({"twice": twice, "crowded": F.count("*").over(by) >= CROWD}).where("twice").select("sig", "node", "probe", "crowded").distinct())


def next_lines(lines: DataFrame, edits: int, parts: int) -> DataFrame:
    """``src, dst``: neighbours in the order of texts, or of reversed texts, that are near copies. Ranges are ordered each for itself; what lies across their borders is left to the signatures."""
    out = None
    for order in (F.col("line"), F.reverse("line")):
        d = lines.select("node", "line", order.alias("by")).repartitionByRange(parts, "by").withColumn("part", F.spark_partition_id())
        w = W.partitionBy("part").orderBy("by", "node")
        d = d.select("node", "line", F.lag("node").over(w).alias("other"), F.lag("line").over(w).alias("before")).where("other is not null").where(F.abs(F.length("line") - F.length("before")) <= edits)
        d = d.where(within_edits(F.col("before"), F.col("line"), edits)).select(F.col("other").alias("src"), F.col("node").alias("dst"))
        out = d if out is None else out.union(d)
    return out


def removed_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, th, gone``: the 0-based lines to remove, for documents that lose any (th: hash of the text)."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "lines")
    lines = line_rows(docs, id_col, text_col)
    distinct = lines.groupBy("k", "k2").agg(F.min("own").alias("own"), F.max("own").alias("far"), F.first("line").alias("line"))
    distinct = tmp.save(distinct.select("k", "k2", "own", (F.col("own") != F.col("far")).alias("again"), "line", F.length("line").alias("len")).withColumn("node", F.monotonically_increasing_id()))

    hits = shared_signatures(distinct.where(F.col("len") >= min_chars), edits, tmp)
    counts = [F.length("line") - F.length(F.translate("line", g + g.upper(), "")) for g in GROUPS]
    shared = distinct.join(hits.select("node").distinct(), "node", "left_semi")
    crowd = tmp.save(hits.where("crowded").select("node").distinct())
    known = None
    if not crowd.isEmpty():
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        beside = tmp.save(next_lines(shared.join(crowd, "node", "left_semi").select("node", "line"), edits, parts))
        known = tmp.save(connected_components(beside, finish=0))
        shared = shared.join(known, "node", "left")
    label = F.coalesce("component", "node") if known is not None else F.col("node")
    some = tmp.save(shared.select("node", label.alias("class"), "len", *[c.alias(f"c{i}") for i, c in enumerate(counts)]))
    hits = hits.drop("crowded").join(some, "node")
    if known is not None:
        by = W.partitionBy("sig")
        hits = hits.withColumn("open", F.min("class").over(by) != F.max("class").over(by)).where("open").drop("open")
    left, right = tmp.save(hits.where("not probe")), tmp.save(hits)
    l, r = left.alias("l"), right.alias("r")
    gap = F.col("r.len") - F.col("l.len")
    apart = sum((F.abs(F.col(f"l.c{i}") - F.col(f"r.c{i}")) for i in range(len(GROUPS))), F.abs(gap - sum((F.col(f"r.c{i}") - F.col(f"l.c{i}") for i in range(len(GROUPS))), F.lit(0))))
    order = (gap > 0) | ((gap == 0) & (F.col("l.node") < F.col("r.node")))
    new = F.col("l.class") != F.col("r.class")
    pairs = l.join(r, (F.col("l.sig") == F.col("r.sig")) & order & new & (gap <= edits) & (apart <= 2 * edits)).select(F.col("l.node").alias("a"), F.col("r.node").alias("b")).distinct()
    text = distinct.select("node", "line")
    both = pairs.join(text.select(F.col("node").alias("a"), F.col("line").alias("x")), "a").join(text.select(F.col("node").alias("b"), F.col("line").alias("y")), "b")
    found = both.where(within_edits(F.col("x"), F.col("y"), edits)).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    links = tmp.save(found if known is None else found.union(known.select(F.col("node").alias("src"), F.col("component").alias("dst"))))

    comp = connected_components(links, finish=0)
    keyed = distinct.select("k", "k2", "own", "again", "node").join(comp, "node", "left")
    least = tmp.save(keyed.where("component is not null").groupBy("component").agg(F.min("own").alias("first")))
    keyed = keyed.where("component is not null or again").join(least, "component", "left").select("k", "k2", F.coalesce("first", "own").alias("first"))
    keyed = tmp.save(keyed)
    gone = lines.select("k", "k2", "own").join(keyed, ["k", "k2"]).where("own <> first")
    # an identical row (same id, same text) holds the same lines and keeps what its twin keeps
    return gone.groupBy(F.col("own.doc_id").alias("doc_id"), F.col("own.th").alias("th")).agg(F.sort_array(F.collect_set("own.pos")).alias("gone"))


def with_lines_removed(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text of each row cut, and ``n_lines, n_removed`` added (leading underscore if taken)."""
    gone = removed_lines(docs, edits, min_chars, id_col, text_col).select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("gone").alias("_gone"))
    names = {x: ("_" + x if x in docs.columns else x) for x in ("n_lines", "n_removed")}
    j = docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(text_col) == F.col("_th")), "left")
    parts = F.split(text_col, "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    return j.select(
        *[F.when(F.col("_gone").isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size(parts), F.lit(0)).alias(names["n_lines"]),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).alias(names["n_removed"]),
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = with_lines_removed(docs)
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: {docs} is the table to clean; the pipeline fills in its own.
LINES_SQL = r"""
ld AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM {docs}),
le AS (SELECT doc_id, unnest(parts) AS line, unnest(range(0, len(parts))) AS pos FROM ld),
ll AS (SELECT * FROM le WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lx AS (SELECT line, min(struct_pack(d := doc_id, p := pos)) AS own, length(line) AS n, row_number() OVER () AS node FROM ll GROUP BY line),
lp AS (SELECT a.node AS a, b.node AS b FROM lx a JOIN lx b ON a.n >= 30 AND b.n BETWEEN a.n AND a.n + 2 AND a.node <> b.node AND levenshtein(a.line, b.line) <= 2),
lq AS (SELECT a, b FROM lp UNION SELECT b, a FROM lp),
lr AS (SELECT a AS node, a AS seen FROM lq UNION SELECT lr.node, lq.b FROM lr JOIN lq ON lq.a = lr.seen),
lc AS (SELECT node, min(seen) AS m FROM lr GROUP BY node),
lo AS (SELECT line, min(own) OVER (PARTITION BY coalesce(m, -node)) AS first FROM lx LEFT JOIN lc USING (node)),
lg AS (SELECT doc_id, list(pos) AS gone FROM ll JOIN lo USING (line) WHERE struct_pack(d := doc_id, p := pos) <> first GROUP BY doc_id),
cut AS (SELECT ld.doc_id, coalesce(len(parts), 0) AS n_lines, coalesce(len(gone), 0) AS n_removed,
  CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string(list_transform(list_filter(range(0, len(parts)), lambda i: NOT list_contains(gone, i)), lambda i: parts[i + 1]), chr(10)), '') END AS text
  FROM ld LEFT JOIN lg USING (doc_id))
"""
OP9_SQL = "WITH RECURSIVE " + LINES_SQL.format(docs="documents") + "SELECT doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM cut"
