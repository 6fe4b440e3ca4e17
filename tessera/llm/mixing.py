"""Mixing sources to target weights by a low-discrepancy source schedule.

The token line of a source is its documents in a seeded shuffled order, cut into blocks of equal
length. Slot ``i`` of the mix maps the golden-ratio point ``frac(i * 0.618...)`` through the cumulative
target shares to a source; the slots of a source are ranked, and rank ``r`` takes its ``r``-th block, going
round again (from another start) until each block was taken ``max_repeat`` times. Every stretch of the mix thus
holds the sources close to their shares.

Ranks and positions are prefix sums in two levels (within a bucket, then over bucket totals), so a source
that holds a third of all rows is not sorted in one task. Only sums over sources reach the driver.

Defined results: null text has size 0; null source is a source of its own, ordered last; null ids are rows
like others; repeated rows are separate documents; a very long text is one document of many blocks, counted where it is read; ties in the shuffle go by hash and position; other columns are not read; an empty
table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 64
#: floor(2**32 / golden ratio), odd: a Weyl sequence on 32 bits.
GOLDEN = 2654435769
#: Cells of the unit interval by which slots find their source: at least CELLS, and four times as many as sources.
CELLS = 1024
SLOT_CHUNK = 8192


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float = 1.5, max_repeat: int = 2, weights=WEIGHTS) -> DataFrame:
    """``s, source, source_size, target, lo, hi``: shares are filled up by weight below each cap.

    A cap is ``max_repeat`` times the source's size. In order of cap / weight, the first source that the
    common level does not fill up, and all after it, get weight times that level.
    """
    one = W.orderBy(F.lit(0))
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("s", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    up = W.orderBy((F.col("cap") / F.col("w")).asc(), F.col("s"))
    total = F.sum("source_size").over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(share)
    by = by.withColumn("level", (total - F.coalesce(F.sum("cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(up.rowsBetween(0, W.unboundedFollowing)))
    by = by.withColumn("common", F.first(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level")), ignorenulls=True).over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    by = by.withColumn("target", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("common"))))
    whole = F.sum("target").over(one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    upto = F.sum("target").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, 0))
    before = F.coalesce(F.sum("target").over(W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return by.select("s", "source", "source_size", "target", F.try_divide(before, whole).alias("lo"), F.try_divide(upto, whole).alias("hi"))


def mix_schedule(docs: DataFrame, share: float = 1.5, max_repeat: int = 2, weights=WEIGHTS, block_words: int = BLOCK_WORDS, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
    """``(pieces, sized, sources)``.

    ``pieces``: ``slot, s, row, from_word, to_word``, which words of which row each slot takes.
    ``sized``: ``row, doc_id, source, s, size``, one per input row. ``sources``: see ``source_targets``.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "mix")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    d = tmp.save(d.withColumn("h", F.md5(F.concat_ws("|", F.lit(seed), "doc_id", "source", "size"))).withColumn("row", F.monotonically_increasing_id()))
    sources = tmp.save(source_targets(d, share, max_repeat, weights))
    sized = tmp.save(d.alias("d").join(sources.select("s", F.col("source").alias("of")).alias("b"), F.col("source").eqNullSafe(F.col("of"))).drop("of"))

    # position of each document on its source's token line
    sized_b = sized.withColumn("bucket", F.substring("h", 1, 3))
    part = sized_b.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    part = tmp.save(part.select("s", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    inside = F.sum("size").over(W.partitionBy("s", "bucket").orderBy("h", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = sized_b.where("size > 0").withColumn("inside", inside).join(part, ["s", "bucket"]).select("s", "row", "size", (F.col("base") + F.col("inside")).alias("a"))
    spans = placed.select("s", "row", "a", "size", F.explode(F.sequence(F.floor(F.col("a") / block_words), F.floor((F.col("a") + F.col("size") - 1) / block_words))).alias("block"))

    # slots: golden-ratio points through the cumulative shares
    goal, n = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count("*")).first()
    n_cells = max(CELLS, 4 * n)
    slots = spark.range(int(-(-goal // block_words))).withColumnRenamed("id", "slot")
    point = F.pmod((F.pmod(F.col("slot"), F.lit(1 << 31)) + 1) * F.lit(GOLDEN), F.lit(1 << 32)) / F.lit(float(1 << 32))
    slots = slots.withColumn("u", point).withColumn("cell", F.floor(F.col("u") * n_cells))
    cells = sources.where("hi > lo").select("s", "lo", "hi", F.ceil(F.col("source_size") / block_words).alias("blocks"), F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1)))).alias("cell"))
    slots = slots.join(cells, "cell").where("u >= lo and u < hi").select("slot", "s", "blocks", F.floor(F.col("slot") / SLOT_CHUNK).alias("chunk"))
    slots = tmp.save(slots)
    count = slots.groupBy("s", "chunk").agg(F.count("*").alias("n"))
    count = tmp.save(count.select("s", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base")))
    ranked = slots.withColumn("k", F.row_number().over(W.partitionBy("s", "chunk").orderBy("slot")) - 1).join(count, ["s", "chunk"]).withColumn("r", F.col("base") + F.col("k"))
    ranked = ranked.where(F.col("r") < F.col("blocks") * max_repeat).withColumn("pass", F.floor(F.col("r") / F.col("blocks")))
    ranked = ranked.select("slot", "s", F.pmod(F.col("r") + F.col("pass") * F.floor(F.col("blocks") / 2), F.col("blocks")).alias("block"))
    start, stop = F.greatest(F.col("a"), F.col("block") * block_words), F.least(F.col("a") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = ranked.join(spans, ["s", "block"]).select("slot", "s", "row", (start - F.col("a")).alias("from_word"), (stop - F.col("a")).alias("to_word"))
    return pieces, sized.select("row", "doc_id", "source", "s", "size"), sources


def mix_counts(docs: DataFrame, **how) -> DataFrame:
    """Per row: ``doc_id, size, source_size, target, taken`` (words the mix takes, repeats counted)."""
    pieces, sized, sources = mix_schedule(docs, **how)
    taken = pieces.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    out = sized.join(sources.select("s", "source_size", "target"), "s").join(taken, "row", "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: {docs} is the table to mix; the pipeline fills in its own.
MIX_SQL = r"""
d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM {docs}),
h AS (SELECT *, md5(concat_ws('|', 'mix', doc_id, source, size)) AS h, row_number() OVER () AS rid FROM d),
b0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
b1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS s FROM b0),
b2 AS (SELECT *, CAST(CASE (s - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w, source_size * 2e0 AS cap, sum(source_size) OVER () * 1.5e0 AS total FROM b1),
b3 AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0)) / sum(w) OVER (ORDER BY cap / w, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b2),
b4 AS (SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS common FROM b3),
b5 AS (SELECT s, source, source_size, CASE WHEN common IS NULL THEN cap ELSE least(cap, w * common) END AS target FROM b4),
b6 AS (SELECT *, coalesce(sum(target) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) / nullif(sum(target) OVER (), 0) AS lo, sum(target) OVER (ORDER BY s) / nullif(sum(target) OVER (), 0) AS hi, (source_size + 63) // 64 AS blocks FROM b5),
pos AS (SELECT h.*, b6.s, sum(size) OVER (PARTITION BY b6.s ORDER BY h, rid ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS a FROM h JOIN b6 ON h.source IS NOT DISTINCT FROM b6.source),
sp AS (SELECT s, rid, a, size, unnest(range(CAST(a // 64 AS BIGINT), CAST((a + size - 1) // 64 + 1 AS BIGINT))) AS block FROM pos WHERE size > 0),
sl AS (SELECT slot, ((slot % 2147483648 + 1) * 2654435769 % 4294967296) / 4294967296e0 AS u FROM (SELECT unnest(range(CAST(ceil((SELECT sum(target) FROM b5) / 64) AS BIGINT))) AS slot)),
rk AS (SELECT slot, s, blocks, row_number() OVER (PARTITION BY s ORDER BY slot) - 1 AS r FROM sl JOIN b6 ON u >= lo AND u < hi),
tk AS (SELECT s, (r + (r // blocks) * (blocks // 2)) % blocks AS block FROM rk WHERE r < 2 * blocks),
tt AS (SELECT rid, sum(least(a + size, (block + 1) * 64) - greatest(a, block * 64)) AS taken FROM tk JOIN sp USING (s, block) GROUP BY rid),
mixed AS (SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM pos JOIN b6 USING (s) LEFT JOIN tt USING (rid))
"""
OP5_SQL = "WITH " + MIX_SQL.format(docs="documents") + "SELECT * FROM mixed"
