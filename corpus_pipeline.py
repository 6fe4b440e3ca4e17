"""A training corpus from ``documents``: five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``documents``.

1. toxicity: documents predicted toxic go.
2. line dedup: near copies of earlier lines are cut; a document left without text goes.
3. n-gram Jaccard join: of each component the row with the smallest id stays (null last, then by hash of the text); of rows equal in id and text, one.
4. benchmark decontamination: rows that hold a benchmark item go.
5. mixing: words that the mix takes of each document.

Stages work on rows: rows that share an id live and die apart. ``n_chars`` follows the text. Null and blank texts have no lines, no shingles and no leaks, and stay.
Very long texts go through each stage whole, as its operator states; other columns of the input are dropped by the first stage, also those with names that stages use; ties go by id, then by hash of the text. Empty tables give empty tables;
without labels nothing is toxic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Scratch, scratch_scope
from tessera.llm import decontaminate, line_dedup, mixing, ngram_jaccard, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=COLUMNS).where("score < 0.5").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.with_lines_removed(docs.select(COLUMNS))
    emptied = (F.col("n_removed") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.where(~emptied).withColumn("n_chars", n_chars).select(COLUMNS)


def row_key() -> Column:
    """A row by its id and text; rows equal in both are one."""
    return F.xxhash64("doc_id", "text")


def second_key() -> Column:
    """Tells rows apart that ``row_key`` does not."""
    return F.xxhash64(F.lit("second"), "text", "doc_id")


def shared_keys(docs: DataFrame, tmp: Scratch) -> DataFrame:
    """Keys of several rows, and whether these are different rows (``clash``), as is to be expected among some 10^10 rows."""
    keys = docs.select(row_key().alias("_key"), second_key().alias("_s")).groupBy("_key")
    return tmp.save(keys.agg(F.count("*").alias("rows"), (F.min("_s") != F.max("_s")).alias("clash")).where("rows > 1").select("_key", "clash"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "documents")
    shared = shared_keys(docs, tmp)
    keyed = docs.select(row_key().alias("_key"), "doc_id", "text")
    comp = ngram_jaccard.jaccard_components(keyed, id_col="_key").select(F.col("doc_id").alias("_key"), "component_id")
    comp = tmp.save(comp.groupBy("_key").agg(F.first("component_id").alias("component_id")))
    # rows that have company: only their ids are looked at
    groups = tmp.save(comp.groupBy("component_id").agg(F.count("*").alias("n")).where("n > 1").select("component_id"))
    some = comp.join(groups, "component_id").join(docs.select(row_key().alias("_key"), "doc_id"), "_key")
    first = some.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_key")).alias("first"))
    gone = some.join(first, "component_id").where("_key <> first._key").select("_key").distinct()
    gone = tmp.save(gone.join(shared.where("clash"), "_key", "left_anti"))
    rows = docs.select(COLUMNS).withColumn("_key", row_key()).join(gone, "_key", "left_anti")
    once = rows.join(shared, "_key", "left_anti")
    return once.unionByName(rows.join(shared, "_key", "left_semi").withColumn("_s", second_key()).dropDuplicates(["_key", "_s"]).drop("_s")).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tmp = Scratch(spark, "leaks")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = lambda rows, key: decontaminate.find_leaks(rows.withColumn("doc_id", key), items).select(F.col("doc_id").alias("_key")).distinct()
    clash = shared_keys(docs, tmp).where("clash").select("_key")
    found = leaks(docs, row_key())
    if clash.isEmpty():
        return docs.join(found, row_key() == F.col("_key"), "left_anti").select(COLUMNS)
    keyed = docs.withColumn("_row", row_key())
    apart = tmp.save(keyed.join(clash, keyed["_row"] == clash["_key"], "left_semi").select(COLUMNS))
    clean = keyed.join(found.unionByName(clash), F.col("_row") == F.col("_key"), "left_anti").select(COLUMNS)
    return clean.unionByName(apart.join(leaks(apart, second_key()), second_key() == F.col("_key"), "left_anti").select(COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard", dedup_documents), ("decontaminate", drop_leaks), ("mixing", mix)]

#: Toxicity is a learned score, which SQL can't express; tests hold run() against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again, and goes once the next one is written.

    A stage's scratch tables belong to whoever calls it (see ``core.scratch_scope``) and are needed until its result is written.
    """
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark, "pipeline")
    for _, f in STAGES:
        with scratch_scope():
            after = kept.save(f(spark, docs, sf_dir))
        kept.drop(docs)
        docs = after
    return docs
