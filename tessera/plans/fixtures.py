"""Views of the given tables in the engine's shapes, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Scratch, load
from tessera.operators import raster as R

MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")

#: SQL of the same views.
CTE = {
    "raster": "raster AS (SELECT vec_id AS image, label AS type, CAST((i-1)//8 AS INT) AS row, CAST((i-1)%8 AS INT) AS col, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1,65)) AS i FROM embeddings))",
    "rgb0": "rgb0 AS (SELECT image // 3 AS image, row, col, least(greatest(CAST(floor((v+0.55)*250) AS INT),0),255) AS q, image % 3 AS k FROM raster)",
    "rgb": "rgb AS (SELECT * FROM (SELECT image, row, col, max(CASE WHEN k=0 THEN q END) AS r, max(CASE WHEN k=1 THEN q END) AS g, max(CASE WHEN k=2 THEN q END) AS b FROM rgb0 GROUP BY image, row, col) WHERE r IS NOT NULL AND g IS NOT NULL AND b IS NOT NULL)",
    "masks": "masks AS (SELECT image, row, col, v, v > 0.1 AS m1, abs(v) > 0.12 AS m2 FROM raster)",
    "sites": "sites AS (SELECT l_orderkey AS image, l_returnflag AS channel, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)",
    "pa": "pa AS (SELECT label AS grp, vec_id AS pid, (CAST(embedding[1] AS DOUBLE)+1)*100 AS y, (CAST(embedding[2] AS DOUBLE)+1)*100 AS x FROM embeddings)",
    "pb": "pb AS (SELECT o_custkey % 50 AS grp, o_orderkey AS pid, ((o_orderkey*7919) % 1009)/4e0 AS y, o_totalprice/1000e0 AS x FROM orders)",
    "names": "names AS (SELECT o_orderkey, 'Image_' || (212 + o_orderkey%4) || '.vsi - 20x_BF_01_col' || lpad(CAST(1+o_custkey%10 AS VARCHAR),2,'0') || '_row' || lpad(CAST(1+o_orderkey%12 AS VARCHAR),2,'0') || '.png' AS name FROM orders)",
    "meta": "meta AS (SELECT n_regionkey+1 AS r, CAST(floor(n_nationkey/5) AS INT)+1 AS c, n_name AS level FROM nation)",
    "diff": "diff AS (SELECT l_returnflag AS channel, ph AS phenotype, feature, CAST(o_orderkey AS VARCHAR) AS image, lv AS level, value FROM (SELECT l_returnflag, o_orderkey, l_linestatus, o_orderstatus, o_orderpriority, unnest(['l_quantity','l_extendedprice','l_discount','l_tax']) AS feature, unnest([l_quantity,l_extendedprice,l_discount,l_tax]) AS value FROM lineitem JOIN orders ON l_orderkey=o_orderkey), LATERAL (SELECT unnest(['linestatus','orderstatus','orderpriority']) AS ph, unnest([l_linestatus,o_orderstatus,o_orderpriority]) AS lv))",
    "pvals": "pvals AS (SELECT p_brand AS grp, p_partkey AS id, CASE WHEN p_partkey%11<>0 THEN (p_partkey%97+1)/100e0 END AS p FROM part)",
}
NEEDS = {"rgb0": ["raster"], "rgb": ["rgb0"], "masks": ["raster"]}


def cte(*names: str) -> str:
    """``WITH`` clause of the views named and those they need."""
    out: list[str] = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in out:
            out.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(CTE[n] for n in out)


def raster(spark: SparkSession, d: str) -> DataFrame:
    return R.from_arrays(load(spark, d, "embeddings").withColumnRenamed("label", "type"), "vec_id", "embedding", 8, "type")


def rgb(spark: SparkSession, d: str) -> DataFrame:
    q = F.least(F.greatest(F.floor((F.col("v") + 0.55) * 250), F.lit(0)), F.lit(255)).cast("int")
    p = raster(spark, d).select(F.floor(F.col("image") / 3).alias("image"), "row", "col", q.alias("q"), (F.col("image") % 3).alias("k"))
    w = p.groupBy("image", "row", "col").agg(*[F.max(F.when(F.col("k") == i, F.col("q"))).alias(c) for i, c in enumerate("rgb")])
    return w.where("r is not null and g is not null and b is not null")


def masks(spark: SparkSession, d: str) -> DataFrame:
    return raster(spark, d).select("image", "row", "col", "v", (F.col("v") > 0.1).alias("m1"), (F.abs("v") > 0.12).alias("m2"))


def sites(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_returnflag").alias("channel"), *MEASURES)


def points_a(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: (F.col("embedding")[i].cast("double") + 1) * 100
    return load(spark, d, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("pid"), e(0).alias("y"), e(1).alias("x"))


def points_b(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select((F.col("o_custkey") % 50).alias("grp"), F.col("o_orderkey").alias("pid"), ((F.col("o_orderkey") * 7919) % 1009 / F.lit(4.0)).alias("y"), (F.col("o_totalprice") / 1000.0).alias("x"))


def names(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return load(spark, d, "orders").select("o_orderkey", F.concat(F.lit("Image_"), (212 + F.col("o_orderkey") % 4).cast("string"), F.lit(".vsi - 20x_BF_01_col"), two(1 + F.col("o_custkey") % 10), F.lit("_row"), two(1 + F.col("o_orderkey") % 12), F.lit(".png")).alias("name"))


def meta(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select((F.col("n_regionkey") + 1).alias("r"), (F.floor(F.col("n_nationkey") / 5) + 1).cast("int").alias("c"), F.col("n_name").alias("level"))


def diff(spark: SparkSession, d: str, keep: bool = False) -> DataFrame:
    """Four measures against three groupings, long. Orders are hashed, so that no task sorts both tables.

    ``keep``: the joined rows are written, for analyses that read them more than once.
    """
    j = load(spark, d, "lineitem").join(load(spark, d, "orders").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    long = j.select(F.col("l_returnflag").alias("channel"), F.col("o_orderkey").cast("string").alias("image"), "l_linestatus", "o_orderstatus", "o_orderpriority", *MEASURES)
    long = Scratch(spark, "diff").save(long) if keep else long
    long = long.unpivot(["channel", "image", "l_linestatus", "o_orderstatus", "o_orderpriority"], list(MEASURES), "feature", "value")
    ph = F.explode(F.array(*[F.struct(F.lit(n).alias("phenotype"), F.col(c).alias("level")) for n, c in (("linestatus", "l_linestatus"), ("orderstatus", "o_orderstatus"), ("orderpriority", "o_orderpriority"))]))
    return long.select("channel", "image", "feature", "value", ph.alias("p")).select("channel", "p.phenotype", "feature", "image", "p.level", "value")


def pvals(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 11 != 0, (F.col("p_partkey") % 97 + 1) / F.lit(100.0)).alias("p"))
