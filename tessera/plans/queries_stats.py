"""Scalar statistics, keys, joins, tests, windows, sorting and unions."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.core import Scratch, _at, load, ship
from tessera.functions import keys as K
from tessera.functions import stats as S
from tessera.operators import difftest as T
from tessera.operators import scans
from tessera.operators import tiles as TL
from tessera.plans import fixtures as X
from tessera.plans.registry import SQL, query, r6
from tessera.sources import tables as IO

SITES = X.cte("sites")
BY = "FROM sites GROUP BY image, channel"
X_ = "l_extendedprice"


@query("A01_finite", f"{SITES} SELECT channel, count(*) AS n, count(CASE WHEN l_discount > 0 THEN ln(l_discount) END) AS n_finite, {r6('avg(CASE WHEN l_discount > 0 THEN ln(l_discount) END)', 'mean')} FROM sites GROUP BY channel")
def a01(spark, d):
    v = F.when(F.col("l_discount") > 0, F.log("l_discount")).otherwise(F.lit(float("-inf")))
    return X.sites(spark, d).withColumn("v", v).groupBy("channel").agg(F.count("*").alias("n"), S.number("v").alias("n_finite"), S.mean("v").alias("mean"))


@query("A02_mean_min_max_median", f"{SITES} SELECT image, channel, {r6('avg(l_extendedprice)', 'mean')}, {r6('min(l_extendedprice)', 'mn')}, {r6('max(l_extendedprice)', 'mx')}, {r6('median(l_extendedprice)', 'median')}, {r6('quantile_cont(l_extendedprice, 0.9)', 'p90')} {BY}")
def a02(spark, d):
    return X.sites(spark, d).groupBy("image", "channel").agg(S.mean(X_).alias("mean"), S.least(X_).alias("mn"), S.most(X_).alias("mx"), S.median(X_).alias("median"), S.percentile(X_, 0.9).alias("p90"))


@query("A03_sd", f"{SITES} SELECT image, channel, {r6('CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(l_extendedprice) END', 'sd')}, {r6('stddev_pop(l_extendedprice)', 'sd0')} {BY}")
def a03(spark, d):
    return X.sites(spark, d).groupBy("image", "channel").agg(S.sd(X_).alias("sd"), S.sd(X_, 0).alias("sd0"))


@query("A04_iqr", f"{SITES} SELECT image, channel, {r6('quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25)', 'iqr')} {BY}")
def a04(spark, d):
    return X.sites(spark, d).groupBy("image", "channel").agg(S.iqr(X_).alias("iqr"))


@query("A05_cv", f"{SITES} SELECT image, channel, {r6('CASE WHEN abs(avg(l_discount)) < 1e-12 THEN NULL WHEN count(*) = 1 THEN 0 ELSE stddev_samp(l_discount) / avg(l_discount) END', 'cv')} {BY}")
def a05(spark, d):
    return X.sites(spark, d).groupBy("image", "channel").agg(S.cv("l_discount").alias("cv"))


@query("A06_skew", f"{SITES} SELECT image, channel, {r6('CASE WHEN count(*) >= 3 AND max(l_quantity) - min(l_quantity) >= 1e-12 THEN skewness(l_quantity) END', 'skew')} {BY}")
def a06(spark, d):
    return X.sites(spark, d).groupBy("image", "channel").agg(S.skew("l_quantity").alias("skew"))


@query("A07_kurtosis", f"{SITES} SELECT image, channel, {r6('CASE WHEN count(*) >= 4 AND max(l_quantity) - min(l_quantity) >= 1e-12 THEN kurtosis(l_quantity) END', 'kurtosis')} {BY}")
def a07(spark, d):
    return X.sites(spark, d).groupBy("image", "channel").agg(S.kurtosis("l_quantity").alias("kurtosis"))


@query("A08_pearson", f"{SITES} SELECT image, {r6('CASE WHEN count(*) >= 3 AND stddev_pop(l_quantity) >= 1e-12 AND stddev_pop(l_discount) >= 1e-12 THEN corr(l_quantity, l_discount) END', 'r')} FROM sites GROUP BY image")
def a08(spark, d):
    return X.sites(spark, d).groupBy("image").agg(S.pearson("l_quantity", "l_discount").alias("r"))


@query("A09_entropy", f"{SITES}, p AS (SELECT image, l_discount AS v, l_discount / sum(l_discount) OVER (PARTITION BY image) AS p FROM sites) SELECT image, {r6('coalesce(-sum(CASE WHEN v > 0 THEN p * log2(p) END), 0)', 'entropy')} FROM p GROUP BY image")
def a09(spark, d):
    return S.entropy(X.sites(spark, d), ["image"], "l_discount")


@query("A10_gini", f"{SITES}, p AS (SELECT image, l_discount AS v, row_number() OVER (PARTITION BY image ORDER BY l_discount) AS i FROM sites) SELECT image, {r6('CASE WHEN max(abs(v)) <= 1e-8 THEN 0 ELSE (2 * sum(i * v) - (count(*) + 1) * sum(v)) / (count(*) * sum(v)) END', 'gini')} FROM p GROUP BY image")
def a10(spark, d):
    return scans.gini(X.sites(spark, d), ["image"], S.finite("l_discount"))


def bins_sql(v: str, p: str) -> str:
    v = f"least(greatest({v}, 0e0), 1e0)"
    lv = f"(CASE WHEN {v} >= 0.75 THEN 3 WHEN {v} >= 0.5 THEN 2 WHEN {v} >= 0.25 THEN 1 WHEN {v} IS NOT NULL THEN 0 END)"
    return ", ".join([*[r6(f"avg(CASE WHEN {lv} IS NULL THEN NULL WHEN {lv} = {k} THEN 1e0 ELSE 0e0 END)", f"{p}_frac_{s}") for k, s in enumerate(("0", "1plus", "2plus", "3plus"))], r6(f"avg({lv}) * 100", f"{p}_hscore")])


@query("A11_score_bins", f"{SITES} SELECT image, {bins_sql('l_quantity / 50', 'q')} FROM sites GROUP BY image")
def a11(spark, d):
    return X.sites(spark, d).withColumn("v", F.col("l_quantity") / 50).groupBy("image").agg(*S.score_bins("v", "q"))


SUM = {"mean": "avg({c})", "sd": "CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp({c}) END", "iqr": "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)", "median": "median({c})"}


def summary_sql(keys: str, cols, aggs, name: str) -> str:
    return f"{SITES} SELECT {keys}, " + ", ".join(r6(SUM[a].format(c=c), name.format(col=c, agg=a)) for c in cols for a in aggs) + f" FROM sites GROUP BY {keys}"


@query("A12_numeric_columns", summary_sql("channel", X.MEASURES, ("mean", "sd", "iqr", "median"), "{col}_{agg}"))
def a12(spark, d):
    return scans.summarise(X.sites(spark, d), ["channel"], list(X.MEASURES), ("mean", "sd", "iqr", "median"))


@query("A13_image_summary", summary_sql("image, channel", X.MEASURES, ("median", "iqr"), "{col}_{agg}"))
def a13(spark, d):
    return S.summarise(X.sites(spark, d), ["image", "channel"], list(X.MEASURES), ("median", "iqr"))


@query("A14_site_aggregates", summary_sql("image, channel", X.MEASURES, ("iqr", "median"), "sites_{col}_{agg}"))
def a14(spark, d):
    return S.summarise(X.sites(spark, d), ["image", "channel"], list(X.MEASURES), name="sites_{col}_{agg}")


@query("A16_object_scores", f"{SITES}, m AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY image) AS mx FROM sites) SELECT image, {bins_sql('l_quantity / 50', 'object_norm_mean')}, {bins_sql('CASE WHEN mx > 0 THEN l_extendedprice / mx ELSE l_extendedprice END', 'object_norm_integrated')} FROM m GROUP BY image")
def a16(spark, d):
    s = X.sites(spark, d)
    top = s.groupBy("image").agg(S.most(X_).alias("mx"))
    s = s.join(top, "image").withColumn("share", F.when(F.col("mx") > 0, F.col(X_) / F.col("mx")).otherwise(F.col(X_))).withColumn("q", F.col("l_quantity") / 50)
    return s.groupBy("image").agg(*S.score_bins("q", "object_norm_mean"), *S.score_bins("share", "object_norm_integrated"))


DIFF = X.cte("diff")


@query("A37_group_means", f"{DIFF} SELECT channel, phenotype, feature, level, count(value) AS n, {r6('avg(value)', 'mean')} FROM diff GROUP BY ALL")
def a37(spark, d):
    return T.group_stats(X.diff(spark, d), ["channel", "phenotype", "feature"]).select("channel", "phenotype", "feature", "level", "n", "mean")


@query("A42_legacy_summary", summary_sql("image", X.MEASURES, ("mean", "sd", "iqr"), "{col}_{agg}"))
def a42(spark, d):
    return S.summarise(X.sites(spark, d), ["image"], list(X.MEASURES), ("mean", "sd", "iqr"))


NAMES = X.cte("names")
VARIED = "CASE o_orderkey % 5 WHEN 0 THEN 'a/b/' || name WHEN 1 THEN 'core_x' || o_orderkey || '.tif' WHEN 2 THEN 'plain' || o_orderkey || '.png' WHEN 3 THEN 'S_R' || (o_orderkey % 9) || '_C' || (o_orderkey % 7) || '_z.jpg' ELSE 'T_row3_x_col' || (o_orderkey % 6) || '.png' END"


def varied(spark, d):
    k = F.col("o_orderkey")
    s = lambda x: x.cast("string")
    v = F.when(k % 5 == 0, F.concat(F.lit("a/b/"), "name")).when(k % 5 == 1, F.concat(F.lit("core_x"), s(k), F.lit(".tif"))).when(k % 5 == 2, F.concat(F.lit("plain"), s(k), F.lit(".png")))
    v = v.when(k % 5 == 3, F.concat(F.lit("S_R"), s(k % 9), F.lit("_C"), s(k % 7), F.lit("_z.jpg"))).otherwise(F.concat(F.lit("T_row3_x_col"), s(k % 6), F.lit(".png")))
    return X.names(spark, d).select("o_orderkey", v.alias("path"))


@query("P01_type_key", f"{NAMES}, n AS (SELECT o_orderkey, regexp_extract({VARIED}, '([^/]*)$', 1) AS f FROM names) SELECT o_orderkey, coalesce(nullif(regexp_extract(f, '_(\\d+)', 1), ''), CASE WHEN contains(f, '_') THEN split_part(f, '_', 1) END, regexp_replace(f, '^(.+)\\.[^.]*$', '\\1')) AS type FROM n")
def p01(spark, d):
    return varied(spark, d).select("o_orderkey", K.type_key(F.col("path")).alias("type"))


def rc_sql(order):
    return "coalesce(" + ", ".join(f"TRY_CAST(nullif(regexp_extract(f, '(?i){p}', {g}), '') AS BIGINT)" for p, g in order) + ")"


P = (r"r(\d+)_c(\d+)", r"col(\d+).*row(\d+)", r"row(\d+).*col(\d+)")


@query("P02_grid_position", f"{NAMES}, n AS (SELECT o_orderkey, {VARIED} AS f FROM names) SELECT o_orderkey, {rc_sql([(P[0], 1), (P[1], 2), (P[2], 1)])} AS r, {rc_sql([(P[0], 2), (P[1], 1), (P[2], 2)])} AS c FROM n")
def p02(spark, d):
    r, c = K.grid_position(F.col("path"))
    return varied(spark, d).select("o_orderkey", r.alias("r"), c.alias("c"))


@query("P03_base_name", f"{NAMES} SELECT o_orderkey, regexp_replace(regexp_extract({VARIED}, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS base FROM names")
def p03(spark, d):
    return varied(spark, d).select("o_orderkey", K.base_name(F.col("path")).alias("base"))


@query("P04_types", f"{NAMES}, t AS (SELECT regexp_extract(name, '_(\\d+)', 1) AS type FROM names) SELECT type, count(*) AS n FROM t WHERE type IN ('212', '214') GROUP BY type")
def p04(spark, d):
    return X.names(spark, d).select(K.type_key(F.col("name")).alias("type")).where(F.col("type").isin("212", "214")).groupBy("type").agg(F.count("*").alias("n"))


META = X.cte("meta")


@query("P05_P06_control", f"{META} SELECT r, CAST(c AS BIGINT) AS c, level FROM meta WHERE NOT (r = 1 AND c = 1) AND level IS NOT NULL AND level <> 'KC'")
def p05(spark, d):
    return K.real_levels(K.not_control(X.meta(spark, d)))


SUFFIX = ("area_px", "density_per_px", "intensity_mean", "intensity_raw_mean", "tile_g4_intensity_mean_sd", "solidity")
NAMED = f"named AS (SELECT p_partkey, lower(replace(p_brand, '#', '_')) || '_' || [{', '.join(repr(x) for x in SUFFIX)}][p_partkey % 6 + 1] AS feature FROM part)"


@query("P07_P08_features", f"WITH {NAMED} SELECT p_partkey, feature, feature NOT LIKE '%\\_px%' ESCAPE '\\' AND (feature LIKE '%intensity\\_raw%' ESCAPE '\\' OR feature NOT LIKE '%intensity%') AS tested, feature LIKE '%\\_px%' ESCAPE '\\' AS legacy FROM named")
def p07(spark, d):
    name = F.concat(F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("_"), F.element_at(F.array(*map(F.lit, SUFFIX)), (F.col("p_partkey") % 6 + 1).cast("int")))
    f = load(spark, d, "part").select("p_partkey", name.alias("feature"))
    return f.select("p_partkey", "feature", K.testable(F.col("feature")).alias("tested"), K.legacy(F.col("feature")).alias("legacy"))


@query("P08_legacy_outputs", "SELECT 'summary' AS part, 'n' || n_nationkey || CASE WHEN n_regionkey % 2 = 0 THEN '_px' ELSE '_per_px2' END AS \"column\" FROM nation WHERE n_regionkey % 3 <> 1 UNION ALL SELECT 'sites', 'r' || r_regionkey || '_PX' FROM region WHERE r_regionkey % 2 = 0")
def p08(spark, d):
    """Column names come from the nations (of a summary) and from the regions (of site files)."""
    root = Scratch(spark, "legacy").root
    n = load(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey", F.when(F.col("n_regionkey") % 3 == 1, "_um").when(F.col("n_regionkey") % 2 == 0, "_px").otherwise("_per_px2")).alias("name"), F.col("n_regionkey").alias("v"))
    r = load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey", F.when(F.col("r_regionkey") % 2 == 0, "_PX").otherwise("_um2")).alias("name"), F.col("r_regionkey").alias("v"))
    wide = lambda t: t.groupBy().pivot("name").agg(F.first("v"))
    IO.write_csv(wide(r), f"{root}/212/sites")
    return IO.legacy_outputs(wide(n), f"{root}/212/sites")


@query("P09_sanitize", "SELECT p_partkey, regexp_replace(p_name || ' (' || p_type || ')', '[^A-Za-z0-9_.-]', '_', 'g') AS s FROM part")
def p09(spark, d):
    return load(spark, d, "part").select("p_partkey", K.sanitize(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))).alias("s"))


@query("P10_scale_labels", "SELECT p_partkey, 's' || replace(replace(format('{:.3g}', p_size * 0.2738), '.', 'p'), '-', 'm') || 'um' AS label FROM part")
def p10(spark, d):
    """Labels are made once per distinct length, by the function that names feature columns."""
    part = load(spark, d, "part").select("p_partkey", "p_size")
    sizes = [r["p_size"] for r in part.select("p_size").distinct().collect()]  # the scales of a run are few
    labels = spark.createDataFrame([(k, K.scale_label(k * 0.2738)) for k in sizes] or [(None, None)], "p_size int, label string")
    return part.join(F.broadcast(labels), "p_size").select("p_partkey", "label")


DUP = "(SELECT n_regionkey + 1 AS r, n_nationkey % 5 + 1 AS c, n_name AS level, CAST(n_nationkey AS BIGINT) AS name FROM nation)"


@query("J01_summary_metadata", f"{NAMES}, s AS (SELECT o_orderkey, name, CAST(regexp_extract(name, 'row(\\d+)', 1) AS BIGINT) AS r, CAST(regexp_extract(name, 'col(\\d+)', 1) AS BIGINT) AS c FROM names) SELECT o_orderkey, s.name, s.r, s.c, level, m.name AS name_meta FROM s LEFT JOIN {DUP} m ON s.r = m.r AND s.c = m.c")
def j01(spark, d):
    r, c = K.grid_position(F.col("name"))
    s = X.names(spark, d).withColumn("r", r).withColumn("c", c)
    m = load(spark, d, "nation").select((F.col("n_regionkey") + 1).alias("r"), (F.col("n_nationkey") % 5 + 1).alias("c"), F.col("n_name").alias("level"), F.col("n_nationkey").alias("name"))
    return IO.with_metadata(s, m)


@query("J02_summary_sites", f"{SITES}, a AS (SELECT image, channel, {r6('median(l_quantity)', 'sites_l_quantity_median')} FROM sites GROUP BY image, channel) SELECT o_orderkey AS image, channel, o_totalprice, sites_l_quantity_median FROM orders LEFT JOIN a ON o_orderkey = image")
def j02(spark, d):
    a = S.summarise(X.sites(spark, d), ["image", "channel"], ["l_quantity"], ("median",), "sites_{col}_{agg}")
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("image"), "o_totalprice").join(a, "image", "left")


@query("J03_image_params", f"{NAMES}, n AS (SELECT o_orderkey, regexp_extract(name, '_(\\d+)', 1) AS type FROM names), p AS (SELECT CAST(212 + r_regionkey AS VARCHAR) AS type, r_name AS engine FROM region) SELECT o_orderkey, type, engine FROM n JOIN p USING (type)")
def j03(spark, d):
    p = load(spark, d, "region").select((212 + F.col("r_regionkey")).cast("string").alias("type"), F.col("r_name").alias("engine"))
    return X.names(spark, d).select("o_orderkey", K.type_key(F.col("name")).alias("type")).join(p, "type")


@query("J13_produced_channels", f"{SITES} SELECT a.image, a.channel AS this, b.channel AS other FROM (SELECT DISTINCT image, channel FROM sites) a JOIN (SELECT DISTINCT image, channel FROM sites) b ON a.image = b.image AND a.channel <> b.channel")
def j13(spark, d):
    c = X.sites(spark, d).select("image", "channel").distinct()
    return c.withColumnRenamed("channel", "this").join(c.withColumnRenamed("channel", "other"), "image").where("this <> other")


@query("S04_U01_union", "SELECT s_suppkey AS id, s_name AS name, s_acctbal AS bal, CAST(NULL AS VARCHAR) AS seg FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def s04(spark, d):
    a = load(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    b = load(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    return IO.union_summaries([a, b])


@query("S05_metadata", "SELECT * FROM (SELECT TRY_CAST(CASE WHEN n_nationkey % 7 = 3 THEN 'x' ELSE CAST(n_regionkey + 1 AS VARCHAR) END AS BIGINT) AS r, CAST(n_nationkey // 5 + 1 AS BIGINT) AS c, n_name AS level FROM nation) WHERE NOT (r = 1 AND c = 1)")
def s05(spark, d):
    m = X.meta(spark, d)
    n = load(spark, d, "nation").select(F.col("n_name").alias("level"), (F.col("n_nationkey") % 7 == 3).alias("bad"))
    return IO.clean_metadata(m.join(n, "level").select(F.when(F.col("bad"), "x").otherwise(F.col("r").cast("string")).alias("r"), F.col("c").cast("string").alias("c"), "level"))


def _sheets(root: str):
    """Writes the rows of a type's part, a hundred to a file that is named by the part and its place: Spark's writers take some 20 ms a file."""

    def work(rows: pa.Table) -> pa.Table:
        store, base = fs.FileSystem.from_uri(root)
        kind, part = rows.column("type")[0], rows.column("_part")[0]
        store.create_dir(f"{base}/type={kind}", recursive=True)
        starts = range(0, rows.num_rows, 100)
        for i in starts:
            with store.open_output_stream(f"{base}/type={kind}/{part}-{i // 100}.PNG") as f:
                csv.write_csv(rows.slice(i, 100).select(["o_orderkey", "name"]), f, csv.WriteOptions(include_header=False))
        return pa.table({"files": [len(starts)]})

    return work


@query("S01_image_list", f"{NAMES}, t AS (SELECT regexp_extract(name, '_(\\d+)', 1) AS folder, count(*) AS n FROM names GROUP BY ALL) SELECT folder, 'png' AS kind, CAST(ceil(n / 100e0) AS BIGINT) AS n FROM t")
def s01(spark, d):
    """Files of a hundred names at most, each type in a folder of its own: images with a capital extension, and notes that are no images.

    All tasks write: the names of a type are dealt to parts, and of each part what fills no file goes to one task, so that a type has no more files than in one task.
    """
    root = Scratch(spark, "files").root
    n = X.names(spark, d).withColumn("type", K.type_key(F.col("name")))
    part = F.pmod(F.hash("o_orderkey"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    w = W.partitionBy("type", "_part")
    dealt = n.withColumn("_part", part).withColumns({"_i": F.row_number().over(w.orderBy("o_orderkey")), "_n": F.count("*").over(w)})
    dealt = dealt.select("o_orderkey", "name", "type", F.when(F.col("_i") <= F.col("_n") - F.col("_n") % 100, F.col("_part")).alias("_part"))
    TL.over_groups(dealt, ["type", "_part"], _sheets(f"{root}/a/images"), "files long", ("o_orderkey",)).agg(F.sum("files")).collect()
    n.write.option("extension", "txt").partitionBy("type").csv(f"{root}/a/notes")
    f = IO.list_images(spark, root)
    return f.groupBy(F.regexp_extract("path", "type=([^/]*)/", 1).alias("folder"), F.lower(F.substring_index("name", ".", -1)).alias("kind")).agg(F.count("*").alias("n"))


@query("S03_site_scan", f"""SELECT 'dab' AS channel, l_linestatus AS image, count(*) AS n, {r6('sum(l_tax)', 'tax')}, {r6('sum(l_discount)', 'discount')}, 0 AS skipped FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL
UNION ALL SELECT 'eosin', 'X' || l_linestatus, count(*), round(sum(l_tax), 6) + 0e0, NULL, 0 FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL
UNION ALL SELECT '-', reason, NULL, NULL, NULL, count(*) FROM (SELECT DISTINCT l_linestatus, unnest(['no column image', 'not a site file', 'first row names no image', 'rows longer than the header', 'no rows', 'not in a channel folder']) AS reason FROM lineitem WHERE l_returnflag = 'N') GROUP BY reason""")
def s03(spark, d):
    """A folder tree of two versions of site files, whose columns are in another order, and of files to be left out; each is one image's.

    A task of the table writes a file of each image, as one task for all rows would have to sort them.
    """
    root = Scratch(spark, "sites").root
    s = load(spark, d, "lineitem").select("l_linestatus", "l_returnflag", F.col("l_tax").cast("string").alias("tax"), F.col("l_discount").cast("string").alias("discount"))

    def put(rows, folder: str, end: str, header: str):
        """One file for each line status, as text lines below their header."""
        lines = rows.select(F.col("l_linestatus").alias("f"), F.col("line"), F.lit(1).alias("o")).unionByName(rows.select(F.col("l_linestatus").alias("f"), F.lit(header).alias("line"), F.lit(0).alias("o")).distinct())
        lines.repartition(1).sortWithinPartitions("f", "o").select("f", "line").write.mode("append").option("extension", end).partitionBy("f").text(f"{root}/_raw/{folder}")
        place(folder, end, header)

    def sheets(rows, folder: str):
        """Files of all tasks, each with its header, as CSV."""
        rows.write.option("header", True).partitionBy("f").csv(f"{root}/_raw/{folder}")
        place(folder, "_sites.csv", ",".join(rows.columns[1:]))

    def place(folder: str, end: str, header: str):
        fs, at = _at(spark, f"{root}/_raw/{folder}")
        for i, part in enumerate(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_raw/{folder}/f=*/*"))):  # a file for each status
            to = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/features/212/{folder}/{header.count(',')}_{i}{end}")
            fs.mkdirs(to.getParent())
            fs.rename(part.getPath(), to)
        fs.delete(at, True)

    of = lambda flag, *c: s.where(F.col("l_returnflag") == flag).select(F.col("l_linestatus").alias("f"), *c)
    sheets(of("R", F.lit("7").alias("label"), F.col("l_linestatus").alias("image"), "tax", "discount"), "dab")
    sheets(of("A", "tax", F.concat(F.lit("X"), "l_linestatus").alias("image")), "eosin")
    one = s.where("l_returnflag = 'N'").select("l_linestatus").distinct()
    line = lambda text: one.withColumn("line", F.lit(text))
    put(line("1,2"), "dab", "_sites.csv", "label,tax")
    put(line("hello"), "dab", "notes.csv", "image")
    put(line(",2,3,4,5"), "dab", "_sites.csv", "image,tax,a,b,c")
    put(line("im,2,3,4,5,6,7"), "dab", "_sites.csv", "image,tax,a,b,c,d")
    put(line(" "), "dab", "_sites.csv", "image,tax,a,b,c,d,e")
    put(line("im,2"), ".", "_sites.csv", "image,tax")
    rows, left = IO.scan_sites(spark, root, "212", "image string, tax double, discount double")
    good = rows.groupBy("channel", "image").agg(F.count("*").alias("n"), F.sum("tax").alias("tax"), F.sum("discount").alias("discount")).withColumn("skipped", F.lit(0))
    none = lambda kind: F.lit(None).cast(kind)
    return good.unionByName(left.groupBy("reason").agg(F.count("*").alias("skipped")).select(F.lit("-").alias("channel"), F.col("reason").alias("image"), none("long").alias("n"), none("double").alias("tax"), none("double").alias("discount"), "skipped"))


SUMMARY = f"{NAMES}, s AS (SELECT name || '_' || o_orderkey AS image, regexp_extract(name, '_(\\d+)', 1) AS type, o_totalprice AS price, CAST(regexp_extract(name, 'row(\\d+)', 1) AS BIGINT) AS r, CAST(regexp_extract(name, 'col(\\d+)', 1) AS BIGINT) AS c FROM names JOIN orders USING (o_orderkey))"


def summary(spark, d):
    n = X.names(spark, d).join(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return n.select(F.concat_ws("_", "name", "o_orderkey").alias("image"), K.type_key(F.col("name")).alias("type"), F.col("o_totalprice").alias("price"))


@query("S04_K02_summaries", f"{SUMMARY} SELECT source, image, type, {r6('CASE WHEN type = 212 THEN price + 1 ELSE price END', 'price')}, r, c FROM s, (SELECT unnest(['combined', 'by_type']) AS source) WHERE NOT (r = 1 AND c = 1)")
def s04_k02(spark, d):
    """The summary sinks read back, combined and (where that is missing) by type, after a second run of one type only."""
    root = Scratch(spark, "summaries").root
    s = summary(spark, d)
    again = s.where("type = '212'").withColumn("price", F.col("price") + 1)
    for t in (s, again):
        IO.write_summaries(t, f"{root}/a")
        IO.write_table(t, f"{root}/b/summary/by_type", ["type"], ["image"])
    parts = [IO.load_summary(spark, f"{root}/{k}").select(F.lit(n).alias("source"), "image", F.col("type").cast("string").alias("type"), "price", "r", "c") for k, n in (("a", "combined"), ("b", "by_type"))]
    return parts[0].unionByName(parts[1])


@query("K01_site_sink", f"{SITES}, n AS (SELECT o_orderkey, regexp_extract(name, '_(\\d+)', 1) AS type FROM ({NAMES} SELECT * FROM names)) SELECT type, channel, image, count(*) AS n, {r6('sum(CASE WHEN type = 213 AND channel = ' + chr(39) + 'N' + chr(39) + ' THEN 2 * l_tax ELSE l_tax END)', 'tax')} FROM sites JOIN n ON image = o_orderkey GROUP BY ALL")
def k01(spark, d):
    """All types are written, then one channel of one type once more: the others stay."""
    path = Scratch(spark, "sink").root
    n = X.names(spark, d).select(F.col("o_orderkey").alias("image"), K.type_key(F.col("name")).alias("type"))
    rows = X.sites(spark, d).join(n, "image")
    for t in (rows, rows.where("type = '213' and channel = 'N'").withColumn("l_tax", 2 * F.col("l_tax"))):
        IO.write_table(t, path, ["type", "channel"], ["image"])
    back = spark.read.parquet(path).withColumn("type", F.col("type").cast("string"))
    return back.groupBy("type", "channel", "image").agg(F.count("*").alias("n"), F.sum("l_tax").alias("tax"))


@query("K05_csv_sink", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def k05(spark, d):
    path = Scratch(spark, "csv").root
    IO.write_csv(load(spark, d, "part").select("p_partkey", "p_name", "p_size"), path)
    return spark.read.schema("p_partkey long, p_name string, p_size int").option("header", True).csv(path)


SAVED = """SELECT type, CASE WHEN type % 4 = 1 THEN 'hsv' END AS engine,
  map('dab', named_struct('threshold', named_struct('method', CASE WHEN type % 2 = 0 THEN 'yen' END, 'absolute_raw', CASE WHEN type % 3 = 0 THEN type * 0.01D END), 'morph', named_struct('open_radius', CASE WHEN type % 2 = 1 THEN int(type) END)),
      'other', named_struct('threshold', named_struct('method', 'li', 'absolute_raw', 1D), 'morph', named_struct('open_radius', 9))) AS channels,
  CASE WHEN type = 4 THEN false END AS gating_enabled,
  CASE type % 3 WHEN 1 THEN array(named_struct('target', 'dab', 'by', 'eosin', 'mode', 'intersect', 'dilate_px', '3', 'min_overlap_frac', '0.5'))
    WHEN 2 THEN array(named_struct('target', 'dab', 'by', 'eosin', 'mode', 'intersect', 'dilate_px', 'many', 'min_overlap_frac', '0.5'), named_struct('target', string(null), 'by', string(null), 'mode', string(null), 'dilate_px', string(null), 'min_overlap_frac', string(null))) END AS gating_rules
FROM {t} WHERE type < 8"""
BUILT_IN = "c AS (SELECT * FROM (VALUES ('hematoxylin', pow(10, -1.75), 3, 70, true, 0.025), ('eosin', NULL, 7, 150, false, 0.08), ('dab', pow(10, -1.5), 7, 150, false, 0.08)) v(channel, raw, close_radius, small, border, share)), t AS (SELECT DISTINCT label AS type FROM embeddings)"
MINE = "channel = 'dab' AND type < 8 AND type"
RECORD = f"""WITH {BUILT_IN} SELECT CAST(type AS BIGINT) AS type, channel, CASE WHEN type < 8 AND type % 4 = 1 THEN 'hsv' ELSE 'hed' END AS engine, CASE WHEN {MINE} % 2 = 0 THEN 'yen' ELSE 'otsu' END AS method, {r6(f'CASE WHEN {MINE} % 3 = 0 THEN type * 0.01 ELSE raw END', 'absolute_raw')},
CAST(CASE WHEN {MINE} % 2 = 1 THEN type ELSE 2 END AS BIGINT) AS open_radius, CAST(close_radius AS BIGINT) AS close_radius, CAST(small AS BIGINT) AS remove_small, border AS clear_border, {r6('share', 'large_area_frac')}, type < 8 AND type <> 4 AND type % 3 <> 0 AS gating_enabled,
CASE WHEN type >= 8 THEN 'dab<hematoxylin:touching:15:0.0' WHEN type % 3 = 0 THEN '' WHEN type % 3 = 1 THEN 'dab<eosin:intersect:3:0.5' ELSE 'dab<hematoxylin:touching:2:0.0' END AS rules FROM t, c"""


def types(spark, d):
    return load(spark, d, "embeddings").select(F.col("label").alias("type")).distinct()


def record(spark, d):
    return IO.load_parameters(types(spark, d), spark.sql(SAVED, t=types(spark, d)))


def flat_record(p):
    c = p.select("type", "engine", "gating_enabled", F.array_join(F.transform("gating_rules", lambda r: F.concat_ws(":", F.concat(r["target"], F.lit("<"), r["by"]), r["mode"], r["dilate_px"].cast("string"), r["min_overlap_frac"].cast("string"))), ",").alias("rules"), F.explode("channels").alias("channel", "c"))
    m = "c.morph"
    return c.select("type", "channel", "engine", "c.threshold.method", "c.threshold.absolute_raw", f"{m}.open_radius", f"{m}.close_radius", f"{m}.remove_small", f"{m}.clear_border", f"{m}.large_area_frac", "gating_enabled", "rules")


@query("S06_parameter_overlay", RECORD)
def s06(spark, d):
    return flat_record(record(spark, d))


@query("S07_saved_parameters", RECORD)
def s07(spark, d):
    path = Scratch(spark, "params").root
    p = record(spark, d)
    IO.save_parameters(p, path)
    return flat_record(spark.read.schema(p.schema).json(path))


@query("P24_preview_parameters", f"WITH {BUILT_IN}, s AS (SELECT *, (1 + type % 4)::DOUBLE AS h, (1 + type % 3)::DOUBLE AS w FROM t) SELECT CAST(type AS BIGINT) AS type, channel, CAST(round_even(2 / sqrt(h * w), 0) AS BIGINT) AS open_radius, CAST(round_even(close_radius / sqrt(h * w), 0) AS BIGINT) AS close_radius, CAST(round_even(small / (h * w), 0) AS BIGINT) AS remove_small FROM s, c")
def p24(spark, d):
    t = types(spark, d)
    p = IO.default_parameters(t).join(t.select("type", (1 + F.col("type") % 4).cast("double").alias("height_scale"), (1 + F.col("type") % 3).cast("double").alias("width_scale")), "type")
    c = IO.preview_parameters(p).select("type", F.explode("channels").alias("channel", "c"))
    return c.select("type", "channel", "c.morph.open_radius", "c.morph.close_radius", "c.morph.remove_small")


def exact(expr: str, name: str) -> str:
    return f"{expr} AS {name}"


def welch_sql(out) -> str:
    return f"""{DIFF}, s AS (SELECT channel, phenotype, feature, level, count(value) AS n, avg(value) AS m, var_samp(value) AS v, min(image) AS fi FROM diff WHERE value IS NOT NULL AND level IS NOT NULL GROUP BY ALL),
c AS (SELECT channel, phenotype, feature FROM s GROUP BY ALL HAVING count(*) = 2),
o AS (SELECT s.*, row_number() OVER (PARTITION BY channel, phenotype, feature ORDER BY level) AS i, row_number() OVER (PARTITION BY channel, phenotype, feature ORDER BY fi, level) AS j FROM s JOIN c USING (channel, phenotype, feature)),
a AS (SELECT channel, phenotype, feature, max(CASE WHEN i=1 THEN n END) AS n1, max(CASE WHEN i=2 THEN n END) AS n2, max(CASE WHEN i=1 THEN m END) AS m1, max(CASE WHEN i=2 THEN m END) AS m2, max(CASE WHEN i=1 THEN v END) AS v1, max(CASE WHEN i=2 THEN v END) AS v2, max(CASE WHEN j=1 THEN m END) - max(CASE WHEN j=2 THEN m END) AS dm FROM o GROUP BY ALL)
SELECT channel, phenotype, feature, {out('CASE WHEN n1>1 AND n2>1 THEN (m1-m2)/nullif(sqrt(v1/n1+v2/n2),0) END', 't')}, {out('CASE WHEN n1>1 AND n2>1 THEN (v1/n1+v2/n2)*(v1/n1+v2/n2)/nullif((v1/n1)*(v1/n1)/(n1-1)+(v2/n2)*(v2/n2)/(n2-1),0) END', 'df')}, {out('CASE WHEN n1>1 AND n2>1 THEN dm/nullif(sqrt(((n1-1)*v1+(n2-1)*v2)/(n1+n2-2)),0) END', 'effect_d')} FROM a"""


@query("TA_TD_welch_effect", welch_sql(r6))
def ta(spark, d):
    k = ["channel", "phenotype", "feature"]
    return T.two_level(T.group_stats(X.diff(spark, d), k), k)


def kruskal_sql(out) -> str:
    return f"""{DIFF}, r AS (SELECT channel, phenotype, feature, level, count(*) OVER (PARTITION BY channel, phenotype, feature, value) AS t, rank() OVER (PARTITION BY channel, phenotype, feature ORDER BY value) AS rk FROM diff WHERE value IS NOT NULL AND level IS NOT NULL),
q AS (SELECT channel, phenotype, feature, level, count(*) AS n, sum(rk + (t - 1) / 2e0) AS s, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY ALL),
w AS (SELECT channel, phenotype, feature, CAST(sum(n) AS DOUBLE) AS n, count(*) AS k, sum(s * s / n) AS s, sum(ties) AS ties FROM q GROUP BY ALL)
SELECT channel, phenotype, feature, {out('CASE WHEN 1 - ties / (n*n*n - n) > 1e-14 THEN (12 * s / (n * (n + 1)) - 3 * (n + 1)) / (1 - ties / (n*n*n - n)) END', 'h')}, k - 1 AS df FROM w"""


@query("TB_kruskal", kruskal_sql(r6))
def tb(spark, d):
    return T.kruskal(X.diff(spark, d), ["channel", "phenotype", "feature"])


@query("TC_gate", f"{DIFF}, s AS (SELECT channel, phenotype, feature, level, count(value) AS n FROM diff WHERE level IS NOT NULL AND value IS NOT NULL GROUP BY ALL) SELECT channel, phenotype, feature, CASE WHEN sum(n) < 2 OR count(*) < 2 OR min(n) < 4000 THEN 'insufficient' WHEN count(*) = 2 THEN 'welch_t' ELSE 'kruskal' END AS test, count(*) AS levels, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY ALL")
def tc(spark, d):
    k = ["channel", "phenotype", "feature"]
    return T.gate(T.group_stats(X.diff(spark, d), k), k, 4000).drop("means")


K3 = "channel, phenotype, feature"

#: Both tails by sums of positive terms, ``z^p (1-z)^q / (p B(p, q)) * sum((p+q)_n / (p+1)_n z^n)`` for the incomplete beta function (from the end that is nearer) and
#: ``x^s e^-x / G(s+1) * sum(x^n / (s+1)_n)`` for the incomplete gamma function; beyond t*t = 1500 or h = 1400 a tail is 0 in all places shown.
TE_SQL = f"""WITH g AS ({SQL['TC_gate'].replace('4000', '2')}), w AS ({welch_sql(exact)}), h AS ({kruskal_sql(exact)}),
m AS (SELECT {K3}, string_agg(level || '=' || CAST(CAST(round(mean * 10000, 0) AS BIGINT) AS VARCHAR), ';' ORDER BY level) AS means FROM (SELECT {K3}, level, avg(value) AS mean FROM ({DIFF} SELECT * FROM diff WHERE value IS NOT NULL AND level IS NOT NULL) GROUP BY ALL) GROUP BY ALL),
j AS (SELECT g.*, w.t, w.df, w.effect_d, h.h, h.df AS h_df, w.df / (w.df + w.t * w.t) AS x FROM g LEFT JOIN w USING ({K3}) LEFT JOIN h USING ({K3})),
b AS (SELECT {K3}, x, t, CASE WHEN x < 0.5 THEN x ELSE 1 - x END AS z, CASE WHEN x < 0.5 THEN df / 2 ELSE 0.5e0 END AS p, CASE WHEN x < 0.5 THEN 0.5e0 ELSE df / 2 END AS q FROM j WHERE test = 'welch_t' AND t <> 0 AND x > 0 AND x < 1),
i AS (SELECT {K3}, x, t, sum(exp(lgamma(p + q + n) - lgamma(p) - lgamma(q) - ln(p) + lgamma(p + 1) - lgamma(p + 1 + n) + (p + n) * ln(z) + q * ln(1 - z))) AS i FROM b, (SELECT CAST(unnest(range(3000)) AS DOUBLE) AS n) GROUP BY ALL),
c AS (SELECT {K3}, h / 2 AS x, h_df / 2e0 AS s FROM j WHERE test = 'kruskal' AND h > 0 AND h <= 1400),
d AS (SELECT {K3}, 1 - sum(exp((s + n) * ln(x) - x - lgamma(s + 1 + n))) AS p FROM c, (SELECT CAST(unnest(range(3000)) AS DOUBLE) AS n) GROUP BY ALL),
p AS (SELECT j.*, CASE test WHEN 'welch_t' THEN CASE WHEN j.t = 0 THEN 1 WHEN j.x >= 1 THEN 1 WHEN j.x < 0.5 THEN i.i WHEN j.t * j.t > 1500 THEN 0 ELSE greatest(1 - i.i, 0) END WHEN 'kruskal' THEN CASE WHEN h <= 0 THEN 1 WHEN h > 1400 THEN 0 ELSE greatest(d.p, 0) END END AS p FROM j LEFT JOIN i USING ({K3}) LEFT JOIN d USING ({K3})),
k AS (SELECT *, row_number() OVER (PARTITION BY channel, phenotype ORDER BY p NULLS LAST, feature) AS place, count(p) OVER (PARTITION BY channel, phenotype) AS tests FROM p)
SELECT {K3}, test, {r6('p', 'p_value')}, {r6('CASE WHEN p IS NOT NULL THEN least(1, min(p * tests / place) OVER (PARTITION BY channel, phenotype ORDER BY place DESC)) END', 'q_value')}, {r6('effect_d', 'effect_d')}, levels, n, {r6('t', 't')}, {r6('df', 'df')}, {r6('h', 'h')}, h_df, means FROM k LEFT JOIN m USING ({K3})"""


@query("TE_differential", TE_SQL)
def te(spark, d):
    """The whole analysis; level means, in ten-thousandths, as one text."""
    r = T.ranked(T.differential(X.diff(spark, d, keep=True), ["channel"]), ["channel"])
    mean = lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"] * 10000).cast("long").cast("string"))
    return r.withColumn("means", F.array_join(F.transform(F.array_sort(F.map_entries("means")), mean), ";"))


@query("TE_statistics", f"SELECT g.*, w.t, w.df, w.effect_d, k.h, k.df AS h_df FROM ({SQL['TC_gate'].replace('4000', '2')}) g LEFT JOIN ({welch_sql(r6)}) w USING (channel, phenotype, feature) LEFT JOIN ({kruskal_sql(r6)}) k USING (channel, phenotype, feature)")
def te_statistics(spark, d):
    """The whole analysis up to its statistics."""
    return T.differential(X.diff(spark, d, keep=True), ["channel"]).select("channel", "phenotype", "feature", "test", "levels", "n", "t", "df", "effect_d", "h", "h_df")


PV = X.cte("pvals")
BH = f"{PV}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY p NULLS LAST, id) AS i, count(p) OVER (PARTITION BY grp) AS m FROM pvals), q AS (SELECT grp, id, p, least(1, min(p * m / i) OVER (PARTITION BY grp ORDER BY i DESC)) AS q FROM k)"


@query("W01_benjamini_hochberg", f"{BH} SELECT grp, id, {r6('p', 'p')}, {r6('CASE WHEN p IS NOT NULL THEN q END', 'q_value')} FROM q")
def w01(spark, d):
    return T.benjamini_hochberg(X.pvals(spark, d), ["grp"], "p", [F.col("id")])


@query("W02_mid_ranks", f"{PV} SELECT grp, id, count(*) OVER (PARTITION BY grp, p) AS ties, rank() OVER (PARTITION BY grp ORDER BY p) + (count(*) OVER (PARTITION BY grp, p) - 1) / 2e0 AS rank FROM pvals WHERE p IS NOT NULL")
def w02(spark, d):
    r = T.mid_ranks(X.pvals(spark, d).withColumnRenamed("p", "value").withColumn("level", F.lit("a")), ["grp"])
    return r.select("grp", "id", "ties", "rank")


@query("W03_first_per_type", f"{NAMES}, t AS (SELECT regexp_extract(name, '_(\\d+)', 1) AS type, name || o_orderkey AS path FROM names) SELECT type, path, n FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY path) AS n FROM t) WHERE n <= 6")
def w03(spark, d):
    t = X.names(spark, d).select(K.type_key(F.col("name")).alias("type"), F.concat("name", "o_orderkey").alias("path"))
    return IO.preview_sample(t)


@query("O01_O03_sorted", f"{BH} SELECT grp, id, {r6('p', 'p')}, {r6('CASE WHEN p IS NOT NULL THEN q END', 'q_value')} FROM q ORDER BY grp, q_value NULLS LAST, p NULLS LAST, id")
def o01(spark, d):
    q = T.benjamini_hochberg(X.pvals(spark, d), ["grp"], "p", [F.col("id")])
    return q.orderBy("grp", F.col("q_value").asc_nulls_last(), F.col("p").asc_nulls_last(), "id")


@query("K03_result_sink", f"{BH} SELECT 'p_' || (id % 3) AS phenotype, grp AS channel, CAST(id AS VARCHAR) AS feature, {r6('p', 'p_value')}, {r6('CASE WHEN p IS NOT NULL THEN q END', 'q_value')} FROM q")
def k03(spark, d):
    path = Scratch(spark, "results").root
    q = T.benjamini_hochberg(X.pvals(spark, d), ["grp"], "p", [F.col("id")])
    q = q.select(F.lit("212").alias("type"), F.col("grp").alias("channel"), F.concat(F.lit("p/"), (F.col("id") % 3).cast("string")).alias("phenotype"), F.col("id").cast("string").alias("feature"), F.col("p").alias("p_value"), "q_value")
    IO.write_results(q, path)
    return spark.read.parquet(path).select("phenotype", "channel", "feature", "p_value", "q_value")


@query("O02_top_significant", f"{BH}, s AS (SELECT grp, id, p, q, row_number() OVER (PARTITION BY grp ORDER BY q, p, id) AS position FROM q WHERE p IS NOT NULL AND q <= 0.5) SELECT grp AS channel, 'x' AS phenotype, id AS feature, {r6('p', 'p_value')}, {r6('q', 'q_value')}, position FROM s WHERE position <= 24")
def o02(spark, d):
    q = T.benjamini_hochberg(X.pvals(spark, d), ["grp"], "p", [F.col("id")]).select(F.col("grp").alias("channel"), F.lit("x").alias("phenotype"), F.col("id").alias("feature"), F.col("p").alias("p_value"), "q_value")
    return T.top_significant(q, ["channel"], alpha=0.5)


@query("U02_distinct", "SELECT DISTINCT least(o_custkey % 40, o_orderkey % 40) AS a, greatest(o_custkey % 40, o_orderkey % 40) AS b FROM orders WHERE o_custkey % 40 <> o_orderkey % 40")
def u02(spark, d):
    o = load(spark, d, "orders").select((F.col("o_custkey") % 40).alias("x"), (F.col("o_orderkey") % 40).alias("y")).where("x <> y")
    return o.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


ship(__name__)
