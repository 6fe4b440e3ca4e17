"""Reading and writing the engine's tables: image lists, site, summary, metadata and parameter tables, results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.core import Scratch, exists, replace
from tessera.functions import keys as K

EXTENSIONS = ("png", "jpg", "jpeg", "tif", "tiff")
PHENOTYPES = ("Region", "Label", "C", "B")
#: Built-in channels (fixed values): name, log10 of the raw threshold, closing radius, smallest object, border cleared, longest share.
CHANNELS = (("hematoxylin", -1.75, 3, 70, True, 0.025), ("eosin", None, 7, 150, False, 0.08), ("dab", -1.5, 7, 150, False, 0.08))


def list_images(spark: SparkSession, root: str, extensions=EXTENSIONS) -> DataFrame:
    """``path, name, type`` of image files below ``root``, at any depth; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    f = f.where(F.lower("path").rlike(r"\.(" + "|".join(extensions) + ")$"))
    return f.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), K.type_key(F.col("path")).alias("type")).orderBy("path")


def preview_sample(images: DataFrame, per_type: int = 6) -> DataFrame:
    """The first images of each type by path."""
    return images.withColumn("n", F.row_number().over(W.partitionBy("type").orderBy("path"))).where(F.col("n") <= per_type)


#: Files whose headers may be sent to all tasks; of more files, rows and headers are joined by file.
FEW_FILES = 10_000


def _first(df: DataFrame, name: str, near) -> DataFrame:
    """``_file, name``: of each file the place of its first row. Blocks, then rows of a block: minima of numbers need no sort."""
    block = df.groupBy("_file").agg(F.min("_place.b").alias("_b"))
    row = df.join(near(block), "_file").where("_place.b = _b").groupBy("_file", "_b").agg(F.min("_place.i").alias("_i"))
    return row.select("_file", F.struct(F.col("_b").alias("b"), F.col("_i").alias("i")).alias(name))


def scan_sites(spark: SparkSession, root: str, type_: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Site rows of one type, and the files that were left out (``file, reason``).

    Files are ``features/<type>/<channel>/*_sites.csv``, or ``features/<type>/*_sites.csv`` (channel null) where the type has no channel folders. Every file's own header says where its
    columns are, as files of several versions lie side by side: columns of ``schema`` that a file lacks are null, values that do not fit their type too. An image is named by its file's
    first row. Left out: other names, other depths, files without rows, without a column ``image``, with rows longer than the header, or whose first row names no image.
    A row is a line: quoted line breaks are not read. A file without a byte is in neither result, as Spark does not list it.
    """
    tmp = Scratch(spark, "scan")
    base = f"{root}/features/{type_}"
    below = F.regexp_extract("path", r"/features/" + re.escape(type_) + r"/(.*)$", 1)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select(F.col("path").alias("_file"), below.alias("below"))
    files = tmp.save(files.withColumn("depth", F.size(F.split("below", "/"))))
    folders = not files.where("depth > 1").isEmpty()
    reason = F.when(~F.col("below").endswith("_sites.csv"), "not a site file").when(F.col("depth") != (2 if folders else 1), "not in a channel folder" if folders else "too deep")
    files = files.select("_file", F.when(F.lit(folders), F.substring_index("below", "/", 1)).alias("channel"), reason.alias("reason"))
    lines = spark.read.option("recursiveFileLookup", True).text(base).select("value", F.col("_metadata.file_path").alias("_file"), F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("_place"))
    lines = tmp.save(lines.join(files.where("reason is null").select("_file"), "_file").where("trim(value) <> ''"))
    near = F.broadcast if files.count() <= FEW_FILES else lambda t: t  # so that the rows of a large file stay in many tasks
    heads = tmp.save(lines.join(near(_first(lines, "_head", near)), "_file").where("_place = _head").select("_file", "_head", "value"))
    most = heads.agg(F.max(F.size(F.split("value", ",")))).first()[0] or 1
    names = [f"c{i}" for i in range(most + 1)]
    fields = F.from_csv("value", ", ".join(f"`{n}` string" for n in names), {"mode": "PERMISSIVE"})
    cells = lambda t, *c: t.withColumn("v", fields).select("_file", *c, F.array(*[F.col(f"v.{n}") for n in names]).alias("v"))
    columns = cells(heads, "_head").select("_file", "_head", F.transform("v", lambda c: F.coalesce(F.trim(F.ltrim(c, F.lit("\ufeff"))), F.lit(""))).alias("h"))
    below = lines.join(near(heads.select("_file", "_head")), "_file").where("_place > _head")
    rows = cells(lines, "_place").join(near(columns), "_file").where("_place > _head").select("_file", "_place", "v", "h")
    at = lambda name: F.get("v", F.nullif(F.array_position("h", F.lit(name)), F.lit(0)).cast("int") - 1)
    width = F.coalesce(F.array_max(F.transform("h", lambda c, i: F.when(c != "", i + 1))), F.lit(0))
    over = F.exists(F.slice(F.col("v"), width + 1, F.lit(most + 1)), lambda c: c.isNotNull())
    facts = rows.groupBy("_file").agg(F.max(over).alias("_over"), F.max(F.array_contains("h", "image")).alias("_named"))
    named = rows.join(near(_first(below, "_one", near)), "_file").where("_place = _one").select("_file", at("image").alias("_image"))
    facts = tmp.save(files.join(facts, "_file", "left").join(named, "_file", "left"))
    why = F.coalesce("reason", F.when(F.col("_named").isNull(), "no rows").when(~F.col("_named"), "no column image").when(F.col("_over"), "rows longer than the header").when(F.coalesce(F.col("_image"), F.lit("")) == "", "first row names no image"))
    facts = facts.withColumn("reason", why)
    kind = T.StructType.fromDDL(schema)
    good = rows.join(near(facts.where("reason is null").select("_file", "channel", "_image")), "_file")
    out = good.select(*[(F.col("_image") if f.name == "image" else at(f.name).try_cast(f.dataType)).alias(f.name) for f in kind], "channel")
    return out, facts.where("reason is not null").select(F.col("_file").alias("file"), "reason")


def read_sites(spark: SparkSession, root: str, type_: str, schema: str) -> DataFrame:
    """Site rows of one type with ``channel``: see ``scan_sites``."""
    return scan_sites(spark, root, type_, schema)[0]


def union_summaries(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def write_summaries(df: DataFrame, root: str) -> None:
    """The summary sinks: by type (sorted by image in a file) and combined (sorted by type and image).

    Types that are not in ``df`` keep their rows, and the combined summary is made from all types. It is written aside and then put in place; a run that ends
    between the two leaves the summaries by type, which ``load_summary`` falls back to.
    """
    spark = df.sparkSession
    write_table(df, f"{root}/summary/by_type", ["type"], ["image"])
    whole, aside = f"{root}/summary/all_types", f"{root}/summary/.all_types-{uuid.uuid4().hex[:8]}"
    parts = spark.read.option("mergeSchema", True).parquet(f"{root}/summary/by_type")
    parts.withColumn("type", F.col("type").cast(df.schema["type"].dataType)).orderBy("type", "image").write.parquet(aside)
    replace(spark, aside, whole)


def load_summary(spark: SparkSession, root: str) -> DataFrame:
    """The combined summary, or where it is missing the union of those by type, with ``r, c`` and without the control."""
    there = exists(spark, f"{root}/summary/all_types/_SUCCESS")
    d = spark.read.parquet(f"{root}/summary/all_types") if there else spark.read.option("mergeSchema", True).parquet(f"{root}/summary/by_type")
    r, c = K.grid_position(F.col("image"))
    return K.not_control(d.withColumn("r", r).withColumn("c", c))


def clean_metadata(raw: DataFrame) -> DataFrame:
    """Metadata with integer ``r, c`` (bad values null) and without the control; both columns must exist."""
    missing = {"r", "c"} - set(raw.columns)
    if missing:
        raise ValueError(f"metadata lacks {sorted(missing)}")
    return K.not_control(raw.withColumn("r", F.col("r").cast("string").try_cast("double").cast("int")).withColumn("c", F.col("c").cast("string").try_cast("double").cast("int")))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    return clean_metadata(spark.read.option("header", True).csv(path))


def with_metadata(summary: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join on (r, c); metadata columns that clash get ``_meta``. Repeated positions multiply rows."""
    clash = [c for c in metadata.columns if c in summary.columns and c not in ("r", "c")]
    for c in clash:
        metadata = metadata.withColumnRenamed(c, f"{c}_meta")
    return summary.join(metadata, ["r", "c"], "left")


def _over(o: Column, d: Column, kind: T.DataType, given: T.DataType) -> Column:
    """``o`` over ``d``, through structs by field and through maps by the keys of ``d``."""
    if isinstance(kind, T.StructType) and isinstance(given, T.StructType):
        return F.struct(*[(_over(o[f.name], d[f.name], f.dataType, given[f.name].dataType) if f.name in given.names else d[f.name]).alias(f.name) for f in kind])
    if isinstance(kind, T.MapType) and isinstance(given, T.MapType):
        return F.when(o.isNull(), d).otherwise(F.transform_values(d, lambda k, v: _over(F.try_element_at(o, k), v, kind.valueType, given.valueType)))
    return F.coalesce(o, d)


def overlay_parameters(defaults: DataFrame, overrides: DataFrame, key: str = "type") -> DataFrame:
    """Overrides over defaults, field by field, in structs and maps too: what an override leaves null keeps its default.

    Fields that only one side has are kept (inside structs and maps: those of the defaults); types only in overrides are dropped.
    """
    o = overrides.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in overrides.columns if c != key])
    j = defaults.join(o, key, "left")
    kind = lambda df, c: df.schema[c].dataType
    both = [c for c in defaults.columns if c != key and c in overrides.columns]
    return j.select(key, *[_over(F.col(f"_{c}"), F.col(c), kind(defaults, c), kind(overrides, c)).alias(c) if c in both else F.col(c) for c in defaults.columns if c != key], *[F.col(f"_{c}").alias(c) for c in overrides.columns if c != key and c not in defaults.columns])


def default_parameters(types: DataFrame) -> DataFrame:
    """The built-in parameter record of each ``type``."""
    lit = lambda **kw: F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in kw.items()])
    none = lambda kind: F.lit(None).cast(kind)
    channels = []
    for name, absolute, close, small, border, share in CHANNELS:
        raw = none("double") if absolute is None else F.lit(10.0**absolute)
        threshold = lit(normalize=False, method="otsu", scale=1.0, absolute_normalized=none("double"), absolute_raw=raw, invert=none("boolean"), stain_estimation="default")
        morph = lit(open_radius=2, close_radius=close, remove_small=small, fill_holes=True, fill_holes_max_area=64, clear_border=border, remove_large_connected=True, large_area_frac=share, large_span_ref_dim=none("int"))
        channels += [F.lit(name), lit(enabled=True, threshold=threshold, morph=morph)]
    rule = lit(target="dab", by="hematoxylin", mode="touching", dilate_px=15, min_overlap_frac=0.0)
    tissue = lit(ignore_black=True, black_rgb_thresh=5, ignore_white=True, white_v_thresh=0.9, white_s_max=0.25)
    return types.select(
        "type", F.lit("hed").alias("engine"), lit(h_low=0.05, h_high=0.15, s_min=0.2, v_min=0.0, v_max=0.9).alias("hsv"), tissue.alias("pre_mask"), F.array(F.lit("dab"), F.lit("hematoxylin")).alias("channels_to_output"),
        F.create_map(*channels).alias("channels"), F.lit(False).alias("gating_enabled"), F.array(rule).alias("gating_rules"),
    )


def clean_rules(rules: Column) -> Column:
    """Gate rules given as text fields: empty fields take their defaults, a rule with a malformed number goes; null is no rule."""
    bad = lambda text, kind: text.isNotNull() & text.try_cast(kind).isNull()
    good = F.filter(F.coalesce(rules, F.array()), lambda r: ~bad(r["dilate_px"], "int") & ~bad(r["min_overlap_frac"], "double"))
    return F.transform(
        good,
        lambda r: F.struct(
            F.coalesce(r["target"], F.lit("dab")).alias("target"), F.coalesce(r["by"], F.lit("hematoxylin")).alias("by"), F.coalesce(r["mode"], F.lit("touching")).alias("mode"),
            F.coalesce(r["dilate_px"].try_cast("int"), F.lit(2)).alias("dilate_px"), F.coalesce(r["min_overlap_frac"].try_cast("double"), F.lit(0.0)).alias("min_overlap_frac"),
        ),
    )


def load_parameters(types: DataFrame, saved: DataFrame) -> DataFrame:
    """The record of each type: the saved one (gate rules as text) over the built-in one.

    A saved record brings its own gate rules, or none; without its switch, gating is on if there are rules.
    """
    s = saved.withColumn("gating_rules", clean_rules(F.col("gating_rules"))).withColumn("gating_enabled", gating()).withColumn("_saved", F.lit(True))
    return overlay_parameters(default_parameters(types), s).drop("_saved")


def preview_parameters(params: DataFrame, height_scale: str = "height_scale", width_scale: str = "width_scale") -> DataFrame:
    """Clean-up for images that are smaller by these factors: radii by the root of their product, areas by it; half rounds to even."""
    area = F.col(height_scale) * F.col(width_scale)
    fit = lambda x, by: F.greatest(F.lit(0), F.rint(x / by).cast("int"))

    def smaller(k: Column, v: Column) -> Column:
        m = v["morph"]
        return v.withField("morph", m.withField("open_radius", fit(m["open_radius"], F.sqrt(area))).withField("close_radius", fit(m["close_radius"], F.sqrt(area))).withField("remove_small", fit(m["remove_small"], area)).withField("large_span_ref_dim", F.lit(None).cast("int")))

    return params.withColumn("channels", F.transform_values("channels", smaller))


def gating(rules: str = "gating_rules", enabled: str = "gating_enabled"):
    """Whether gating is on: as set, else if there are rules."""
    return F.coalesce(F.col(enabled), F.size(F.coalesce(F.col(rules), F.array())) > 0)


def legacy_outputs(summary: DataFrame, sites_root: str | None = None, most: int = 3) -> DataFrame:
    """What is still in pixel units: one row (``part, column``) per such column of the summary and of the first ``most`` site files."""
    spark = summary.sparkSession
    found = [("summary", c) for c in summary.columns]
    if sites_root is not None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(sites_root).select("path").orderBy("path").limit(most)
        for r in files.collect():
            found += [("sites", c) for c in spark.read.option("header", True).csv(r["path"]).columns]
    d = spark.createDataFrame(found or [(None, None)], "part string, column string")
    return d.where(K.legacy(F.col("column"))).distinct()


def write_table(df: DataFrame, path: str, partition_by: list[str], sort: list[str] = ()) -> None:
    """Parquet, one folder per key; rows sorted inside each file. Keys that ``df`` holds are replaced when the job commits; folders of other keys stay as they are."""
    d = df.sortWithinPartitions(*partition_by, *sort) if sort else df
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def save_parameters(params: DataFrame, path: str) -> None:
    """Parameter records as JSON lines, nested fields and all; ``spark.read.schema(...).json(path)`` reads them back."""
    params.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """Test tables by type, channel and phenotype, with the phenotype made fit for a folder name."""
    write_table(df.withColumn("phenotype", K.sanitize(F.col("phenotype"))), path, ["type", "channel", "phenotype"], ["q_value", "p_value", "feature"])


def wide(long: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """One row per key and one column per feature, in the order given."""
    return long.groupBy(*keys).pivot("feature", features).agg(F.first("value"))
