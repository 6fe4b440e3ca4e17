"""Whitening of embeddings with block matrices.

Entries become integers first (``floor(scale * c) + shift``), so that equal vectors are equal exactly, sums are exact, and centring loses nothing: an
entry x of a fit list of n vectors with sums S becomes ((n * (x - m)) - (S - n * m)) / n, with m = S div n, in integers up to the division.

* The fit list holds each distinct vector once. Centred rows are numbered without gaps and grouped into dense blocks of a megabyte; a file of blocks
  is read as matrices by its schema alone, so no row passes through Python or a serializer of objects.
* A *panel* of ``BLOCKS`` blocks is one BlockMatrix A: A' A, split along the rows, adds to the scatter matrix, which alone comes to the driver
  (dimension squared). ``eigh`` there gives the components; a panel's projection is A times the whitening matrix, again as block matrices.
* A block product keeps the blocks of a task in memory and the driver holds two integers a block, so panels bound both, however many rows there are.
  Panels are independent jobs, a few at a time; each writes its result.

Defined results: the dimension is the most frequent length of valid vectors (of equally frequent ones the greatest); rows whose vector is null, empty, of another
length, or holds null, non-finite or (after scaling) too large entries for a long are left out. Directions without variance (eigenvalue not above the
rounding of the largest) have no whitened value and give no component; so equal vectors only, one vector or none give no rows. Repeated rows and rows without id are
projected like others; extra columns are ignored. Where a sum does not fit a long, ``deviation`` is null.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from tessera.core import Scratch
from tessera.llm import by_value

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Values of a block (its rows are as many as fit), blocks of a task and of a panel, most tasks of a projection, panels at work at a time.
BLOCK_VALUES, TASK_BLOCKS, BLOCKS, TASKS, AT_ONCE = 131_072, 8, 1024, 16, 4
#: Magnitude below which a scaled entry is sure to fit a long.
FITS = 2.0**62
_PLACE = StructType().add("_1", LongType()).add("_2", LongType())


def as_integers(vector: Column, scale: int = SCALE, shift: int = SHIFT) -> Column:
    """``floor(scale * c) + shift`` of each entry; null if an entry has none."""
    scaled = F.transform(vector, lambda c: c.cast("double") * scale)
    good = F.forall(scaled, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < FITS))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(scaled, lambda c: F.floor(c).cast("long") + shift))


def in_blocks(rows: DataFrame, tmp: Scratch, height: int) -> DataFrame:
    """Blocks of ``height`` rows of ``rows`` (``centred`` and others): ``panel, place, matrix`` and an array of each other column, written.

    Rows are numbered by their partition and place in it: the driver reads one count for each partition, and a group has ``height`` rows at most.
    """
    marked = tmp.save(rows.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = sorted((r[0], r[1]) for r in marked.groupBy(part.alias("p")).count().collect())
    starts = np.concatenate([[0], np.cumsum([c for _, c in counts])])
    start = rows.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(counts, starts)], "p long, s long")
    n = F.col("s") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    j = marked.withColumn("p", part).join(F.broadcast(start), "p").withColumn("_n", n)
    g = j.groupBy(F.floor(F.col("_n") / height).alias("_b")).agg(F.sort_array(F.collect_list(F.struct("_n", *rows.columns))).alias("l"))
    each = lambda c: F.transform("l", lambda x: x[c])
    none, byte = F.lit(None).cast("array<int>"), F.lit(1).cast("tinyint")  # type 1: dense; by rows, so "transposed"
    matrix = F.struct(byte.alias("type"), F.size("l").alias("numRows"), F.size(F.col("l")[0]["centred"]).alias("numCols"), none.alias("colPtrs"), none.alias("rowIndices"), F.flatten(each("centred")).alias("values"), F.lit(True).alias("isTransposed"))
    place = F.struct((F.col("_b") % BLOCKS).alias("_1"), F.lit(0).cast("long").alias("_2"))
    out = tmp.save(g.select(F.floor(F.col("_b") / BLOCKS).alias("panel"), place.alias("place"), matrix.alias("matrix"), *[each(c).alias(c) for c in rows.columns if c != "centred"]))
    out._rows = int(starts[-1])
    return out


def block_matrix(blocks: DataFrame, panel: int, height: int, width: int) -> BlockMatrix:
    """The blocks of a panel as a BlockMatrix."""
    spark, total = blocks.sparkSession, blocks._rows - panel * BLOCKS * height
    kind = StructType().add("panel", LongType()).add("place", _PLACE).add("matrix", MatrixUDT())
    t = spark.read.schema(kind).parquet(blocks._tessera_path).where(F.col("panel") == panel).select("place", "matrix")
    rows = min(total, BLOCKS * height)
    return BlockMatrix(callMLlibFunc("createBlockMatrix", t, height, width, rows, width), height, width)


def scatter(a: BlockMatrix) -> np.ndarray:
    """A' A; the rows are split into as many parts as the blocks need tasks, whose products are added by Spark."""
    splits = max(-(-a.numRowBlocks // TASK_BLOCKS), 1)
    java = a.transpose()._java_matrix_wrapper.call("multiply", a._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(java, a.numCols(), a.numCols()).toLocalMatrix().toArray()


def project(spark: SparkSession, a: BlockMatrix, w: np.ndarray) -> BlockMatrix:
    """A times a small matrix. MLlib deals the product to the root of the larger number of partitions, hence the square."""
    tasks = min(-(-a.numRowBlocks // TASK_BLOCKS), TASKS)
    block = ((0, 0), DenseMatrix(*w.shape, w.ravel(order="F")))
    return a.multiply(BlockMatrix(spark.sparkContext.parallelize([block], tasks * tasks), *w.shape))


def components(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns; the largest entry is positive) above the rounding of the largest."""
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1], q[:, ::-1]
    k = int((e > max(e[0], 0) * len(e) * np.finfo(float).eps * 8).sum()) if len(e) else 0
    e, q = e[: min(k, most)], q[:, : min(k, most)]
    return e, q * np.sign(q[np.abs(q).argmax(0), np.arange(q.shape[1])])


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, shift: int = SHIFT, most: int = COMPONENTS) -> DataFrame:
    """``id, n, deviation, whitened`` (array, one value a component) of each valid row, with ``explained`` (array) and ``identity_error`` repeated."""
    spark = embeddings.sparkSession
    tmp = Scratch(spark, "whitening")
    x = embeddings.select(F.col(id_col).alias("id"), as_integers(F.col(vector_col), scale, shift).alias("x"))
    x = tmp.save(x.where(F.size("x") > 0))
    size = x.groupBy(F.size("x").alias("d")).count().agg(F.max_by("d", F.struct("count", "d"))).first()[0]
    shape = "id: , n long, deviation long, whitened array<double>, explained array<double>, identity_error double".replace("id: ", f"id {x.schema['id'].dataType.simpleString()}")
    empty = spark.createDataFrame([], shape)
    if size is None:
        return empty
    x = x.where(F.size("x") == size)
    distinct = tmp.save(x.groupBy("x").agg(F.count("*").alias("copies")).select("x"))
    sums = distinct.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).collect()
    n, s = sums[0]["n"], [int(r["s"]) for r in sorted(sums)]
    mean, rest = [v // n for v in s], [v % n for v in s]
    off = F.zip_with("x", F.lit(np.array(mean, np.int64)), lambda a, m: F.try_subtract(a, m))
    away = lambda v: F.zip_with(v, F.lit(np.array(rest, np.int64)), lambda a, r: (a - r / F.lit(float(n))))
    exact = F.zip_with(off, F.lit(np.array(rest, np.int64)), lambda a, r: F.try_subtract(F.try_multiply(a, F.lit(n).cast("long")), r))
    deviation = F.aggregate(exact, F.lit(0).cast("long"), lambda a, v: F.try_add(a, F.try_multiply(v, v)))
    height = max(BLOCK_VALUES // size, 1)
    rows = in_blocks(x.select("id", deviation.alias("deviation"), away(off).alias("centred")), tmp, height)
    fit = in_blocks(distinct.select(away(off).alias("centred")), tmp, height)

    def panels(blocks: DataFrame, f) -> list:
        """``f(panel number, its matrix)`` for each panel, a few at a time."""
        with ThreadPoolExecutor(AT_ONCE) as pool:
            return list(pool.map(lambda p: f(p, block_matrix(blocks, p, height, size)), range(-(-blocks._rows // (BLOCKS * height)))))

    v = sum(panels(fit, lambda _, a: scatter(a))) / n
    e, q = components(v, most)
    k = len(e)
    if not k:
        return empty
    w = q / np.sqrt(e)
    check = sum(panels(fit, lambda _, a: scatter(project(spark, a, w)))) / n
    error = float(np.abs(check - np.eye(k)).max())

    def written(p: int, a: BlockMatrix) -> DataFrame:
        t = callMLlibFunc("getMatrixBlocks", project(spark, a, w)._java_matrix_wrapper._java_model)
        return tmp.save(t.select(F.lit(p).cast("long").alias("panel"), F.col("_1._1").cast("long").alias("block"), F.col("_2").alias("matrix")))

    done = panels(rows, written)
    plain = StructType().add("panel", LongType()).add("block", LongType()).add("matrix", MatrixUDT.sqlType())
    whitened = spark.read.schema(plain).parquet(*[d._tessera_path for d in done])
    m = F.col("matrix")
    at = lambda i, j: F.get(m["values"], F.when(m["isTransposed"], i * k + j).otherwise(j * m["numRows"] + i))
    lines = F.transform(F.sequence(F.lit(0), m["numRows"] - 1), lambda i: F.array(*[at(i, j) for j in range(k)]))
    j = rows.select("panel", F.col("place._1").alias("block"), "id", "deviation").join(whitened.select("panel", "block", lines.alias("whitened")), ["panel", "block"])
    out = j.select(F.explode(F.arrays_zip("id", "deviation", "whitened")).alias("r")).select("r.*")
    return out.select("id", F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.lit([float(a) for a in e / np.trace(v)]).alias("explained"), F.lit(error).alias("identity_error"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    out = out.select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c"))
    return out.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


by_value(__name__)
