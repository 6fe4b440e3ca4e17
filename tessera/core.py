"""Session defaults and written intermediate tables.

Loops (components, nearest neighbours, spanning trees) cut their lineage by writing each
round to Parquet below ``spark.checkpoint.dir``: a lost executor then re-reads files instead of
replaying the loop, and a re-read table has no partitioning of its own, so that adaptive
execution may split a skewed join over it.
"""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import itertools
import os
import shutil
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tessera", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, else (local runs) a temporary one."""
    d = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = have.get() if have.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="tessera-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        d = "file://" + own
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


_SCOPE: contextvars.ContextVar[list | None] = contextvars.ContextVar("scope", default=None)


@contextlib.contextmanager
def scratch_scope():
    """Owns the scratch tables of the operators called inside it: write or collect their results inside it too.

    Yields the list of ``(session, folder)``; the folders are deleted at the end, unless the caller takes them off the list. Without a scope
    they stay until their folder is cleared: a result that was not read yet still needs them.
    """
    made: list[tuple[SparkSession, str]] = []
    token = _SCOPE.set(made)
    try:
        yield made
    finally:
        _SCOPE.reset(token)
        drop(made)


def drop(made: list[tuple[SparkSession, str]]) -> None:
    """Delete folders that a scope has listed, and empty the list."""
    while made:
        delete(*made.pop())


class Scratch:
    """Written tables of one operator run, in a folder of their own under the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.ids = itertools.count(1)  # safe between threads
        owner = _SCOPE.get()
        if owner is not None:
            owner.append((spark, self.root))

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back; the schema is kept, so no file is opened to infer it."""
        path = f"{self.root}/{next(self.ids)}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables of earlier rounds that nothing reads any more."""
        for df in dfs:
            path = getattr(df, "_tessera_path", None)
            if path:
                delete(self.spark, path)


def _at(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Spark sees them."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def replace(spark: SparkSession, new: str, old: str) -> None:
    """Put a written folder in the place of another."""
    fs, p = _at(spark, new)
    q = _at(spark, old)[1]
    fs.delete(q, True)
    if not fs.rename(p, q):
        raise OSError(f"{new} was not moved to {old}")


def ship(module: str) -> None:
    """Send the task-side functions of a module to executors by value, so that workers need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)  # modules that are sent hold ``ship`` itself


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
