"""Queries of the reference's operators and their SQL, by name (the survey's row ids, then what they compute)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict = {}


def even(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places (no negative zero), integers as long: what both engines can be held to."""
    out = []
    for f in df.schema:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        out.append((F.round(c, 6) + 0.0).alias(f.name) if kind in ("double", "float") else c.cast("long").alias(f.name) if kind in ("integer", "short", "byte") else c)
    return df.select(*out)


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, sf_dir)`` under ``name``."""

    def wrap(f):
        QUERIES[name] = lambda spark, sf_dir: even(f(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return f

    return wrap


def r6(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0e0 AS {name}"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["TE_differential"](spark, sf_dir)


from tessera.plans import queries_objects, queries_raster, queries_spatial, queries_stats  # noqa: E402, F401
