"""Keys parsed from names, and names of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = (1, 1)
CONTROL_LEVEL = "KC"


def base_name(path: Column) -> Column:
    """File name without directories and without its last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"^(.+)\.[^.]*$", "$1")


def type_key(path: Column) -> Column:
    """First digits after an underscore; else what stands before the first underscore; else the name without extension."""
    file = F.regexp_extract(path, r"([^/]*)$", 1)
    digits = F.nullif(F.regexp_extract(file, r"_(\d+)", 1), F.lit(""))
    return F.coalesce(digits, F.when(F.contains(file, F.lit("_")), F.substring_index(file, "_", 1)), base_name(path))


def grid_position(name: Column, strict: bool = False) -> tuple[Column, Column]:
    """Row and column from ``r#_c#``, else ``col#...row#``, else ``row#...col#``; both from the first form that is there.

    Null (strict: an error) if none is, or if its numbers are no ints.
    """
    forms = [("(?is)" + p, i, j) for p, i, j in ((r"r(\d+)_c(\d+)", 1, 2), (r"col(\d+).*row(\d+)", 2, 1), (r"row(\d+).*col(\d+)", 1, 2))]
    r = c = None
    for pattern, i, j in forms:
        here = F.rlike(name, F.lit(pattern))
        x, y = (F.regexp_extract(name, pattern, g).try_cast("int") for g in (i, j))
        r, c = (F.when(here, x), F.when(here, y)) if r is None else (r.when(here, x), c.when(here, y))
    if strict:
        bad = F.raise_error(F.concat(F.lit("no row and column in "), name)).cast("int")
        r, c = F.coalesce(r, bad), F.coalesce(c, bad)
    return r, c


def not_control(df: DataFrame, r: str = "r", c: str = "c") -> DataFrame:
    """Drop the control position; rows without a position are dropped too, as three-valued logic has it only where the known part matches."""
    return df.where(~((F.col(r) == CONTROL[0]) & (F.col(c) == CONTROL[1])))


def real_levels(df: DataFrame, level: str = "level") -> DataFrame:
    return df.where(F.col(level).isNotNull() & (F.col(level).cast("string") != CONTROL_LEVEL))


def legacy(feature: Column) -> Column:
    """Features in pixel units, of outputs made before lengths were physical."""
    return F.contains(F.lower(feature), F.lit("_px"))


def testable(feature: Column) -> Column:
    """Features that are tested: not in pixel units, and no intensity but raw ones."""
    low = F.lower(feature)
    return ~legacy(feature) & (~F.contains(low, F.lit("intensity")) | F.contains(low, F.lit("intensity_raw")))


def sanitize(s: Column) -> Column:
    return F.regexp_replace(s, r"[^A-Za-z0-9_.-]", "_")


def length_label(um: float) -> str:
    """Three significant digits, with p for the point and m for minus: 0.2738 is ``0p274``."""
    return format(um, ".3g").replace(".", "p").replace("-", "m")


def scale_label(um: float) -> str:
    return f"s{length_label(um)}um"

