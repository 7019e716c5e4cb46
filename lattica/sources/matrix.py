"""Matrices of cells and edges as tidy tables, and the check of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wrap(matrix: DataFrame, var: DataFrame, obs: DataFrame | None = None) -> DataFrame:
    """Tidy rows of ``matrix(cell_id, v array)`` by position: entry i of v belongs to the row of ``var(idx, ...)`` with idx i.

    Columns of ``obs(cell_id, ...)`` join by cell. ValueError where a cell's array and ``var`` differ in length, or a key of
    ``var`` or ``obs`` repeats, since rows would multiply then.
    """
    for table, key in ((var, "idx"), (obs, "cell_id")):
        if table is not None and not table.groupBy(key).count().filter("count > 1").isEmpty():
            raise ValueError(f"{key} repeats")
    size = var.count()
    if not matrix.filter(F.size("v") != size).isEmpty():
        raise ValueError(f"arrays must have {size} entries")
    out = matrix.select("cell_id", F.posexplode("v").alias("idx", "w")).join(var, "idx").drop("idx")
    return out if obs is None else out.join(obs, "cell_id", "left")


def checked(grn: DataFrame, *keys: str) -> DataFrame:
    """``grn`` itself; ValueError if a key (by default cell, source and target) has several rows or a null."""
    keys = keys or ("cell_id", "source", "target")
    null = grn.filter(" or ".join(f"{k} is null" for k in keys))
    if not grn.groupBy(*keys).count().filter("count > 1").isEmpty() or not null.isEmpty():
        raise ValueError(f"{', '.join(keys)} must be unique and not null")
    return grn
