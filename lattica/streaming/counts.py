"""Top-edge counts over a stream of cells.

A cell's weights arrive together in one packed row, so ranking is local to the row and counts add up over micro-batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pack(grn: DataFrame) -> DataFrame:
    """cell_id, edges: one row a cell with all its (w, source, target)."""
    return grn.groupBy("cell_id").agg(F.collect_list(F.struct("w", "source", "target")).alias("edges"))


def streaming_counts(cells: DataFrame, n_top: int) -> DataFrame:
    """Running source, target, cell_count of ``cells(cell_id, edges)``; no state but the counts."""
    before = lambda a, b: F.when(a["w"] > b["w"], -1).when(a["w"] < b["w"], 1).when(F.concat_ws("_", a["source"], a["target"]) < F.concat_ws("_", b["source"], b["target"]), -1).otherwise(1)
    top = F.slice(F.array_sort("edges", before), 1, n_top)
    return cells.select(F.explode(top).alias("e")).groupBy("e.source", "e.target").agg(F.count(F.lit(1)).alias("cell_count"))
