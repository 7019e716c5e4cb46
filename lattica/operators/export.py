"""Tables behind network drawings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COLOURS = {"Activation": "green", "Repression": "red", "Unknown": "grey"}


def undirected(edges: DataFrame, regulons: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the chosen sources: both directions of an edge are one, no self loops. ValueError if none matches."""
    own = edges.filter(F.col("source").isin(regulons) & (F.col("source") != F.col("target")))
    own = own.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    if own.isEmpty():
        raise ValueError("no regulon matches")
    return own.select(F.col("a").alias("node")).union(own.select("b")).distinct(), own


def directed(curated: DataFrame, regulons: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges with the colour of their mode) of the chosen sources."""
    colours = F.create_map(*[F.lit(x) for kv in COLOURS.items() for x in kv])
    own = curated.filter(F.col("source").isin(regulons)).select("source", "target", "mode", colours[F.col("mode")].alias("colour")).distinct()
    return own.select(F.col("source").alias("node")).union(own.select("target")).distinct(), own


def heatmap(shared: DataFrame) -> DataFrame:
    """The matrix of shared targets, one row and one column for each source."""
    return shared.groupBy("a").pivot("b").agg(F.first("shared")).orderBy("a")


def write_html(nodes: DataFrame, edges: DataFrame, path: str, most: int = 5000) -> None:
    """A page that lists a network's edges; drawings have bounded size, a larger network raises."""
    rows = edges.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} edges")
    body = "".join("<tr>" + "".join(f"<td>{x}</td>" for x in r) + "</tr>" for r in rows)
    with open(path, "w") as f:
        f.write(f"<html><body><table>{body}</table></body></html>")
