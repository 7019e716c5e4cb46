"""Ranking edges within cells and counting cells among the strongest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.sources.files import positions, stored


def edge_key(source="source", target="target") -> Column:
    """Display name of an edge; joins use the pair, since names may hold the separator."""
    return F.concat_ws("_", source, target)


def edges_of(grn: DataFrame) -> DataFrame:
    return grn.select("source", "target").distinct().withColumn("edge_key", edge_key())


def top_n(n_edges: int, te: float) -> int:
    """Number of edges in the fraction ``te``, halves to even."""
    return round(n_edges * te)


def ranked(grn: DataFrame, by: str = "w") -> DataFrame:
    """Position of each edge in its cell, strongest first: NaN above all numbers, ties by edge, null last.

    One shuffle on the cell; a literal bound on ``rank`` reaches the window as a group limit. ``by='abs'`` ranks magnitudes.
    """
    weight = F.abs("w") if by == "abs" else F.col("w")
    order = Window.partitionBy("cell_id").orderBy(weight.desc_nulls_last(), edge_key(), "source")
    return grn.withColumn("rank", F.row_number().over(order))


def top_edge_counts(grn: DataFrame, fractions: list[float], cells: DataFrame | None = None, n_edges: int | None = None, by: str = "w") -> DataFrame:
    """source, target, te, [cluster,] cell_count: cells that have the edge in their top fraction, 0 counts left out.

    All fractions come from one ranking; each is counted on its own, so their order doesn't matter. The fraction is of all
    edges, also within clusters.
    """
    n = n_edges if n_edges is not None else edges_of(grn).count()
    sizes = [(te, top_n(n, te)) for te in fractions]
    most = max([s for _, s in sizes], default=0)
    top = ranked(grn, by).filter(F.col("rank") <= most)
    keys = ["source", "target"]
    if cells is not None:
        top, keys = top.join(cells, "cell_id"), [*keys, "cluster"]
    names = [f"te{i}" for i in range(len(sizes))]
    wide = top.groupBy(*keys).agg(*[F.count(F.when(F.col("rank") <= s, 1)).alias(name) for name, (_, s) in zip(names, sizes, strict=True)])
    pairs = F.array(*[F.struct(F.lit(te).alias("te"), F.col(name).alias("cell_count")) for name, (te, _) in zip(names, sizes, strict=True)])
    return wide.select(*keys, F.inline(pairs)).filter("cell_count > 0")


def annotate_global(grn: DataFrame, fractions: list[float], key_name: str = "global", nan_fill: int = 0) -> DataFrame:
    """All edges with one count column for each fraction, named {key_name}_cell_count_{te}."""
    every = stored(edges_of(grn))
    wide = top_edge_counts(grn, fractions, n_edges=every.count()).groupBy("source", "target")
    wide = wide.agg(*[F.max(F.when(F.col("te") == te, F.col("cell_count"))).alias(f"{key_name}_cell_count_{te}") for te in fractions])
    return every.join(wide, ["source", "target"], "left").fillna(nan_fill)


def annotate_clusters(grn: DataFrame, fractions: list[float], cells: DataFrame, nan_fill: int = 0) -> DataFrame:
    """All edges with columns cell_count_{te}_{cluster}; clusters come from ``cells``."""
    every = stored(edges_of(grn))
    counts = top_edge_counts(grn, fractions, cells, every.count())
    names = [f"cell_count_{te}_{c}" for te in fractions for c in sorted(r[0] for r in cells.select("cluster").distinct().collect())]
    wide = counts.withColumn("name", F.concat(F.lit("cell_count_"), F.col("te").cast("string"), F.lit("_"), F.col("cluster").cast("string"))).groupBy("source", "target").pivot("name", names)
    return every.join(wide.agg(F.first("cell_count")), ["source", "target"], "left").fillna(nan_fill)


def filter_clusters(counts: DataFrame, n_edges: int, fraction: float, first: str, second: str) -> DataFrame:
    """Union of the top edges by (first, second) and by (second, first); ``counts`` has both columns, ties go by edge key.

    The share of the edges that stays may be large, so edges are sorted by range and numbered instead of gathered by a limit.
    """
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be above 0 and at most 1")
    missing = {first, second} - set(counts.columns)
    if missing:
        raise KeyError(f"missing columns: {sorted(missing)}")
    n = max(1, int(n_edges * fraction))
    order = lambda a, b: [F.col(f"`{a}`").desc(), F.col(f"`{b}`").desc(), F.col("edge_key").asc()]
    tops = [positions(counts, order(a, b), "__at").filter(F.col("__at") < n).drop("__at") for a, b in ((first, second), (second, first))]
    return tops[0].unionByName(tops[1]).distinct()


def quantile_partition(values: DataFrame, group: list[str], value: str, order: list[str], q: int) -> DataFrame:
    """Replace each value by k / q, k the part of the group's sorted order that it is in.

    Part k ends before floor(k * (n / q)), evaluated in double; positions beyond the last end, which the rounding can leave, get 0.
    """
    if q <= 0:
        raise ValueError("q must be positive")
    w = Window.partitionBy(*group)
    p = F.row_number().over(w.orderBy(value, *order)) - 1
    n = F.count(F.lit(1)).over(w).cast("double")
    ends = F.transform(F.sequence(F.lit(1), F.lit(q)), lambda k: F.floor(k.cast("double") * (F.col("__n") / F.lit(float(q)))))
    above = F.size(F.filter(ends, lambda e: e > F.col("__p")))
    out = values.withColumn("__p", p).withColumn("__n", n).withColumn("part", F.when(above == 0, 0.0).otherwise((F.lit(q + 1) - above).cast("double") / q))
    return out.drop("__p", "__n")


def keep_edges(grn: DataFrame, edges: DataFrame) -> DataFrame:
    return grn.join(edges.select("source", "target"), ["source", "target"], "left_semi")


def count_totals(wide: DataFrame) -> DataFrame:
    """threshold, cluster, cell_count: sums of the columns cell_count_{te}_{cluster} of ``annotate_clusters``, one row for each."""
    names = [c for c in wide.columns if c.startswith("cell_count_") and len(c.split("_")) == 4]
    if not names:
        raise KeyError("no columns cell_count_{te}_{cluster}")
    sums = wide.agg(*[F.sum(f"`{c}`").alias(c) for c in names])
    parts = [F.struct(F.lit(float(c.split("_")[2])).alias("threshold"), F.lit(c.split("_")[3]).alias("cluster"), F.col(f"`{c}`").alias("cell_count")) for c in names]
    return sums.select(F.inline(F.array(*parts)))


def genes_of(edges: DataFrame) -> DataFrame:
    """All names that are a source or a target."""
    return edges.select(F.col("source").alias("gene")).union(edges.select("target")).distinct()


def ordered_names(genes: DataFrame, names: DataFrame, only: bool = True) -> DataFrame:
    """``genes(gene_idx, gene)`` among the names, or all of them, in the order of gene_idx; ValueError if none is left."""
    kept = filter_names(genes.select("gene"), names, only)
    return genes.join(kept.select("gene"), "gene", "left_semi").select("gene_idx", "gene").orderBy("gene_idx")


def filter_names(genes: DataFrame, names: DataFrame, only: bool = True) -> DataFrame:
    """Genes among the names (one column, any name), or all of them; ValueError if none is left."""
    if not only:
        return genes
    out = genes.join(names.toDF("gene").distinct(), "gene", "left_semi")
    if out.isEmpty():
        raise ValueError("no name is a gene")
    return out
