"""Joining edges with external networks and genome intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.edges import edge_key, edges_of


def external_weight(net: DataFrame) -> DataFrame:
    """One weight for each edge of ``net(source, target, weight, ord)``: of duplicates the last by ``ord``."""
    return net.groupBy("source", "target").agg(F.max_by("weight", "ord").alias("weight"))


def add_external(edges: DataFrame, net: DataFrame, name: str = "external") -> DataFrame:
    """edge_in_{name} (0 if absent), is_target_{name}, is_source_{name}; membership is in the whole external network."""
    out = edges.join(external_weight(net).withColumnRenamed("weight", f"edge_in_{name}"), ["source", "target"], "left")
    for end in ("target", "source"):
        known = net.select(F.col(end)).distinct().withColumn(f"is_{end}_{name}", F.lit(True))
        out = out.join(known, end, "left")
    return out.fillna(0.0, [f"edge_in_{name}"]).fillna(False, [f"is_target_{name}", f"is_source_{name}"])


def edge_overlap(edges: DataFrame, nets: list[tuple[str, DataFrame]]) -> DataFrame:
    """net, percent: rows of the inner join per 100 rows of each network; duplicates multiply, an empty network gives 0."""
    spark = edges.sparkSession
    names = spark.createDataFrame([(f"{name}__{i}",) for i, (name, _) in enumerate(nets)], "net string")
    parts = []
    for i, (name, net) in enumerate(nets):
        if missing := {"source", "target"} - set(net.columns):
            raise KeyError(f"missing columns: {sorted(missing)}")
        parts.append(net.select(F.lit(f"{name}__{i}").alias("net"), "source", "target"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionAll(part)
    copies = edges.groupBy("source", "target").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.join(copies, ["source", "target"], "left")
    share = rows.groupBy("net").agg((F.lit(100.0) * F.coalesce(F.sum("copies"), F.lit(0)) / F.count(F.lit(1))).alias("percent"))
    return names.join(share, "net", "left").fillna(0.0, ["percent"])


#: Bins of level k are 2 to the power of FINEST + STEP k wide; one bin of the last level holds everything.
FINEST, STEP, LEVELS = 10, 3, 18


def _bin(place, level: int):
    return F.lit(0).cast("long") if level == LEVELS else F.shiftright(place, FINEST + STEP * level)


def regulators(crm: DataFrame, genes: DataFrame, window: int) -> DataFrame:
    """TF, gene, nTFs, edge, regulator for factors of intervals within ``window`` of a gene's start, both ends inclusive.

    Each interval, widened by the window, is one row in the smallest bin that holds it, of bins in levels of eightfold width; a
    gene's start looks into its bin of each level that has intervals. So the range join is an equality join on chromosome, level
    and bin with the band as residual, and makes no more rows than intervals plus levels x genes, however long intervals are. A
    factor counts once for a gene, since factors form a set. An interval that ends before it starts counts if both its ends
    are within the window. Without a hit: empty.
    """
    c = crm.select("chr", (F.col("start").cast("long") - window).alias("lo"), (F.col("end").cast("long") + window).alias("hi"), "TF_list_list").filter("lo <= hi")
    level = F.coalesce(*[F.when(_bin(F.col("lo"), k) == _bin(F.col("hi"), k), k) for k in range(LEVELS + 1)])
    c = c.withColumn("level", level)
    used = sorted(r[0] for r in c.select("level").distinct().collect())
    at = lambda place, levels: F.coalesce(*[F.when(F.col("level") == k, _bin(place, k)) for k in levels], F.lit(0).cast("long"))
    c = c.withColumn("bin", at(F.col("lo"), used))
    g = genes.select("chr", "gene_name", F.col("start").cast("long").alias("tss"))
    g = g.withColumn("level", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>"))).withColumn("bin", at(F.col("tss"), used))
    hits = c.join(g, ["chr", "level", "bin"]).filter("tss between lo and hi").select("gene_name", F.explode("TF_list_list").alias("TF")).distinct()
    sizes = hits.groupBy("gene_name").agg(F.count(F.lit(1)).alias("nTFs"))
    out = hits.join(sizes, "gene_name")
    return out.select("TF", F.col("gene_name").alias("gene"), "nTFs", edge_key("TF", "gene_name").alias("edge"), F.lit(True).alias("regulator"))


def add_regulators(edges: DataFrame, tf2gene: DataFrame, name: str = "") -> DataFrame:
    """regulator_{name}: whether the edge is among the regulators."""
    known = tf2gene.select(F.col("TF").alias("source"), F.col("gene").alias("target")).distinct().withColumn(f"regulator_{name}", F.lit(True))
    return edges.join(known, ["source", "target"], "left").fillna(False, [f"regulator_{name}"])


def mode():
    """Activation, Repression or Unknown from the interaction flags."""
    return F.when(F.col("is_stimulation"), "Activation").when(F.col("is_inhibition"), "Repression").otherwise("Unknown")


def curate(edges: DataFrame, net: DataFrame, tfs: DataFrame | None = None) -> DataFrame:
    """Edges that a network with interaction flags knows, with their mode; ``tfs`` restricts the network's sources."""
    net = net.withColumn("mode", mode())
    if tfs is not None:
        net = net.join(tfs.toDF("source_genesymbol").distinct(), "source_genesymbol", "left_semi")
    return edges.join(net, (edges["source"] == net["source_genesymbol"]) & (edges["target"] == net["target_genesymbol"]))


def with_target_clusters(edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Edges with the columns of their target in ``genes(gene, ...)``; targets without an entry drop."""
    return edges.join(genes.withColumnRenamed("gene", "target"), "target")


__all__ = ["add_external", "add_regulators", "curate", "edge_overlap", "edges_of", "external_weight", "mode", "regulators", "with_target_clusters"]
