"""Network and expression views over relational tables.

Each view is a lazy DataFrame: (cell, gene, x) for expression, (cell, source, target, w) for per-cell networks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def complete(raw: DataFrame) -> DataFrame:
    """Give every cell every edge of ``raw(cell_id, source, target, w)``; absent ones weigh 0.

    The result has cells x edges rows by definition; edges, the small side, are replicated to the cells.
    """
    edges, cells = raw.select("source", "target").distinct(), raw.select("cell_id").distinct()
    return cells.crossJoin(edges).join(raw, ["cell_id", "source", "target"], "left").fillna(0.0, ["w"])


def _weights(spark: SparkSession, sf_dir: str, target) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("cell_id"), "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("source"), target.alias("target"))
    return lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("cell_id", "source", "target").agg(F.sum("l_quantity").alias("w"))


def grn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complete(_weights(spark, sf_dir, F.col("p_type")))


def square_grn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network whose targets are of the same kind as its sources, so most edges have a reverse."""
    return complete(_weights(spark, sf_dir, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cell_id"), (F.col("s_nationkey") % 2).cast("int").alias("cluster"))


def expr_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_suppkey").alias("cell_id"), "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("gene"))
    raw = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy("cell_id", "gene").agg(F.sum("l_quantity").alias("x"))
    every = raw.select("cell_id").distinct().crossJoin(raw.select("gene").distinct())
    return every.join(raw, ["cell_id", "gene"], "left").fillna(0.0, ["x"])


def expr_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell_id"), F.posexplode("embedding").alias("gene", "x")).withColumn("x", F.col("x").cast("double"))


def ext_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_size <= 5")
    return parts.select(F.col("p_brand").alias("source"), F.col("p_type").alias("target"), F.col("p_size").cast("double").alias("weight"), F.col("p_partkey").alias("ord"))


def moded_net(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").filter("p_size <= 5")
    return parts.select(F.col("p_brand").alias("source_genesymbol"), F.col("p_type").alias("target_genesymbol"), (F.col("p_size") % 2 == 0).alias("is_stimulation"), (F.col("p_size") % 3 == 0).alias("is_inhibition"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'signup'")
    return e.select(F.col("user_id").cast("string").alias("chr"), F.unix_timestamp("ts").alias("start"), F.col("event_id").cast("string").alias("gene_name"))


def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type <> 'signup'")
    at = F.unix_timestamp("ts")
    return e.select(F.col("user_id").cast("string").alias("chr"), at.alias("start"), (at + F.floor("value")).alias("end"), F.array("event_type").alias("TF_list_list"))


def count_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("y"))


#: The same views as DuckDB CTEs.
SQL = {
    "raw": "raw AS (SELECT l_suppkey AS cell_id, p_brand AS source, p_type AS target, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "grn": "grn AS (SELECT c.cell_id, e.source, e.target, coalesce(r.w, 0.0) AS w FROM (SELECT DISTINCT cell_id FROM raw) c CROSS JOIN (SELECT DISTINCT source, target FROM raw) e LEFT JOIN raw r ON r.cell_id = c.cell_id AND r.source = e.source AND r.target = e.target)",
    "rawsq": "rawsq AS (SELECT l_suppkey AS cell_id, p_brand AS source, 'Brand#' || (p_partkey % 25 + 1) AS target, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "sq": "sq AS (SELECT c.cell_id, e.source, e.target, coalesce(r.w, 0.0) AS w FROM (SELECT DISTINCT cell_id FROM rawsq) c CROSS JOIN (SELECT DISTINCT source, target FROM rawsq) e LEFT JOIN rawsq r ON r.cell_id = c.cell_id AND r.source = e.source AND r.target = e.target)",
    "cells": "cells AS (SELECT s_suppkey AS cell_id, s_nationkey % 2 AS cluster FROM supplier)",
    "rawx": "rawx AS (SELECT l_suppkey AS cell_id, p_brand AS gene, sum(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)",
    "expr": "expr AS (SELECT c.cell_id, g.gene, coalesce(r.x, 0.0) AS x FROM (SELECT DISTINCT cell_id FROM rawx) c CROSS JOIN (SELECT DISTINCT gene FROM rawx) g LEFT JOIN rawx r ON r.cell_id = c.cell_id AND r.gene = g.gene)",
    "net": "net AS (SELECT p_brand AS source, p_type AS target, CAST(p_size AS DOUBLE) AS weight, p_partkey AS ord FROM part WHERE p_size <= 5)",
    "loci": "loci AS (SELECT CAST(user_id AS VARCHAR) AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(event_id AS VARCHAR) AS gene_name FROM events WHERE event_type = 'signup')",
    "crm": "crm AS (SELECT CAST(user_id AS VARCHAR) AS chr, CAST(floor(epoch(ts)) AS BIGINT) AS start, CAST(floor(epoch(ts)) + floor(value) AS BIGINT) AS fin, event_type AS tf FROM events WHERE event_type <> 'signup')",
    "obs": "obs AS (SELECT user_id, event_type, CAST(count(*) AS DOUBLE) AS y FROM events GROUP BY ALL)",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
