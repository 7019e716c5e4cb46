"""Readers and writers: intervals, annotations, name and edge lists, tables, settings."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import asdict, dataclass, fields
from pathlib import Path

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BED_SCHEMA = "chr string, start long, end long, TF_list string, TF_number long, strand string, number1 long, number2 long, large_number string"
GTF_SCHEMA = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"
GTF_ATTRIBUTES = ("gene_id", "gene_version", "gene_name", "gene_source", "gene_biotype")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Headerless tab-separated intervals with the comma-separated factors also as an array."""
    return spark.read.csv(path, sep="\t", schema=BED_SCHEMA).withColumn("TF_list_list", F.split("TF_list", ","))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF lines with the gene attributes as columns."""
    df = spark.read.csv(path, sep="\t", schema=GTF_SCHEMA, comment="#", quote="")
    return df.select("*", *[F.regexp_extract("attributes", rf'{a} "([^"]*)"', 1).alias(a) for a in GTF_ATTRIBUTES]).drop("attributes")


def gene_annotation(gtf: DataFrame) -> DataFrame:
    """Named genes of a GTF table with chromosome names that start with chr."""
    columns = ["seqname", "source", "feature", "start", "end", "score", "strand", "frame", *GTF_ATTRIBUTES]
    return gtf.filter("feature = 'gene'").select(columns).filter("gene_name <> ''").withColumn("chr", F.concat(F.lit("chr"), "seqname"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """One name a line, without header."""
    return spark.read.csv(path, schema="tfs string")


def read_edges(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited source and target with header; every weight is 1."""
    return spark.read.csv(path, sep=sep, header=True).withColumn("weight", F.lit(1.0))


def choose_layer(expr: DataFrame, layer: str = "X") -> DataFrame:
    """x as float from the column ``counts`` if that layer is asked for, else from ``x``."""
    return expr.withColumn("x", F.col("counts" if layer == "counts" else "x").cast("float"))


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write Parquet; an existing table raises unless ``overwrite``."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; a temporary one where it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written below spark.checkpoint.dir and read back: lineage ends there, and lost executors cost nothing."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the place of each row from 0 by ``order``.

    Rows are sorted by range and written; a row's file and its place there number it, with sums of the files' rows, so no task has
    more than its range.
    """
    done = stored(df.repartitionByRange(*order).sortWithinPartitions(*order))
    file = F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.file_name").alias("file"))
    kept = [F.col(f"`{c}`") for c in df.columns]
    done = done.select(*kept, file.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = F.sum("__n").over(Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    starts = done.groupBy("__file").agg(F.count(F.lit(1)).alias("__n")).select("__file", F.coalesce(before, F.lit(0)).alias("__start"))
    return done.join(F.broadcast(starts), "__file").select(*kept, (F.col("__start") + F.col("__row")).alias(name))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass
class Settings:
    """Run settings as a YAML mapping; unknown keys raise TypeError."""

    # fixed values: the keys of the settings format
    input_data: str = "data.parquet"
    layer: str = "X"
    output_directory: str = "output"
    transcription_factors: str = ""
    tf_only: bool = True
    penalize_error: bool = True
    adata_filename: str = "network.parquet"
    grn: str = "network.tsv"
    masking_percentage: float = 0.1
    print_every: int = 100
    optimizer: str = "Adam"
    learning_rate: float = 0.005
    epochs: int = 10_000
    n_models: int = 20
    validation_size: float = 0.2
    model: str = "NegativeBinomialAutoencoder"
    xai_method: str = "GradientShap"
    aggregation_strategy: str = "mean"

    @classmethod
    def read_yaml(cls, path: str) -> Settings:
        return cls(**(yaml.safe_load(Path(path).read_text()) or {}))

    def write_yaml(self, path: str) -> None:
        write_mapping(asdict(self), path)


def write_mapping(mapping: dict, path: str) -> None:
    Path(path).write_text(yaml.safe_dump(mapping, sort_keys=False))


SETTING_NAMES = tuple(f.name for f in fields(Settings))
