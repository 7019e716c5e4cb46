"""From raw documents to shards of text: language, near duplicates, benchmark passages, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, langid, mixing, neardup, sharding
from lattica.llm.common import table, word_count, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in which no language is found: null, empty or without a letter. An empty table stays empty."""
    return langid.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by five-word similarity of 0.8 or more, the one with the smallest id.

    Documents without id come last in a group, wordless texts are one group, repeated rows count as copies.
    """
    return neardup.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which benchmark windows cover a twentieth of the words or more; null and empty texts stay."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source to its budget: repeat documents of epochs, shorten the document at the cut; wordless texts go."""
    return mixing.mixed(docs, word_count(F.col("text")))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shards: each row of the mixture, repeats and text included, with size, CRC, shard and its slot in the shard.

    Null ids, sources and texts keep their rows; an empty table gives no shard.
    """
    return sharding.sharded(docs)


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("sharding", shards),
]

#: XXH64 and hyperdimensional profiles are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
