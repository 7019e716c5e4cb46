"""Proportional stratified interleaving into shards, law ``rows``.

Within each source the rows are shuffled by a seeded hash and ranked; all rows are then sorted by fractional rank
(rank + 1/2) / rows of the source, and the sorted order is cut into shards of equal counts, so every shard has each source in
its overall proportion. Both orders are sorted by range over their whole keys and numbered by file and place, so neither a large
source nor many sources of one row fill a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import bins_for, numbered, placed, random_key, source_key, table, written

SHARDS = 8
SEED = "shard"


def interleave(docs: DataFrame, shards: int = SHARDS, per_bin: int = 20_000) -> DataFrame:
    """Shard and slot of each row of ``docs(doc_id, source, text)``.

    Returns doc_id, source, size (UTF-8 bytes plus 1; a null text has size 1 and CRC 0), text_crc32, shard, slot. Counts of the
    shards differ by one at most; slots have no gaps. Null sources form one source. Rows equal in doc_id are told apart by size
    and CRC, then by their place in the table. With fewer rows than shards some shards stay empty. Texts are not shuffled.
    """
    rows = numbered(docs.select("doc_id", "source", "text"), "shard-texts")
    slim = written(rows.select(F.col("at").alias("__at"), "row.*").select(F.col("__at").alias("at"), *_slim_columns()), "shard-rows")
    return _placed(slim, shards, per_bin).drop("at")


def _slim_columns() -> list:
    text = F.col("text")
    return ["doc_id", "source", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32")]


def _placed(slim: DataFrame, shards: int = SHARDS, per_bin: int = 20_000) -> DataFrame:
    """``interleave`` for ``slim(at, doc_id, source, size, text_crc32)``, a written table in which ``at`` numbers the rows; both
    orders are sorted in ranges of about ``per_bin`` rows."""
    total = slim.count()
    ranges = bins_for(total, per_bin)
    order = ["key", "doc_id", "size", "text_crc32", "at"]
    slim = slim.withColumn("tree", source_key(F.col("source"))).withColumn("key", random_key(F.col("doc_id"), SEED))
    ranked = placed(slim, order, "shard-ranks", ranges).withColumn("fraction", (F.col("pos") + F.lit(0.5)) / F.col("n"))
    ranked = ranked.withColumnRenamed("tree", "skey").drop("pos", "n").withColumn("tree", F.lit("all"))
    placed_rows = placed(ranked, ["fraction", "skey", *order], "shard-places", ranges)
    shard = F.expr(f"(pos * {shards}) div {max(total, 1)}")
    placed_rows = placed_rows.withColumn("shard", shard.cast("int"))
    slot = F.col("pos") - F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed_rows.select("at", "doc_id", "source", "size", "text_crc32", "shard", slot.cast("long").alias("slot"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs(doc_id, source, text, ...)``, text included, with size, text_crc32, shard and slot as in ``interleave``.

    Rows are told apart by a number of their own, so documents that a mix repeats keep each their place. Columns of the names
    made here are replaced. Null texts stay null; an empty table gives an empty one.
    """
    kept = [c for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]
    rows = numbered(docs.select(*kept), "shard-texts")
    slim = written(rows.select(F.col("at").alias("__at"), "row.*").select(F.col("__at").alias("at"), *_slim_columns()), "shard-rows")
    places = _placed(slim, shards).select("at", "size", "text_crc32", "shard", "slot")
    return rows.join(places, "at").select(*[F.col(f"row.{c}") for c in kept], "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write ``sharded(docs)`` as one folder per shard, its rows in the order of slots within and across the files."""
    out = written(sharded(docs, shards), "shards")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, by the law ``rows``."""
    placed = interleave(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: CRC-32 (polynomial 0xEDB88320) has no DuckDB function; the fold over the UTF-8 bytes is spelled out.
ORACLE = r"""
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS t),
c AS (SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey, coalesce(strlen(text), 0) + 1 AS size,
    CASE WHEN text IS NULL THEN 0 ELSE xor(4294967295, list_reduce(list_transform(range(1, 2 * strlen(text), 2), lambda p: CAST('0x' || substr(hex(encode(text)), p, 2) AS BIGINT)),
        lambda a, b: xor(a // 256, t[1 + xor(a % 256, b)]), 4294967295)) END AS text_crc32,
    md5('shard:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents, tab),
r AS (SELECT *, (row_number() OVER (PARTITION BY skey ORDER BY key, doc_id, size, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY skey) AS fraction, count(*) OVER () AS total FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY fraction, skey, key, doc_id, size, text_crc32) - 1 AS pos FROM r),
s AS (SELECT *, (pos * 8) // total AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard,
    CAST(pos - (shard * total + 7) // 8 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""
