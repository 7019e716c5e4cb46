"""What the text operators share: tables, word rules, written intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java/RE2 class of the characters that separate words.
SPACE = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of one key from which a join deals the key to several tasks.
HOT_ROWS = 1_000_000


def by_value(name: str) -> None:
    """Ship the functions of module ``name`` inside the tasks, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """row (all columns of ``docs``) and at, which tells every row apart and stays the same each time the rows are read.

    Rows of a table on disk are known by file and place in it, so nothing is written; other rows are written with a number first.
    """
    row, plan = F.struct(*docs.columns).alias("row"), docs._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() in ("Project", "SubqueryAlias"):
        plan = plan.children().apply(0)
    if plan.getClass().getSimpleName() == "LogicalRelation":
        try:
            place = F.concat_ws(":", F.hex(F.xxhash64("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
            return docs.select(row, place.alias("at"))
        except AnalysisException:  # no files behind it
            pass
    return written(docs.select(row).withColumn("at", F.monotonically_increasing_id().cast("string")), name)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound the rows of an Arrow batch, so a batch of long documents stays small in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0), with memory of the size of the text."""
    marks = F.regexp_replace(F.regexp_replace(text, f"[^{SPACE}]++", "x"), f"[{SPACE}]++", "")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, UPPER.lower())


def source_key(source: Column) -> Column:
    """A non-null key for grouping and joining by source; null is a source of its own."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def random_key(doc_id: Column, seed: str) -> Column:
    """Hash-random sort key of a document: hex MD5, the same in any SQL engine."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def chance(*values: Column) -> Column:
    """A hash-random number from 0 to 1 of some columns, over all 64 bits."""
    return (F.xxhash64(*values).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def sampled(docs: DataFrame, total: int, most: int, seed: str) -> DataFrame:
    """About ``most`` of the ``total`` rows of ``docs(doc_id, text, ...)`` by hash, at any total; rows without id by their text."""
    return docs if total <= most else docs.filter(chance(F.col("doc_id"), F.col("text"), F.lit(seed)) < F.lit(most / total))


def key_bin(key: Column, bins: int) -> Column:
    """Range bin of a hex key: bins follow the order of keys and have about equal numbers of them."""
    return F.expr("0").cast("long") if bins <= 1 else F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") * F.lit(bins / 2.0**32)).cast("long")


def spread(rows: DataFrame, bins: int, per_bin: int) -> DataFrame:
    """``rows(key, at, ...)`` with bin: the range bin of each key.

    Rows of one key share a bin, so a key with more than ``per_bin`` rows (documents without id, say, or repeated rows) would
    make a bin of any size. The row number ``at`` deals such rows out: their key becomes a hash of key and number.
    """
    rows = rows.withColumn("bin", key_bin(F.col("key"), bins))
    over = rows.groupBy("bin").count().filter(F.col("count") > 3 * per_bin)
    if over.isEmpty():
        return rows
    hot = rows.join(F.broadcast(over.select("bin")), "bin", "left_semi").groupBy("key").count().filter(F.col("count") > per_bin)
    rows = rows.join(F.broadcast(hot.select("key", F.lit(True).alias("__hot"))), "key", "left")
    rows = rows.withColumn("key", F.when(F.col("__hot"), F.md5(F.concat_ws(":", "key", "at"))).otherwise(F.col("key"))).drop("__hot")
    return rows.withColumn("bin", key_bin(F.col("key"), bins))


def bins_for(rows: int, per_bin: int = 20_000) -> int:
    return max(1, -(-rows // per_bin))


def dealt_join(many: DataFrame, one: DataFrame, key: str) -> DataFrame:
    """``many(key, ...)`` joined with ``one(key, ...)``, which has each key once; rows of ``many`` without a match go.

    ``many`` is a table on disk, so a row read again has the same number. A key with more than HOT_ROWS rows is dealt to as many
    parts as it fills, and its row of ``one`` goes to each of them. Such keys are fewer than the rows of ``many`` over HOT_ROWS, so
    telling them to all tasks is small.
    """
    hot = many.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT_ROWS)).cast("int").alias("__parts")).filter("__parts > 1")
    if hot.isEmpty():
        return many.join(one, key)
    hot = F.broadcast(hot)
    parts = F.coalesce("__parts", F.lit(1))
    many = many.join(hot, key, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
    one = one.join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return many.join(one, [key, "__part"]).drop("__part")


def told_apart(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` may be among those of ``keys``, rows whose key isn't), told by a bitmap of hashes: where both are joined
    afterwards, only the first need be shuffled. Exact for the second.

    The bitmap has 64 bits a key, 16 MB at most; with more than about 2 ** 27 keys nearly all rows are among the first.
    ``keys`` is a table on disk.
    """
    bits = 1 << min(27, max(15, (64 * keys.count()).bit_length()))
    place = (F.pmod(F.xxhash64(key), F.lit(bits)) + 1).alias("__place")
    marks = keys.select(place).groupBy(F.bitmap_bucket_number("__place").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__place")).alias("__bits"))
    found = rows.select("*", place).withColumn("__part", F.bitmap_bucket_number("__place")).join(F.broadcast(marks), "__part", "left")
    at = F.bitmap_bit_position("__place").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = found.withColumn("__in", F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), at % 8 + 1)) != 0, F.lit(False)))
    return found.filter("__in").select(*rows.columns), found.filter("not __in").select(*rows.columns)


def placed(rows: DataFrame, order: list, name: str, ranges: int | None = None) -> DataFrame:
    """``rows(tree, ...)`` with pos and n: the place of each row in its tree by ``order``, and the tree's rows.

    Rows are sorted in ``ranges`` ranges (as many as shuffles have partitions, if not given) and written; a row's file and place in
    it then number it, with sums of the files' rows.
    """
    columns = rows.columns
    by = ["tree", *order]
    dealt = rows.repartitionByRange(*by) if ranges is None else rows.repartitionByRange(ranges, *by)
    done = written(dealt.sortWithinPartitions(*by), name)
    part = F.struct(F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("int").alias("part"), F.col("_metadata.file_name").alias("file"))
    done = done.select(*columns, part.alias("__file"), F.col("_metadata.row_index").alias("__row"))
    runs = done.groupBy("tree", "__file").agg(F.count(F.lit(1)).alias("__count"), F.min("__row").alias("__first"))
    before = F.sum("__count").over(Window.partitionBy("tree").orderBy("__file").rowsBetween(Window.unboundedPreceding, -1))
    whole = F.sum("__count").over(Window.partitionBy("tree"))
    starts = runs.select("tree", "__file", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__start"), whole.alias("n"))
    return done.join(starts, ["tree", "__file"]).select(*columns, (F.col("__start") + F.col("__row")).alias("pos"), "n")
