"""Benchmark decontamination as a prefix-filtered set join.

An item gives windows of WINDOW words (a shorter item is one window). A window is the set of its word shingles, and it is
contained in a stretch of a document only if all of them are, so one shingle is a sufficient prefix: the rarest by the
shingles' counts over all documents. Documents' shingles are joined with the windows' prefixes; length and positional bounds
drop candidates that don't fit into the document; what is left is verified word by word over a stretch of the window's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import lower_ascii, numbered, table, written

WINDOW = 13
SHINGLE = 3
#: Up to so many bytes of windows are broadcast; beyond, the join is shuffled.
BROADCAST_BYTES = 48 << 20
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def line(text: Column) -> Column:
    """Words of a text joined by single spaces, after lower-casing A-Z: runs of digits, a-z and characters beyond ASCII."""
    return F.coalesce(F.trim(F.regexp_replace(lower_ascii(text), _BREAKS, " ")), F.lit(""))


def words(joined: Column) -> Column:
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def n_words(joined: Column) -> Column:
    return F.when(joined == "", F.lit(0)).otherwise(F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(" "), F.lit(""))) + 1)


def _shingles(df: DataFrame, joined: Column, sizes: list[int], *keep: str) -> DataFrame:
    """keep, size, pos, h for each shingle of the given sizes; h is a hash, verified later.

    The shingles of a size come from one match-all with a look ahead at each word, so nothing is evaluated word by word outside
    generated code.
    """
    found = [F.struct(F.lit(k).alias("size"), F.regexp_extract_all(joined, F.lit("(?=(" + " ".join(["[^ ]++"] * k) + "))[^ ]++"), F.lit(1)).alias("found")) for k in sizes]
    df = df.select(*keep, F.explode(F.array(*found)).alias("__p"))
    df = df.select(*keep, F.col("__p.size").alias("size"), F.posexplode("__p.found").alias("pos", "shingle"))
    return df.select(*keep, "size", "pos", F.xxhash64("shingle").alias("h"))


def windows(benchmark: DataFrame) -> DataFrame:
    """win, len, ws, items: each distinct window of the benchmark with the ids of the items that have it."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(line(F.col("text"))).alias("ws")).filter(F.size("ws") > 0)
    length = F.least(F.size("ws"), F.lit(WINDOW))
    one = items.select("item_id", length.alias("len"), F.explode(F.transform(F.sequence(F.lit(1), F.size("ws") - length + 1), lambda i: F.slice(F.col("ws"), i, F.lit(WINDOW)))).alias("ws"))
    return one.groupBy("ws", "len").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("win", F.array_join("ws", " "))


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted array), row (all its columns) of each row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no words and no hits; so does every document if the benchmark has no words. Rows that share a
    doc_id, null included, are judged each by its own text. A null item_id counts hits but no item.
    """
    wins = written(windows(benchmark.select("item_id", "text")), "decontam-windows")
    size = wins.agg(F.sum(F.octet_length("win") + 64), F.collect_set(F.least(F.col("len"), F.lit(SHINGLE)))).first()
    sizes = sorted(size[1])
    doc_id, text = F.col("row.doc_id"), F.col("row.text")
    out = numbered(docs, "decontam-rows") if sizes else docs.select(F.struct(*docs.columns).alias("row"))
    if not sizes:
        nothing = F.array().cast("array<string>")
        return out.select(doc_id.alias("doc_id"), n_words(line(text)).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), nothing.alias("items"), "row")
    small = (size[0] or 0) * 4 <= broadcast_bytes
    hint = F.broadcast if small else (lambda df: df)
    own = _shingles(wins, F.col("win"), sizes, "win", "len", "items").filter(F.col("size") == F.least(F.col("len"), F.lit(SHINGLE)))
    own = own.select("win", "len", "items", F.col("pos").alias("offset"), "h")
    lines = out.select("at", line(text).alias("line")).filter("line <> ''").withColumn("n", n_words(F.col("line")))
    placed = _shingles(lines, F.col("line"), sizes, "at", "n")
    met = written(placed.join(hint(own.select("h").distinct()), "h", "left_semi"), "decontam-met")
    counts = met.groupBy("h").count()
    rare = Window.partitionBy("win").orderBy("count", "h", "offset")
    prefix = own.join(counts, "h", "left").fillna(0, ["count"]).withColumn("__rank", F.row_number().over(rare)).filter("__rank = 1").drop("__rank", "count")
    prefix = written(prefix, "decontam-prefixes")
    start = F.col("pos") - F.col("offset")
    found = met.join(hint(prefix), "h").filter((start >= 0) & (start + F.col("len") <= F.col("n")))
    found = found.groupBy("at").agg(F.collect_list(F.struct(start.alias("start"), "len", "win", "items")).alias("found"))
    out = out.join(found, "at", "left")
    out = out.select("row", "found", line(text).alias("line"))
    out = out.select("row", "found", n_words(F.col("line")).alias("n"), F.when(F.col("found").isNotNull(), words(F.col("line"))).alias("ws"))
    same = lambda c: F.array_join(F.slice(F.col("ws"), c["start"] + 1, c["len"]), " ") == c["win"]
    none = F.array().cast("array<struct<start:int,len:int,win:string,items:array<string>>>")
    out = out.select("row", F.col("n").cast("long").alias("n_words"), F.when(F.col("found").isNull(), none).otherwise(F.filter("found", same)).alias("hits"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda c: F.sequence(c["start"], c["start"] + c["len"] - 1))))
    items = F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda c: c["items"]))))
    out = out.select("row", "n_words", F.size(covered).cast("long").alias("n_hit"), items.alias("items"))
    return out.select(doc_id.alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", "row")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that are not contaminated, with all their columns.

    Null and empty texts have no words and stay; rows are judged one by one, whatever their ids; an empty table stays empty.
    """
    return contamination(docs, benchmark).filter(~contaminated(F.col("n_hit"), F.col("n_words"))).select("row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest for all documents and all items of the benchmark."""
    out = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    sha = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", sha.alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


_SQL_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"
ORACLE = f"""
WITH dw AS (SELECT doc_id, {_SQL_WORDS} AS ws FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, unnest(list_transform(range(1, greatest(len(ws) - 12, 1) + 1), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM iw WHERE len(ws) > 0),
pos AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM win)),
hit AS (SELECT pos.doc_id, pos.p, pos.n, win.item_id FROM pos JOIN win ON pos.n = win.n AND array_to_string(ws[p:p + pos.n - 1], ' ') = win.g),
cov AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
itm AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN itm ON dw.doc_id = itm.doc_id
"""
