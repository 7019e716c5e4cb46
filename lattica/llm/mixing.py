"""Mixing sources to target weights.

Every document gets a hash-random key. Each source is range-sorted by that key in bins of bounded size, prefix sums of the
sizes run inside the bins and over the bins' totals, and the source is cut at its exact budget. A budget above the source's
size repeats the whole source first (epochs). No source, however large, is sorted in one task: a task holds one bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import SPACE, bins_for, numbered, random_key, source_key, spread, table, word_count, written

#: Weights of the sources by code point order, null last, repeating.
WEIGHTS = (5, 2, 1)
SHARE_NUM, SHARE_DEN = 3, 2  # the mix is 150 % of all sizes
MAX_EPOCHS = 2
SEED = "mix"


def targets(sizes: DataFrame) -> DataFrame:
    """Budget of each source of ``sizes(source, skey, source_size)``: a share by weight of the mix, filled up like water.

    A source stops at MAX_EPOCHS times its size. In the order of size / weight, a source is full iff the share left for it
    and those behind it would exceed its stop; the rest share what is left by weight. One row per source goes through.
    """
    n = len(WEIGHTS)
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(n)) + 1).cast("int"))
    scale = 1
    for w in WEIGHTS:
        scale *= w
    df = sizes.withColumn("w", weight.cast("long")).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    order = Window.orderBy((F.col("source_size") * F.lit(scale) / F.col("w")), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    df = (
        df.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(SHARE_NUM) / F.lit(SHARE_DEN))
    )
    df = df.withColumn("full", (F.col("budget") - F.col("cap_before")) * F.col("w") > F.col("cap") * (F.col("w_all") - F.col("w_before")))
    df = df.withColumn("cap_full", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(everything))
    df = df.withColumn("w_full", F.sum(F.when(F.col("full"), F.col("w")).otherwise(0)).over(everything))
    share = (F.col("budget") - F.col("cap_full")) * F.col("w") / (F.col("w_all") - F.col("w_full"))
    return df.select("skey", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, size: Column, per_bin: int = 20_000) -> DataFrame:
    """How many words the mix takes from each row of ``docs(doc_id, source, ...)``.

    Returns doc_id, source, size, source_size, target, taken; one row per row of ``docs``. Null sources form one source, null
    texts have size 0 and give 0. Rows equal in doc_id are ordered by size, then by their place in the table. An empty table gives an
    empty result. A doc_id that very many rows share (or lack) is dealt over the bins. Only keys and sizes are shuffled, never texts.
    """
    rows = numbered(docs, "mix-rows").select(F.col("at").alias("__at"), "row.*")
    return _taken(written(rows.select(F.col("__at").alias("at"), "doc_id", "source", size.alias("size")), "mix-sizes"), per_bin).drop("at")


def _taken(slim: DataFrame, per_bin: int = 20_000) -> DataFrame:
    """``mix`` for ``slim(at, doc_id, source, size)``, a written table in which ``at`` numbers the rows."""
    slim = slim.withColumn("skey", source_key(F.col("source"))).withColumn("key", random_key(F.col("doc_id"), SEED))
    slim = spread(slim, bins_for(slim.count(), per_bin), per_bin)
    in_bins = slim.groupBy("skey", "bin").agg(F.sum("size").alias("bin_size"), F.first("source").alias("source"))
    in_bins = written(in_bins, "mix-bins")
    budgets = targets(in_bins.groupBy("skey").agg(F.sum("bin_size").alias("source_size"), F.first("source").alias("source")))
    up_to = Window.partitionBy("skey").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    starts = in_bins.select("skey", "bin", F.coalesce(F.sum("bin_size").over(up_to), F.lit(0)).alias("bin_start"))
    starts = starts.join(budgets, "skey")
    inside = Window.partitionBy("skey", "bin").orderBy("key", "doc_id", "size", "at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = slim.withColumn("upto", F.sum("size").over(inside)).join(starts, ["skey", "bin"])
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(F.lit(0)).cast("long")
    left = whole - epochs * F.col("source_size") - (F.col("bin_start") + F.col("upto") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("at", "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its word number ``n``."""
    pieces = F.split(text, f"(?<=[^{SPACE}])(?=[{SPACE}])")
    return F.array_join(F.slice(pieces, 1, n.cast("int")), "")


def mixed(docs: DataFrame, sizes: Column) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as taken, the row at a source's cut shortened to the words taken.

    Rows are told apart by a number of their own, so rows without id and repeated rows are each decided for themselves, and the
    words of a source sum to the whole part of its target. Null and empty texts have no words and are not taken; an empty table
    gives an empty one. ``n_chars``, if there, follows the text.
    """
    rows = numbered(docs, "mix-rows")
    slim = written(rows.select(F.col("at").alias("__at"), "row.*").select(F.col("__at").alias("at"), "doc_id", "source", sizes.alias("size")), "mix-sizes")
    plan = _taken(slim).filter("taken > 0").select("at", "size", "taken")
    out = rows.join(plan, "at").withColumn("part", F.explode(F.expr("sequence(1, (taken + size - 1) div size)")))
    last = F.col("taken") - (F.col("part") - 1) * F.col("size")
    cut = last < F.col("size")
    own = {c: F.col(f"row.{c}") for c in docs.columns}
    own["text"] = F.when(cut, first_words(F.col("row.text"), last)).otherwise(F.col("row.text"))
    if "n_chars" in own:
        kind = docs.schema["n_chars"].dataType
        own["n_chars"] = F.when(cut, F.length(own["text"]).cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[c.alias(k) for k, c in own.items()])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, word_count(F.col("text"))).drop("source")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS skey,
    md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT skey, min(source) AS source, CAST(sum(size) AS BIGINT) AS ss FROM d GROUP BY skey),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
o AS (SELECT *, 2 * ss AS cap, sum(ss) OVER () * 3 / 2 AS budget, sum(w) OVER () AS w_all,
    coalesce(sum(2 * ss) OVER p, 0) AS cap_before, coalesce(sum(w) OVER p, 0) AS w_before
    FROM w WINDOW p AS (ORDER BY ss * 10 / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (budget - cap_before) * w > cap * (w_all - w_before) AS is_full FROM o),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS cap_full, sum(CASE WHEN is_full THEN w ELSE 0 END) OVER () AS w_full FROM f),
t AS (SELECT skey, ss, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE CAST(budget - cap_full AS DOUBLE) * CAST(w AS DOUBLE) / CAST(w_all - w_full AS DOUBLE) END AS target FROM g),
r AS (SELECT d.*, t.ss, t.target, sum(size) OVER (PARTITION BY d.skey ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before,
    CASE WHEN ss > 0 THEN CAST(floor(target) AS BIGINT) // ss ELSE 0 END AS epochs FROM d JOIN t ON d.skey = t.skey)
SELECT doc_id, size, ss AS source_size, target,
    CAST(epochs * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - epochs * ss - before)) AS BIGINT) AS taken FROM r
"""
