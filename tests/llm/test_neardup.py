"""The near-dedup stage against exact Jaccard similarity of five-word shingles."""

import random

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, neardup, simhash


def shingles(text):
    w = text.lower().split()
    return {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def labels(texts):
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and jaccard(texts[i], texts[j]) >= 0.8:
                group = [group[j] if g == group[i] else g for g in group]
    return group


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(5)
    say = lambda n: [f"w{rnd.randint(0, 400)}" for _ in range(n)]
    out = ["", " \n", "one two", "One  two", "one two three"]
    for n in (30, 104, 104, 204, 804):
        base = say(n)
        out.append(" ".join(base))
        for changes in (1, 2, 3, 4, 8, 16):  # each changed word spoils five shingles
            copy = list(base)
            for p in rnd.sample(range(n), changes):
                copy[p] = f"x{rnd.randint(0, 9999)}"
            out.append(" ".join(copy))
    chain = say(100)
    for k in range(6):  # neighbours are similar, the ends are not
        out.append(" ".join(chain[8 * k : 8 * k + 60 + 40]) + " " + " ".join(f"t{i}" for i in range(8 * k)))
    return out


def test_near_dedup_is_jaccard(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = labels(texts)
    want = {group.index(g) for g in group}
    far = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8 and (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count() > 3]
    assert far and len(want) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == want


def test_similar_is_exact_at_the_bound():
    a = np.arange(100, dtype=np.uint64)
    assert neardup.similar([a, a[:80]]) == [1, 1]
    assert neardup.similar([a, a[:79]]) == [0, 1]


def test_without_rows_or_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e  f"), (None, None), (None, "x")], "doc_id long, text string")
    assert len(neardup.deduplicated(docs).collect()) == 3
    assert neardup.deduplicated(docs.limit(0)).collect() == []


def test_groups_in_blocks(spark, texts):
    """A group dealt to many blocks has the components of one block."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def parts(block):
        marked, labels = neardup.classes(common.numbered(docs, "rows"), block)
        out = {}
        for r in marked.join(labels, "set").select("doc_id", "label").collect():
            out.setdefault(r.label, set()).add(r.doc_id)
        return sorted(map(sorted, out.values()))

    assert parts(150) == parts(neardup.BLOCK)


def test_rows_on_disk_keep_their_numbers(spark, tmp_path):
    """Rows of a table are known by file and place however they are read; rows that are computed are written first."""
    df = spark.range(1000).select((F.col("id") % 7).alias("doc_id"), F.lit("a").alias("text"), F.col("id").alias("n"))
    df.repartition(3).write.parquet(str(tmp_path / "t"))
    own = spark.read.parquet(str(tmp_path / "t"))
    first = {r.at: r.n for r in common.numbered(own, "x").select("at", "row.n").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    again = {r.at: r.n for r in common.numbered(own.select("n", "text"), "x").select("at", "row.n").collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert first == again and len(first) == 1000
    twice = common.numbered(own.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), "x")
    assert twice.select("at").distinct().count() == 2000


def test_texts_that_no_join_needs_are_not_shuffled(spark, tmp_path):
    """Rows are told apart by keys before the join: no row with a key is missed, few without one are taken, and the rest of the
    result comes straight from the table, without an exchange."""
    spark.range(20_000).selectExpr("cast(id as string) AS at", "id").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    some, rest = common.told_apart(rows, rows.filter("id % 7 = 0").select("at"), "at")
    some_ids, rest_ids = ([r.id for r in x.select("id").collect()] for x in (some, rest))
    assert sorted(some_ids + rest_ids) == list(range(20_000))
    assert set(range(0, 20_000, 7)) <= set(some_ids) and len(some_ids) < 1.1 * 20_000 / 7
    none, every = common.told_apart(rows, rows.limit(0).select("at"), "at")
    assert none.count() == 0 and every.count() == 20_000
    texts = [(i, " ".join(f"w{i // 2 if i < 20 else i}x{j}" for j in range(30))) for i in range(200)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    out = neardup.deduplicated(spark.read.parquet(str(tmp_path / "docs")))
    assert sorted(r.doc_id for r in out.collect()) == [*range(0, 20, 2), *range(20, 200)]
    plan = out._jdf.queryExecution().optimizedPlan()
    assert plan.getClass().getSimpleName() == "Union" and "LeftSemi" not in plan.children().apply(0).toString()
