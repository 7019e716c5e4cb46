"""Near duplicates: SimHash over five-word shingles, verified by Jaccard similarity of 0.8 or more.

The general form of operator 5, as the pipeline uses it. Multi-index hashing of 64-bit SimHash fingerprints over five-word
shingles (``simhash.links``) gives candidates at RADIUS bits or fewer. Sets at similarity 0.8 differ in about 10 of 64 bits,
beyond what balls within segments can enumerate on a large table, so min-wise keys (BANDS bands of ROWS minima) add candidates:
a pair at 0.8 shares no key with a chance of 5e-7, more similar pairs with less. Every candidate is then decided exactly by its
whole sets of shingles, so a link is always a true one.

A key gives a star of candidates, not its pairs. Candidates that hang together are a group; a group is dealt to blocks of
bounded size. All blocks are compared with the group's first block; the sets that this doesn't join to the group's largest
component are then compared with every block. So any two sets of a group are joined or compared, tasks hold two blocks, and a
group of near copies that hang together, however large, is read twice. Only distinct sets take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from lattica.llm import simhash
from lattica.llm.common import by_value, numbered, small_batches, told_apart, written

by_value(__name__)

SHINGLE = 5
SEED = 42
BANDS, ROWS = 48, 6
#: Least similarity of a link.
NUM, DEN = 4, 5
#: Shingles of a block, on average.
BLOCK = 400_000


def shingles(text: str | None) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles of a text; one shingle of all words if there are fewer than five, none without words."""
    words = simhash._WORD.findall((text or "").encode().translate(simhash._LOWER))
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(SHINGLE, len(words)) - 1 :]
    found = (xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[: len(last)].tolist(), last.tolist(), strict=True))
    return np.unique(np.fromiter(found, np.uint64, len(last)))


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, np.uint32)


def keys(own: np.ndarray, times: np.ndarray, plus: np.ndarray) -> list[int]:
    """A signed key for each band of minima over a set of shingles; none of an empty set."""
    if not len(own):
        return []
    short, least = (own >> np.uint64(32)).astype(np.uint32), np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 512):
        np.minimum(least, (short[at : at + 512, None] * times + plus).min(axis=0), out=least)
    data, size = least.tobytes(), 4 * ROWS
    return np.array([xxhash.xxh64_intdigest(data[i * size : (i + 1) * size], i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    times, plus = _coefficients()
    for b in batches:
        which, fps, sizes, every = [], [], [], []
        for t in b.column("text"):
            s = shingles(t.as_py())
            which.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
            fps.append(simhash.majority(s))
            sizes.append(len(s))
            every.append(keys(s, times, plus))
        longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (which, fps, sizes)]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *longs, pa.array(every, pa.list_(pa.int64()))], [*b.schema.names[:-1], "set", "fp", "size", "keys"])


def similar(sets: list[np.ndarray]) -> list[int]:
    """For each of some sets, none empty, the number of its component over links at NUM/DEN or more."""
    sizes = np.array([len(s) for s in sets])
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    at = np.concatenate(([0], np.cumsum(sizes)))
    own = [numbers[at[i] : at[i + 1]] for i in range(len(sets))]
    mark, group = np.zeros(int(numbers.max()) + 1, bool), [-1] * len(sets)
    rest = np.argsort(sizes, kind="stable")
    while len(rest):
        front, number, rest = [int(rest[0])], int(rest[0]), rest[1:]
        group[number] = number
        while front and len(rest):
            i = front.pop()
            # sets of another size class can't be similar enough
            low, high = np.searchsorted(sizes[rest] * DEN, sizes[i] * NUM), np.searchsorted(sizes[rest] * NUM, sizes[i] * DEN, "right")
            if low == high:
                continue
            mark[own[i]] = True
            common = np.array([np.count_nonzero(mark[own[j]]) for j in rest[low:high]])
            mark[own[i]] = False
            hit = np.zeros(len(rest), bool)
            hit[low:high] = (NUM + DEN) * common >= NUM * (sizes[i] + sizes[rest[low:high]])
            for j in rest[hit].tolist():
                group[j] = number
                front.append(j)
            rest = rest[~hit]
    return group


def _verified(rows: pa.Table) -> pa.Table:
    """a, b: the least set of each component among the sets of a task, and each other set of it."""
    which = rows.column("set").to_pylist()
    group, least = similar([shingles(t.as_py()) for t in rows.column("text")]), {}
    for g, s in zip(group, which, strict=True):
        least[g] = min(least.get(g, s), s)
    ends = [(least[g], s) for g, s in zip(group, which, strict=True) if least[g] != s]
    return pa.table({"a": pa.array([a for a, _ in ends], pa.int64()), "b": pa.array([b for _, b in ends], pa.int64())})


def _compared(tasks: DataFrame, rows: DataFrame, held: DataFrame) -> DataFrame:
    """Links among the sets of each task of ``tasks(task, set, at)``; ``at`` is the row that holds the set's text, and one of
    ``held(at)``, a table on disk, so texts of other rows stay where they are."""
    some = told_apart(rows.select("at", F.col("row.text").alias("text")), held, "at")[0]
    texts = tasks.join(some, "at")
    return texts.select("task", "set", "text").groupBy("task").applyInArrow(_verified, "a long, b long")


def _labelled(sets: DataFrame, links: DataFrame) -> DataFrame:
    """``sets(set, ...)`` with label, the least set of the component."""
    comp = simhash.connected(links).withColumnsRenamed({"v": "__v", "label": "__l"})
    return sets.join(comp, sets["set"] == comp["__v"], "left").withColumn("label", F.coalesce("__l", "set")).drop("__v", "__l")


def _task(group: str, first: Column | str, second: Column) -> Column:
    return F.concat_ws(":", F.col(group).cast("string"), F.col(first).cast("string") if isinstance(first, str) else first.cast("string"), second.cast("string"))


def classes(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """at, doc_id, which (a hash of the text), set, size of each of ``rows(at, row)``; set and label, the class, of each distinct set.

    Null, empty and wordless texts are one class. Repeated rows fall into one class; an empty table gives empty ones.
    """
    small_batches(rows.sparkSession)
    packed = rows.select("at", "row.doc_id", F.xxhash64("row.text").alias("which"), F.col("row.text").alias("text"))
    long = [StructField(n, LongType()) for n in ("set", "fp", "size")]
    schema = StructType([*packed.schema.fields[:-1], *long, StructField("keys", ArrayType(LongType()))])
    marked = written(packed.mapInArrow(_marked, schema), "near-rows")
    own = written(marked.groupBy("set").agg(F.min("at").alias("at"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")).filter("size > 0"), "near-sets")
    key = Window.partitionBy("key")
    stars = own.select("set", F.explode("keys").alias("key")).withColumn("a", F.min("set").over(key)).filter(F.col("a") < F.col("set")).select("a", F.col("set").alias("b"))
    # equal fingerprints of different sets are candidates too: each with the least set of its fingerprint
    by_fp = own.groupBy("fp").agg(F.min("set").alias("a"))
    same = own.join(by_fp, "fp").filter(F.col("a") < F.col("set")).select("a", F.col("set").alias("b"))
    near = simhash.links(by_fp.select("fp")).withColumnsRenamed({"a": "fa", "b": "fb"})
    near = near.join(by_fp.select(F.col("fp").alias("fa"), F.col("a")), "fa").join(by_fp.select(F.col("fp").alias("fb"), F.col("a").alias("b")), "fb").select("a", "b")
    groups = _labelled(own.drop("keys", "fp"), stars.unionAll(same).unionAll(near).distinct()).withColumnRenamed("label", "group")
    of = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("size") / block).cast("int").alias("blocks")).filter("n > 1")
    members = groups.join(of, "group").select("group", "set", "at", "blocks", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("block"))
    members = written(members, "near-members")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).when(F.col("block") == 0, F.expr("sequence(1, blocks - 1)")).otherwise(F.array("block"))
    tasks = members.withColumn("second", F.explode(others)).select(_task("group", F.lit(0), F.col("second")).alias("task"), "set", "at")
    links = written(_compared(tasks, rows, members.select("at")), "near-links")
    split = members.filter("blocks > 1")
    if not split.isEmpty():
        now = written(_labelled(split, links), "near-split")
        counts = now.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
        largest = counts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
        rest = now.join(largest, "group").filter(F.col("label") != F.col("largest"))
        parts = rest.join(own.select("set", "size"), "set").groupBy("group").agg(F.ceil(F.sum("size") / block).cast("int").alias("parts"))
        outside = rest.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("set", F.lit("part")), F.col("parts")).cast("int"))
        outside = outside.withColumn("second", F.explode(F.expr("sequence(0, blocks - 1)"))).select(_task("group", "part", F.col("second")).alias("task"), "set", "at")
        every = now.join(parts, "group").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(_task("group", "part", F.col("block")).alias("task"), "set", "at")
        links = links.unionAll(written(_compared(outside.unionAll(every).distinct(), rows, now.select("at")), "near-links"))
    none = marked.filter("size = 0").select("set").distinct()
    return marked, _labelled(own.select("set"), links).unionAll(none.select("set", F.col("set").alias("label")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each class of ``docs(doc_id, text, ...)``: the one with the least doc_id (null last), then text hash, then row.

    Null, empty and wordless texts are one class. An empty table gives an empty one; the columns stay.
    """
    rows = numbered(docs, "near-texts")
    marked, labels = classes(rows)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("which"), F.col("at"))
    by_set = marked.groupBy("set").agg(F.min(rank).alias("rank"))
    heads = by_set.join(labels, "set").groupBy("label").agg(F.min("rank").alias("rank")).select(F.col("rank.at").alias("at"))
    heads = written(heads, "near-heads")
    dropped = written(marked.select("at").join(heads, "at", "left_anti"), "near-dropped")
    some, kept = told_apart(rows, dropped, "at")
    return kept.unionByName(some.join(heads, "at", "left_semi")).select("row.*")
