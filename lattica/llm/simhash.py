"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into two 32-bit segments. Fingerprints at 3 or fewer differing bits have a segment with at most one of
them, so each fingerprint goes under its own key and the 32 keys at one bit of each segment (a ball of radius 1, with the
deviating bit's number in the key). Fingerprints that meet under a key are verified over all 64 bits. A key gives a spanning
forest of its links, not its pairs: memory and output stay linear in a group of near copies of any size. Only distinct
fingerprints take part; equal ones are one class from the start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lattica.llm.common import by_value, dealt_join, small_batches, table, written

by_value(__name__)

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits, each set where over half of the shingles' XXH64 have it; 0 without words, null included."""
    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - size + 1, 1)
    last = ends[min(size, len(words)) - 1 :]
    return majority(np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of some hashes have; 0 of none."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps)], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(..., text)`` with fp (the 64 bits as a signed long) in place of the text and of a column of that name."""
    small_batches(docs.sparkSession)
    others = docs.drop("text", "fp")
    return docs.select(*others.columns, "text").mapInArrow(_fingerprints, StructType([*others.schema.fields, StructField("fp", LongType())]))


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, by breadth-first search over blocks."""
    rest, links = fps, []
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            met = np.full(len(rest), -1)
            for at in range(0, len(front), 256):
                near = np.bitwise_count(rest[:, None] ^ front[None, at : at + 256]) <= radius
                new = (met < 0) & near.any(axis=1)
                met[new] = at + near[new].argmax(axis=1)
            hit = met >= 0
            links += zip(front[met[hit]].view(np.int64).tolist(), rest[hit].view(np.int64).tolist(), strict=True)
            front, rest = rest[hit], rest[~hit]
    return links


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the fingerprints under each key; rows come sorted by key, so a key's rows are consecutive."""

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        many = np.flatnonzero(np.diff(cut) > 1)
        out: list[tuple[int, int]] = []
        pair = many[np.diff(cut)[many] == 2]
        a, b = fps[cut[pair]], fps[cut[pair] + 1]
        near = np.bitwise_count(a ^ b) <= RADIUS
        out += zip(a[near].view(np.int64).tolist(), b[near].view(np.int64).tolist(), strict=True)
        for i in many[np.diff(cut)[many] > 2]:
            out += _forest(fps[cut[i] : cut[i + 1]], RADIUS)
        if out:
            ends = np.array(out, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends.min(axis=1)), pa.array(ends.max(axis=1))], ["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # batches whose last key may go on
    for batch in batches:
        keys, fps = batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)
        at = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if at or held and len(keys) and held[-1][0][-1] != keys[0]:
            before = [*held, (keys[:at], fps[:at])]
            yield from links(np.concatenate([k for k, _ in before]), np.concatenate([f for _, f in before]))
            held = []
        if len(keys):
            held.append((keys[at:], fps[at:]))
    if held:
        yield from links(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))


def links(fps: DataFrame) -> DataFrame:
    """a < b: links that connect the distinct fingerprints of ``fps(fp)`` as all pairs at RADIUS or fewer bits would."""
    spark = fps.sparkSession
    keys = []
    for half, segment in enumerate((F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32))):
        own = F.lit(half << 39 | 32 << 33) + segment
        ball = F.transform(F.sequence(F.lit(0), F.lit(31)), _one_off(segment, half))
        keys.append(F.concat(F.array(own), ball))
    spread = fps.select("fp", F.explode(F.concat(*keys)).alias("key"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) * 2
    spread = spread.repartition(parts, "key").sortWithinPartitions("key")
    return spread.select("key", "fp").mapInArrow(_met, "a long, b long").distinct()


def _one_off(segment, half: int):
    """Key of the pair of segment values that differ in bit i only: the bit's number and the value without it."""
    return lambda i: F.lit(half << 39) + i.cast("long") * (1 << 33) + segment.bitwiseAND(F.lit(0xFFFFFFFF) - F.element_at(F.array(*[F.lit(1 << k) for k in range(32)]), i + 1))


def connected(edges: DataFrame) -> DataFrame:
    """v, label: the smallest end of the component of each end of ``edges(a, b)``.

    Label propagation with pointer jumping: a node takes the least label among its neighbours', then its label's label. Labels
    are a written table after each round; the number of rounds grows with the logarithm of the longest chain.
    """
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b"), F.col("a"))), "links")
    labels = written(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("l")), "u").groupBy("v").agg(F.min("l").alias("l"))
        # hook the old label's root, not only the node: roots of two linked trees merge at once
        step = labels.join(near, "v").select("v", "label", F.least("label", "l").alias("low"))
        hooks = step.groupBy("label").agg(F.min("low").alias("root")).withColumnRenamed("label", "old")
        moved = step.join(hooks, step["label"] == hooks["old"]).select("v", "label", F.least("low", "root").alias("low"))
        jump = labels.select(F.col("v").alias("w"), F.col("label").alias("up"))
        new = moved.join(jump, moved["low"] == jump["w"]).select("v", F.least("low", "up").alias("label"), (F.least("low", "up") < F.col("label")).alias("changed"))
        new = written(new, "labels")
        if new.filter("changed").isEmpty():
            return new.select("v", "label")
        labels = new.select("v", "label")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of each row of ``docs(doc_id, text)``.

    component_id is the smallest doc_id reachable over links. Null, empty and wordless texts have fingerprint 0 and are linked
    like any other. Repeated rows get the same result; an empty table gives an empty one; a null doc_id counts as no id.
    """
    marked = written(fingerprints(docs.select("doc_id", "text")), "fingerprints")
    own = written(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    comp = connected(links(own.select("fp")))
    own = own.join(comp, own["fp"] == comp["v"], "left").select("fp", F.coalesce("label", "fp").alias("label"), "least")
    own = written(own, "labelled")
    least = own.groupBy("label").agg(F.min("least").alias("component_id"))
    return dealt_join(marked, dealt_join(own, least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    out = components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

