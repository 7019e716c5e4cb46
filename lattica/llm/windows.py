"""Substring deduplication of 13-word windows by super-k-mer partitioning.

The minimiser of a window is the least of its 3-word hashes, short word triples late and frequent ones last. Consecutive windows
sharing a minimiser travel as one packed string to its bucket, where windows are sorted by ranks of doubling length and equal
ones are counted exactly, with the least doc_id of each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import packing
from lattica.llm.common import by_value, small_batches, table

by_value(__name__)

WINDOW = 13
UNIT = 3
#: Triples of fewer bytes of words come late in the order of minimisers.
SHORT = 14


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 0)
        return h


def units(hashes: np.ndarray) -> np.ndarray:
    """Hash of each UNIT consecutive words."""
    h = hashes
    unit = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] * np.uint64(0x165667B19E3779F9)
    unit ^= unit >> np.uint64(29)
    unit *= np.uint64(0xBF58476D1CE4E5B9)
    unit ^= unit >> np.uint64(32)
    return unit


def minimisers(hashes: np.ndarray, lengths: np.ndarray, often: packing.Frequent) -> np.ndarray:
    """Minimiser of each window of WINDOW words, short triples late and frequent ones last."""
    unit = units(hashes)
    short = (lengths[:-2] + lengths[1:-1] + lengths[2:] < SHORT).astype(np.uint64) << np.uint64(62)
    last = often.flags(unit).astype(np.uint64) << np.uint64(63)
    return packing.minimisers((unit >> np.uint64(2)) | short | last, WINDOW - UNIT + 1)


def _units():
    cache = Hashes()

    def of(text: bytes) -> Iterator[np.ndarray]:
        words = text.split()
        if len(words) >= WINDOW:
            yield units(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))

    return of


def _pack(buckets: int, often: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, cache = packing.Packer(buckets, lambda s: s.count(b" ") + 1, within=False), Hashes()
        last = packing.Frequent(often.value)
        for b in batches:
            for doc, key, text in zip(b.column("doc").to_pylist(), b.column("key").to_pylist(), b.column("text"), strict=True):
                words = text.as_py().encode().split()
                if len(words) < WINDOW:
                    continue
                hashes = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
                minis = minimisers(hashes, np.fromiter(map(len, words), np.int64, len(words)), last)
                for first, end in packing.runs(minis):
                    packer.add(b" ".join(words[first : end + WINDOW - 1]), int(minis[first]), doc, key, first)
                    if packer.held > packing.HELD_BYTES:
                        yield from packer.blocks()
        yield from packer.blocks()

    return run


def _ranks(a: np.ndarray, step: int) -> np.ndarray:
    """Ranks of the pairs (a[i], a[i + step])."""
    return np.unique(a[:-step] * (int(a.max()) + 1) + a[step:], return_inverse=True)[1] if len(a) > step else np.empty(0, np.int64)


def find(blocks: list[bytes]) -> pa.Table:
    """Spans of words of one bucket to remove."""
    strings, minis, places, settled = packing.unpack(blocks)
    if not strings:
        return packing.removed(settled[:1], settled[2:3], settled[3:], settled[1:2])
    least = np.full(len(strings), packing.NO_ID)
    np.minimum.at(least, places[:, 0], places[:, 1])
    wins = np.array([s.count(b" ") for s in strings]) + 2 - WINDOW
    later = places[places[:, 1] > least[places[:, 0]]]
    docs, keys, firsts, ends = [settled[0], later[:, 1]], [settled[1], later[:, 2]], [settled[2], later[:, 3]], [settled[3], later[:, 3] + wins[later[:, 0]] + WINDOW - 1]
    chosen = np.flatnonzero(packing.several(minis))
    if len(chosen):
        ids: dict[bytes, int] = {}
        words = b" ".join([strings[g] for g in chosen.tolist()]).split(b" ")
        ranks = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
        del words, ids
        counts = wins[chosen] + WINDOW - 1
        begin = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(chosen)), wins[chosen])
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(wins[chosen]) - wins[chosen], wins[chosen])
        at = begin[owner] + offset
        for step in (1, 2, 4):
            ranks = _ranks(ranks, step)
        _, same = np.unique(ranks[at] * (int(ranks.max()) + 1) + ranks[at + WINDOW - 8], return_inverse=True)
        own = least[chosen][owner]
        first_doc = np.full(int(same.max()) + 1, packing.NO_ID)
        np.minimum.at(first_doc, same, own)
        g, a, b = packing.stretches(first_doc[same] < own, chosen[owner], offset)
        if len(g):
            head = places[places[:, 1] == least[places[:, 0]]]
            head = head[np.isin(head[:, 0], g)]
            lo, hi = np.searchsorted(g, head[:, 0]), np.searchsorted(g, head[:, 0], "right")
            each = np.repeat(np.arange(len(head)), hi - lo)
            which = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]
            docs.append(head[each, 1])
            keys.append(head[each, 2])
            firsts.append(head[each, 3] + a[which])
            ends.append(head[each, 3] + b[which] + WINDOW)
    return packing.removed(docs, firsts, ends, keys)


def _bucket(part: pa.Table) -> pa.Table:
    return find(part.column("block").to_pylist())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, gone, shas, texts = [], [], [], []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            words = text.as_py().encode().split()
            out = packing.mask(len(words), spans)
            kept = b" ".join([w for w, x in zip(words, out.tolist(), strict=True) if not x])
            total.append(len(words))
            gone.append(int(out.sum()))
            shas.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of each row of ``docs(doc_id, text)``.

    Null and empty texts have no words; texts of fewer than WINDOW words lose nothing. Rows that share a doc_id don't remove
    from each other; each is judged by its own text. A null doc_id counts as the largest. Windows never cross documents.
    """
    small_batches(docs.sparkSession)
    rows = packing.keyed(docs)
    spans = packing.in_buckets(rows, _units, _pack, _bucket)
    kind = dict(docs.dtypes)["doc_id"]
    return packing.with_spans(rows, spans).mapInArrow(_cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def op8_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
p AS (SELECT doc_id, p, array_to_string(ws[p:p + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)),
f AS (SELECT g, min(doc_id) AS first_doc FROM p GROUP BY g),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM p JOIN f USING (g) WHERE doc_id > first_doc),
s AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(qs), 0) AS BIGINT) AS n_removed,
    sha256(coalesce(array_to_string([w FOR w, i IN ws IF NOT list_contains(coalesce(qs, []), i)], ' '), '')) AS kept_sha256
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""
