"""Exact substring deduplication of 100-byte strings with suffix arrays.

Stretches of text are dealt to buckets by the minimiser of their 100-byte windows, so equal windows meet. Stretches whose
minimiser occurs once can't repeat and stop there. The others form shards of bounded size, cut between minimisers. A shard's suffix array comes from
Larsson-Sadakane refinement, its common prefixes from Kasai's rule run in lock step over the shard's strings; neighbours with a
common prefix of 100 bytes are the same window. Where one minimiser's stretches fill several shards, these are merged by binary
search of windows in sorted windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import packing
from lattica.llm.common import by_value, small_batches, table

by_value(__name__)

LENGTH = 100
UNIT = 24
#: Text is hashed in pieces of so many bytes.
PIECE = 1 << 19
SHARD_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


class Minimisers:
    """Minimisers of the windows of a piece of text: least hash of UNIT consecutive bytes, frequent ones last."""

    def __init__(self, often: packing.Frequent) -> None:
        self.often = often
        self.up, self.down = np.empty(0, np.uint64), np.empty(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) < len(data):
            n = max(len(data), 1 << 16)
            self.up, self.down = _powers(_ODD, n), _powers(_INVERSE, n)
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], dtype=np.uint64)))

    def units(self, total: np.ndarray) -> np.ndarray:
        """Hash of each UNIT consecutive bytes, by the sums of the piece."""
        return _mixed((total[UNIT:] - total[:-UNIT]) * self.down[: len(total) - UNIT])

    def of(self, data: np.ndarray) -> np.ndarray:
        total = self.sums(data)
        h = self.units(total)
        return packing.minimisers((h >> np.uint64(1)) | self.often.flags(h).astype(np.uint64) << np.uint64(63), LENGTH - UNIT + 1)


def _units():
    minimisers = Minimisers(packing.Frequent(np.empty(0, np.uint64)))

    def of(text: bytes) -> Iterator[np.ndarray]:
        for piece in range(0, len(text) - LENGTH + 1, PIECE):
            yield minimisers.units(minimisers.sums(np.frombuffer(text[piece : piece + PIECE + UNIT - 1], np.uint8)))

    return of


def _pack(buckets: int, often: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, minimisers = packing.Packer(buckets, len, within=True), Minimisers(packing.Frequent(often.value))
        for b in batches:
            for doc, key, text in zip(b.column("doc").to_pylist(), b.column("key").to_pylist(), b.column("text"), strict=True):
                data = text.as_py().encode()
                for piece in range(0, len(data) - LENGTH + 1, PIECE):
                    part = data[piece : piece + PIECE + LENGTH - 1]
                    minis = minimisers.of(np.frombuffer(part, np.uint8))
                    for first, end in packing.runs(minis):
                        packer.add(part[first : end + LENGTH - 1], int(minis[first]), doc, key, piece + first)
                        if packer.held > packing.HELD_BYTES:
                            yield from packer.blocks()
        yield from packer.blocks()

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of symbols 0 to 256: sort by 7 symbols, then refine the unsorted groups by ranks at doubling distance."""
    n, h = len(text), 7
    padded = np.concatenate((text.astype(np.int64), np.zeros(h, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(h):
        key = key << 9 | padded[j : j + n]
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    start = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    single = start & np.concatenate((start[1:], [True]))
    left = np.flatnonzero(~single)
    while len(left):
        at = sa[left]
        ahead = np.where(at + h < n, rank[np.minimum(at + h, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + ahead
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        sa[left] = at
        start = np.concatenate(([True], key[1:] != key[:-1]))
        rank[at] = left[np.maximum.accumulate(np.where(start, np.arange(len(left)), 0))]
        single = start & np.concatenate((start[1:], [True]))
        left, h = left[~single], 2 * h
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, begin: np.ndarray, end: np.ndarray, most: int = LENGTH) -> np.ndarray:
    """Common prefix, ``most`` at most, of each suffix with its predecessor in ``sa``; symbol 0 ends a suffix.

    Kasai's rule: the suffix one further shares at least one symbol less with its predecessor. All strings [begin, end) advance
    together, each from a prefix of 0; a step extends the prefixes of those that still match.
    """
    n = len(text)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    padded = np.concatenate((text, np.zeros(most + 1, text.dtype)))
    out = np.zeros(n, np.int64)
    lanes = np.argsort(begin - end, kind="stable")  # the longest first, so the active lanes are a prefix
    at, stop = begin[lanes].copy(), end[lanes]
    have, alive = np.zeros(len(at), np.int64), len(at)
    while alive:
        i, j, h = at[:alive], before[at[:alive]], np.maximum(have[:alive] - 1, 0)
        h[j < 0] = 0
        go = np.flatnonzero((j >= 0) & (h < most))
        while len(go):
            a, b = padded[i[go] + h[go]], padded[j[go] + h[go]]
            go = go[(a == b) & (a != 0)]
            h[go] += 1
            go = go[h[go] < most]
        out[i] = h
        have[:alive] = h
        at[:alive] += 1
        alive = int(np.searchsorted(-(stop[:alive] - at[:alive]), 0))
    return out


class Shard:
    """Strings of a bucket: classes of equal windows, in sorted order, with the first place of each."""

    def __init__(self, strings: list[bytes], places: np.ndarray) -> None:
        size = np.array([len(s) for s in strings])
        self.bytes = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        begin = np.cumsum(size + 1) - size - 1
        symbols = self.bytes.astype(np.int16) + 1
        symbols[begin + size] = 0
        sa = suffix_array(symbols)
        prefix = common_prefixes(symbols, sa, begin, begin + size)[sa]
        wins = size - LENGTH + 1
        self.owner = np.repeat(np.arange(len(strings)), wins)
        self.offset = np.arange(len(self.owner)) - np.repeat(np.cumsum(wins) - wins, wins)
        where = begin[self.owner] + self.offset
        valid = np.zeros(len(symbols), bool)
        valid[where] = True
        # a window that follows a shorter suffix starts a class: its common prefix with that one is below LENGTH
        number = np.cumsum(prefix < LENGTH)
        keep = valid[sa]
        classes = np.unique(number[keep], return_inverse=True)[1]
        of = np.empty(len(symbols), np.int64)
        of[sa[keep]] = classes
        self.classes = of[where]
        self.place = places[self.owner] + self.offset
        self.first = np.full(int(classes.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(self.first, self.classes, self.place)
        self.where = np.empty(len(self.first), np.int64)
        self.where[classes] = sa[keep]

    def windows(self, a: int, b: int) -> np.ndarray:
        """Sorted windows of the classes a to b."""
        view = np.lib.stride_tricks.sliding_window_view(self.bytes, LENGTH)
        return np.ascontiguousarray(view[self.where[a:b]]).view(f"S{LENGTH}").ravel()

    def merge(self, other: Shard, step: int = 100_000) -> None:
        """Let equal windows of two shards have the earlier first place."""
        mine = self.windows(0, len(self.where))
        for a in range(0, len(other.where), step):
            theirs = other.windows(a, a + step)
            at = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
            hit = np.flatnonzero(mine[at] == theirs)
            low = np.minimum(self.first[at[hit]], other.first[a + hit])
            self.first[at[hit]] = low
            other.first[a + hit] = low


def repeats(string: bytes) -> bool:
    """Whether a window may recur within the string: what all its windows share, if anything, must then occur again."""
    n = len(string) - LENGTH + 1
    return n > LENGTH - UNIT + 1 or n > 1 and string.find(string[n - 1 : LENGTH], n) >= 0


def parts(chosen: np.ndarray, minis: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    """The strings ``chosen`` by minimiser, dealt to parts of about ``most`` bytes. A part ends between minimisers; only the
    strings of one that alone is larger go to several parts, which hold nothing else."""
    chosen = chosen[np.argsort(minis[chosen], kind="stable")]
    edges = np.flatnonzero(np.concatenate(([True], minis[chosen][1:] != minis[chosen][:-1], [True]))) if len(chosen) else np.zeros(1, int)
    out, held, total = [], [], 0
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = chosen[a:b]
        n = int(size[own].sum())
        if held and total + n > most:
            out.append(np.concatenate(held))
            held, total = [], 0
        if n > most:
            out += [x for x in np.split(own, np.flatnonzero(np.diff(np.cumsum(size[own]) // most, prepend=0))) if len(x)]
        else:
            held.append(own)
            total += n
    return [*out, np.concatenate(held)] if held else out


def find(blocks: list[bytes], shard_bytes: int = SHARD_BYTES) -> pa.Table:
    """Spans of bytes of one bucket to remove."""
    strings, minis, places, settled = packing.unpack(blocks)
    if not strings:
        return packing.removed(settled[:1], settled[2:3], settled[3:], settled[1:2])
    ids, rank = np.unique(places[:, 1], return_inverse=True)
    spot = rank << 32 | places[:, 3]
    first = np.full(len(strings), np.iinfo(np.int64).max)
    np.minimum.at(first, places[:, 0], spot)
    size = np.array([len(s) for s in strings])
    later = places[spot > first[places[:, 0]]]
    docs, keys, firsts, ends = [settled[0], later[:, 1]], [settled[1], later[:, 2]], [settled[2], later[:, 3]], [settled[3], later[:, 3] + size[later[:, 0]]]
    chosen = packing.several(minis)
    chosen = np.flatnonzero(chosen | np.array([not c and repeats(s) for s, c in zip(strings, chosen.tolist(), strict=True)], bool))
    shards = [(part, Shard([strings[g] for g in part.tolist()], first[part])) for part in parts(chosen, minis, size, shard_bytes)]
    for i, (own, a) in enumerate(shards):
        for other, b in shards[i + 1 :]:
            if minis[own[-1]] != minis[other[0]]:
                break
            a.merge(b)
    head = places[spot == first[places[:, 0]]]
    head = head[np.argsort(head[:, 0], kind="stable")]
    for part, s in shards:
        g, a, b = packing.stretches(s.first[s.classes] < s.place, part[s.owner], s.offset)
        lo, hi = np.searchsorted(head[:, 0], g), np.searchsorted(head[:, 0], g, "right")
        each = np.repeat(np.arange(len(g)), hi - lo)
        which = np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]
        docs.append(head[which, 1])
        keys.append(head[which, 2])
        firsts.append(head[which, 3] + a[each])
        ends.append(head[which, 3] + b[each] + LENGTH)
    return packing.removed(docs, firsts, ends, keys)


def _bucket(part: pa.Table) -> pa.Table:
    return find(part.column("block").to_pylist())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, gone, runs, shas, kept = [], [], [], [], []
        for text, spans in zip(b.column("text"), b.column("spans").to_pylist(), strict=True):
            data = np.frombuffer(text.as_py().encode(), np.uint8)
            out = packing.mask(len(data), spans)
            left = data[~out].tobytes()
            total.append(len(data))
            gone.append(int(out.sum()))
            runs.append(int((out & ~np.concatenate(([False], out[:-1]))).sum()) if len(out) else 0)
            shas.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        ints = [pa.array(x, pa.int64()) for x in (total, gone, runs)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *ints, pa.array(shas, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary) of each row of ``docs(doc_id, text)``.

    Null and empty texts have no bytes; texts under LENGTH bytes lose nothing. Rows that share doc_id and text are one document
    and keep alike. A null doc_id counts as the largest. Removed runs may cut a character, so what is kept is binary.
    """
    small_batches(docs.sparkSession)
    rows = packing.keyed(docs)
    spans = packing.in_buckets(rows, _units, _pack, _bucket)
    kind = dict(docs.dtypes)["doc_id"]
    return packing.with_spans(rows, spans).mapInArrow(_cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
