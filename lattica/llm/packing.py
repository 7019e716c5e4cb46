"""Exchange of packed strings by minimiser bucket, shared by the two substring deduplicators.

Consecutive windows of a text with the same minimiser value form one string (a super-k-mer). Windows that are equal have equal
minimisers, so they meet in one bucket. A task sends each distinct string once, with all places where it saw it, in one
compressed block for each bucket. Of the places of a string it sends on only the earliest: the others repeat it, whatever else
there is, so their spans are settled in the task. A string that a third of all rows have thus costs a bucket one place a task.
Buckets and partitions follow the bytes of the table.

Frequent units of text would draw all different strings around them to one bucket. They come last in the order of minimisers,
and a window of nothing but frequent units is dealt by the least and the greatest of them. Which units are frequent is estimated on a sample of the
documents; any set of them gives the same spans, as a window's minimiser still depends on the window alone.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import by_value, chance

by_value(__name__)

#: A task sends what it holds when its strings reach so many bytes.
HELD_BYTES = 32 << 20
#: Longer runs of windows are cut; any cut will do, as all parts go to the same bucket.
LONGEST_RUN = 512
NO_ID = (1 << 63) - 1
#: Bytes of text for each bucket and each shuffle partition, and the most partitions.
BUCKET_BYTES, PARTITION_BYTES, MOST_PARTITIONS = 8 << 20, 64 << 20, 50_000
#: Share of the documents in which units are counted, the places in all documents from which a unit is frequent, and the most
#: frequent units that are told to the tasks (8 bytes each).
UNIT_SHARE, FREQUENT, MOST_FREQUENT = 1 / 512, 1 << 16, 1 << 22
LAST = np.uint64(1 << 63)


class Packer:
    """``units`` gives the length of a string in units of text; with ``within``, a place repeats an earlier one of the same
    document too, else only places of earlier documents."""

    def __init__(self, buckets: int, units: Callable[[bytes], int], within: bool) -> None:
        self.buckets, self.units, self.within, self.zip = buckets, units, within, zstandard.ZstdCompressor(level=9)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.minis: list[int] = []
        self.places = array("q")  # string, doc, key, start of each place
        self.held = 0

    def add(self, string: bytes, mini: int, doc: int, key: int, start: int) -> None:
        i = self.ids.setdefault(string, len(self.minis))
        if i == len(self.minis):
            self.minis.append(mini)
            self.held += len(string) + 60
        self.held += 40
        self.places.extend((i, doc, key, start))

    def earliest(self, places: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, tuple[list[int], list[bytes]]]:
        """The earliest places of each string, and blocks, dealt by document, with the spans of the others."""
        rank = np.lexsort((places[:, 3], places[:, 1], places[:, 0])) if self.within else np.lexsort((places[:, 1], places[:, 0]))
        places = places[rank]
        new = np.concatenate(([True], places[1:, 0] != places[:-1, 0]))
        first = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = places[:, 1] > first[:, 1]
        if self.within:
            later |= places[:, 3] > first[:, 3]
        gone = places[later]
        out: tuple[list[int], list[bytes]] = ([], [])
        if len(gone):
            size = np.array([self.units(strings[i]) for i in gone[:, 0].tolist()], np.int64)
            home = gone[:, 1] % self.buckets
            order = np.argsort(home, kind="stable")
            gone, size, home = gone[order], size[order], home[order]
            edges = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1], [True])))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                columns = [np.array([0, b - a], np.int32), np.diff(gone[a:b, 1], prepend=0), gone[a:b, 2], gone[a:b, 3], size[a:b]]
                out[0].append(int(home[a]))
                out[1].append(self.zip.compress(b"".join(c.tobytes() for c in columns)))
        return places[~later], out

    def blocks(self) -> Iterator[pa.RecordBatch]:
        if not self.minis:
            return
        minis = np.array(self.minis, np.uint64)
        home = (minis % np.uint64(self.buckets)).astype(np.int64)
        strings = list(self.ids)
        places, settled = self.earliest(np.frombuffer(self.places, np.int64).reshape(-1, 4), strings)
        order, place_home = np.argsort(home, kind="stable"), home[places[:, 0]]
        local = np.empty(len(home), np.int64)
        by_place = np.argsort(place_home, kind="stable")
        cut, place_cut = np.searchsorted(home[order], range(self.buckets + 1)), np.searchsorted(place_home[by_place], range(self.buckets + 1))
        out: tuple[list[int], list[bytes]] = settled
        for b in np.unique(home).tolist():
            own, at = order[cut[b] : cut[b + 1]], places[by_place[place_cut[b] : place_cut[b + 1]]]
            local[own] = np.arange(len(own))
            parts = [strings[i] for i in own.tolist()]
            columns = [np.array([len(own), len(at)], np.int32), np.array([len(p) for p in parts], np.int32), (minis[own] >> np.uint64(32)).astype(np.uint32), np.diff(local[at[:, 0]], prepend=0).astype(np.int32), np.diff(at[:, 1], prepend=0), at[:, 2], at[:, 3].astype(np.int32)]
            out[0].append(b)
            out[1].append(self.zip.compress(b"".join([*(c.tobytes() for c in columns), *parts])))
            if sum(map(len, out[1][-64:])) > 4 << 20 or len(out[0]) >= 64:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "block"])
                out = ([], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary())], ["bucket", "block"])
        self.clear()


def unpack(blocks: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, list[np.ndarray]]:
    """Distinct strings of a bucket, 32 bits of their minimisers, places (string, doc, key, start) of them, and settled spans
    (doc, key, first, end)."""
    ids: dict[bytes, int] = {}
    minis: list[np.ndarray] = []
    places: list[np.ndarray] = []
    settled: list[np.ndarray] = [np.empty((0, 4), np.int64)]
    for block in blocks:
        data = zstandard.ZstdDecompressor().decompress(block)
        n, m = np.frombuffer(data, np.int32, 2).tolist()
        at = 8
        if not n:
            doc, key, start, size = np.frombuffer(data, np.int64, 4 * m, at).reshape(4, m)
            settled.append(np.column_stack([np.cumsum(doc), key, start, start + size]))
            continue
        cols = []
        for kind, count in ((np.int32, n), (np.uint32, n), (np.int32, m), (np.int64, m), (np.int64, m), (np.int32, m)):
            cols.append(np.frombuffer(data, kind, count, at))
            at += count * np.dtype(kind).itemsize
        lengths, mini, which, doc, key, start = cols
        before = len(ids)
        new, own = [], np.empty(n, np.int64)
        for i, size in enumerate(lengths.tolist()):
            own[i] = g = ids.setdefault(data[at : at + size], len(ids))
            if g >= before + len(new):
                new.append(i)
            at += size
        minis.append(mini[new])
        places.append(np.column_stack([own[np.cumsum(which)], np.cumsum(doc), key, start.astype(np.int64)]))
    gone = np.concatenate(settled)
    return list(ids), np.concatenate(minis or [np.empty(0, np.uint32)]), np.concatenate(places or [np.empty((0, 4), np.int64)]), [gone[:, i] for i in range(4)]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        a, done = np.minimum(a[:-done], a[done:]), 2 * done
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def minimisers(order: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` places of units in the order; where all are frequent, a hash of the least and greatest, top bit set."""
    minis = sliding_min(order, width)
    at = np.flatnonzero(minis >= LAST)
    if len(at):
        both = minis[at] * np.uint64(0x9E3779B97F4A7C15) + ~sliding_min(~order, width)[at] * np.uint64(0xC2B2AE3D27D4EB4F)
        minis[at] = both ^ both >> np.uint64(32) | LAST
    return minis


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of equal values, cut at LONGEST_RUN."""
    edges = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))
    return [(a, min(a + LONGEST_RUN, e)) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for a in range(s, e, LONGEST_RUN)]


class Frequent:
    """Membership in a sorted array of units, most of them settled by 24 of their bits."""

    def __init__(self, units: np.ndarray) -> None:
        self.units, self.some = units, np.zeros(1 << 24 if len(units) else 0, bool)
        if len(units):
            self.some[units >> np.uint64(40)] = True

    def flags(self, units: np.ndarray) -> np.ndarray:
        if not len(self.units):
            return np.zeros(len(units), bool)
        out = self.some[units >> np.uint64(40)]
        at = np.flatnonzero(out)
        out[at] = self.units[np.minimum(np.searchsorted(self.units, units[at]), len(self.units) - 1)] == units[at]
        return out


def _counted(units: Callable[[], Callable[[bytes], Iterator[np.ndarray]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = units()
        for b in batches:
            for text in b.column("text"):
                for found in of(text.as_py().encode()):
                    unit, n = np.unique(found, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(n.astype(np.int64))], ["unit", "n"])

    return run


def frequent(rows: DataFrame, units: Callable[[], Callable[[bytes], Iterator[np.ndarray]]]) -> np.ndarray:
    """The frequent units of the texts, sorted; ``units()`` makes a function that gives the units of a text, piece by piece."""
    some = rows.filter(chance(F.col("doc"), F.col("key"), F.lit("units")) < F.lit(UNIT_SHARE)).select("text")
    counted = some.mapInArrow(_counted(units), "unit long, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    found = counted.filter(F.col("n") >= UNIT_SHARE * FREQUENT).orderBy(F.desc("n"), "unit").limit(MOST_FREQUENT).toArrow()
    return np.sort(found.column("unit").to_numpy().astype(np.int64).view(np.uint64))


def several(minis: np.ndarray) -> np.ndarray:
    """True for the strings whose minimiser another string has too."""
    _, inverse, counts = np.unique(minis, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def stretches(flag: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, first and last offset of the runs of flagged entries; entries are by owner and then consecutive offset."""
    on = np.flatnonzero(flag)
    if not len(on):
        return on, on, on
    new = np.concatenate(([True], (np.diff(on) > 1) | (owner[on[1:]] != owner[on[:-1]])))
    first, last = on[new], on[np.concatenate((new[1:], [True]))]
    return owner[first], offset[first], offset[last]


def removed(docs: list[np.ndarray], firsts: list[np.ndarray], ends: list[np.ndarray], keys: list[np.ndarray]) -> pa.Table:
    cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return pa.table({"doc": cat(docs).astype(np.int64), "key": cat(keys).astype(np.int64), "span": (cat(firsts).astype(np.int64) << 32) | cat(ends).astype(np.int64)})


REMOVED = "doc long, key long, span long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc (a null id is the largest; ids are whole numbers), key (tells rows of the same id apart by text; 0 if no id repeats) and text.

    A hash doesn't compress and goes with every string, so one look at the ids first saves a good part of the exchange.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    repeated = not docs.groupBy(doc.alias("doc")).count().filter("count > 1").isEmpty()
    key = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    return docs.select("doc_id", doc.alias("doc"), key.alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row of ``docs`` (see keyed) with the array of its removed spans."""
    lists = spans.groupBy("doc", "key").agg(F.collect_list("span").alias("spans"))
    return docs.join(lists, ["doc", "key"], "left").select("doc_id", "text", "spans")


def counts(text_bytes: int, partitions: int) -> tuple[int, int]:
    """Buckets and shuffle partitions for so many bytes of text: at least what the session sets, more where the text is large."""
    parts = max(partitions, min(-(-text_bytes // PARTITION_BYTES), MOST_PARTITIONS))
    return max(2 * parts, -(-text_bytes // BUCKET_BYTES)), parts


def in_buckets(rows: DataFrame, units: Callable, pack: Callable[[int, Broadcast], Callable], bucket: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Spans (doc, key, span) that ``bucket`` finds in the blocks of each bucket, made by ``pack(buckets, frequent units)``."""
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, parts = counts(total, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    often = rows.sparkSession.sparkContext.broadcast(frequent(rows, units))
    blocks = rows.select("doc", "key", "text").mapInArrow(pack(buckets, often), "bucket int, block binary")
    return blocks.repartition(parts, "bucket").groupBy("bucket").applyInArrow(bucket, REMOVED)


def mask(n: int, spans: list[int] | None) -> np.ndarray:
    """True for the units that a span covers."""
    if not spans:
        return np.zeros(n, bool)
    s = np.array(spans, np.int64)
    step = np.bincount(s >> 32, minlength=n + 1)[: n + 1].astype(np.int64) - np.bincount(s & 0xFFFFFFFF, minlength=n + 1)[: n + 1]
    return np.cumsum(step)[:n] > 0

