"""Phrase collocation mining by suffix-sigma.

Each task turns its texts into suffixes truncated to ``max_n`` words, counts equal ones among themselves, and shuffles them by
language and first word. Sorted in reverse lexicographic order, all suffixes that share a prefix are neighbours, so one stack of
open prefixes counts every phrase as the rows stream by. Counts of a phrase's parts are joined afterwards.

First words with a large share of the corpus are dealt by their second word as well, such pairs of words by the whole suffix; what
this splits up, the counts of the words and pairs themselves, is summed after the stack. Which words these are is estimated from a
sample of documents; it only routes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import by_value, chance, dealt_join, small_batches, table, written

by_value(__name__)

MAX_N = 3
#: Between words: the least character, so a prefix and its extensions are neighbours in the order of strings.
JOINT = "\x00"
#: A-Z to a-z, ends of pieces to a line feed, tab to a space.
LETTERS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0a\x0b\x0c\x0d\x09", b"abcdefghijklmnopqrstuvwxyz" + b"\x0a" * 10 + b" ")
#: Bytes of text whose suffixes a task counts at a time.
HELD_BYTES = 12 << 20
#: One of so many documents tells which words are hot: those with a share of 1 / HOT_SHARE or more, so at most HOT_SHARE a language.
SAMPLE = 64
HOT_SHARE = 512
#: Parts of a language's phrases that are ranked first, each for itself.
PARTS = 64
#: Exact for counts below 10^15 and parts below 10^18.
SCORE = "(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))"


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _hidden(text: bytes) -> bytes:
    """The text without JOINT; \\x01 marks what stood there."""
    return text.replace(b"\x01", b"\x01\x02").replace(b"\x00", b"\x01\x01") if b"\x00" in text or b"\x01" in text else text


def words_of(texts: list[bytes], max_n: int) -> tuple[pa.Array, list[np.ndarray]]:
    """(words, ids of the 1st, 2nd, ... word of each suffix; 0 where the piece has ended)."""
    ids = _Ids({b"": 0, b"\n": 1})
    tokens = _hidden(b"\n".join([*texts, b""]).translate(LETTERS)).replace(b"\n", b" \n ").split(b" ")
    at = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    del tokens
    at = np.concatenate([at[at > 0], np.ones(max_n, np.int64)])
    starts = np.flatnonzero(at > 1)
    columns = [at[starts]]
    over = np.zeros(len(starts), bool)
    for k in range(1, max_n):
        nxt = at[starts + k]
        over |= nxt == 1
        columns.append(np.where(over, 0, nxt))
    return pa.array(list(ids), pa.binary()), columns


def suffixes(texts: list[bytes], max_n: int) -> tuple[pa.Array, np.ndarray, list[np.ndarray], pa.Array]:
    """(suffixes joined by JOINT, their counts, their words' ids, the words): distinct truncated suffixes of the texts."""
    words, columns = words_of(texts, max_n)
    key = columns[0]
    for nxt in columns[1:]:
        if int(key.max(initial=0)) * len(words) >= 1 << 62:  # number anew before the product would not fit
            key = np.unique(key, return_inverse=True)[1]
        key = key * len(words) + nxt
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    columns = [c[first] for c in columns]
    out = words.take(pa.array(columns[0]))
    for nxt in columns[1:]:
        part = words.take(pa.array(nxt, mask=nxt == 0))
        joined = pc.binary_join_element_wise(out, part, JOINT.encode())
        out = pc.if_else(pa.array(nxt > 0), joined, out)
    return out.cast(pa.string()), counts, columns, words


def _suffix_rows(max_n: int, hot: Broadcast | None):
    """lang, suffix, words that it is dealt by, count."""

    def rows(lang: str, texts: list[bytes]) -> pa.RecordBatch | None:
        suffix, counts, columns, words = suffixes(texts, max_n)
        if not len(suffix):
            return None
        depth = np.ones(len(suffix), np.int32)
        for level, often in enumerate((hot.value.get(lang, ((), ())) if hot is not None else ())[: max_n - 1]):
            if len(often):
                prefix = words.take(pa.array(columns[0]))
                if level:
                    second = words.take(pa.array(columns[1], mask=columns[1] == 0))
                    prefix = pc.binary_join_element_wise(prefix, second, JOINT.encode())
                depth[np.asarray(pc.fill_null(pc.is_in(prefix, pa.array([w.encode() for w in often], pa.binary())), False))] = level + 2
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(suffix), pa.string()), suffix, pa.array(depth), pa.array(counts)], ["lang", "suffix", "depth", "count"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                raw = text.as_py().encode()
                held.setdefault(lang, []).append(raw)
                size += len(raw)
                if size >= HELD_BYTES:
                    for name, texts in held.items():
                        if (out := rows(name, texts)) is not None:
                            yield from _sliced(out)
                    held, size = {}, 0
        for name, texts in held.items():
            if (out := rows(name, texts)) is not None:
                yield from _sliced(out)

    return run


def _sliced(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), rows):
        yield batch.slice(at, rows)


COUNTED = "lang string, phrase string, words int, n long, partial boolean"


def _stacked(max_n: int, least: int):
    """Counts of all prefixes of sorted suffixes: lang, phrase, words, count, partial.

    The stack holds, for each number of words, the open prefix, its count so far, and by how many words its suffixes were dealt. A
    prefix is closed by the first suffix that doesn't have it. A batch is gone through by columns, one number of words after
    the other: runs of equal prefixes within it are summed, its first run goes on with the stack's, its last stays open. Counts
    below ``least`` go, but for those of which other tasks have a part, and the language's sum, which has zero words.
    """
    types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.bool_())
    names = [c.split()[0] for c in COUNTED.split(", ")]

    def rows(lang, phrase, level: int, n, deep) -> pa.RecordBatch:
        columns = [lang, phrase, np.full(len(n), level), n, deep > level if level else np.ones(len(n), bool)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path: list[str] = []  # the language and the words of the last suffix
        counts, deep = [0] * (max_n + 1), [0] * (max_n + 1)

        def closed(level: int) -> Iterator[pa.RecordBatch]:
            if counts[level] and (counts[level] >= least or deep[level] > level or not level):
                yield rows([path[0]], [JOINT.join(path[1 : level + 1])], level, np.array([counts[level]]), np.array([deep[level]]))

        for b in batches:
            size = b.num_rows
            if not size:
                continue
            lists = pc.split_pattern(b.column("suffix"), JOINT)
            at = lists.offsets.to_numpy()
            length = np.diff(at)
            n, d = b.column("count").to_numpy(), b.column("depth").to_numpy()
            same, columns = np.ones(size, bool), []
            for level in range(max_n + 1):
                has = length >= level
                own = b.column("lang") if not level else lists.values.take(pa.array(at[:-1] + level - 1, mask=~has))
                columns.append(own)
                same[1:] &= np.asarray(pc.fill_null(pc.equal(own.slice(1), own.slice(0, size - 1)), False))
                same[0] &= len(path) > level and bool(has[0]) and own[0].as_py() == path[level]
                starts = np.flatnonzero(~same)
                if same[0]:
                    starts = np.concatenate([[0], starts])
                else:
                    yield from closed(level)
                sums, most = np.add.reduceat(n, starts), np.maximum.reduceat(d, starts)
                if same[0]:
                    sums[0] += counts[level]
                    most[0] = max(most[0], deep[level])
                real = has[starts]
                counts[level], deep[level] = (int(sums[-1]), int(most[-1])) if real[-1] else (0, 0)
                told = np.flatnonzero(real[:-1] & ((sums[:-1] >= least) | (most[:-1] > level) | (level == 0)))
                if len(told):
                    first = pa.array(starts[told])
                    parts = [c.take(first) for c in columns[1:]]
                    phrase = pc.binary_join_element_wise(*parts, JOINT) if parts else pa.array([""] * len(told), pa.string())
                    yield rows(columns[0].take(first), phrase, level, sums[told], most[told])
            path = [b.column("lang")[size - 1].as_py(), *lists[size - 1].as_py()]
        for level in range(max_n + 1):
            yield from closed(level)

    return run


def _hot(docs: DataFrame, max_n: int) -> dict[str, tuple[list[str], list[str]]]:
    """For each language the words and pairs of words with which a large share of suffixes begins, by a sample of the documents."""
    some = docs.filter(chance(F.col("doc_id"), F.col("text"), F.lit("hot words")) < F.lit(1 / SAMPLE)).select("lang", "text")
    rows = some.mapInArrow(_suffix_rows(min(2, max_n), None), "lang string, suffix string, depth int, count long")
    first = F.substring_index("suffix", JOINT, 1)
    shares = rows.groupBy("lang", "suffix").agg(F.sum("count").alias("n"))
    both = shares.select("lang", F.col("suffix").alias("phrase"), "n").filter(F.contains(F.col("suffix"), F.lit(JOINT)))
    single = shares.groupBy("lang", first.alias("phrase")).agg(F.sum("n").alias("n"))
    whole = rows.groupBy("lang").agg(F.sum("count").alias("whole"))
    often = single.unionByName(both).join(F.broadcast(whole), "lang").filter(F.col("n") * HOT_SHARE >= F.col("whole"))
    found: dict[str, tuple[list[str], list[str]]] = {}
    for r in often.select("lang", "phrase").collect():
        found.setdefault(r["lang"], ([], []))[r["phrase"].count(JOINT)].append(r["phrase"])
    return found


def counted(docs: DataFrame, max_n: int = MAX_N, least: int = 10) -> DataFrame:
    """lang, phrase (words joined by JOINT), words, n: phrases of 1 to ``max_n`` words with ``least`` occurrences or more; and, as
    phrase '' of 0 words, the number of words of each language.

    ``docs(doc_id, text, lang)``; a null text is empty, a null lang is ``und``. Occurrences lie within pieces, overlaps count;
    repeated rows count as often as they stand.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text")).filter("text is not null")
    hot = spark.sparkContext.broadcast(_hot(own, max_n))
    rows = own.select("lang", "text").mapInArrow(_suffix_rows(max_n, hot), "lang string, suffix string, depth int, count long")
    rows = rows.repartition("lang", F.expr("substring_index(suffix, char(0), depth)")).sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    parts = written(rows.mapInArrow(_stacked(max_n, least), COUNTED), "phrase-counts")
    small_batches(spark)
    summed = parts.filter("partial").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n")).filter(F.col("n") >= F.when(F.col("words") == 0, 1).otherwise(least))
    return parts.filter("not partial").select("lang", "phrase", "words", "n").unionByName(summed)


def collocations(docs: DataFrame, max_n: int = MAX_N, least: int = 10, inside: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases of 2 to ``max_n`` words, best first.

    ``docs(doc_id, text, lang, ...)``. A phrase with a occurrences, cut after k words into parts of l and r occurrences, scores
    floor(1000000 a a / (l r)), exactly; the least cut counts, ties go to the smallest k. A phrase that lies in a longer one with
    ``inside`` hundredths of its occurrences or more is left out, whether or not the longer one stays. Ranks go by score and a
    descending, then by the phrase's bytes. Ties beyond these don't exist, as phrases differ. A language without a phrase of
    ``least`` occurrences has no rows, nor has an empty table; columns beside the three are ignored.
    """
    known = written(counted(docs, max_n, least), "phrases")
    count = known.filter("words > 0").select("lang", "phrase", "n")
    many = known.filter("words > 1").select("lang", "phrase", F.col("n").alias("a"), F.split("phrase", JOINT).alias("ws"))
    part = lambda first, size: F.array_join(F.slice("ws", first, size), JOINT)
    size = F.size("ws")
    cuts = many.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, size - F.col("k")).alias("rest"))
    parts = count.select(F.struct("lang", "phrase").alias("part"), "n")
    cuts = written(cuts.withColumn("part", F.struct("lang", F.col("first").alias("phrase"))), "phrase-cuts")
    cuts = written(dealt_join(cuts, parts.withColumnRenamed("n", "l"), "part").withColumn("part", F.struct("lang", F.col("rest").alias("phrase"))), "phrase-firsts")
    cuts = dealt_join(cuts, parts.withColumnRenamed("n", "r"), "part")
    scored = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    if max_n > 2:
        size = F.size("ws")
        spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda p: F.array_join(F.slice("ws", p, m), JOINT))))
        longer = many.filter(size > 2).select("lang", F.col("a").alias("outer"), F.explode(F.array_distinct(spans)).alias("phrase"))
        longer = longer.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
        scored = scored.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(F.col("outer") * 100 < F.col("a") * inside, F.lit(True))).drop("outer")
    plain = F.replace(F.replace(F.replace("phrase", F.lit(JOINT), F.lit(" ")), F.lit("\x01\x01"), F.lit("\x00")), F.lit("\x01\x02"), F.lit("\x01"))
    # a language's best are among the best of each of its parts, so the last window has PARTS x top rows at most
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = scored.withColumn("phrase", plain).withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    sums = known.filter("words = 0").select("lang", "n")
    return best.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents."""
    return collocations(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


ORACLE = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
o AS (SELECT lang, unnest(ws) AS w1, unnest(ws[2:] || [NULL]) AS w2, unnest(ws[3:] || [NULL, NULL]) AS w3 FROM w WHERE len(ws) > 0),
s AS (SELECT * FROM o WHERE w1 IS NOT NULL),
f AS (SELECT lang, w1 AS ph, count(*) AS c FROM s GROUP BY ALL UNION ALL SELECT lang, w1 || ' ' || w2, count(*) FROM s WHERE w2 IS NOT NULL GROUP BY ALL
    UNION ALL SELECT lang, w1 || ' ' || w2 || ' ' || w3, count(*) FROM s WHERE w3 IS NOT NULL GROUP BY ALL),
total AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
cand AS (SELECT lang, ph, c AS a, string_split(ph, ' ') AS ws FROM f WHERE c >= 10 AND contains(ph, ' ')),
parts AS (SELECT lang, ph, a, 1 AS k, ws[1] AS x, array_to_string(ws[2:], ' ') AS y FROM cand UNION ALL SELECT lang, ph, a, 2, ws[1] || ' ' || ws[2], ws[3] FROM cand WHERE len(ws) = 3),
cuts AS (SELECT d.lang, d.ph, a, k, x.c AS l, y.c AS r, (1000000::HUGEINT * a * a) // (x.c::HUGEINT * y.c) AS score FROM parts d
    JOIN f x ON x.lang || ' ' || x.ph = d.lang || ' ' || d.x JOIN f y ON y.lang || ' ' || y.ph = d.lang || ' ' || d.y),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
longer AS (SELECT lang, ph, max(a) AS b FROM (SELECT lang, ws[1] || ' ' || ws[2] AS ph, a FROM cand WHERE len(ws) = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM cand WHERE len(ws) = 3) GROUP BY ALL),
ranked AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.ph) AS rank FROM best b LEFT JOIN longer u ON u.lang = b.lang AND u.ph = b.ph WHERE u.b IS NULL OR 100 * u.b < 50 * a)
SELECT lang, rank, ph AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
