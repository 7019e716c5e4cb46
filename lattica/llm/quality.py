"""Quality rules by distribution divergence.

References are histograms of character classes and of common words for each language, from all labelled documents. A language's
common words go into GROUPS of about equal shares by rank, as a bin for each word would be all noise in a short text. A document
is compared with every reference by Jensen-Shannon distance; it fails if even its nearest reference is far away. Short texts
have noisy histograms, so each comparison has a least length, and what is far in words depends on the length: between what
samples of the reference give and what a text without any common word gives.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import by_value, small_batches, table

by_value(__name__)

COMMON, GROUPS = 100, 4
#: A task sends its word counts when it holds so many.
HELD = 400_000
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Least length for a comparison, and the distance of characters above which it fails.
CHAR_LENGTH, CHAR_DISTANCE = 300, 0.30
WORD_LENGTH = 50
#: Lengths for which a reference's limit is drawn (a text takes the nearest one below), samples of each, and their share within.
LENGTHS = [round(WORD_LENGTH * 2 ** (i / 2)) for i in range(15)]
SAMPLES, WITHIN = 1000, 0.999
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?\"'()[]-"

_CLASSES = 7  # lower, upper, digit, space, punctuation, symbol, beyond ASCII


def _class_table() -> np.ndarray:
    out = np.full(256, 5, np.int64)
    for name, number in (("abcdefghijklmnopqrstuvwxyz", 0), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("0123456789", 2), (" \t\n\r\x0b\x0c", 3), (PUNCTUATION, 4)):
        out[list(name.encode())] = number
    out[128:] = 6
    return out


def classes(data: bytes, lookup: np.ndarray) -> np.ndarray:
    """Histogram of the classes of the bytes of a text."""
    return sum((np.bincount(lookup[np.frombuffer(data[at : at + (1 << 20)], np.uint8)], minlength=_CLASSES) for at in range(0, len(data), 1 << 20)), np.zeros(_CLASSES, np.int64))


def normal(words: list[str]) -> list[str]:
    return [w.strip(PUNCTUATION).lower() for w in words]


def split(text: str) -> list[str]:
    """Words ``[^\\x20\\x09-\\x0D]+``; bytes.split() parts at these separators exactly."""
    return [w.decode() for w in text.encode().split()]


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) of the histogram p and each row of q."""
    p, q = p / p.sum(), q / q.sum(axis=1, keepdims=True)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.clip(kl / 2, 0, 1))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of the words with a letter, and of all words and classes under names that no word has. A task adds up what
    it holds and sends it whenever that reaches HELD words, so counts are exact and memory is bounded."""
    lookup, sums = _class_table(), {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, own in sums.items():
            own = {w: n for w, n in own.items() if w[:1] == " " or any(map(str.isalpha, w))}
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["lang", "word", "n"])
        sums.clear()

    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang").to_pylist(), strict=True):
            text = text.as_py()
            words = normal(split(text))
            own = sums.setdefault(lang, Counter())
            own.update(words)
            own[" words"] += len(words)
            for i, n in enumerate(classes(text.encode(), lookup).tolist()):
                own[f" class{i}"] += n
        if sum(map(len, sums.values())) > HELD:
            yield from sent()
    yield from sent()


Reference = dict  # vocabulary: list[str]; groups: array (languages, len + 1) of each word's group, the last for other words; words: array (languages, GROUPS + 1); chars: array (languages, classes); limits: array (LENGTHS, languages)


def grouped(own: list[int]) -> list[int]:
    """Groups of a language's common words, given their counts from the most frequent one on."""
    total, before, out = max(sum(own), 1), 0, []
    for n in own:
        out.append(min(GROUPS * (2 * before + n) // (2 * total), GROUPS - 1))
        before += n
    return out


def histograms(counts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Words in each group of each language, by the counts of the vocabulary and of other words."""
    return np.array([np.bincount(g, counts, GROUPS + 1) for g in groups])


def unknown(words: np.ndarray) -> np.ndarray:
    """Distance of a text without any common word from each reference."""
    return distance(np.eye(GROUPS + 1)[-1], words)


def limits(words: np.ndarray) -> np.ndarray:
    """Largest distance of words that passes, for each of LENGTHS and each reference.

    A third of the way from the median sample of the reference to a text without common words, or what WITHIN of the samples
    keep if that is more, but always below the text without common words.
    """
    rng, out = np.random.default_rng(0), np.zeros((len(LENGTHS), len(words)))
    for k, (row, far) in enumerate(zip(words, unknown(words), strict=True)):
        for i, n in enumerate(LENGTHS):
            own = distance(row, rng.multinomial(n, row / row.sum(), SAMPLES).astype(float))
            out[i, k] = min(max((2 * np.median(own) + far) / 3, np.quantile(own, WITHIN)), 0.99 * far)
    return out


def learn(docs: DataFrame, common: int = COMMON) -> Reference:
    """References from all of ``docs(text, lang)`` with text and language. What comes to the driver grows with the languages only.

    One pass counts all words exactly; the counts are added up in tasks before they are shuffled, and only the most frequent
    words of each language come back. Null texts and languages are left out; an empty table gives no reference.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("text", "lang").filter("text is not null and lang is not null")
    found = rows.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    special = F.col("word").startswith(" ")
    top = Window.partitionBy("lang", special).orderBy(F.col("n").desc(), "word")
    exact: dict[str, dict[str, int]] = {}
    for r in found.withColumn("r", F.row_number().over(top)).filter(F.col("r") <= common).select("lang", "word", "n").collect():
        exact.setdefault(r["lang"], {})[r["word"]] = r["n"]
    langs = sorted(k for k, own in exact.items() if own.get(" words"))
    own_words = {k: sorted((w for w in exact[k] if w[:1] != " "), key=lambda w: (-exact[k][w], w))[:common] for k in langs}
    vocabulary = sorted({w for ws in own_words.values() for w in ws})
    index, groups = {w: i for i, w in enumerate(vocabulary)}, np.full((len(langs), len(vocabulary) + 1), GROUPS)
    words = np.zeros((len(langs), GROUPS + 1))
    for k, lang in enumerate(langs):
        counts = [exact[lang][w] for w in own_words[lang]]
        groups[k, [index[w] for w in own_words[lang]]] = grouped(counts)
        words[k] = np.bincount(np.array(grouped(counts), int), counts, GROUPS + 1)
        words[k, -1] = exact[lang][" words"] - sum(counts)
    chars = np.array([[exact[k].get(f" class{i}", 0) for i in range(_CLASSES)] for k in langs], float)
    return {"vocabulary": vocabulary, "groups": groups, "words": words, "chars": chars, "limits": limits(words)}


def _judge(ref: Reference):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, index = _class_table(), {w: i for i, w in enumerate(ref["vocabulary"])}
        for b in batches:
            rows = [judge(t.as_py() or "", ref, lookup, index) for t in b.column("text")]
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in FIELDS]
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, kinds[k]) for c, k in zip(cols, FIELDS.values(), strict=True))], ["doc_id", *FIELDS])

    return run


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "char_distance": "double", "word_distance": "double"}


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows found twice or more."""
    triples = list(zip(words, words[1:], words[2:]))  # noqa: B905
    counts = Counter(triples)
    if len(counts) == len(triples):
        return 0
    hit = np.fromiter((counts[t] > 1 for t in triples), bool, len(triples))
    return int((np.concatenate([hit, [False, False]]) | np.concatenate([[False], hit, [False]]) | np.concatenate([[False, False], hit])).sum())


def duplicate_lines(text: str) -> int:
    lines = Counter(line for line in text.split("\n") if line.encode().split())
    return sum(lines.values()) - len(lines)


def judge(text: str, ref: Reference, lookup: np.ndarray, index: dict[str, int]) -> tuple:
    data = text.encode()
    words = split(text)
    n, again = len(words), repeated_words(words)
    failed = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
    far_chars = far_words = None
    known = True
    if len(ref["words"]) and len(data) >= CHAR_LENGTH:
        far_chars = float(distance(classes(data, lookup).astype(float), ref["chars"]).min())
    if len(ref["words"]) and n >= WORD_LENGTH:
        counts = np.zeros(len(index) + 1)
        for w, c in Counter(normal(words)).items():
            counts[index.get(w, -1)] += c
        far = np.array([distance(p, q[None])[0] for p, q in zip(histograms(counts, ref["groups"]), ref["words"], strict=True)])
        far_words = float(far.min())
        known = bool((far <= ref["limits"][np.searchsorted(LENGTHS, n, "right") - 1]).any())
    kept = not failed and (far_chars is None or far_chars <= CHAR_DISTANCE) and known
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), duplicate_lines(text), again, failed, kept, far_chars, far_words


def judged(docs: DataFrame, ref: Reference) -> DataFrame:
    """The contract's counts, verdict and both distances of each row of ``docs(doc_id, text)``.

    Null and empty texts have no words and fail. A distance is null below its least length or without references, and then
    doesn't reject.
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(_judge(ref), f"doc_id {kind}, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, and both distances."""
    docs = table(spark, sf_dir, "documents")
    return judged(docs, learn(docs))
