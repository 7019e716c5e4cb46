"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product of its letters' vectors, permuted (rolled) by
their place; a text is the sum of its n-grams' vectors, and so is a language's prototype. A text gets the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm.common import by_value, chance, small_batches, table

by_value(__name__)

DIM = 1024
GRAM = 3
SEED = 20240501
#: Training texts of a language are a hash sample of about so many of its labelled rows.
TRAIN_ROWS = 4_000
UNKNOWN = "und"
_SPACE = 0x20


class Space:
    """Vectors of letters and n-grams. The table of n-gram vectors starts anew when it reaches ``most`` rows."""

    def __init__(self, dim: int = DIM, gram: int = GRAM, seed: int = SEED, most: int = 24_000) -> None:
        self.dim, self.gram, self.seed, self.most = dim, gram, seed, most
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.empty((1024, dim), np.float32)

    def letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.default_rng((self.seed, c)).choice(np.array([-1, 1], np.float32), self.dim)
        return self.letters[c]

    def bind(self, code: int) -> np.ndarray:
        out = np.ones(self.dim, np.float32)
        for place in range(self.gram):
            out = out * np.roll(self.letter(code >> 21 * place & 0x1FFFFF), place)
        return out

    def bundle(self, text: str) -> np.ndarray | None:
        """Sum of the n-gram vectors; None if the text has no letter."""
        points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32).astype(np.int64)
        kinds, inverse = np.unique(points, return_inverse=True)
        letter = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)
        if not letter.any():
            return None
        points = np.where(letter[inverse], points, _SPACE)
        points = np.concatenate(([_SPACE], points, [_SPACE]))
        points = points[np.concatenate(([True], (points[1:] != _SPACE) | (points[:-1] != _SPACE)))]
        if len(points) < self.gram:
            return None
        codes = sum(points[self.gram - 1 - p : len(points) - p] << 21 * p for p in range(self.gram))
        codes, counts = np.unique(codes, return_counts=True)
        total = np.zeros(self.dim, np.float64)
        for at in range(0, len(codes), 4096):
            part = codes[at : at + 4096].tolist()
            if len(self.rows) + len(part) > self.most:
                self.rows.clear()
            ids = []
            for code in part:
                row = self.rows.get(code)
                if row is None:
                    row = self.rows[code] = len(self.rows)
                    if row >= len(self.table):
                        self.table = np.concatenate([self.table, np.empty_like(self.table)])
                    self.table[row] = self.bind(code)
                ids.append(row)
            total += counts[at : at + 4096].astype(np.float32) @ self.table[ids]
        return total


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space, sums = Space(), {}
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            if (v := space.bundle(text)) is not None:
                sums[lang] = sums.get(lang, 0) + np.rint(v).astype(np.int64)
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(v)), pa.array(range(len(v)), pa.int32()), pa.array(v)], ["lang", "dim", "v"])


def share(count: Column, most: int) -> Column:
    """Share of ``count`` rows that makes about ``most`` of them, at any count."""
    return F.lit(float(most)) / count.cast("double")


def learn(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from ``labelled(doc_id, text, lang)`` without null labels.

    About ``train_rows`` rows of each language by hash of the id. The sums are of whole numbers, so the order of rows doesn't
    matter; what comes to the driver is one vector for each language.
    """
    small_batches(labelled.sparkSession)
    counts = labelled.groupBy("lang").count()
    picked = labelled.filter("text is not null").join(F.broadcast(counts.select("lang", share(F.col("count"), train_rows).alias("__share"))), "lang")
    picked = picked.filter(chance(F.col("doc_id"), F.col("text"), F.lit("lang")) < F.col("__share")).select("text", "lang")
    sums = picked.mapInArrow(_totals, "lang string, dim int, v long").groupBy("lang", "dim").agg(F.sum("v").alias("v")).collect()
    langs = sorted({r["lang"] for r in sums})
    proto = np.zeros((len(langs), DIM))
    for r in sums:
        proto[langs.index(r["lang"]), r["dim"]] = r["v"]
    norms = np.linalg.norm(proto, axis=1, keepdims=True)
    return langs, np.divide(proto, norms, out=np.zeros_like(proto), where=norms > 0)


def nearest(space: Space, text: str | None, langs: list[str], proto: np.ndarray) -> tuple[str, float]:
    v = space.bundle(text) if text and langs else None
    if v is None:
        return UNKNOWN, 0.0
    cosines = proto @ v / max(float(np.linalg.norm(v)), 1e-9)
    return langs[int(cosines.argmax())], float(min(1.0, max(0.0, round(float(cosines.max()), 6))))


def _predict(langs: list[str], proto: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for b in batches:
            found = [nearest(space, t, langs, proto) for t in b.column("text").to_pylist()]
            preds, scores = pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), preds, scores], [*b.schema.names[:-1], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``docs(..., text)`` with lang_pred and score (cosine, 0 at least) in place of the text and of columns of these names.

    ``und`` and 0 where the text is null or has no letter, or nothing was learned.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "lang_pred string, score double"])
    return docs.select(*others, "text").mapInArrow(_predict(*model), schema)


def held_out(doc_id: Column) -> Column:
    """True for the quarter of documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(docs: DataFrame) -> DataFrame:
    return docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")


def letters(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _found(langs: list[str], proto: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Space()
        for b in batches:
            texts = b.column("text").to_pylist()
            yield b.filter(pa.array([(nearest(space, t, langs, proto)[0] != UNKNOWN) if langs else letters(t) for t in texts], pa.bool_()))

    return run


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents in which no language is found; rows pass where they are, without a shuffle.

    A document is rejected if its language is ``und``, that is if its text is null, empty or without a letter. Where no row has a
    label nothing is learned, and texts with a letter stay. Repeated rows pass or go alike; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_found(*learn(labelled(docs))), docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents; score is the cosine with the nearest prototype."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return predict(rows, learn(labelled(docs)))
