"""Operators on spans with texts of tens of thousands of words, copies across the borders of pieces, and brute force beside them."""

import hashlib
import random
import re

import pytest

from lattica.llm import decontam, suffixdedup, windows

PASSAGE = " ".join(f"p{i}x{i * i % 89}" for i in range(90))
ITEM = " ".join(f"q{i}" for i in range(14))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(17)
    words = [f"w{i}" for i in range(3000)] + ["the", "été", "of"]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [say(30_000), say(9_000) + " " + PASSAGE + " " + say(9_000), say(4_001) + " " + PASSAGE, PASSAGE + " " + say(777) + " " + ITEM + " " + say(3), say(20) + " " + ITEM, say(40)]
    texts += [texts[0][: 60_000], say(5) + texts[1][20_000:90_000]]
    return [(i + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("piece", [512, 3001, 1 << 19])
def test_suffix_dedup_across_pieces(spark, monkeypatch, rows, piece):
    monkeypatch.setattr(suffixdedup, "PIECE", piece)
    got = {r.doc_id: r for r in suffixdedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    seen = set()
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(gone), hashlib.sha256(kept).hexdigest()), i
    assert got[7].n_removed == len(rows[6][1].encode()) and got[1].n_removed == 0


def test_windows_of_long_texts(spark, rows):
    got = {r.doc_id: r for r in windows.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    first = {}
    for i, t in rows:
        ws = t.split()
        gone = [False] * len(ws)
        for p in range(len(ws) - 12):
            if first.setdefault(tuple(ws[p : p + 13]), i) < i:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (len(ws), sum(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def test_decontamination_of_long_texts(spark, rows):
    items = spark.createDataFrame([(1, ITEM), (2, "no such words here"), (3, " ".join(rows[0][1].split()[20_000:20_040]))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    grams = {}
    for k, t in ((1, ITEM), (3, " ".join(rows[0][1].split()[20_000:20_040]))):
        ws = words(t)
        for p in range(len(ws) - 12):
            grams.setdefault(tuple(ws[p : p + 13]), set()).add(k)
    for i, t in rows:
        ws, hit, found = words(t), set(), set()
        for p in range(len(ws) - 12):
            if (g := tuple(ws[p : p + 13])) in grams:
                hit.update(range(p, p + 13))
                found |= grams[g]
        assert (got[i].n_words, got[i].n_hit, got[i].n_items) == (len(ws), len(hit), len(found)), i
