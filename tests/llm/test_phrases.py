"""Phrase mining against plain counts, with no word hot, some and all."""

import random
import re
from collections import Counter

import pytest

from lattica.llm import phrases

SCHEMA = "doc_id long, text string, lang string, n int, suffix string, words int"


def texts():
    rnd = random.Random(11)
    words = ["the", "of", "New", "york", "City", "a\x00b", "\x01", "a", "b\x01", "été", "x\x85y", "w"] + [f"v{i}" for i in range(40)]
    say = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "\r", ","]) for _ in range(n))
    out = [None, "", "   ", ".,;", "one", "New york City " * 30, "the the the the " * 20, say(6000)] + [say(rnd.randint(1, 200)) for _ in range(40)]
    out += ["of the new york city, of the new york" + " w" * k for k in range(12)] + [out[9]] * 3
    return [(i if i % 9 else None, t, ["en", "fr", None, "und"][i % 4], 1, "s", 2) for i, t in enumerate(out)]


def plain(rows, max_n, least, inside, top):
    f, total = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for m in range(1, max_n + 1):
                for p in range(len(ws) - m + 1):
                    f[lang, tuple(ws[p : p + m])] += 1
    out = []
    many = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    covered = {}
    for (lang, ph), a in many.items():
        for m in range(2, len(ph)):
            for p in range(len(ph) - m + 1):
                key = (lang, ph[p : p + m])
                covered[key] = max(covered.get(key, 0), a)
    for lang in total:
        own = []
        for (x, ph), a in many.items():
            if x != lang or covered.get((lang, ph), -1) * 100 >= inside * a:
                continue
            score, k = min((1000000 * a * a // (f[lang, ph[:k]] * f[lang, ph[k:]]), k) for k in range(1, len(ph)))
            own.append((-score, -a, " ".join(ph).encode(), f[lang, ph[:k]], f[lang, ph[k:]]))
        out += [(lang, i, ph.decode(), -a, le, r, total[lang], -s) for i, (s, a, ph, le, r) in enumerate(sorted(own)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("max_n,hot", [(3, "none"), (3, "all"), (3, "some"), (2, "all"), (4, "some")])
def test_collocations(spark, monkeypatch, max_n, hot):
    rows = texts()
    often = {"none": {}, "all": None, "some": {"en": (["the", "a"], ["the\x00the"]), "und": (["new"], ["new\x00york"])}}[hot]
    if often is None:
        monkeypatch.setattr(phrases, "SAMPLE", 1)
        monkeypatch.setattr(phrases, "HOT_SHARE", 10**9)
    else:
        monkeypatch.setattr(phrases, "_hot", lambda docs, n: often)
    monkeypatch.setattr(phrases, "HELD_BYTES", 3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(df, max_n, 5, 50, 40).collect())
    assert got == plain(rows, max_n, 5, 50, 40)
    assert got


def test_empty_and_huge_products(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, None, "en", 1, "", 1), (2, "a b", None, 1, "", 1)], SCHEMA)).count() == 0
    # the score's products pass 64 bits
    a, left, right = 3_000_000_000_000, 3_500_000_000_000, 4_000_000_000_000
    row = spark.sql(f"SELECT {phrases.SCORE} AS score FROM (SELECT {a}L AS a, {left}L AS l, {right}L AS r)").first()
    assert row.score == 1000000 * a * a // (left * right)


def test_suffixes_renumber_wide_keys():
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words).encode(), " ".join(reversed(words)).encode()]
    suffix, counts, columns, known = phrases.suffixes(texts, 9)  # 300^9 is past 64 bits
    want = Counter()
    for t in texts:
        ws = t.decode().split()
        want.update("\x00".join(ws[i : i + 9]) for i in range(len(ws)))
    assert dict(zip(suffix.to_pylist(), counts.tolist(), strict=True)) == want
