"""The word rule of op7 against texts of unknown words and of marks."""

import math
import random

import pytest

from lattica.llm import quality


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(2)
    common, rare = [f"a{c}{d}" for c in "bcdfghjklm" for d in "aeiou"], lambda: "".join(rnd.choice("bcdfghklmnprstaeiou") for _ in range(9))
    prose = lambda n: " ".join(rnd.choice(common) if rnd.random() < 0.4 else rare() for _ in range(n))
    unknown = lambda n, mark: " ".join(rare() + mark for _ in range(n))
    rows = [("prose", prose(n)) for n in (55, 80, 150, 400, 2000) for _ in range(40)]
    rows += [("unknown", unknown(n, "")) for n in (55, 80, 150, 400, 2000) for _ in range(4)] + [("marks", unknown(n, " |")) for n in (60, 90, 150, 400) for _ in range(4)]
    docs = spark.createDataFrame([(i, t, "en", k) for i, (k, t) in enumerate(rows)], "doc_id long, text string, lang string, kind string")
    ref = quality.learn(docs)
    got = {r.doc_id: r for r in quality.judged(docs, ref).collect()}
    return ref, [(k, got[i]) for i, (k, _) in enumerate(rows)]


def test_unknown_words_and_marks_fail_at_any_length(judged):
    rows = judged[1]
    assert not any(r.base_failed for _, r in rows)
    assert not any(r.kept for k, r in rows if k != "prose")
    assert sum(r.kept for k, r in rows if k == "prose") >= 0.98 * sum(k == "prose" for k, _ in rows)


def test_vocabulary_and_limits(judged):
    ref = judged[0]
    assert "|" not in ref["vocabulary"] and all(any(map(str.isalpha, w)) for w in ref["vocabulary"])
    assert (ref["limits"] < quality.unknown(ref["words"])).all()


def test_distances_by_naive_counts(spark, monkeypatch):
    """Common words, both distances and the verdict against plain Python, with counts sent in many parts."""
    monkeypatch.setattr(quality, "HELD", 5)
    rnd = random.Random(7)
    say = lambda n, pool: " ".join(rnd.choice(pool) + rnd.choice(["", ",", "."]) for _ in range(n))
    pools = {"en": [f"e{i}" for i in range(30)] + ["the"] * 20, "fr": [f"f{i}" for i in range(30)] + ["Le"] * 20}
    rows = [(i, say(rnd.randint(40, 90), pools[k]), k) for i, k in enumerate(["en", "fr"] * 12)] + [(90, None, "en"), (91, "", "fr"), (92, "x | y", None), (93, say(80, ["q1", "q2", "é"]), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    ref = quality.learn(df, 10)
    langs, tables, chars = ["en", "fr"], [], []
    for lang in langs:
        words = [w.strip(quality.PUNCTUATION).lower() for _, t, k in rows if k == lang and t for w in t.split()]
        counts = {w: words.count(w) for w in set(words) if any(map(str.isalpha, w))}
        top = sorted(counts, key=lambda w: (-counts[w], w))[:10]
        groups = dict(zip(top, quality.grouped([counts[w] for w in top]), strict=True))
        hist = [sum(counts[w] for w in top if groups[w] == g) for g in range(quality.GROUPS)]
        tables.append((groups, [*hist, len(words) - sum(hist)]))
        whole = "".join(t for _, t, k in rows if k == lang and t).encode()
        chars.append(naive_classes(whole))
    for r in quality.judged(df, ref).collect():
        text = rows[[x[0] for x in rows].index(r.doc_id)][1] or ""
        words = [w.strip(quality.PUNCTUATION).lower() for w in text.split()]
        far = []
        for groups, hist in tables:
            own = [0] * (quality.GROUPS + 1)
            for w in words:
                own[groups.get(w, quality.GROUPS)] += 1
            far.append(js(own, hist) if words else None)
        long = len(words) >= quality.WORD_LENGTH
        assert (r.word_distance is None) == (not long)
        if long:
            assert abs(r.word_distance - min(far)) < 1e-9
        wide = len(text.encode()) >= quality.CHAR_LENGTH
        assert (r.char_distance is None) == (not wide)
        if wide:
            assert abs(r.char_distance - min(js(naive_classes(text.encode()), c) for c in chars)) < 1e-9
        at = max([i for i, n in enumerate(quality.LENGTHS) if n <= len(words)], default=0)
        ok = not r.base_failed and (not wide or r.char_distance <= quality.CHAR_DISTANCE) and (not long or any(f <= m for f, m in zip(far, ref["limits"][at], strict=True)))
        assert r.kept == ok


def naive_classes(data):
    kinds = [lambda b: 97 <= b <= 122, lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b in b" \t\n\r\x0b\x0c", lambda b: b in quality.PUNCTUATION.encode(), None, lambda b: b >= 128]
    out = [sum(map(k, data)) if k else 0 for k in kinds]
    out[5] = len(data) - sum(out)
    return out


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x > 0)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))
