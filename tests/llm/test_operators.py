"""The text operators on small tables with nulls, empty, long and repeated texts, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import common, decontam, html, langid, mixing, neardup, packing, pii, quality, sharding, simhash, suffixdedup, windows
from lattica.llm.common import word_count

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, fp string, bin string"
BENCH = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, "Short item"), (3, None), (4, "..."), (5, "short ITEM")]


def corpus() -> list[tuple]:
    rnd = random.Random(3)
    words = ["the", "of", "and", "run", "blue", "été", "naïve", "straße", "green", "seven", "window", "river"] + [f"w{i}" for i in range(200)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = say(60)
    texts = [None, "", "   \n\t", "...", "one", "two words", say(40), passage + " " + say(30), say(10) + " " + passage, say(5) + " " + passage, "ab" * 400, "abcdefg " * 300, "line of text here\n" * 60, say(3000)]
    texts += [texts[13]] * 3 + [texts[6]] * 5 + [say(20) + " Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu " + say(10), say(30) + " short item " + say(4), texts[13].replace("the", "a", 2)]
    texts += ["mail a.b@c-d.org,x@y.z_q@r.st 10.0.0.1 1.2.3.4.5.6.7.8 999.1.1.1 4111 1111 1111 1111 4111-1111-1111-1112 +1 (357) 555-2937 +12 3 é a@b.co.uk. 00001.02.3.4"]
    return [(i, t, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", None]), len(t or ""), 1, "x", "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, rows[7], rows[1]], SCHEMA)


@pytest.fixture(scope="module")
def unique(docs):
    return docs.dropDuplicates(["doc_id"])


def by_id(df) -> dict:
    return {r["doc_id"]: r for r in df.collect()}


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame(BENCH, "item_id long, text string")
    for df in (mixing.mix(none, word_count(F.col("text"))), sharding.interleave(none), decontam.contamination(none, items), pii.find(none, pii.fit(none)), simhash.components(none), langid.predict(none.select("doc_id", "text"), langid.learn(langid.labelled(none))), quality.judged(none, quality.learn(none)), windows.deduplicated(none), suffixdedup.deduplicated(none), html.extracted(spark.createDataFrame([], "page_id long, url string, html string"))):
        assert df.count() == 0


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def pii_spans(text):
    for k, p in PII.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                yield m.start(), k, m.end()


def test_pii_base_and_model(spark, docs):
    rnd = random.Random(1)
    extra = ["card 4111.1111.1111.1111 ok", "call (357) 555-2937 now"]
    known = [f"{rnd.choice(['pay by card', 'call', 'note'])} {x} soon" for _ in range(300) for x in ("4111 1111 1111 1111", f"+1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)}", str(rnd.randint(10**7, 10**9)), f"{rnd.randint(1, 99)}/{rnd.randint(1, 12)}")]
    train = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(known + extra)], "doc_id long, text string")
    models = pii.fit(train)
    assert {"card", "phone"} <= set(models)
    got = by_id(pii.find(docs.select("doc_id", "text").unionAll(train), models))
    for i, t, *_ in corpus():
        own = sorted((s.start, k, s.end) for k in PII for s in got[i][f"b_{k}"])
        assert own == sorted(pii_spans(t))
    n = 1000 + len(known)
    assert [s.kind for s in got[n].added] == ["card"]
    clean = by_id(pii.redacted(train, models))
    assert clean[n].text == "card <card> ok"
    assert clean[1000].text.count("<") == 1


def test_suffix_dedup(docs):
    got, seen = by_id(suffixdedup.deduplicated(docs)), set()
    for i, t, *_ in corpus():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept) == (len(b), sum(gone), len(bytes(gone).replace(b"\0", b" ").split()), kept), i
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_suffix_array_and_shards():
    rng = np.random.default_rng(0)
    text = rng.integers(0, 3, 400).astype(np.int16)
    assert suffixdedup.suffix_array(text).tolist() == sorted(range(400), key=lambda i: text[i:].tolist())
    # shards of one bucket must find what one shard finds
    strings = [bytes(rng.integers(97, 99, 130).astype(np.uint8)) for _ in range(30)]
    strings += [s[7:] + b"zz" for s in strings[:15]]
    whole = suffixdedup.Shard(strings, np.arange(45) * 1000)
    parts = [suffixdedup.Shard(strings[a:b], np.arange(a, b) * 1000) for a, b in ((0, 14), (14, 33), (33, 45))]
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            a.merge(b, step=50)
    assert np.concatenate([p.first[p.classes] for p in parts]).tolist() == whole.first[whole.classes].tolist()


def test_parts_end_between_minimisers():
    rng = np.random.default_rng(1)
    minis, size = rng.integers(0, 40, 500), rng.integers(100, 200, 500)
    minis[:200] = 7
    got = suffixdedup.parts(np.arange(500), minis, size, 3000)
    assert sorted(np.concatenate(got).tolist()) == list(range(500))
    assert all(size[p].sum() <= 3200 or len(set(minis[p])) == 1 for p in got)
    homes = [{i for i, p in enumerate(got) if m in minis[p]} for m in range(40)]
    assert len(homes[7]) > 5 and all(set(minis[got[i]]) == {7} for i in homes[7]) and all(len(h) <= 1 or m == 7 for m, h in enumerate(homes) if size[minis == m].sum() <= 3000)
    assert suffixdedup.parts(np.arange(0), minis, size, 10) == []


def test_buckets_follow_the_bytes():
    assert packing.counts(10, 4) == (8, 4)
    buckets, parts = packing.counts(10**14, 200)
    assert 10**14 / buckets <= packing.BUCKET_BYTES and parts == packing.MOST_PARTITIONS
    assert packing.counts(30 * 10**9, 200)[1] > 400


@pytest.mark.parametrize(("held", "frequent"), [(1, 1 << 16), (4000, 1 << 16), (4000, 20), (4000, 1)])
def test_copies_settled_in_the_task(spark, monkeypatch, held, frequent):
    """Many copies of a passage, with blocks sent at once or after many strings, against brute force; no unit is frequent, those
    of the passage, or all."""
    monkeypatch.setattr(packing, "HELD_BYTES", held)
    monkeypatch.setattr(packing, "UNIT_SHARE", 1.01)
    monkeypatch.setattr(packing, "FREQUENT", frequent)
    rnd = random.Random(6)
    words = lambda n: " ".join(rnd.choice("abcdefgh") * 3 + str(rnd.randint(0, 99)) for _ in range(n))
    passage = words(30)
    rows = [(rnd.randint(0, 30), words(rnd.randint(0, 20)) + " " + passage + " " + words(rnd.randint(0, 3)) + " " + (passage if rnd.random() < 0.3 else "")) for _ in range(60)]
    rows = list({i: (i, t) for i, t in rows}.values())
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, got = set(), by_id(suffixdedup.deduplicated(df))
    for i, t in sorted(rows):
        b, gone = t.encode(), set()
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone |= set(range(s, s + 100))
            seen.add(b[s : s + 100])
        assert got[i].kept == bytes(x for k, x in enumerate(b) if k not in gone)
    first, got = {}, by_id(windows.deduplicated(df))
    for i, t in sorted(rows):
        w, gone = split(t), set()
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), i) < i:
                gone |= set(range(s, s + 13))
        assert got[i].kept == " ".join(x for k, x in enumerate(w) if k not in gone)


def test_frequent_units_draw_no_strings(spark, monkeypatch):
    """Strings around a passage don't meet at the minimisers of its edges: none has as many strings as a frequent unit has places."""
    monkeypatch.setattr(packing, "UNIT_SHARE", 1.01)
    monkeypatch.setattr(packing, "FREQUENT", 50)
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(7))
    passage = " ".join(word() for _ in range(40))
    rows = packing.keyed(spark.createDataFrame([(i, " ".join([*(word() for _ in range(15)), passage, *(word() for _ in range(15))])) for i in range(200)], "doc_id long, text string"))
    for module, hashed in ((windows, windows._units), (suffixdedup, suffixdedup._units)):
        found = packing.frequent(rows, hashed)
        most = []
        for often in (found, found[:0]):
            blocks = [b for batch in module._pack(1, type("", (), {"value": often}))(rows.toArrow().to_batches()) for b in batch.column("block").to_pylist()]
            most.append(int(np.unique(packing.unpack(blocks)[1], return_counts=True)[1].max()))
        assert len(found) > 30 and most[0] < packing.FREQUENT < most[1]


def test_window_dedup(docs):
    got, first = by_id(windows.deduplicated(docs)), {}
    for i, t, *_ in corpus():
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - 12):
            if first.setdefault(tuple(w[s : s + 13]), i) < i:
                gone[s : s + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), sum(gone), kept)


def test_language(docs):
    rnd = random.Random(2)
    en, fr = ["the", "and", "with", "street", "house", "where", "thing"], ["les", "est", "avec", "rue", "maison", "où", "être"]
    rows = [(i, " ".join(rnd.choice(en if i % 2 else fr) for _ in range(30)), "en" if i % 2 else "fr") for i in range(80)]
    train = docs.sparkSession.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(langid.labelled(train))
    got = by_id(langid.predict(train, model))
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    odd = by_id(langid.predict(docs.select("doc_id", "text"), model))
    for i, t, *_ in corpus():
        assert (odd[i].lang_pred == "und") == (not re.search(r"[^\W\d_]", t or ""))
        assert 0 <= odd[i].score <= 1
    assert by_id(langid.predict(train, ([], np.zeros((0, langid.DIM)))))[0].lang_pred == "und"
    assert langid.identified(docs).count() == sum(bool(re.search(r"[^\W\d_]", r.text or "")) for r in docs.collect())


def test_mixing(docs, unique):
    got = mixing.mix(docs, word_count(F.col("text"))).collect()
    assert len(got) == docs.count()
    total = sum(r["size"] for r in got)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)
    for s in {r.source for r in got}:
        own = [r for r in got if r.source == s]
        assert sum(r.taken for r in own) == int(own[0].target)
        assert all(0 <= r.taken <= 2 * r["size"] and own[0].target <= 2 * r.source_size for r in own)
    small = mixing.mix(docs, word_count(F.col("text")), per_bin=3).collect()
    assert sorted(map(repr, small)) == sorted(map(repr, got))
    mixed = mixing.mixed(unique, word_count(F.col("text")))
    assert mixed.columns == unique.columns
    want = sum(r.taken for r in mixing.mix(unique, word_count(F.col("text"))).collect())
    assert mixed.select(F.sum(word_count(F.col("text")))).first()[0] == want


def test_sharding_of_many_small_sources(spark):
    """Each source has one row, so all have the same fraction; no range of the sort holds many more rows than another."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("host"), "id").alias("source"), F.lit("ab").alias("text"))
    got = sharding.interleave(rows, 8, 1000)
    shape = got.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("m"), F.max("slot").alias("top")).collect()
    assert sorted((r.shard, r.n, r.m, r.top) for r in shape) == [(s, 2500, 2500, 2499) for s in range(8)]
    one = rows.withColumn("tree", F.lit("all")).withColumn("fraction", F.lit(0.5))
    places = common.placed(one, ["fraction", "source"], "test-places", 20).groupBy(F.floor(F.col("pos") / 1000)).count().collect()
    assert [r["count"] for r in places] == [1000] * 20
    files = spark.read.parquet(common.written(one.repartitionByRange(20, "tree", "fraction", "source"), "test-ranges").inputFiles()[0].rsplit("/", 1)[0])
    assert files.groupBy("_metadata.file_name").count().agg(F.max("count")).first()[0] < 3000


@pytest.mark.parametrize("per_bin", [4, 10_000])
def test_sharding(docs, per_bin):
    got = sharding.interleave(docs, 4, per_bin).collect()
    counts = [sorted(r.slot for r in got if r.shard == s) for s in range(4)]
    assert all(c == list(range(len(c))) for c in counts)
    assert max(map(len, counts)) - min(map(len, counts)) <= 1
    for s in {r.source for r in got}:
        own = [sum(r.shard == k and r.source == s for r in got) for k in range(4)]
        assert max(own) - min(own) <= 2
    assert sum(r["size"] for r in got) == sum(len((r.text or "").encode()) + 1 for r in docs.collect())


def brute_components(fps: dict[int, int]) -> dict[int, int]:
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("hot", [common.HOT_ROWS, 2])
def test_simhash(docs, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    got, fps = by_id(simhash.components(docs)), {}
    for i, t, *_ in corpus():
        w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sh = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert got[i].fp % (1 << 64) == fps[i]
    assert {i: got[i].component_id for i in got} == brute_components(fps)


def test_dealt_join(spark, monkeypatch):
    """A key of most rows, null and unmatched keys, and repeated rows: the rows of a plain join, the hot key in several parts."""
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [("hot", i % 7) for i in range(200)] + [(f"k{i % 40}", i) for i in range(100)] + [(None, 1)] * 30 + [("lost", 2)] * 30
    many = common.written(spark.createDataFrame(rows, "key string, x long"), "dealt")
    one = spark.createDataFrame([("hot", 1.0), ("unused", 2.0), *((f"k{i}", float(i)) for i in range(40))], "key string, y double")
    got = common.dealt_join(many, one, "key")
    assert got.columns == ["key", "x", "y"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one, "key").collect()))
    assert common.dealt_join(many.filter("key = 'k1'"), one, "key").count() == 3
    assert common.dealt_join(many.limit(0), one, "key").count() == 0


def test_hamming_links(spark):
    """Dense balls and chains of fingerprints, all bits in use."""
    rnd = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        c = rnd.getrandbits(64)
        for _ in range(25):
            fps.add(c)
            for _ in range(rnd.randint(1, 5)):
                c ^= 1 << rnd.randrange(64)
    signed = {i: f for i, f in enumerate(sorted(fps))}
    own = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in signed.values()], "fp long")
    labels = {r.v % (1 << 64): r.label for r in simhash.connected(simhash.links(own)).collect()}
    want = brute_components(signed)
    groups: dict = {}
    for i, f in signed.items():
        groups.setdefault(want[i], set()).add(labels.get(f, ("alone", f)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_quality(docs):
    got = by_id(quality.judged(docs, quality.learn(docs)))
    for i, t, *_ in corpus():
        w, t = split(t), t or ""
        tri = list(zip(w, w[1:], w[2:]))  # noqa: B905
        again = {p + k for p, x in enumerate(tri) for k in range(3) if tri.count(x) > 1} if len(w) < 1500 else None
        seen, dup = set(), 0
        for line in t.split("\n"):
            dup += bool(split(line)) and line in seen
            seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup)
        if again is not None:
            assert r.n_repeat_words == len(again)
            assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w))
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize("limit", [decontam.BROADCAST_BYTES, 0])
def test_decontamination(spark, docs, limit):
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    got = by_id(decontam.contamination(docs, spark.createDataFrame(BENCH, "item_id long, text string"), limit))
    wins = {(i, tuple(w[p : p + 13])) for i, t in BENCH for w in [norm(t)] for p in range(max(1, len(w) - 12)) if w}
    for i, t, *_ in corpus():
        w = norm(t)
        hit, items = set(), set()
        for item, win in wins:
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    items.add(str(item))
        assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == (len(w), len(hit), sorted(items))
    empty = by_id(decontam.contamination(docs, spark.createDataFrame([(1, None)], "item_id long, text string")))
    assert all(r.n_hit == 0 for r in empty.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><header>Top</header>
<nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, many, many cookies on this page</div><div id=main>
<article><h1>Head &amp; line</h1><p><b>First, with\n a  break.<br>Next.<p>Second &lt;paragraph&gt; of some length, with commas, and words.</p><aside>Side</aside><form>Name <input></form></article>
<section class="comments"><p>A reader comment, long, with commas, and still, not part of it at all, though it goes on and on</p></section></div><footer>Foot</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, "u", ""), (4, "u", "plain text"), (5, "u", "<p>unclosed <b>bold"), (6, "u", "<div " * 2000 + "x"), (7, "u", "<i>" * 5000 + "deep"), (1, "u", PAGE)]
    got = {r.page_id: r for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].text == "Head & line\nFirst, with a break. Next.\nSecond <paragraph> of some length, with commas, and words."
    assert [got[i].text for i in (2, 3, 4, 5, 7)] == ["", "", "plain text", "unclosed bold", "deep"]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_rows_without_id(spark):
    """Stages treat rows without an id as documents of their own."""
    rnd = random.Random(9)
    say = lambda n: " ".join(rnd.choice("abcdefghij") * 4 + str(rnd.randint(0, 999)) for _ in range(n))
    a, b, c = say(80), say(80), say(80)
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, c + " tail"), (None, BENCH[0][1])]
    df = spark.createDataFrame([(i, t, "en", "s", len(t), 1, "x", "y") for i, t in rows], SCHEMA)
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns
    texts = [r.text for r in kept.collect()]
    assert sorted(texts) == sorted([a, b, c, BENCH[0][1]]) or sorted(texts) == sorted([a, b, c + " tail", BENCH[0][1]])
    clean = decontam.decontaminated(df, spark.createDataFrame(BENCH, "item_id long, text string"))
    assert clean.columns == df.columns
    assert sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows[:-1])
    mixed = mixing.mixed(df, word_count(F.col("text")))
    want = mixing.mix(df, word_count(F.col("text"))).agg(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(word_count(F.col("text")))).first()[0] == want


def test_many_rows_without_id_are_dealt_out(spark):
    """Rows that lack an id or share one don't meet in one bin, and budgets and shards stay exact."""
    rows = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 3 == 1, F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"), F.col("id").alias("at"))
    bins = common.spread(rows.withColumn("key", common.random_key(F.col("doc_id"), "x")), 60, 100).groupBy("bin").count().agg(F.max("count"), F.count("*")).first()
    assert bins[0] < 200 and bins[1] == 60
    got = mixing.mix(rows, word_count(F.col("text")), per_bin=100)
    assert got.agg(F.sum("taken"), F.first("target")).first() == (27000, 27000.0)
    counts = sharding.interleave(rows, 4, per_bin=100).groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("m"), F.max("slot").alias("top")).collect()
    assert [(r.n, r.m, r.top) for r in counts] == [(1500, 1500, 1499)] * 4


def test_shards_of_rows_with_a_column_of_the_number_s_name(spark):
    rows = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("a b c").alias("text"), F.col("id").alias("at"))
    got = sharding.sharded(rows, 4).collect()
    assert len(got) == 40 and all(r["at"] == r.doc_id for r in got) and len({(r.shard, r.slot) for r in got}) == 40


def test_many_contaminated_rows_without_id(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(BENCH[0][1] + " "), F.col("id").cast("string")).alias("text"))
    assert decontam.contamination(docs, spark.createDataFrame(BENCH, "item_id long, text string")).agg(F.sum("n_hit")).first()[0] == 4000 * 14


def test_samples_at_any_size(spark):
    """The share of a made-up count is never zero, and follows the count."""
    one = spark.range(1).select(langid.share(F.lit(10**11), 4000).alias("s"), common.chance(F.lit(1), F.lit("t"), F.lit("x")).alias("c")).first()
    assert one.s == pytest.approx(4e-8) and 0 <= one.c <= 1
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    assert 300 < common.sampled(docs, 20000, 400, "x").count() < 500
    assert common.sampled(docs, 10**11, 400, "x").count() == 0


def test_shards_hold_their_texts(spark, tmp_path):
    docs = spark.createDataFrame([(i % 3 if i % 4 else None, f"t{i // 2}" if i else None, "ab"[i % 2], i) for i in range(23)], "doc_id long, text string, source string, size long")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(repr(r.text) for r in got.collect()) == sorted(repr(r.text) for r in docs.collect())
    slots = {}
    for r in got.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 4
    assert sharding.sharded(docs.limit(0)).count() == 0


def test_language_by_naive_bundling(spark):
    """Cosines against letter vectors bound and bundled one n-gram at a time; without labels texts with letters stay."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("The cat, the hat", "en"), ("le chat est là", "fr"), ("one more line here", "en"), ("Été à Paris", "fr"), ("a", "en"), ("12 !", "fr"), (None, "en"), ("that cat", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    space = langid.Space()

    def naive(text):
        line = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
        total = np.zeros(langid.DIM)
        for p in range(len(line) - 2):
            total += np.prod([np.roll(space.letter(ord(c)), 2 - k) for k, c in enumerate(line[p : p + 3])], axis=0)
        return total

    langs, proto = langid.learn(df.filter("lang is not null"))
    want = {}
    for lang in ("en", "fr"):
        own = sum(naive(t) for _, t, k in rows if k == lang and t and any(map(str.isalpha, t)))
        want[lang] = own / np.linalg.norm(own)
        assert np.allclose(proto[langs.index(lang)], want[lang])
    for r in langid.predict(df.select("doc_id", "text"), (langs, proto)).collect():
        t = rows[r.doc_id][1]
        if t and any(map(str.isalpha, t)):
            v = naive(t)
            cos = {k: w @ v / np.linalg.norm(v) for k, w in want.items()}
            assert r.lang_pred == max(cos, key=cos.get) and abs(r.score - max(0, max(cos.values()))) < 1e-5
        else:
            assert (r.lang_pred, r.score) == ("und", 0)
    bare = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in langid.identified(bare).collect()} == {0, 1, 2, 3, 4, 7}
    clash = langid.predict(df.select("doc_id", "text", F.lit(1).alias("score")), (langs, proto))
    assert clash.columns == ["doc_id", "lang_pred", "score"]


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.op3_language_id(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", F.length("text").alias("n")), "doc_id").filter("held_out and lang is not null and n >= 40")
    right, all_ = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * all_
