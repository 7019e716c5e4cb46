"""The corpus pipeline stage by stage on a small table, against plain Python."""

import hashlib
import re
import zlib
from fractions import Fraction

import corpus_pipeline
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import mixing
from lattica.llm.common import word_count

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, before, SF)
        assert after.columns == columns
        kept, had = {r.doc_id for r in after.collect()}, {r.doc_id for r in before.collect()}
        assert kept <= had
        if name == "near_dedup":
            texts = [r.text for r in after.collect()]
            assert len(set(texts)) == len(texts)
        before = after
    mixed = corpus_pipeline.mixture(spark, before, SF)
    assert mixed.columns == columns
    want = mixing.mix(before, word_count(F.col("text"))).agg(F.sum("taken")).first()[0]
    assert mixed.select(F.sum(word_count(F.col("text")))).first()[0] == want
    shards = corpus_pipeline.shards(spark, mixed, SF).groupBy("shard").count().collect()
    assert max(r["count"] for r in shards) - min(r["count"] for r in shards) <= 1


def word_spans(text):
    return [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]


def norm(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def five(text):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in text[a:b]) for a, b in word_spans(text)]
    return {tuple(words[p : p + 5]) for p in range(max(1, len(words) - 4))} if words else set()


def one_of_each(rows):
    """One row of each component over five-word Jaccard similarity of 0.8 or more: least id, then least signed hash of the text."""
    sets, group = [five(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if group[i] != group[j] and 5 * common >= 4 * either:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for g, r in zip(group, rows, strict=True):
        h = xxhash.xxh64_intdigest(r[1].encode(), 42)
        key = (r[0] is None, r[0] or 0, h - (1 << 64) if h >> 63 else h)
        best[g] = min(best.get(g, (key, r)), (key, r), key=lambda x: x[0])
    return [r for _, r in best.values()]


def clean(rows, items):
    wins = {tuple(w[p : p + 13]) for t in items for w in [norm(t)] if w for p in range(max(1, len(w) - 12))}
    out = []
    for r in rows:
        w, hit = norm(r[1]), set()
        for n in {len(x) for x in wins}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in wins:
                    hit |= set(range(p, p + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(r)
    return out


def by_hash(seed, r, *more):
    return (hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, *more)


def mix(rows):
    sources = sorted({r[2] for r in rows}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(len(word_spans(r[1])) for r in rows if r[2] == s) for s in sources}
    weight, target, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, set(sources)
    while open_:
        left = Fraction(3 * sum(size.values()), 2) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        target |= {s: 2 * size[s] for s in over} or share
        open_ = open_ - over if over else set()
    out = []
    for s in sources:
        left = int(target[s])
        own = sorted((r for r in rows if r[2] == s), key=lambda r: by_hash("mix", r, len(word_spans(r[1]))))
        while left > 0:
            for i, t, _ in own:
                spans = word_spans(t)
                if left > 0 and spans:
                    out.append((i, t if left >= len(spans) else t[: spans[left - 1][1]], s))
                    left -= min(left, len(spans))
    return out


def sharded(rows):
    rows = [(i, t, s, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t, s in rows]
    placed = []
    for s in {r[2] for r in rows}:
        own = sorted((r for r in rows if r[2] == s), key=lambda r: by_hash("shard", r, *r[3:]))
        placed += [((k + 0.5) / len(own), "n" if s is None else "s" + s, by_hash("shard", r, *r[3:]), r) for k, r in enumerate(own)]
    out, slots = [], {}
    for pos, (_, _, _, r) in enumerate(sorted(placed, key=lambda x: x[:3])):
        shard = pos * 8 // len(placed)
        out.append((r[0], r[2], r[3], r[4], shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
    return out


def test_run_against_brute_force(spark, tmp_path):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    say = lambda seed: " ".join(hashlib.md5(f"{seed} {k}".encode()).hexdigest()[:7] for k in range(90))
    item = next(r.text for r in items.collect() if len(norm(r.text)) >= 13)
    more = [(None, "", "web"), (None, None, None), (9001, "12 34 ... 56", "web"), (None, say(1), "web"), (None, say(1), "web"), (9002, say(2), None), (9002, say(3), None), (9002, say(3), None), (9003, item, "web"), (9004, say(4) * 30, "only")]
    blank = {f.name: None for f in docs.schema}
    extra = spark.createDataFrame([tuple((blank | {"doc_id": i, "text": t, "source": s})[c] for c in docs.columns) for i, t, s in more], docs.schema)
    docs.unionAll(extra).write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.unionAll(extra).collect()]
    kept = clean(one_of_each([r for r in rows if any(map(str.isalpha, r[1] or ""))]), [r.text for r in items.collect()])
    assert len({r[0] for r in kept}) < len(kept) < len(rows)
    want = sharded(mix(kept))
    got = [(r.doc_id, r.source, r["size"], r.text_crc32, r.shard, r.slot) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_empty_documents(spark, tmp_path):
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    with pytest.raises(KeyError):
        names["nothing"]
