"""The Merkle manifest against trees built plainly, at several block and subtree heights."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lattica.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, pos int, tree string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, more=0):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    doc_id, source, lang, n, text = row
    return sha(*map(enc, (doc_id, source, lang, None if n is None else n + more, text)))


def climb(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        out.append((at & 1, level[at ^ 1] if at ^ 1 < len(level) else ""))
        at >>= 1
    return out


def expected(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[lang] = (own, climb([plain_leaf(r) for r in own]))
    top = climb([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            path = siblings(levels, at) + siblings(top, k)
            node = plain_leaf(r, 1) if tampered(r[0]) else plain_leaf(r)
            for left, other in path:
                node = sha(other, node) if left else sha(node, other)
            out.append((r[0], plain_leaf(r), levels[-1][0], top[-1][0], sha(*[s for _, s in path]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def corpus():
    rows = [(i * 3 % 101, f"s{i % 3}", ["en", "fr", None, "de"][i % 4 if i % 7 else 0], i, f"text {i} é" * (i % 5)) for i in range(101)]
    return rows + [(None, None, "en", None, None), (None, None, "en", None, None), (5, "x", "", 2**63 - 1, ""), (7, "b", "one", 4, "long " * 20_000), rows[3], rows[3]]


@pytest.mark.parametrize("block", [1, 2, 3, 10])
def test_manifest(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "t") for r in rows], SCHEMA)
    tampered = F.col("doc_id") % 7 == 0
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    out = merkle.manifest(docs, tampered, {"n_chars": more})
    got = out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = expected(rows, lambda i: i is not None and i % 7 == 0)
    assert sorted(map(tuple, got), key=repr) == want
    assert any(not w[-1] for w in want)


def test_empty_and_single(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(none, F.lit(False), {}).count() == 0
    one = merkle.manifest(spark.createDataFrame([(1, "a", "en", 3, "abc", 0, "t")], SCHEMA), F.lit(None).cast("boolean"), {}).collect()
    leaf = plain_leaf((1, "a", "en", 3, "abc"))
    assert [(r.leaf, r.root, r.proof_sha256, r.verified, r.proof) for r in one] == [(leaf, leaf, sha(), True, [])]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 21, 64])
@pytest.mark.parametrize("levels", [1, 2, 3])
def test_traversal_holds_two_subtrees_a_stage(n, levels):
    nodes = [sha(str(i)) for i in range(n)]
    tree = climb(nodes)
    walk = merkle.Traversal(nodes, len(tree) - 1, levels)
    assert walk.root() == tree[-1][0]
    most = 0
    for at, path in enumerate(walk.paths()):
        assert [(s or "") for s in path] == [s for _, s in siblings(tree, at)]
        held = sum(len(row) for sub in [*walk.held, *[x for x in walk.next if x]] for row in sub.rows)
        most = max(most, held + sum(map(len, walk.stacks)))
    stages = max(1, len(walk.stages))
    assert most <= stages * (2 * 2 ** (levels + 1) + len(tree))
