"""Correlation, linkage and cophenetic distances over tables of pairs, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import genes, stats
from lattica.sources import views


def tidy(spark, x, names):
    return spark.createDataFrame([(i, names[j], float(x[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1]) if np.isfinite(x[i, j])], "cell_id long, gene string, x double")


def sequential(d):
    """Average linkage one merge at a time over a matrix of distances."""
    n = len(d)
    d = d.copy()
    np.fill_diagonal(d, np.inf)
    members, out = {i: [i] for i in range(n)}, np.zeros((n, n))
    first = d.copy()
    heights = []
    while len(members) > 1:
        best = min(((np.mean([first[x, y] for x in a for y in b]), i, j) for i, a in members.items() for j, b in members.items() if i < j))
        a, b = members[best[1]], members.pop(best[2])
        out[np.ix_(a, b)] = best[0]
        out[np.ix_(b, a)] = best[0]
        members[best[1]] = a + b
        heights.append(best[0])
    return heights, out


def test_correlation_over_blocks_with_missing_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(3, 2, (90, 23))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 5] = 7.3
    x[:, 6] = np.nan
    x[3, 6] = 1.0
    names = [f"g{j:02d}" for j in range(23)]
    for side in (8, 128):
        got = {(r.a, r.b): r.corr for r in stats.gene_correlation(tidy(spark, x, names), side).collect()}
        for i in range(23):
            for j in range(i + 1, 23):
                ok = np.isfinite(x[:, i]) & np.isfinite(x[:, j])
                key = (names[i], names[j])
                if ok.sum() == 0:
                    assert key not in got
                elif ok.sum() == 1 or 5 in (i, j):
                    assert got[key] is None
                else:
                    assert got[key] == pytest.approx(np.corrcoef(x[ok, i], x[ok, j])[0, 1], abs=1e-10)


@pytest.mark.parametrize("n,block", [(30, 8_000_000), (45, 16)])
def test_linkage_equals_merges_one_at_a_time(spark, monkeypatch, n, block):
    monkeypatch.setattr(genes, "BLOCK_NUMBERS", block)
    rng = np.random.default_rng(n)
    x = rng.normal(0, 1, (40, n)) + rng.normal(0, 1, (40, 4))[:, rng.integers(0, 4, n)]
    names = [f"g{j:02d}" for j in range(n)]
    pairs, links, listed = genes.hierarchical(tidy(spark, x, names))
    c = 1 - np.corrcoef(x.T)
    np.fill_diagonal(c, 0)
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1))
    heights, meet = sequential(d)
    assert listed == names and links.shape == (n - 1, 4)
    assert np.allclose(links[:, 2], sorted(heights), atol=1e-9) and links[-1, 3] == n
    assert np.allclose(genes.cophenetic(links), meet, atol=1e-9)
    got = {(r.a, r.b): r.cophenet for r in pairs.collect()}
    assert len(got) == n * (n - 1) // 2
    assert all(v == pytest.approx(meet[names.index(a), names.index(b)], abs=1e-9) for (a, b), v in got.items())
    plain = genes.average_linkage(c)
    assert np.allclose(plain[:, 2], links[:, 2], atol=1e-9) and np.array_equal(plain[:, 3], links[:, 3])


def test_linkage_with_ties_and_few_genes(spark):
    """Equal rows meet at 0; ultrametric whatever the order of equal merges."""
    base = np.random.default_rng(3).normal(0, 1, (20, 3))
    x = base[:, [0, 0, 0, 1, 1, 2, 2, 2, 2]]
    pairs, links, listed = genes.hierarchical(tidy(spark, x, list("abcdefghi")))
    got = {(r.a, r.b): r.cophenet for r in pairs.collect()}
    assert got["a", "b"] == got["a", "c"] == got["d", "e"] == got["f", "i"] == pytest.approx(0, abs=1e-6) and got["a", "d"] > 0.1
    assert len(set(genes.cut(links, 0.05))) == 3
    one, links, listed = genes.hierarchical(tidy(spark, base[:, :1], ["a"]))
    assert one.count() == 0 and listed == ["a"] and len(links) == 0 and genes.cut(links, 1.0) == [1]


def test_given_genes(spark):
    expr = views.expr_counts(spark, "/root/testdata/sf0.001")
    pairs, links, listed = genes.hierarchical(expr, ["Brand#1", "Brand#2", "Brand#3"])
    assert listed == ["Brand#1", "Brand#2", "Brand#3"] and pairs.count() == 3
    assert genes.add_clusters(expr.select("gene").distinct(), listed, links, 0.0).filter(F.col("correlation_cluster").isNull()).count() == expr.select("gene").distinct().count() - 3


def best_of_all_lines(x, y, q):
    loss = lambda b: np.where((r := y - b[0] - b[1] * x) >= 0, q * r, (q - 1) * r).sum()
    return min(loss((y[i] - (m := (y[i] - y[j]) / (x[i] - x[j])) * x[i], m)) for i in range(len(x)) for j in range(i) if x[i] != x[j])


@pytest.mark.parametrize("seed", range(12))
def test_quantile_line_is_the_best_of_all(seed):
    rng = np.random.default_rng(seed)
    n = 60
    x = rng.integers(0, 6, n).astype(float) if seed % 3 == 0 else rng.normal(0, 1, n)
    y = np.round(0.5 * x + rng.normal(0, 1, n), 1 if seed % 3 == 1 else 9)
    for q in (0.1, 0.5, 0.9):
        a, b = genes.quantile_regression(x, y, q)
        r = y - a - b * x
        assert np.where(r >= 0, q * r, (q - 1) * r).sum() == pytest.approx(best_of_all_lines(x, y, q), rel=1e-9)


def test_quantile_line_by_bands(spark, monkeypatch):
    rng = np.random.default_rng(9)
    n = 3000
    x = rng.normal(0, 1, n)
    y = 2 - x + rng.standard_t(2, n) * (1 + np.abs(x))
    pairs = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (float("nan"), 1.0)], "cophenet double, corr double")
    want = genes.quantile_regression(x, y, 0.1)
    monkeypatch.setattr(genes, "LEAST_POINTS", 200)
    assert genes.quantile_line(pairs, 0.1) == pytest.approx(want, abs=1e-9)
    assert genes.quantile_line(pairs.limit(0), 0.1) == (0.0, 0.0)
    assert genes.quantile_regression(np.ones(5), np.arange(5.0), 0.5) == (2.0, 0.0)


def test_ranks_of_values(spark):
    """Ties averaged over ranges, with null, NaN and a value that most rows have."""
    rng = np.random.default_rng(4)
    rows = [(f"s{i % 3}", None if i % 41 == 0 else float("nan") if i % 43 == 0 else float(rng.integers(0, 40)) if i % 2 else 7.0) for i in range(900)]
    df = spark.createDataFrame(rows, "sig string, v double")
    got = {(r.sig, repr(r.v)): (r.n, r["rank"]) for r in stats.value_ranks(df, ["sig"], "v").collect()}
    key = lambda v: (0, 0.0) if v is None else (2, 0.0) if v != v else (1, v)
    for sig in ("s0", "s1", "s2"):
        own = [key(v) for g, v in rows if g == sig]
        for v in {repr(v): v for g, v in rows if g == sig}.values():
            less, same = sum(x < key(v) for x in own), own.count(key(v))
            assert got[sig, repr(v)] == (same, less + (same + 1) / 2)
    assert stats.value_ranks(df.limit(0), ["sig"], "v").count() == 0
