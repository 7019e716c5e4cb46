"""The layout of neighbours: its parts against their definitions, and how well it keeps neighbours."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import clusters, layout, masks
from lattica.sources import views


def overlap(place, near):
    d = ((place[:, None] - place[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    k = len(near[0])
    return np.mean([len(set(np.argsort(row, kind="stable")[:k].tolist()) & set(n)) / k for row, n in zip(d, near, strict=True)])


@pytest.mark.parametrize("block_links", [10**6, 4000])
def test_layout_keeps_more_neighbours_than_components(spark, block_links):
    expr = views.expr_dense(spark, "/root/testdata/sf0.01").persist()
    knn = masks.nearest(expr, 15).persist()
    near = {r.cell_id: set(r.n) for r in knn.groupBy("cell_id").agg(F.collect_list("nbr_id").alias("n")).collect()}
    ids = sorted(near)
    got = {r.cell_id: r.umap for r in layout.umap(knn, block_links=block_links).collect()}
    assert sorted(got) == ids and all(len(x) == 2 and np.isfinite(x).all() for x in got.values())
    x = np.zeros((len(ids), 64))
    for r in expr.collect():
        x[r.cell_id, r.gene] = r.x
    v = np.linalg.svd(x, full_matrices=False)[2]
    plain = overlap(x @ v[:2].T, [near[i] for i in ids])
    assert overlap(np.array([got[i] for i in ids]), [near[i] for i in ids]) > plain * 1.5
    if block_links == 10**6:
        assert {r.cell_id: r.umap for r in layout.umap(knn).collect()} == got


def test_memberships(spark):
    rng = np.random.default_rng(1)
    d = np.sort(rng.random((50, 12)), axis=1)
    d[0] = 0
    d[1, :3] = 0
    rho, sigma = layout.smoothed(d)
    sums = np.exp(-np.maximum(d - rho[:, None], 0) / sigma[:, None]).sum(axis=1)
    assert rho[0] == 0 and rho[1] == d[1, 3] and np.allclose(sums[2:], np.log2(12), atol=1e-6)
    knn = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "a", 1.0), ("b", "c", 5.0), ("c", "a", 2.0), ("c", "b", 5.0)], "cell_id string, nbr_id string, dist double")
    w = {(r.cell_id, r.nbr_id): r.w for r in layout.fuzzy_graph(knn).collect()}
    assert w["a", "b"] == w["b", "a"] == pytest.approx(1.0) and w["a", "c"] == w["c", "a"] and all(0 <= x <= 1 for x in w.values())
    assert layout.umap(knn.limit(0)).count() == 0


def test_curve():
    a, b = layout.curve(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=2e-3), pytest.approx(0.895, abs=2e-3))
    a, b = layout.curve(0.5)
    assert (a, b) == (pytest.approx(0.583, abs=2e-3), pytest.approx(1.334, abs=2e-3))


def test_process_has_a_layout(spark):
    rng = np.random.default_rng(4)
    rows = [(f"cell{i}", f"g{g}", float(rng.normal(6 if (g < 3) == (i < 10) else 0, 0.3))) for i in range(20) for g in range(6)]
    cells = spark.createDataFrame([(f"cell{i}", "old") for i in range(20)], "cell_id string, spectral string")
    got = clusters.process(spark.createDataFrame(rows, "cell_id string, gene string, x double"), 2, 5, 3, cells=cells, dimensions=3)
    assert got.columns == ["cell_id", "spectral", "pc", "spectral_1", "community", "umap"]
    assert got.count() == 20 and {len(r.umap) for r in got.collect()} == {3} and {r.spectral for r in got.collect()} == {"old"}
