"""Components, neighbours, communities and spectral clusters against dense or plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import clusters, communities, krylov, layout, masks
from lattica.sources import files


def tidy(spark, x, ids=None, genes=None):
    n, m = x.shape
    ids, genes = ids or list(range(n)), genes or list(range(m))
    kind = lambda v: "long" if isinstance(v, int) else "string"
    return spark.createDataFrame([(ids[i], genes[j], float(x[i, j])) for i in range(n) for j in range(m)], f"cell_id {kind(ids[0])}, gene {kind(genes[0])}, x double")


def dense(x, k):
    u, s, v = np.linalg.svd(x, full_matrices=False)
    v = v[:k] * np.sign(v[np.arange(min(k, len(v))), np.abs(v[:k]).argmax(axis=1)])[:, None]
    return x @ v.T, v.T, s[:k]


def test_components_over_several_blocks(spark, monkeypatch):
    """A spectrum that falls slowly, over 4 x 9 blocks, with a basis that is compressed on the way."""
    monkeypatch.setattr(krylov, "SIDE", 40)
    monkeypatch.setattr(krylov, "BLOCKS_HELD", 3)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((150, 340)) * 0.97 ** np.arange(340)
    x[7] = 0
    real = krylov.index_of
    monkeypatch.setattr(krylov, "index_of", lambda names, column: real(names, column, 40))
    scores, loadings, values = clusters.decomposed(tidy(spark, x, [f"c{i:03d}" for i in range(150)]), 8)
    pc, v, s = dense(x, 8)
    got = np.array([r.pc for r in scores.orderBy("cell_id").collect()])
    assert got.shape == (150, 8) and np.abs(got - pc).max() < 1e-6 and np.abs(values - s).max() < 1e-9
    assert np.abs(np.array([r.loading for r in loadings.orderBy("gene").collect()]) - v).max() < 1e-6


def test_components_of_low_rank_nulls_and_empty(spark):
    x = np.outer(np.arange(1.0, 7), [1, 2, 0, 3])
    df = tidy(spark, x).withColumn("x", F.when(F.col("gene") == 2, F.lit(None)).otherwise(F.col("x")))
    pc = {r.cell_id: r.pc for r in clusters.components(df, 3).collect()}
    assert all(len(p) == 1 and p[0] == pytest.approx((i + 1) * np.sqrt(14)) for i, p in pc.items())
    assert clusters.components(df.limit(0), 3).count() == 0


def test_the_first_of_equal_components_has_what_cells_sum_to(spark):
    """Four copies of a matrix side by side have each value four times; a power iteration from ones finds the same in each copy."""
    x = np.random.default_rng(4).random((12, 15)).round(3)
    rows = [(12 * c + i, 15 * c + j, float(x[i, j])) for c in range(4) for i in range(12) for j in range(15)]
    scores, _, values = clusters.decomposed(spark.createDataFrame(rows, "cell_id long, gene long, x double"), 6)
    pc, _, s = dense(x, 2)
    got = np.array([r.pc for r in scores.orderBy("cell_id").collect()])
    assert np.abs(values - np.repeat(s, 4)[:6]).max() < 1e-9
    assert np.abs(got[:, 0] - np.tile(pc[:, 0], 4) / 2).max() < 1e-9
    assert np.abs(got.T @ got - np.diag(values**2)).max() < 1e-8


def all_nearest(x, ids, k):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return {(ids[i], b, round(a, 9)) for i in range(len(x)) for a, b in sorted((d[i, j], ids[j]) for j in range(len(x)) if j != i)[:k]}


@pytest.mark.parametrize("case", ["few values", "all equal", "groups", "few cells"])
def test_nearest_with_ties(spark, case):
    rng = np.random.default_rng(3)
    x, k, block = {
        "few values": (rng.integers(0, 2, (200, 4)).astype(float), 14, 20), "all equal": (np.ones((90, 2)), 5, 10),
        "groups": (rng.normal(0, 30, (12, 6))[rng.integers(0, 12, 600)] + rng.normal(0, 1, (600, 6)), 8, 20), "few cells": (rng.normal(0, 1, (4, 3)), 10, 2),
    }[case]
    ids = [f"c{(7 * i) % 1009:04d}" for i in range(len(x))]
    df = tidy(spark, x, ids)
    got = masks.nearest(df, k, block).collect()
    assert {(r.cell_id, r.nbr_id, round(r.dist, 9)) for r in got} == all_nearest(x, ids, k) and len(got) == len(x) * min(k, len(x) - 1)
    if case == "groups":
        compared, every = masks.compared_pairs(df, k, block)
        assert compared < every / 4


def test_neighbours_are_searched_once_for_both_directions(spark):
    expr = tidy(spark, np.random.default_rng(8).normal(size=(120, 3)))
    found = masks.neighbourhood(expr, masks.nearest(expr, 4, 20), 2)
    assert "CoGroup" not in found._jdf.queryExecution().toString() and found.count() > 0


@pytest.mark.parametrize("scale", [1.0, 1e-25])
def test_closest_over_several_tiles(monkeypatch, scale):
    """Ties at the end, with and without a bound known before, where single precision does and where it doesn't."""
    monkeypatch.setattr(masks, "TILE_ROWS", 16)
    monkeypatch.setattr(masks, "TILE_COLUMNS", 32)
    x, ids = np.random.default_rng(9).integers(-3, 4, (150, 3)) * scale, np.arange(150) * 2
    d = np.sqrt(((x[:, None] - x) ** 2).sum(-1))
    want = {(ids[i], j) for i in range(150) for _, j in sorted((d[i, j], ids[j]) for j in range(150) if j != i)[:6]}
    for tau in (np.full(150, np.inf), np.sort(d, axis=1)[:, 6]):
        got = masks._closest(ids, x, ids, x, 6, tau)
        assert set(zip(got["cell_id"], got["nbr_id"], strict=True)) == want and len(got) == len(want)


def ring_graph(spark, groups, size, bridges, name="cell"):
    """Groups in which each cell links to the next three, and a few links between groups."""
    rows = [(f"{name}{g}-{i}", f"{name}{g}-{(i + s) % size}") for g in range(groups) for i in range(size) for s in (1, 2, 3)]
    rows += [(f"{name}{b % groups}-{b % size}", f"{name}{(b + 1) % groups}-{(b * 7) % size}") for b in range(bridges)]
    return spark.createDataFrame(rows, "cell_id string, nbr_id string")


def test_spectral_finds_planted_groups(spark):
    found = clusters.spectral(ring_graph(spark, 4, 25, 6), 4).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cell_id.split("-")[0], set()).add(r.spectral)
    assert len(found) == 100 and all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == 4


def test_eigenvalues_agree_with_a_dense_solution(spark):
    """Rayleigh quotients of 500 cells in eight groups, over 5 x 5 blocks."""
    rng = np.random.default_rng(5)
    same = np.arange(500)[:, None] % 8 == np.arange(500) % 8
    a = (rng.random((500, 500)) < np.where(same, 0.15, 0.01)).astype(float)
    a = np.triu(a, 1) + np.triu(a, 1).T + np.eye(500)
    d = 1 / np.sqrt(a.sum(1))
    b = d[:, None] * a * d
    cells = krylov.index_of(spark.range(500).withColumnRenamed("id", "cell_id"), "cell_id", 120)
    i, j = np.nonzero(b)
    blocks = krylov.Blocks.of(spark.createDataFrame([(int(p), int(q), float(b[p, q])) for p, q in zip(i, j, strict=True)], "row long, col long, x double"), cells, cells)
    found = krylov.leading(lambda v, width: blocks.times(v, width), cells, 6, 1e-8)
    assert np.abs(found.values - np.linalg.eigvalsh(b)[::-1][:6]).max() < 1e-10 and found.lack.max() < 1e-7
    q = np.zeros((500, 6))
    for r in krylov.unpacked(found, cells, "cell_id", "q").collect():
        q[r.cell_id] = r.q
    assert np.abs((q * (b @ q)).sum(0) - found.values).max() < 1e-10 and np.abs(q.T @ q - np.eye(6)).max() < 1e-10


def sequential(graph, mass, gamma):
    """Local moving with aggregation of whole communities, on one machine."""
    member, names = list(range(len(graph))), None
    while True:
        out = communities.moved([f"{i:06d}" for i in range(len(graph))], mass, [f"{i:06d}" for i in range(len(graph))], graph, [{} for _ in graph], {f"{i:06d}": m for i, m in enumerate(mass)}, gamma, "/")
        names = {c: k for k, c in enumerate(sorted(set(out)))}
        if len(names) == len(graph):
            return member
        merged = [{} for _ in names]
        sums = [0.0] * len(names)
        for i, g in enumerate(graph):
            a = names[out[i]]
            sums[a] += mass[i]
            for j, w in g.items():
                if names[out[j]] != a:
                    merged[a][names[out[j]]] = merged[a].get(names[out[j]], 0.0) + w
        graph, mass, member = merged, sums, [names[out[m]] for m in member]


def reached(graph, member, gamma):
    mass = [sum(g.values()) for g in graph]
    inside = sum(w for i, g in enumerate(graph) for j, w in g.items() if member[i] == member[j])
    total = {}
    for i, m in enumerate(member):
        total[m] = total.get(m, 0.0) + mass[i]
    return inside - gamma * sum(t * t for t in total.values())


def connected(graph, member):
    for own in set(member):
        nodes = [i for i, m in enumerate(member) if m == own]
        seen, left = {nodes[0]}, [nodes[0]]
        while left:
            for j in graph[left.pop()]:
                if member[j] == own and j not in seen:
                    seen.add(j)
                    left.append(j)
        if len(seen) < len(nodes):
            return False
    return True


@pytest.mark.parametrize("n,block_links", [(2000, 10**6), (400, 900)])
def test_leiden_against_local_moving(spark, monkeypatch, n, block_links):
    """As good as local moving on one machine, or nearly with several blocks; communities are connected; ids are strings."""
    rng = np.random.default_rng(6)
    place = rng.normal(0, 4, (8, 3))[rng.integers(0, 8, n)] + rng.normal(0, 1, (n, 3))
    near = np.argsort(((place[:, None] - place[None]) ** 2).sum(-1), axis=1)[:, 1:11]
    graph = [{} for _ in range(n)]
    for i in range(n):
        for j in near[i].tolist():
            graph[i][j] = graph[j][i] = 1.0
    knn = spark.createDataFrame([(f"c{i}", f"c{j}") for i in range(n) for j in near[i].tolist()], "cell_id string, nbr_id string")
    real = communities.leiden
    monkeypatch.setattr(communities, "leiden", lambda *a: real(*a, block_links=block_links))
    got = {r.cell_id: r.community for r in clusters.modularity_communities(knn).collect()}
    member = [got[f"c{i}"] for i in range(n)]
    mass = [sum(g.values()) for g in graph]
    gamma = 1.0 / sum(mass)
    plain = reached(graph, sequential(graph, mass, gamma), gamma)
    assert reached(graph, member, gamma) >= plain * (1 if block_links > n * 20 else 0.97)
    assert connected(graph, member)
    sizes = [member.count(c) for c in range(max(member) + 1)]
    assert sizes == sorted(sizes, reverse=True) and min(sizes) > 0


def test_positions(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "a int, b int").repartition(7)
    assert [r.at for r in files.positions(df, [F.col("a").desc()], "at").orderBy(F.desc("a")).collect()] == list(range(101))
    assert files.positions(df.limit(0), [F.col("a")], "at").count() == 0


def test_products_of_many_nearly_empty_blocks(spark):
    n, side = 600, 8
    to = np.random.default_rng(3).permutation(n)
    cells = krylov.index_of(spark.range(n).withColumnRenamed("id", "cell_id"), "cell_id", side)
    blocks = krylov.Blocks.of(spark.createDataFrame([(i, int(j), 1.0 + i) for i, j in enumerate(to)], "row long, col long, x double"), cells, cells)
    used = blocks.entries.select("cb").distinct().count()
    assert blocks.strips(False).count() == used < blocks.entries.select("rb", "cb").distinct().count() / 4
    place = {r.cell_id: (r.blk, r.pos) for r in cells.collect()}
    v = {}
    for i, (blk, pos) in place.items():
        v.setdefault(blk, {})[pos] = (float(i), float(i * i))
    vectors = spark.createDataFrame([(b, bytearray(np.array([rows[p] for p in range(len(rows))]).tobytes())) for b, rows in v.items()], "blk int, data binary")
    for transposed in (False, True):
        out = {r.blk: krylov.matrix(r.data, 2) for r in blocks.times(vectors, 2, transposed).collect()}
        for i, j in enumerate(to.tolist()):
            a, b = (j, i) if transposed else (i, j)
            assert out[place[a][0]][place[a][1]].tolist() == [(1.0 + i) * b, (1.0 + i) * b * b]


def test_neighbours_where_nothing_is_ruled_out(spark, monkeypatch):
    x = (5 * np.random.default_rng(5).normal(size=(400, 16))).round()
    x[300:350] = x[:50]
    expr = spark.createDataFrame([(i, g, float(v)) for i, row in enumerate(x) for g, v in enumerate(row)], "cell_id long, gene long, x double")
    real, found = masks._searched, []
    monkeypatch.setattr(masks, "_searched", lambda *a: found.append(real(*a)) or found[-1])
    got = {}
    for r in masks.nearest(expr, 10, 5).collect():
        got.setdefault(r.cell_id, []).append((round(r.dist, 9), r.nbr_id))
    for i in range(400):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1)).round(9)
        assert sorted(got[i]) == sorted((d[j], j) for j in range(400) if j != i)[:10]
    # 10 from each of at most 17 regions, instead of up to 5 from each of 80 parts
    assert found[1][0].count() <= 400 * 17 * 10 < 400 * 80 * 5
    assert found[1][0].groupBy("cell_id").count().agg(F.max("count")).first()[0] <= 170


@pytest.mark.parametrize("block_links", [10**6, 3000])
def test_leiden_finds_planted_groups_in_few_steps(spark, monkeypatch, block_links):
    """Four groups of 150 with links at places that look random, and a few across: found whole, in one block and in several; one
    block goes through all levels in one task, so the tables written don't grow with the levels."""
    rows = [(150 * g + r, 150 * g + (r * a + b) % 150) for g in range(4) for r in range(150) for a, b in ((1, 1), (7, 1), (31, 3), (101, 7))]
    rows += [(i, i + 150) for i in range(0, 450, 20)]
    knn = spark.createDataFrame(rows, "cell_id long, nbr_id long").filter("cell_id <> nbr_id")
    real, store, count = communities.leiden, communities.stored, []
    monkeypatch.setattr(communities, "leiden", lambda *a: real(*a, block_links=block_links))
    monkeypatch.setattr(communities, "stored", lambda df: count.append(1) or store(df))
    got = {r.cell_id: r.community for r in clusters.modularity_communities(knn, 0.5).collect()}
    assert len(got) == 600 and len(set(got.values())) == 4 and all(got[i] == got[i // 150 * 150] for i in got)
    assert block_links < 10**6 or len(count) <= 8


def test_eigenvectors_read_the_last_two_blocks_only_while_rounding_allows(spark, monkeypatch):
    """Two values that are found at once, ten that take long: what rounding brings back of the first ones is taken off in time."""
    monkeypatch.setattr(krylov, "EXTRA", 2)
    read, joined = [], krylov._joined
    monkeypatch.setattr(krylov, "_joined", lambda held, *rest: (read.append(len(held)), joined(held, *rest))[1])
    values = np.concatenate([[50.0, 40.0], np.linspace(2.0, 1.8, 10), np.linspace(1.5, 0, 288)])
    cells = krylov.index_of(spark.range(300).withColumnRenamed("id", "cell_id"), "cell_id", 150)
    blocks = krylov.Blocks.of(spark.createDataFrame([(i, i, float(x)) for i, x in enumerate(values)], "row long, col long, x double"), cells, cells)
    found = krylov.leading(lambda v, width: blocks.times(v, width), cells, 12, 1e-9)
    q = np.zeros((300, 12))
    for r in krylov.unpacked(found, cells, "cell_id", "q").collect():
        q[r.cell_id] = r.q
    assert np.abs(found.values - values[:12]).max() < 1e-8
    assert np.abs(q.T @ q - np.eye(12)).max() < 1e-7
    late = [n for n in read if n > 2]
    assert late and len(late) < len([n for n in read if n == 2]), read


@pytest.mark.parametrize("of", ["spectral", "layout"])
def test_a_graph_of_close_values_keeps_its_basis(spark, monkeypatch, of):
    """A ring takes as many steps as its cells allow, not the many more that a basis of three blocks takes."""
    monkeypatch.setattr(krylov, "BLOCKS_HELD", 3)
    made, times = [], krylov.Blocks.times
    monkeypatch.setattr(krylov.Blocks, "times", lambda *args, **kw: (made.append(1), times(*args, **kw))[1])
    knn = spark.createDataFrame([(i, (i + j) % 120, float(j)) for i in range(120) for j in (1, 2)], "cell_id long, nbr_id long, dist double")
    found = (clusters.spectral(knn, 4) if of == "spectral" else layout.umap(knn, epochs=1)).collect()
    assert len(found) == 120 and len(made) <= 11
    if of == "spectral":
        label = [r.spectral for r in sorted(found)]
        assert len(set(label)) == 4 and sum(a != b for a, b in zip(label, label[1:] + label[:1], strict=True)) == 4
