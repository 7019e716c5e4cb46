"""Hand-computed results of the network operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import special
from lattica.operators import annotate, clusters, edges, export, genes, masks, networks, stats
from lattica.sources import files, matrix

NAN = float("nan")


@pytest.fixture(scope="module")
def grn(spark):
    w = {"c1": (0.1, 0.9, 0.5, -0.2), "c2": (NAN, 0.3, 0.8, 0.2), "c3": (0.0, 0.4, 0.4, 0.1)}
    return spark.createDataFrame([(c, s, t, x) for c, ws in w.items() for (s, t), x in zip(("AA", "AB", "BA", "BB"), ws, strict=True)], "cell_id string, source string, target string, w double")


@pytest.fixture(scope="module")
def cells(spark):
    return spark.createDataFrame([("c1", 0), ("c2", 1), ("c3", 0)], "cell_id string, cluster int")


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_top_edges(grn, cells):
    got = {(r.te, r.source + r.target): r.cell_count for r in edges.top_edge_counts(grn, [0.5, 0.25]).collect()}
    assert got == {(0.25, "AB"): 2, (0.25, "AA"): 1, (0.5, "BA"): 3, (0.5, "AB"): 2, (0.5, "AA"): 1}
    got = {(r.cluster, r.source + r.target): r.cell_count for r in edges.top_edge_counts(grn, [0.5], cells).collect()}
    assert got == {(0, "AB"): 2, (0, "BA"): 2, (1, "AA"): 1, (1, "BA"): 1}
    wide = edges.annotate_clusters(grn, [0.5], cells)
    kept = edges.filter_clusters(wide, 4, 0.25, "cell_count_0.5_0", "cell_count_0.5_1")
    assert [r.edge_key for r in kept.select("edge_key").collect()] == ["B_A"]
    with pytest.raises(ValueError):
        edges.filter_clusters(wide, 4, 0, "cell_count_0.5_0", "cell_count_0.5_1")
    with pytest.raises(KeyError):
        edges.filter_clusters(wide, 4, 0.5, "nothing", "cell_count_0.5_1")
    assert [edges.top_n(n, 0.1) for n in (5, 15, 25, 35)] == [0, 2, 2, 4]
    assert edges.top_edge_counts(grn, [0.01]).count() == 0


def test_quantile_partition(spark):
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate((10, 30, 20, 50, 40))], "g int, i int, x double")
    assert [r.part for r in edges.quantile_partition(df, ["g"], "x", ["i"], 2).orderBy("i").collect()] == [0.5, 1.0, 0.5, 1.0, 1.0]
    assert edges.quantile_partition(df.limit(1), ["g"], "x", ["i"], 49).first().part == 0.0
    with pytest.raises(ValueError):
        edges.quantile_partition(df, ["g"], "x", ["i"], 0)


def test_regulators(spark):
    crm = spark.createDataFrame([("chr1", 900, 950, ["T1", "T2"]), ("chr1", 1100, 1200, ["T2", "T3"]), ("chr1", 4000, 4000, ["T4"])], "chr string, start long, end long, TF_list_list array<string>")
    loci = spark.createDataFrame([("g1", "chr1", 1000), ("g2", "chr1", 5000), ("g3", "chr2", 1000)], "gene_name string, chr string, start long")
    out = annotate.regulators(crm, loci, 100)
    assert sorted((r.edge, r.nTFs) for r in out.collect()) == [("T1_g1", 3), ("T2_g1", 3), ("T3_g1", 3)]
    own = spark.createDataFrame([("T1", "g1"), ("T1", "g2")], "source string, target string")
    assert as_dict(annotate.add_regulators(own, out, "w"), "target", "regulator_w") == {"g1": True, "g2": False}
    assert annotate.regulators(crm.filter("false"), loci, 0).count() == 0


def test_external(spark, grn):
    net = spark.createDataFrame([("A", "B", 1.0, 0), ("A", "B", -2.0, 1), ("B", "Z", 5.0, 2)], "source string, target string, weight double, ord int")
    own = edges.edges_of(grn)
    got = {r.edge_key: (r.edge_in_net, r.is_target_net, r.is_source_net) for r in annotate.add_external(own, net, "net").collect()}
    assert got == {"A_A": (0, False, True), "A_B": (-2, True, True), "B_A": (0, False, True), "B_B": (0, True, True)}
    assert as_dict(annotate.edge_overlap(own, [("n", net), ("none", net.filter("false"))]), "net", "percent") == {"n__0": pytest.approx(200 / 3), "none__1": 0.0}
    with pytest.raises(KeyError):
        annotate.edge_overlap(own, [("n", net.drop("target"))])
    flags = spark.createDataFrame([(True, True), (True, False), (False, True), (False, False)], "is_stimulation boolean, is_inhibition boolean")
    assert [r[0] for r in flags.select(annotate.mode()).collect()] == ["Activation", "Activation", "Repression", "Unknown"]


def test_names(spark, tmp_path):
    own = spark.createDataFrame([("a",), ("b",)], "gene string")
    (tmp_path / "tf.csv").write_text("b\nc\n")
    names = files.read_names(spark, str(tmp_path / "tf.csv"))
    assert [r.gene for r in edges.filter_names(own, names).collect()] == ["b"]
    assert edges.filter_names(own, names, only=False).count() == 2
    with pytest.raises(ValueError):
        edges.filter_names(own, names.filter("tfs = 'c'"))


def test_readers(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr1\t1\t2\tA,B\t2\t+\t0\t0\t1,2\n")
    assert files.read_bed(spark, str(tmp_path / "x.bed")).first().TF_list_list == ["A", "B"]
    line = '1\tens\t{}\t5\t9\t.\t+\t.\tgene_id "E1"; gene_name "{}"; gene_biotype "x";\n'
    (tmp_path / "x.gtf").write_text("#!head\n" + line.format("gene", "G") + line.format("gene", "") + line.format("exon", "G"))
    got = files.gene_annotation(files.read_gtf(spark, str(tmp_path / "x.gtf"))).collect()
    assert [(r.chr, r.start, r.gene_name) for r in got] == [("chr1", 5, "G")]
    (tmp_path / "e.csv").write_text("source,target\na,b\n")
    assert files.read_edges(spark, str(tmp_path / "e.csv")).first().weight == 1.0
    s = files.Settings(n_models=3)
    s.write_yaml(str(tmp_path / "s.yaml"))
    assert files.Settings.read_yaml(str(tmp_path / "s.yaml")) == s
    (tmp_path / "s.yaml").write_text("nonsense: 1\n")
    with pytest.raises(TypeError):
        files.Settings.read_yaml(str(tmp_path / "s.yaml"))
    files.write_table(got and spark.range(2), str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_table(spark.range(2), str(tmp_path / "t"))
    files.write_table(spark.range(3), str(tmp_path / "t"), overwrite=True)
    assert files.read_table(spark, str(tmp_path / "t")).count() == 3


def test_pair_mask(spark):
    expr = spark.createDataFrame([("c", "A", 1.0), ("c", "B", 1.0), ("c", "C", 0.0)], "cell_id string, gene string, x double")
    assert sorted((r.source, r.target) for r in masks.pair_mask(masks.binarize(expr)).collect()) == [("A", "B"), ("B", "A")]


def test_nearest_in_blocks_equals_one_block(spark):
    rng = np.random.default_rng(0)
    expr = spark.createDataFrame([(i, g, float(x)) for i, row in enumerate(rng.integers(0, 3, (40, 4))) for g, x in enumerate(row)], "cell_id long, gene int, x double")
    key = lambda df: sorted((r.cell_id, r.nbr_id) for r in df.collect())
    assert key(masks.nearest(expr, 3, block_cells=7)) == key(masks.nearest(expr, 3))


def test_label_match(spark):
    ref = spark.createDataFrame(list(enumerate("xxyyy")), "cell_id long, l string")
    new = spark.createDataFrame(list(enumerate("11001")), "cell_id long, l string")
    mapped, score = clusters.unify_labels(ref, new)
    assert {(r.label, r.remap) for r in mapped.collect()} == {("1", "x"), ("0", "y")}
    assert score == pytest.approx(0.8)
    gain = np.random.default_rng(1).integers(0, 9, (4, 6)).astype(float)
    from itertools import permutations

    assert sum(gain[i, j] for i, j in enumerate(clusters.assignment(gain))) == max(sum(gain[i, j] for i, j in enumerate(p)) for p in permutations(range(6), 4))


def test_rank_sum(spark):
    scores = spark.createDataFrame([(c, s, x) for s in ("s", "t") for c, x in enumerate((3.0, 4.0, 1.0, 2.0))], "cell_id long, signature string, score double")
    own = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "cell_id long, cluster string")
    r = stats.rank_sum(scores, own).filter("cluster = 'a' and signature = 's'").first()
    assert r.stat == pytest.approx(1.549193, abs=1e-6)
    assert r.p == pytest.approx(0.060668, abs=1e-5)
    ps = spark.createDataFrame([(0, 0.01), (0, 0.04), (0, 0.03)], "g int, p double")
    assert sorted(round(r.p_adj, 9) for r in stats.benjamini_hochberg(ps, "p", "g", tie="p").collect()) == [0.03, 0.04, 0.04]


def test_rank_sum_of_equal_stats(spark):
    scores = spark.createDataFrame([(c, s, 0.5) for s in ("s", "t") for c in range(4)], "cell_id long, signature string, score double")
    own = spark.createDataFrame([(0, "a"), (1, "a"), (2, "b"), (3, "b")], "cell_id long, cluster string")
    assert all(r.stat == 0 and math.isnan(r.z_score) and math.isnan(r.combined_score) for r in stats.rank_sum(scores, own).collect())
    assert [r.z_score for r in stats.rank_sum(scores.filter("signature = 's'"), own).collect()] == [None, None]


def test_losses(spark):
    one = spark.range(1)
    f = lambda c: one.select(c).first()[0]
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    assert f(special.nb_nll(*lit(0, 1, 1))) == pytest.approx(0.693147, abs=1e-6)
    assert f(special.nb_nll(*lit(2, 1, 1))) == pytest.approx(2.079442, abs=1e-6)
    assert f(special.zinb_nll(*lit(0, 1, 1, 0.5))) == pytest.approx(0.287682, abs=1e-6)
    assert f(special.log_cosh(*lit(0, 900))) == pytest.approx(900 - math.log(2))
    for x in (0.1, 1.0, 3.5, 40.0):
        assert f(special.lgamma(F.lit(x))) == pytest.approx(math.lgamma(x), abs=1e-9)
        assert f(special.erfc(F.lit(x - 1))) == pytest.approx(math.erfc(x - 1), rel=2e-7)


def test_shared_targets(spark):
    own = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", "y"), ("B", "z"), ("B", "w")], "source string, target string")
    got = {(r.a, r.b): r.shared for r in stats.shared_targets(own).collect()}
    assert got == {("A", "A"): 2, ("A", "B"): 1, ("B", "A"): 1, ("B", "B"): 3}
    with pytest.raises(ValueError):
        stats.shared_targets(own, ["A"])
    with pytest.raises(ValueError):
        export.undirected(own, ["none"])


def test_linkage_and_cut():
    links = genes.average_linkage(np.array([[0.0], [1.0], [5.0], [7.0]]))
    assert links[:, 2].tolist() == [1.0, 2.0, 5.5]
    assert genes.cophenetic(links)[0, 3] == 5.5
    assert genes.cut(links, 2.0) == [1, 1, 2, 2]
    assert genes.cut(links, None) == [-1] * 4
    x = np.linspace(0, 1, 101)
    intercept, slope = genes.quantile_regression(x, 2 * x + 1, 0.1)
    assert (intercept, slope) == (pytest.approx(1, abs=1e-3), pytest.approx(2, abs=1e-3))


@pytest.mark.parametrize("kind", networks.MODEL_TYPES)
def test_gradients(kind):
    """Weights' gradients and the plain Jacobian against finite differences."""
    rng = np.random.default_rng(0)
    x = rng.poisson(2, (6, 5)).astype(float)
    model = networks.Model(5, 3, 4, kind, seed=1)
    c = model.forward(x)
    grads, h = model.gradients(c, model.loss(c)[1]), 1e-6
    for name in model.p:
        at = np.unravel_index(0, model.p[name].shape)
        old = model.p[name][at]
        ends = []
        for d in (h, -h):
            model.p[name][at] = old + d
            ends.append(model.loss(model.forward(x))[0])
        model.p[name][at] = old
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / (2 * h), abs=1e-5)
    jac = model.jacobian(x[0])
    for s in range(5):
        up, down = x[0].copy(), x[0].copy()
        up[s] += h
        down[s] -= h
        d = (model.forward(up[None])["mu"] - model.forward(down[None])["mu"])[0] / (2 * h)
        assert jac[:, s] == pytest.approx(d, abs=1e-5)


def test_training_and_attribution(spark):
    rng = np.random.default_rng(0)
    base = rng.poisson(5, (60, 2))
    x = np.column_stack([base, base[:, 0] * 2, rng.poisson(5, 60)]).astype(float)
    expr = spark.createDataFrame([(i, f"g{g}", float(v)) for i, row in enumerate(x) for g, v in enumerate(row)], "cell_id long, gene string, x double")
    models = networks.model_zoo(expr, n_models=2, epochs=40, kind="NegativeBinomialAutoencoder", latent=3, hidden=16, failures=0, lr=5e-3)
    assert len(models) == 2
    net = networks.infer(models, expr, "GradientShap")
    assert net.count() == 60 * 16
    assert net.filter("w is null or isnan(w)").count() == 0
    for method in ("GuidedBackprop", "Deconvolution"):
        assert networks.infer(models[:1], expr.filter("cell_id < 3"), method).count() == 48
    with pytest.raises(ValueError):
        networks.attribution(models[0], x[0], "nothing")
    with pytest.raises(ValueError):
        networks.backgrounds(x[0])
    assert sorted(networks.backgrounds(x, "randomize")[:, 0]) == sorted(x[:, 0])


def test_stream(spark, grn, tmp_path):
    from lattica.streaming import counts

    counts.pack(grn).write.parquet(str(tmp_path / "cells"))
    stream = spark.readStream.schema("cell_id string, edges array<struct<w:double,source:string,target:string>>").parquet(str(tmp_path / "cells"))
    q = counts.streaming_counts(stream, 2).writeStream.outputMode("complete").format("memory").queryName("top").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.source + r.target: r.cell_count for r in spark.table("top").collect()} == {"BA": 3, "AB": 2, "AA": 1}


def test_settings_round_trip(tmp_path):
    own = files.Settings(**{f: f"v_{f}" for f in files.SETTING_NAMES})
    assert len(files.SETTING_NAMES) == 18
    own.write_yaml(str(tmp_path / "s.yaml"))
    assert files.Settings.read_yaml(str(tmp_path / "s.yaml")) == own
    (tmp_path / "t.yaml").write_text("unknown: 1\n")
    with pytest.raises(TypeError):
        files.Settings.read_yaml(str(tmp_path / "t.yaml"))


def test_matrix(spark):
    m = spark.createDataFrame([("c", [1.0, 2.0]), ("d", [3.0, 4.0])], "cell_id string, v array<double>")
    var = spark.createDataFrame([(0, "A", "B"), (1, "B", "A")], "idx int, source string, target string")
    obs = spark.createDataFrame([("c", 7)], "cell_id string, cluster int")
    got = {(r.cell_id, r.source, r.w, r.cluster) for r in matrix.wrap(m, var, obs).collect()}
    assert got == {("c", "A", 1.0, 7), ("c", "B", 2.0, 7), ("d", "A", 3.0, None), ("d", "B", 4.0, None)}
    for bad in (lambda: matrix.wrap(m, var.limit(1)), lambda: matrix.wrap(m, var.union(var)), lambda: matrix.checked(matrix.wrap(m.union(m), var)), lambda: edges.count_totals(m) and None):
        with pytest.raises((ValueError, KeyError)):
            bad()
    names = spark.createDataFrame([(1, "x"), (0, "y"), (2, "z")], "gene_idx int, gene string")
    assert [r.gene for r in edges.ordered_names(names, names.filter("gene <> 'z'").select("gene")).collect()] == ["y", "x"]


def test_inverted_interval_counts(spark):
    crm = spark.createDataFrame([("c", 120, 90, ["T"]), ("c", 500, 90, ["U"])], "chr string, start long, end long, TF_list_list array<string>")
    loci = spark.createDataFrame([("c", 100, "g")], "chr string, start long, gene_name string")
    assert [r.TF for r in annotate.regulators(crm, loci, 30).collect()] == ["T"]


@pytest.mark.parametrize("activation", ["relu", "leaky_relu", "elu", "sigmoid", "other"])
@pytest.mark.parametrize("hidden", [[], [4], [6, 3]])
def test_gradients_of_chains(activation, hidden):
    rng = np.random.default_rng(2)
    x = rng.poisson(2, (6, 5)).astype(float)
    model, h = networks.Model(5, 3, hidden, "NegativeBinomialAutoencoder", seed=3, activation=activation), 1e-6
    assert model.p["e0w"].shape == (5, hidden[0] if hidden else 3)
    model.p = {k: w + rng.normal(0, 0.2, w.shape) for k, w in model.p.items()}  # no sum is exactly at a kink
    grads = model.gradients(c := model.forward(x), model.loss(c)[1])
    assert set(grads) == set(model.p)
    for name in model.p:
        at = tuple(n - 1 for n in model.p[name].shape)
        old, ends = model.p[name][at], []
        for d in (h, -h):
            model.p[name][at] = old + d
            ends.append(model.loss(model.forward(x))[0])
        model.p[name][at] = old
        assert grads[name][at] == pytest.approx((ends[0] - ends[1]) / (2 * h), abs=1e-5)
    jac = model.jacobians(x)
    for s in range(5):
        up, down = x.copy(), x.copy()
        up[:, s] += h
        down[:, s] -= h
        assert jac[:, :, s] == pytest.approx((model.forward(up)["mu"] - model.forward(down)["mu"]) / (2 * h), abs=1e-5)
    dropped = model.forward(x, 0.5, np.random.default_rng(1))["seen"]
    assert not hidden or all((np.asarray(dropped[c, 0][2]) == 0).any() for c in ("e", "mu", "theta"))


def test_process_of_string_cells(spark):
    """Two groups of cells that differ in half of their genes, with names for ids."""
    rng = np.random.default_rng(4)
    rows = [(f"cell{i}", f"g{g}", float(rng.normal(6 if (g < 3) == (i < 15) else 0, 0.3))) for i in range(30) for g in range(6)]
    got = clusters.process(spark.createDataFrame(rows, "cell_id string, gene string, x double"), 2, 5, 3).collect()
    groups = {int(r.cell_id[4:]) < 15: set() for r in got}
    for r in got:
        groups[int(r.cell_id[4:]) < 15].add((r.spectral, r.community))
    assert len(got) == 30 and all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == 2


def test_communities(spark):
    pairs = [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f"), ("d", "f"), ("c", "d")]
    knn = spark.createDataFrame(pairs, "cell_id string, nbr_id string")
    got = as_dict(clusters.modularity_communities(knn), "cell_id", "community")
    assert got == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1, "f": 1}
    spread = as_dict(clusters.label_communities(knn.filter("cell_id <> 'c'")), "cell_id", "community")
    assert len({spread[x] for x in "abc"}) == 1 and len({spread[x] for x in "def"}) == 1
    cut = as_dict(clusters.spectral(knn, 2), "cell_id", "spectral")
    assert len({cut[x] for x in "abc"}) == len({cut[x] for x in "def"}) == 1 and cut["a"] != cut["d"]


def test_potts_communities(spark):
    """A triangle, a pair and a weak link between them: resolution decides whether a link is worth a pair."""
    links = [("a", "b", 1.0), ("b", "a", 0.9), ("b", "c", 0.9), ("a", "c", 0.9), ("d", "e", 0.9), ("c", "d", 0.3)]
    knn = spark.createDataFrame(links, "cell_id string, nbr_id string, w double")
    got = lambda r: as_dict(clusters.potts_communities(knn, r), "cell_id", "community")
    assert got(0.5) == {"a": 0, "b": 0, "c": 0, "d": 1, "e": 1}
    assert got(1.0) == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    assert set(got(0.01).values()) == {0}


def test_consensus_of_models(spark):
    """Two models agree on two groups of cells, a third splits them at random; each model's own network gives its labels."""
    rng = np.random.default_rng(8)
    grn = lambda half: spark.createDataFrame([(f"cell{i:02d}", f"g{g}", float(rng.normal(6 if (g < 3) == half(i) else 0, 0.3))) for i in range(24) for g in range(6)], "cell_id string, gene string, x double")
    labels = clusters.model_labels({"m1": grn(lambda i: i < 12), "m2": grn(lambda i: i < 12), "m3": grn(lambda i: i % 2 == 0)}, 5, 3).persist()
    assert labels.count() == 72 and labels.select("model", "label").distinct().count() == 6
    near = {(r.cell_id, r.nbr_id): r.dist for r in clusters.hamming_nearest(labels, 23).collect()}
    own = {}
    for r in labels.collect():
        own.setdefault(r.cell_id, {})[r.model] = r.label
    assert near == {(a, b): pytest.approx(sum(own[a][m] != own[b][m] for m in own[a]) / 3) for a in own for b in own if a != b}
    got = as_dict(clusters.consensus_communities(labels, 23, 0.5, closeness=True), "cell_id", "community")
    assert len({got[f"cell{i:02d}"] for i in range(12)}) == 1 and len(set(got.values())) == 2
