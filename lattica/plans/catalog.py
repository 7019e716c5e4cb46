"""Registered queries of the network operators and their SQL.

A query takes (spark, sf_dir). SQL runs on DuckDB over the same tables; operators that iterate, decompose matrices or train
have none and are tested by invariants.
"""

from __future__ import annotations

import tempfile
from dataclasses import asdict

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import special
from lattica.operators import annotate, clusters, edges, export, genes, masks, networks, stats
from lattica.sources import files, matrix
from lattica.sources import views as v
from lattica.sources.views import ctes
from lattica.streaming import counts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


R = lambda c, n=6: F.round(c, n)
_BASE = ctes("raw", "grn")
_EDGES = "edges AS (SELECT DISTINCT source, target, source || '_' || target AS edge_key FROM grn)"
_RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY w DESC, source || '_' || target) AS r FROM grn), " + _EDGES


def _n(te: float) -> str:
    return f"CAST(round_even((SELECT count(*) FROM edges) * {te}, 0) AS BIGINT)"


@query(f"{_BASE}, {_RANKED} SELECT e.edge_key, e.source, e.target, count(r.r) AS cell_count FROM edges e LEFT JOIN ranked r ON r.source = e.source AND r.target = e.target AND r.r <= {_n(0.1)} GROUP BY ALL")
def top_edges_global(spark, d):
    grn = v.grn(spark, d)
    return edges.annotate_global(grn, [0.1]).withColumnRenamed("global_cell_count_0.1", "cell_count")


@query(f"{_BASE}, {_RANKED} SELECT source, target, te, count(*) AS cell_count FROM ranked, (SELECT unnest([0.1, 0.2, 0.3]) AS te) WHERE r <= CAST(round_even((SELECT count(*) FROM edges) * te, 0) AS BIGINT) GROUP BY ALL".replace("[0.1, 0.2, 0.3]", "[0.1::DOUBLE, 0.2::DOUBLE, 0.3::DOUBLE]"))
def top_edges_multi(spark, d):
    return edges.top_edge_counts(v.grn(spark, d), [0.1, 0.2, 0.3])


@query(f"{_BASE}, {v.SQL['cells']}, {_RANKED} SELECT source, target, cluster, 0.1::DOUBLE AS te, count(*) AS cell_count FROM ranked JOIN cells USING (cell_id) WHERE r <= {_n(0.1)} GROUP BY ALL")
def top_edges_cluster(spark, d):
    return edges.top_edge_counts(v.grn(spark, d), [0.1], v.cells(spark, d))


@query(f"{_BASE}, {v.SQL['cells']}, {_RANKED}, c AS (SELECT e.edge_key, e.source, e.target, count(*) FILTER (cluster = 0) AS c0, count(*) FILTER (cluster = 1) AS c1 FROM edges e LEFT JOIN (SELECT * FROM ranked JOIN cells USING (cell_id) WHERE r <= {_n(0.1)}) t ON t.source = e.source AND t.target = e.target GROUP BY ALL), "
       "p AS (SELECT *, row_number() OVER (ORDER BY c0 DESC, c1 DESC, edge_key) AS a, row_number() OVER (ORDER BY c1 DESC, c0 DESC, edge_key) AS b FROM c) "
       "SELECT edge_key, source, target, c0, c1 FROM p WHERE least(a, b) <= greatest(1, CAST(floor((SELECT count(*) FROM edges) * 0.2) AS BIGINT))")  # fmt: skip
def filter_clusters(spark, d):
    grn = v.grn(spark, d)
    wide = edges.annotate_clusters(grn, [0.1], v.cells(spark, d)).withColumnsRenamed({"cell_count_0.1_0": "c0", "cell_count_0.1_1": "c1"})
    return edges.filter_clusters(wide, edges.edges_of(grn).count(), 0.2, "c0", "c1").select("edge_key", "source", "target", "c0", "c1")


@query(f"{_BASE}, p AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY w, source || '_' || target) - 1 AS p, count(*) OVER (PARTITION BY cell_id)::DOUBLE AS n FROM grn), "
       "b AS (SELECT *, len(list_filter(list_transform(range(1, 8), lambda k: floor(k::DOUBLE * (n / 7))), lambda e: e > p)) AS above FROM p) "
       "SELECT cell_id, source, target, CASE WHEN above = 0 THEN 0.0::DOUBLE ELSE (8 - above)::DOUBLE / 7 END AS part FROM b")  # fmt: skip
def quantile_partition(spark, d):
    grn = v.grn(spark, d).withColumn("k", edges.edge_key())
    return edges.quantile_partition(grn, ["cell_id"], "w", ["k"], 7).select("cell_id", "source", "target", "part")


@query(f"{_BASE}, {_RANKED}, top AS (SELECT DISTINCT source, target FROM ranked WHERE r <= {_n(0.05)}) SELECT cell_id, count(*) AS n, sum(w) AS w FROM grn SEMI JOIN top USING (source, target) GROUP BY cell_id")
def kept_edges(spark, d):
    grn = v.grn(spark, d)
    return edges.keep_edges(grn, edges.top_edge_counts(grn, [0.05])).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query(f"{_BASE}, {_EDGES}, {v.SQL['net']}, w AS (SELECT source, target, arg_max(weight, ord) AS weight FROM net GROUP BY ALL) SELECT e.*, coalesce(weight, 0.0) AS edge_in_net, e.target IN (SELECT target FROM net) AS is_target_net, e.source IN (SELECT source FROM net) AS is_source_net FROM edges e LEFT JOIN w ON w.source = e.source AND w.target = e.target")
def ext_grn_annotate(spark, d):
    return annotate.add_external(edges.edges_of(v.grn(spark, d)), v.ext_net(spark, d), "net")


@query(f"{_BASE}, {_EDGES}, {v.SQL['net']}, j AS (SELECT 'all__0' AS net, count(e.edge_key) AS hits, count(*) AS n FROM net LEFT JOIN edges e USING (source, target) UNION ALL SELECT 'heavy__1', count(e.edge_key), count(*) FROM (SELECT * FROM net WHERE weight > 3) LEFT JOIN edges e USING (source, target)) SELECT net, CASE WHEN n = 0 THEN 0.0 ELSE 100.0::DOUBLE * hits / n END AS percent FROM j")
def edge_overlap(spark, d):
    net = v.ext_net(spark, d)
    return annotate.edge_overlap(edges.edges_of(v.grn(spark, d)), [("all", net), ("heavy", net.filter("weight > 3"))])


@query(f"{_BASE}, {_EDGES} SELECT e.source, e.target, CASE WHEN p_size % 2 = 0 THEN 'Activation' WHEN p_size % 3 = 0 THEN 'Repression' ELSE 'Unknown' END AS mode, count(*) AS n FROM edges e JOIN part ON p_brand = e.source AND p_type = e.target WHERE p_size <= 5 GROUP BY ALL")
def curated_mode(spark, d):
    return annotate.curate(edges.edges_of(v.grn(spark, d)), v.moded_net(spark, d)).groupBy("source", "target", "mode").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_BASE} SELECT source AS gene FROM grn UNION SELECT target FROM grn")
def all_genes(spark, d):
    return edges.genes_of(edges.edges_of(v.grn(spark, d)))


@query(f"{ctes('rawx', 'expr', 'net')} SELECT DISTINCT gene FROM expr WHERE gene IN (SELECT source FROM net WHERE weight > 4)")
def tf_filter(spark, d):
    return edges.filter_names(v.expr_counts(spark, d).select("gene").distinct(), v.ext_net(spark, d).filter("weight > 4").select("source"))


_REG = ctes("loci", "crm") + ", hit AS (SELECT DISTINCT gene_name, tf FROM crm JOIN loci USING (chr) WHERE fin >= loci.start - 3600 AND crm.start <= loci.start + 3600)"


@query(f"{_REG} SELECT tf AS TF, gene_name AS gene, count(*) OVER (PARTITION BY gene_name) AS nTFs, tf || '_' || gene_name AS edge, true AS regulator FROM hit")
def regulators_window(spark, d):
    return annotate.regulators(v.crm(spark, d), v.loci(spark, d), 3600)


@query(f"{_REG}, e AS (SELECT DISTINCT event_type AS source, CAST(user_id AS VARCHAR) || '' AS u FROM events), t AS (SELECT source, gene_name AS target FROM e JOIN loci ON chr = u) SELECT DISTINCT source, target, EXISTS (SELECT 1 FROM hit WHERE tf = source AND gene_name = target) AS regulator_1h FROM t")
def regulators_annotate(spark, d):
    types = v.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("user_id").cast("string").alias("chr")).distinct()
    pairs = types.join(v.loci(spark, d), "chr").select("source", F.col("gene_name").alias("target")).distinct()
    return annotate.add_regulators(pairs, annotate.regulators(v.crm(spark, d), v.loci(spark, d), 3600), "1h")


_STRICT = ctes("rawx", "expr") + ", e AS (SELECT a.gene AS source, b.gene AS target FROM (SELECT DISTINCT gene FROM expr) a, (SELECT DISTINCT gene FROM expr) b)"


@query(f"{_STRICT}, m AS (SELECT a.gene AS source, b.gene AS target, count(*) AS n FROM expr a JOIN expr b USING (cell_id) WHERE a.x > 0 AND b.x > 0 AND a.gene <> b.gene GROUP BY ALL) SELECT e.source, e.target, coalesce(n, 0) AS count_nonzero FROM e LEFT JOIN m ON m.source = e.source AND m.target = e.target")
def mask_strict(spark, d):
    expr = v.expr_counts(spark, d)
    names = expr.select("gene").distinct()
    pairs = names.toDF("source").crossJoin(names.toDF("target"))
    return masks.add_mask(expr, pairs, strict=True)[1]


_KNN = """WITH x AS (SELECT vec_id AS cell_id, embedding::DOUBLE[] AS v FROM embeddings), dist AS (SELECT a.cell_id, b.cell_id AS nbr_id, list_distance(a.v, b.v) AS dist FROM x a JOIN x b ON a.cell_id <> b.cell_id),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, nbr_id) AS r FROM dist) WHERE r <= 10)"""


@query(f"{_KNN} SELECT cell_id, nbr_id, round(dist, 6) AS dist FROM k")
def knn(spark, d):
    return masks.nearest(v.expr_dense(spark, d), 10).withColumn("dist", R("dist"))


@query(f"{_KNN}, both_ways AS (SELECT cell_id, nbr_id FROM k UNION SELECT nbr_id, cell_id FROM k), g AS (SELECT cell_id AS nbr_id, unnest(range(0, len(v))) AS gene, unnest(v) AS x FROM x), n AS (SELECT b.cell_id, gene, count(*) AS n FROM both_ways b JOIN g USING (nbr_id) WHERE x > 0 GROUP BY ALL) SELECT gene::INTEGER AS gene, count(*) AS cells FROM n WHERE n >= 5 GROUP BY gene")
def knn_mask(spark, d):
    expr = v.expr_dense(spark, d)
    return masks.neighbourhood(expr, masks.nearest(expr, 10), 5).groupBy("gene").agg(F.count(F.lit(1)).alias("cells"))


def _models(spark, d):
    return v.grn(spark, d).withColumn("model_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(3)))).withColumn("w", F.col("w") * (F.col("model_id") + 1))


@query(f"{_BASE}, m AS (SELECT cell_id, source, target, w * (i + 1) AS w FROM grn, range(4) t(i)) SELECT cell_id, source, target, avg(w) AS mean_w, sum(w) AS sum_w, median(w) AS median_w FROM m GROUP BY ALL")
def ensemble_aggregate(spark, d):
    m, keys = _models(spark, d), ["cell_id", "source", "target"]
    mean, total, median = (stats.aggregate_models(m, how).withColumnRenamed("w", f"{how}_w") for how in ("mean", "sum", "median"))
    return mean.join(total, keys).join(median, keys)


@query(f"{_BASE} SELECT cell_id, source, target, l::INTEGER AS level, w * l * (l + 1) / 2 / l AS w FROM grn, (SELECT unnest([2, 4]) AS l)")
def ensemble_levels(spark, d):
    return stats.model_levels(_models(spark, d), [2, 4])


@query(f"{ctes('rawsq', 'sq')}, r AS (SELECT *, rank() OVER (PARTITION BY source, target ORDER BY w) + (count(*) OVER (PARTITION BY source, target, w) - 1) / 2.0::DOUBLE AS r FROM sq WHERE source <> target) SELECT a.source, a.target, round(corr(a.r, b.r), 6) AS rho FROM r a JOIN r b ON a.cell_id = b.cell_id AND a.source = b.target AND a.target = b.source GROUP BY ALL")
def spearman_pairs(spark, d):
    return stats.consistent_pairs(v.square_grn(spark, d)).withColumn("rho", R("rho"))


@query(f"{ctes('rawx', 'expr')} SELECT a.gene AS a, b.gene AS b, round(corr(a.x, b.x), 6) AS corr FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene < b.gene GROUP BY ALL")
def gene_corr(spark, d):
    return stats.gene_correlation(v.expr_counts(spark, d)).withColumn("corr", R("corr"))


_RANK = ctes("rawx", "expr", "cells") + """, o AS (SELECT cluster, gene, count(*)::DOUBLE AS n, sum(x) AS s, sum(x * x) AS q FROM expr JOIN cells USING (cell_id) GROUP BY ALL),
a AS (SELECT *, sum(n) OVER w - n AS n0, sum(s) OVER w - s AS s0, sum(q) OVER w - q AS q0 FROM o WINDOW w AS (PARTITION BY gene)),
t AS (SELECT *, sqrt(greatest((q - s * s / n) / (n - 1), 0) / n + greatest((q0 - s0 * s0 / n0) / (n0 - 1), 0) / n0) AS sd FROM a),
u AS (SELECT cluster, gene, CASE WHEN sd > 0 THEN (s / n - s0 / n0) / sd ELSE 0 END AS score FROM t),
ranks AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY round(score, 9) DESC, gene) AS rank FROM u)"""


@query(f"{_RANK} SELECT cluster, gene, round(score, 6) AS score, rank::INTEGER AS rank FROM ranks")
def rank_genes(spark, d):
    return stats.rank_genes(v.expr_counts(spark, d), v.cells(spark, d)).withColumn("score", R("score"))


_TARGETS = f"""{_RANK}, {v.SQL['rawsq']}, e AS (SELECT DISTINCT source, target FROM rawsq), sh AS (SELECT cluster, gene, abs(rank - (sum(rank) OVER w - rank)::DOUBLE / (count(*) OVER w - 1)) AS diff FROM ranks WINDOW w AS (PARTITION BY gene)),
dd AS (SELECT s.cluster, e.source, e.target, abs(t.diff - s.diff) AS distance FROM e JOIN sh s ON s.gene = e.source LEFT JOIN sh t ON t.gene = e.target AND t.cluster = s.cluster),
pp AS (SELECT *, row_number() OVER (PARTITION BY cluster, source ORDER BY round(distance, 9) NULLS LAST, target) AS pos FROM dd),
g AS (SELECT *, count(*) OVER (PARTITION BY cluster, source) AS size FROM pp WHERE pos <= 8)"""


@query(f"{_TARGETS} SELECT DISTINCT source, target FROM g WHERE size >= 3")
def top_targets(spark, d):
    expr, cells = v.expr_counts(spark, d), v.cells(spark, d)
    return stats.top_targets(edges.edges_of(v.square_grn(spark, d)).join(v._weights(spark, d, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))).select("source", "target").distinct(), ["source", "target"], "left_semi"), stats.rank_genes(expr, cells), 8, 3)[0]


_UCELL = f"""{ctes('rawx', 'expr', 'rawsq', 'cells')}, sig AS (SELECT DISTINCT source AS signature, target FROM rawsq), rk AS (SELECT cell_id, gene AS target, least(rank() OVER (PARTITION BY cell_id ORDER BY x DESC) + (count(*) OVER (PARTITION BY cell_id, x) - 1) / 2.0::DOUBLE, 1501.0::DOUBLE) AS r FROM expr),
sc AS (SELECT cell_id, signature, 1 - (sum(r) - count(*) * (count(*) + 1) / 2) / (count(*) * 1500.0::DOUBLE) AS score FROM rk JOIN sig USING (target) GROUP BY ALL)"""


def _scores(spark, d):
    return stats.ucell(v.expr_counts(spark, d), v._weights(spark, d, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string"))))


@query(f"{_UCELL} SELECT cell_id, signature, round(score, 8) AS score FROM sc")
def ucell(spark, d):
    return _scores(spark, d).withColumn("score", R("score", 8))


_STAT = "(rs - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12)"
_TEST = f"""{_UCELL}, q AS (SELECT *, rank() OVER (PARTITION BY signature ORDER BY round(score, 8)) + (count(*) OVER (PARTITION BY signature, round(score, 8)) - 1) / 2.0::DOUBLE AS r FROM sc JOIN cells USING (cell_id)),
o AS (SELECT cluster, signature, count(*)::DOUBLE AS n1, sum(r) AS rs, sum(round(score, 8)) AS sx FROM q GROUP BY ALL), o2 AS (SELECT *, sum(n1) OVER w AS n, sum(sx) OVER w AS tot FROM o WINDOW w AS (PARTITION BY signature)),
p AS (SELECT *, {_STAT} AS stat, 0.5 * {special.erfc_sql(f'({_STAT} / sqrt(2.0::DOUBLE))')} AS p FROM o2),
b AS (SELECT *, p * count(*) OVER (PARTITION BY cluster) / row_number() OVER (PARTITION BY cluster ORDER BY p, signature) AS adj FROM p),
f AS (SELECT *, least(1, min(adj) OVER (PARTITION BY cluster ORDER BY p, signature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM b)"""


@query(f"{_TEST} SELECT cluster, signature, round(stat, 6) AS stat, round(p, 6) AS p, round(p_adj, 6) AS p_adj, round(abs(sx / n1 - (tot - sx) / (n - n1)), 6) AS mean_diff, round((stat - avg(stat) OVER (PARTITION BY cluster)) / stddev_samp(stat) OVER (PARTITION BY cluster), 6) AS z_score FROM f")
def ranksum_bh(spark, d):
    scores = _scores(spark, d).withColumn("score", R("score", 8))
    out = stats.rank_sum(scores, v.cells(spark, d))
    return out.select("cluster", "signature", *[R(c).alias(c) for c in ("stat", "p", "p_adj", "mean_diff", "z_score")])


_TOP = f"""{_TEST}, z AS (SELECT cluster, signature, (stat - avg(stat) OVER (PARTITION BY cluster)) / stddev_samp(stat) OVER (PARTITION BY cluster) AS z FROM f),
o3 AS (SELECT signature, row_number() OVER (PARTITION BY cluster ORDER BY round(z, 9) DESC, signature) AS r FROM z), top AS (SELECT DISTINCT signature FROM o3 WHERE r <= 5)"""


@query(f"{_TOP} SELECT signature FROM top")
def top_signatures(spark, d):
    tests = stats.rank_sum(_scores(spark, d).withColumn("score", R("score", 8)), v.cells(spark, d))
    return stats.top_signatures(tests.withColumn("z_score", R("z_score", 9)), 5)


@query(f"{_TOP} SELECT cell_id, cluster, signature || '_regulon' AS regulon, round(score, 8) AS score FROM sc JOIN cells USING (cell_id) SEMI JOIN top USING (signature)")
def regulon_activity(spark, d):
    scores, cells = _scores(spark, d), v.cells(spark, d)
    tests = stats.rank_sum(scores.withColumn("score", R("score", 8)), cells)
    top = stats.top_signatures(tests.withColumn("z_score", R("z_score", 9)), 5)
    return stats.regulon_activity(scores, top, cells).withColumn("score", R("score", 8))


@query(f"{_UCELL} SELECT c.cell_id, cluster, round(score, 8) AS score FROM cells c LEFT JOIN sc ON sc.cell_id = c.cell_id WHERE signature = 'Brand#1'")
def merge_to_cells(spark, d):
    own = _scores(spark, d).filter("signature = 'Brand#1'").select("cell_id", R("score", 8).alias("score"))
    cells = v.cells(spark, d).join(own.select("cell_id"), "cell_id", "left_semi")
    return stats.merge_to_cells(cells.withColumn("score", F.lit(0.0)), own)


_MU = ctes("obs") + ", m AS (SELECT *, avg(y) OVER (PARTITION BY event_type) AS mu, 2.0::DOUBLE AS th, 0.25::DOUBLE AS pi FROM obs)"
_NB = "lgamma(th + 1e-10) + lgamma(y + 1) - lgamma(y + th + 1e-10) + (th + y) * ln(1 + mu / (th + 1e-10)) + y * (ln(th + 1e-10) - ln(mu + 1e-10))"


def _likelihood(spark, d, name, loss):
    from pyspark.sql import Window

    obs = v.count_obs(spark, d).withColumn("mu", F.avg("y").over(Window.partitionBy("event_type")))
    return obs.groupBy("event_type").agg(R(F.avg(loss(F.col("y"), F.col("mu")))).alias(name))


@query(f"{_MU} SELECT event_type, round(avg({_NB}), 6) AS nll FROM m GROUP BY event_type")
def nb_nll(spark, d):
    return _likelihood(spark, d, "nll", lambda y, mu: special.nb_nll(y, mu, F.lit(2.0)))


@query(f"{_MU}, z AS (SELECT event_type, th, pi, mu, CASE WHEN y < 5 THEN 0 ELSE y END AS y FROM m) SELECT event_type, round(avg(CASE WHEN y < 1e-10 THEN -ln(pi + (1 - pi) * pow(th / (th + mu + 1e-10), th) + 1e-10) ELSE {_NB} END), 6) AS nll FROM z GROUP BY event_type")
def zinb_nll(spark, d):
    return _likelihood(spark, d, "nll", lambda y, mu: special.zinb_nll(F.when(y < 5, 0.0).otherwise(y), mu, F.lit(2.0), F.lit(0.25)))


@query(f"{_MU} SELECT event_type, round(avg(pow(mu - y, 2)), 6) AS loss FROM m GROUP BY event_type")
def mse(spark, d):
    return _likelihood(spark, d, "loss", special.squared_error)


@query(f"{_MU} SELECT event_type, round(avg(ln(cosh(mu - y))), 6) AS loss FROM m GROUP BY event_type")
def log_cosh(spark, d):
    return _likelihood(spark, d, "loss", special.log_cosh)


@query("SELECT s_nationkey % 2 AS la, s_nationkey % 3 AS lb, count(*) AS n FROM supplier GROUP BY ALL")
def contingency(spark, d):
    s = v.table(spark, d, "supplier")
    return stats.contingency(s.select("s_suppkey", (F.col("s_nationkey") % 2)), s.select("s_suppkey", (F.col("s_nationkey") % 3)))


@query(f"{ctes('rawsq')}, e AS (SELECT DISTINCT source, target FROM rawsq), n AS (SELECT DISTINCT source FROM e) SELECT x.source AS a, y.source AS b, (SELECT count(*) FROM e i JOIN e j USING (target) WHERE i.source = x.source AND j.source = y.source) AS shared FROM n x, n y")
def shared_targets(spark, d):
    raw = v._weights(spark, d, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")))
    return stats.shared_targets(raw)


@query(f"{ctes('rawx', 'expr', 'cells')} SELECT cluster, gene, round(avg(x), 6) AS mean FROM expr JOIN cells USING (cell_id) GROUP BY ALL")
def group_means(spark, d):
    return stats.mean_by(v.expr_counts(spark, d).join(v.cells(spark, d), "cell_id"), "cluster").withColumn("mean", R("mean"))


@query(f"{ctes('rawx', 'expr')} SELECT gene, sum(x) AS total, min(x) AS low, max(x) AS high, count(*) AS n FROM expr GROUP BY gene")
def shuffle_columns(spark, d):
    out = stats.shuffle_columns(v.expr_counts(spark, d), 7)
    return out.groupBy("gene").agg(F.sum("x").alias("total"), F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))


@query(f"{ctes('rawsq')} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM rawsq WHERE source IN ('Brand#1', 'Brand#2') AND source <> target")
def regulon_graph(spark, d):
    raw = v._weights(spark, d, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")))
    return export.undirected(raw, ["Brand#1", "Brand#2"])[1]


@query()
def spectral_clusters(spark, d):
    expr = v.expr_dense(spark, d)
    near = masks.nearest(clusters.components(expr, 20).select("cell_id", F.posexplode("pc").alias("gene", "x")), 10)
    return clusters.spectral(near, 10)


@query("SELECT vec_id AS cell_id, CAST((CAST(label AS INTEGER) + 3) % 10 AS VARCHAR) AS label, CAST(label AS VARCHAR) AS remap FROM embeddings")
def unify_labels(spark, d):
    own = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string"))
    renamed = own.select("cell_id", ((F.col("label").cast("int") + 3) % 10).cast("string").alias("label"))
    return clusters.unify_labels(own, renamed)[0]


#: Average linkage one merge a step: distances of rows of 1 - corr, then the nearest two clusters by their mean distance.
_LINKS = """cr AS (SELECT a.gene AS a, b.gene AS b, corr(a.x, b.x) AS corr FROM expr a JOIN expr b USING (cell_id) GROUP BY ALL),
ds AS (SELECT x.a AS a, y.a AS b, sqrt(sum(pow(CASE WHEN x.a = x.b THEN 1 ELSE x.corr END - CASE WHEN y.a = y.b THEN 1 ELSE y.corr END, 2))) AS d FROM cr x JOIN cr y ON x.b = y.b GROUP BY ALL),
merges AS (SELECT 0 AS step, gene AS g, gene AS c, 0.0::DOUBLE AS h FROM (SELECT DISTINCT gene FROM expr)
    UNION ALL SELECT s.step + 1, s.g, CASE WHEN s.c = m.y THEN m.x ELSE s.c END, m.d FROM merges s,
        (SELECT x, y, d FROM (SELECT a.c AS x, b.c AS y, avg(ds.d) AS d FROM merges a JOIN merges b ON a.c < b.c JOIN ds ON ds.a = a.g AND ds.b = b.g GROUP BY ALL) ORDER BY round(d, 12), x, y LIMIT 1) m),
co AS (SELECT a.g AS a, b.g AS b, min(a.h) AS cophenet FROM merges a JOIN merges b ON a.step = b.step AND a.c = b.c AND a.g < b.g GROUP BY ALL),
pairs AS (SELECT co.a, co.b, cophenet, corr FROM co JOIN cr ON cr.a = co.a AND cr.b = co.b)"""
_RECURSIVE = ctes("rawx", "expr").replace("WITH ", "WITH RECURSIVE ", 1)
#: Cells by types of parts, a table of a few columns.
_TYPES = "WITH RECURSIVE rawx AS (SELECT l_suppkey AS cell_id, p_type AS gene, sum(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), " + v.SQL["expr"]


def _types(spark, d):
    raw = v.table(spark, d, "lineitem").join(v.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("cell_id"), F.col("p_type").alias("gene")).agg(F.sum("l_quantity").alias("x"))
    every = raw.select("cell_id").distinct().crossJoin(raw.select("gene").distinct())
    return every.join(raw, ["cell_id", "gene"], "left").fillna(0.0, ["x"])


@query(f"{_RECURSIVE}, {_LINKS} SELECT a, b, round(cophenet, 6) AS cophenet, round(corr, 6) AS corr FROM pairs")
def gene_linkage(spark, d):
    return genes.hierarchical(v.expr_counts(spark, d))[0].withColumns({"cophenet": R("cophenet"), "corr": R("corr")})


@query(f"{_RECURSIVE}, {_LINKS}, l AS (SELECT a.corr - (a.corr - b.corr) / (a.cophenet - b.cophenet) * a.cophenet AS i, (a.corr - b.corr) / (a.cophenet - b.cophenet) AS s FROM pairs a JOIN pairs b ON (a.a, a.b) < (b.a, b.b) AND a.cophenet <> b.cophenet), "
       "f AS (SELECT i, s, sum(CASE WHEN corr >= i + s * cophenet THEN 0.1::DOUBLE * (corr - i - s * cophenet) ELSE 0.9::DOUBLE * (i + s * cophenet - corr) END) AS loss FROM l, pairs GROUP BY i, s), best AS (SELECT arg_min(i, loss) AS i, arg_min(s, loss) AS s FROM f), "
       "last AS (SELECT g, arg_max(c, step) AS c FROM merges, best WHERE h <= (0.0 - i) / s GROUP BY g), n AS (SELECT c, row_number() OVER (ORDER BY min(g)) AS k FROM last GROUP BY c) SELECT g AS gene, k::INTEGER AS correlation_cluster FROM last JOIN n USING (c)")  # fmt: skip
def gene_clusters(spark, d):
    expr = v.expr_counts(spark, d)
    pairs, links, names = genes.hierarchical(expr)
    cutoff = genes.cutoff(pairs, float("inf"), 0.0)[0]
    return genes.add_clusters(expr.select("gene").distinct(), names, links, cutoff)


@query(f"{_TYPES}, {_LINKS} SELECT a, b, round(cophenet, 6) AS cophenet, round(corr, 6) AS corr FROM pairs")
def linkage_fixed(spark, d):
    return genes.hierarchical(_types(spark, d))[0].withColumns({"cophenet": R("cophenet"), "corr": R("corr")})


@query(f"{_TYPES}, {_LINKS}, mid AS (SELECT (max(h) + min(h) FILTER (h > 0)) / 2 AS h FROM merges), last AS (SELECT g, arg_max(c, step) AS c FROM merges, mid WHERE merges.h <= mid.h GROUP BY g), n AS (SELECT c, row_number() OVER (ORDER BY min(g)) AS k FROM last GROUP BY c) SELECT p_type AS gene, k::INTEGER AS correlation_cluster FROM (SELECT DISTINCT p_type FROM part) LEFT JOIN (last JOIN n USING (c)) ON g = p_type")
def clusters_fixed(spark, d):
    """Types cut half way between the first and the last merge."""
    _, links, names = genes.hierarchical(_types(spark, d))
    every = v.table(spark, d, "part").select(F.col("p_type").alias("gene")).distinct()
    return genes.add_clusters(every, names, links, (links[0, 2] + links[-1, 2]) / 2)


@query(f"{ctes('rawx', 'expr')}, p AS (SELECT gene, avg(x) AS cophenet, stddev_samp(x) AS corr FROM expr GROUP BY gene), l AS (SELECT a.corr - (a.corr - b.corr) / (a.cophenet - b.cophenet) * a.cophenet AS i, (a.corr - b.corr) / (a.cophenet - b.cophenet) AS s FROM p a JOIN p b ON a.gene < b.gene AND a.cophenet <> b.cophenet), "
       "f AS (SELECT i, s, sum(CASE WHEN corr >= i + s * cophenet THEN 0.1::DOUBLE * (corr - i - s * cophenet) ELSE 0.9::DOUBLE * (i + s * cophenet - corr) END) AS loss FROM l, p GROUP BY i, s), best AS (SELECT arg_min(i, loss) AS i, arg_min(s, loss) AS s FROM f) SELECT gene, round(i + s * cophenet, 5) AS line FROM p, best")  # fmt: skip
def quantile_line(spark, d):
    points = v.expr_counts(spark, d).groupBy("gene").agg(F.avg("x").alias("cophenet"), F.stddev_samp("x").alias("corr"))
    return genes.regression_points(points, float("inf"), 0.1).select("gene", R("line", 5).alias("line"))


@query(f"{ctes('rawx', 'expr')}, p AS (SELECT a.gene AS a, b.gene AS b, 1 - corr(a.x, b.x) AS cophenet FROM expr a JOIN expr b ON a.cell_id = b.cell_id AND a.gene < b.gene GROUP BY ALL) SELECT a, b, round(cophenet, 6) AS cophenet FROM p WHERE cophenet < 1.0")
def pairs_below(spark, d):
    pairs = stats.gene_correlation(v.expr_counts(spark, d)).select("a", "b", (1 - F.col("corr")).alias("cophenet"))
    return genes.below(pairs, 1.0).withColumn("cophenet", R("cophenet"))


@query(f"{ctes('rawx', 'expr')} SELECT gene, round(avg(x), 6) AS mean FROM expr GROUP BY gene")
def gene_means(spark, d):
    return stats.mean_by(v.expr_counts(spark, d)).withColumn("mean", R("mean"))


@query(f"{ctes('rawx', 'expr')} SELECT cell_id, gene, CAST(CAST(2 * x AS FLOAT) AS DOUBLE) AS counts, CAST(CAST(x / 3 AS FLOAT) AS DOUBLE) AS x FROM expr")
def layer_choice(spark, d):
    expr = v.expr_counts(spark, d).withColumn("counts", F.col("x") * 2).withColumn("x", F.col("x") / 3)
    of = lambda layer: files.choose_layer(expr, layer).select("cell_id", "gene", F.col("x").cast("double").alias("counts" if layer == "counts" else "x"))
    return of("counts").join(of("X"), ["cell_id", "gene"])


@query(f"{_BASE}, {v.SQL['cells']}, {_RANKED}, n AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE]) AS threshold) SELECT threshold, CAST(cluster AS VARCHAR) AS cluster, CAST(count(*) AS BIGINT) AS cell_count FROM ranked JOIN cells USING (cell_id), n WHERE r <= CAST(round_even((SELECT count(*) FROM edges) * threshold, 0) AS BIGINT) GROUP BY ALL")
def count_totals(spark, d):
    return edges.count_totals(edges.annotate_clusters(v.grn(spark, d), [0.1, 0.2], v.cells(spark, d)))


@query(f"{ctes('rawx', 'expr', 'net')}, g AS (SELECT gene, row_number() OVER (ORDER BY gene DESC) - 1 AS gene_idx FROM (SELECT DISTINCT gene FROM expr)) SELECT gene_idx::INTEGER AS gene_idx, gene FROM g WHERE gene IN (SELECT source FROM net WHERE weight > 4) ORDER BY gene_idx")
def tf_filter_ordered(spark, d):
    names = files.positions(v.expr_counts(spark, d).select("gene").distinct(), [F.col("gene").desc()], "gene_idx").withColumn("gene_idx", F.col("gene_idx").cast("int"))
    return edges.ordered_names(names, v.ext_net(spark, d).filter("weight > 4").select("source"))


@query(f"{_BASE} SELECT cell_id, source, target, w FROM grn")
def matrix_wrap(spark, d):
    grn = v.grn(spark, d)
    var = files.positions(edges.edges_of(grn).select("source", "target"), [F.col("source").asc(), F.col("target").asc()], "idx").select(F.col("idx").cast("int").alias("idx"), "source", "target")
    packed = grn.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source", "target", "w"))), lambda s: s["w"]).alias("v"))
    return matrix.checked(matrix.wrap(packed, var)).select("cell_id", "source", "target", "w")


@query(f"{_UCELL} SELECT c.cell_id, cluster, round(score, 8) AS score FROM cells c LEFT JOIN sc ON sc.cell_id = c.cell_id AND signature = (SELECT min(signature) FROM sc) WHERE c.cell_id IN (SELECT cell_id FROM sc)")
def drop_stale_columns(spark, d):
    scores = _scores(spark, d)
    first = scores.agg(F.min("signature").alias("signature"))
    own = scores.join(first, "signature", "left_semi").select("cell_id", R("score", 8).alias("score"))
    cells = v.cells(spark, d).join(own.select("cell_id"), "cell_id", "left_semi").withColumn("old_regulon", F.lit(1.0)).withColumn("score", F.lit(0.0))
    return stats.merge_to_cells(cells, own)


@query(f"{_BASE}, {_EDGES} SELECT e.source, e.target, length(e.target) % 3 AS correlation_cluster FROM edges e WHERE length(e.target) % 2 = 0")
def target_clusters(spark, d):
    own = edges.edges_of(v.grn(spark, d))
    clustered = own.select(F.col("target").alias("gene")).distinct().filter(F.length("gene") % 2 == 0).withColumn("correlation_cluster", (F.length("gene") % 3).cast("long"))
    return annotate.with_target_clusters(own.select("source", "target"), clustered).select("source", "target", "correlation_cluster")


@query(f"{_STRICT}, c AS (SELECT DISTINCT cell_id FROM expr), m AS (SELECT a.cell_id, a.gene AS source, b.gene AS target FROM expr a JOIN expr b USING (cell_id) WHERE a.x > 0 AND b.x > 0 AND a.gene <> b.gene), o AS (SELECT DISTINCT source, target FROM m), k AS (SELECT e.*, row_number() OVER (ORDER BY e.source, e.target) AS edge_idx FROM e) "
       "SELECT c.cell_id, k.edge_idx::INTEGER AS edge_idx, k.source, k.target, CASE WHEN m.cell_id IS NULL THEN 0 ELSE 1 END AS b FROM k SEMI JOIN o ON o.source = k.source AND o.target = k.target CROSS JOIN c LEFT JOIN m ON m.cell_id = c.cell_id AND m.source = k.source AND m.target = k.target")  # fmt: skip
def mask_frame(spark, d):
    return _mask_frame(spark, d)[0]


@query(f"{_STRICT}, m AS (SELECT DISTINCT a.gene AS source, b.gene AS target FROM expr a JOIN expr b USING (cell_id) WHERE a.x > 0 AND b.x > 0 AND a.gene <> b.gene) SELECT e.source, e.target FROM e ANTI JOIN m ON m.source = e.source AND m.target = e.target")
def mask_missing(spark, d):
    return _mask_frame(spark, d)[1].select("source", "target")


def _mask_frame(spark, d):
    expr = v.expr_counts(spark, d)
    names = expr.select("gene").distinct()
    pairs = names.toDF("source").crossJoin(names.toDF("target"))
    order = files.positions(pairs, [F.col("source").asc(), F.col("target").asc()], "edge_idx").withColumn("edge_idx", (F.col("edge_idx") + 1).cast("int"))
    return masks.mask_frame(masks.pair_mask(masks.binarize(expr)), expr.select("cell_id").distinct(), order)


@query(f"{_KNN}, both_ways AS (SELECT cell_id, nbr_id FROM k UNION SELECT nbr_id, cell_id FROM k), g AS (SELECT cell_id AS nbr_id, unnest(range(0, len(v))) AS gene, unnest(v) AS x FROM x), n AS (SELECT b.cell_id, gene FROM both_ways b JOIN g USING (nbr_id) WHERE x > 0 GROUP BY ALL HAVING count(*) >= 5) SELECT a.gene::INTEGER AS source, b.gene::INTEGER AS target, count(*) AS count_nonzero FROM n a JOIN n b ON a.cell_id = b.cell_id AND a.gene <> b.gene GROUP BY ALL")
def mask_neighbours(spark, d):
    """The mask that is not strict: a gene counts where five neighbours express it."""
    expr = v.expr_dense(spark, d)
    pairs = expr.select(F.col("gene").alias("source")).distinct().crossJoin(expr.select(F.col("gene").alias("target")).distinct()).filter("source <> target")
    return masks.add_mask(expr, pairs, False, 10, 5)[1].filter("count_nonzero > 0")


@query(f"{ctes('rawsq', 'sq', 'rawx', 'expr')}, m AS (SELECT a.cell_id, a.gene AS source, b.gene AS target FROM expr a JOIN expr b USING (cell_id) WHERE a.x > 0 AND b.x > 0 AND a.gene <> b.gene) SELECT source, target, sum(CASE WHEN m.cell_id IS NULL THEN 0.0 ELSE w END) AS w FROM sq LEFT JOIN m USING (cell_id, source, target) GROUP BY ALL")
def mask_applied(spark, d):
    mask = masks.pair_mask(masks.binarize(v.expr_counts(spark, d)))
    return masks.apply_mask(v.square_grn(spark, d), mask).groupBy("source", "target").agg(F.sum("w").alias("w"))


@query(f"{_BASE}, {_EDGES} SELECT DISTINCT e.source, e.target, CASE WHEN p_size % 2 = 0 THEN 'Activation' WHEN p_size % 3 = 0 THEN 'Repression' ELSE 'Unknown' END AS mode, CASE WHEN p_size % 2 = 0 THEN 'green' WHEN p_size % 3 = 0 THEN 'red' ELSE 'grey' END AS colour FROM edges e JOIN part ON p_brand = e.source AND p_type = e.target WHERE p_size <= 5 AND p_brand IN ('Brand#1', 'Brand#2', 'Brand#13')")
def curated_graph(spark, d):
    curated = annotate.curate(edges.edges_of(v.grn(spark, d)), v.moded_net(spark, d))
    return export.directed(curated, ["Brand#1", "Brand#2", "Brand#13"])[1]


@query(f"{ctes('rawsq')}, e AS (SELECT DISTINCT source, target FROM rawsq WHERE source IN ('Brand#1', 'Brand#2', 'Brand#3')), m AS (SELECT i.source AS a, j.source AS b, count(*) AS shared FROM e i JOIN e j USING (target) GROUP BY ALL), n AS (SELECT DISTINCT source AS a FROM e) "
       "SELECT n.a, " + ", ".join(f"coalesce(max(shared) FILTER (b = 'Brand#{i}'), 0) AS \"Brand#{i}\"" for i in (1, 2, 3)) + " FROM n LEFT JOIN m ON m.a = n.a GROUP BY n.a")  # fmt: skip
def shared_heatmap(spark, d):
    raw = v._weights(spark, d, F.concat(F.lit("Brand#"), (F.col("p_partkey") % 25 + 1).cast("string")))
    return export.heatmap(stats.shared_targets(raw, ["Brand#1", "Brand#2", "Brand#3"]))


def _line(kind: str, n: int, scale: float) -> networks.Model:
    """A model with weights that SQL can follow: one hidden unit adds up the cell, output j is (j + 1) times that, scaled."""
    model = networks.Model(n, 1, [1], kind)
    for name in model.p:
        model.p[name] = np.zeros_like(model.p[name]) if name[-1] == "b" else np.ones_like(model.p[name])
    model.p["e0w"] /= 1000
    for k, head in enumerate(model.heads):
        model.p[f"{head}1w"] *= scale * np.arange(1, n + 1) / (k + 1)
    return model


_LINE = ctes("rawx", "expr", "cells") + ", g AS (SELECT gene, row_number() OVER (ORDER BY gene) AS j FROM (SELECT DISTINCT gene FROM expr)), s AS (SELECT cell_id, sum(x) / 1000 AS s FROM expr GROUP BY cell_id)"


def _summary_sql(head: int, out: str) -> str:
    return f"{_LINE}, o AS (SELECT cluster, gene, j * s / {head} AS a FROM s JOIN cells USING (cell_id), g) SELECT cluster, gene, round(avg({out}), 6) AS mean FROM o GROUP BY ALL"


def _summary(spark, d, kind, head):
    expr = v.expr_counts(spark, d)
    n = expr.select("gene").distinct().count()
    return networks.summaries(_line(kind, n, 1.0), expr, head, v.cells(spark, d)).withColumn("mean", R("mean"))


@query(_summary_sql(1, "a"))
def autoencoder_summary(spark, d):
    return _summary(spark, d, "Autoencoder", "mu")


@query(_summary_sql(2, "CASE WHEN a > 30 THEN a ELSE ln(1 + exp(a)) END"))
def nb_autoencoder_summary(spark, d):
    return _summary(spark, d, "NegativeBinomialAutoencoder", "theta")


@query(_summary_sql(3, "CASE WHEN a > 30 THEN a ELSE ln(1 + exp(a)) END"))
def zinb_autoencoder_summary(spark, d):
    return _summary(spark, d, "ZINBAutoencoder", "pi")


def _attributed(spark, d, models, method, strategy="mean", **kw):
    expr = v.expr_counts(spark, d)
    n = expr.select("gene").distinct().count()
    out = networks.infer([_line("Autoencoder", n, m) for m in models], expr, method, strategy, **kw)
    return out.withColumn("w", R("w"))


@query(f"{_LINE} SELECT cell_id, e.gene AS source, g.gene AS target, round(j * x / 1000, 6) AS w FROM expr e JOIN s USING (cell_id), g")
def attribution_shap(spark, d):
    """Of a linear network a gradient times the distance from zero is the weight times the value."""
    return _attributed(spark, d, [1.0], "GradientShap")


@query(f"{_LINE} SELECT cell_id, e.gene AS source, g.gene AS target, round(j / 1000::DOUBLE, 6) AS w FROM expr e JOIN s USING (cell_id), g")
def attribution_guided(spark, d):
    return _attributed(spark, d, [1.0], "GuidedBackprop")


@query(f"{_LINE} SELECT cell_id, e.gene AS source, g.gene AS target, round(j * 2 / 1000::DOUBLE, 6) AS w FROM expr e JOIN s USING (cell_id), g")
def attribution_deconvolution(spark, d):
    """Mean over models of weights 1 and 3."""
    return _attributed(spark, d, [1.0, 3.0], "Deconvolution")


@query(f"{_LINE} SELECT cell_id, g.gene AS source, e.gene AS target, round(j * x * 4 / 1000, 6) AS w FROM expr e JOIN s USING (cell_id), g")
def attribution_summed(spark, d):
    """Models summed, with the ends of an edge swapped."""
    return _attributed(spark, d, [1.0, 3.0], "GradientShap", "sum", swap_labels=True)


@query("SELECT CAST(user_id AS VARCHAR) AS chr, event_id AS start, event_id + 5 AS 'end', event_type || ',x' AS TF_list, [event_type, 'x'] AS TF_list_list FROM events")
def bed_file(spark, d):
    e = v.table(spark, d, "events")
    rows = e.select(F.col("user_id").cast("string").alias("chr"), F.col("event_id").cast("long").alias("start"), (F.col("event_id") + 5).alias("end"), F.concat("event_type", F.lit(",x")).alias("TF_list"), F.lit(2).alias("n"), F.lit("+").alias("s"), F.lit(1).alias("a"), F.lit(1).alias("b"), F.lit("z").alias("c"))
    path = f"{files.scratch(spark)}/bed"
    rows.write.csv(path, sep="\t")
    return files.read_bed(spark, path).select("chr", "start", "end", "TF_list", "TF_list_list")


@query("SELECT 'chr' || CAST(user_id AS VARCHAR) AS chr, event_id AS start, 'g' || CAST(event_id AS VARCHAR) AS gene_name, event_type AS gene_biotype FROM events WHERE event_id % 3 = 0 AND event_id % 5 <> 0")
def gtf_genes(spark, d):
    e, q = v.table(spark, d, "events"), F.lit('"')
    name = F.when(F.col("event_id") % 5 != 0, F.concat(F.lit(' gene_name "g'), F.col("event_id").cast("string"), F.lit('";'))).otherwise(F.lit(""))
    attributes = F.concat(F.lit('gene_id "i";'), name, F.lit(' gene_biotype '), q, F.col("event_type"), q)
    rows = e.select(F.concat_ws("\t", F.col("user_id").cast("string"), F.lit("src"), F.when(F.col("event_id") % 3 == 0, "gene").otherwise("exon"), F.col("event_id").cast("string"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), attributes).alias("value"))
    path = f"{files.scratch(spark)}/gtf"
    rows.write.text(path)
    return files.gene_annotation(files.read_gtf(spark, path)).select("chr", "start", "gene_name", "gene_biotype")


@query("SELECT DISTINCT p_brand AS tfs FROM part")
def name_file(spark, d):
    path = f"{files.scratch(spark)}/names"
    v.table(spark, d, "part").select("p_brand").distinct().write.text(path)
    return files.read_names(spark, path)


@query("SELECT DISTINCT p_brand AS source, p_type AS target, 1.0::DOUBLE AS weight FROM part")
def edge_file(spark, d):
    path = f"{files.scratch(spark)}/edges"
    v.table(spark, d, "part").select(F.col("p_brand").alias("source"), F.col("p_type").alias("target")).distinct().write.csv(path, header=True, sep="\t")
    return files.read_edges(spark, path, "\t")


@query(f"{_BASE} SELECT cell_id, source, target, w FROM grn")
def table_file(spark, d):
    path = f"{files.scratch(spark)}/network"
    files.write_table(v.grn(spark, d), path)
    return files.read_table(spark, path)


@query("SELECT 'learning_rate' AS name, '0.25' AS value UNION ALL SELECT 'model', 'ZINBAutoencoder' UNION ALL SELECT 'n_models', '7' UNION ALL SELECT 'tf_only', 'False'")
def settings_file(spark, d):
    """Settings written as YAML and read again: those that differ from the defaults."""
    with tempfile.TemporaryDirectory() as folder:  # on the driver only
        files.Settings(learning_rate=0.25, model="ZINBAutoencoder", n_models=7, tf_only=False).write_yaml(f"{folder}/s.yaml")
        back = asdict(files.Settings.read_yaml(f"{folder}/s.yaml"))
    changed = [(k, str(x)) for k, x in back.items() if x != asdict(files.Settings())[k]]
    return spark.createDataFrame(changed, "name string, value string")


@query("SELECT CAST(label AS VARCHAR) AS label, count(*) AS cells FROM embeddings GROUP BY ALL")
def community_groups(spark, d):
    """Communities of a graph whose links never leave a label: one community each, named by its label."""
    own = v.table(spark, d, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("label"))
    from pyspark.sql import Window

    w = Window.partitionBy("label").orderBy("cell_id")
    near = own.select("cell_id", F.array(F.lead("cell_id", 1).over(w), F.lead("cell_id", 2).over(w), F.first("cell_id").over(w)).alias("near"))
    links = near.select("cell_id", F.explode("near").alias("nbr_id")).filter("nbr_id is not null and nbr_id <> cell_id")
    found = clusters.modularity_communities(links, 0.01).join(own, "cell_id")
    return found.groupBy("community", "label").agg(F.count(F.lit(1)).alias("cells")).select("label", "cells")


_LABELS = "l AS (SELECT s_suppkey AS cell_id, s_nationkey % 2 AS a, s_nationkey % 3 AS b, s_suppkey % 4 AS c, s_suppkey % 7 AS d FROM supplier)"


@query(f"WITH {_LABELS}, p AS (SELECT x.cell_id, y.cell_id AS nbr_id, ((x.a <> y.a)::INT + (x.b <> y.b)::INT + (x.c <> y.c)::INT + (x.d <> y.d)::INT) / 4.0::DOUBLE AS dist FROM l x JOIN l y ON x.cell_id <> y.cell_id) SELECT cell_id, nbr_id, dist FROM p QUALIFY row_number() OVER (PARTITION BY cell_id ORDER BY dist, nbr_id) <= 14")
def hamming_knn(spark, d):
    """Neighbours by the labels of four models."""
    s = v.table(spark, d, "supplier")
    models = {"a": F.col("s_nationkey") % 2, "b": F.col("s_nationkey") % 3, "c": F.col("s_suppkey") % 4, "d": F.col("s_suppkey") % 7}
    labels = F.array(*[F.struct(F.lit(m).alias("model"), x.cast("long").alias("label")) for m, x in models.items()])
    return clusters.hamming_nearest(s.select(F.col("s_suppkey").alias("cell_id"), F.inline(labels)))


@query()
def ensemble_network(spark, d):
    """Training and attribution over all genes: 3 models, their mean network."""
    expr = v.expr_counts(spark, d)
    models = networks.model_zoo(expr, n_models=3, epochs=30, hidden=16, latent=4, failures=1, lr=1e-3)
    return networks.infer(models, expr)


@query(f"{_BASE}, {_RANKED} SELECT source, target, count(*) AS cell_count FROM ranked WHERE r <= {_n(0.1)} GROUP BY ALL")
def row_local_top_edges(spark, d):
    """The streaming operator on a table: one packed row a cell."""
    grn = v.grn(spark, d)
    return counts.streaming_counts(counts.pack(grn), edges.top_n(edges.edges_of(grn).count(), 0.1))


#: Customers in five groups by nation; each links to four others of its group at places that look random, each twentieth also to the
#: next customer, of whatever group.
_PLANTED = """g AS (SELECT c_custkey AS cell_id, c_nationkey % 5 AS grp, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY c_custkey) - 1 AS r, count(*) OVER (PARTITION BY c_nationkey % 5) AS n FROM customer)"""


def _planted(spark, d):
    from pyspark.sql import Window

    group = Window.partitionBy("grp")
    own = v.table(spark, d, "customer").select(F.col("c_custkey").alias("cell_id"), (F.col("c_nationkey") % 5).alias("grp"))
    own = own.withColumn("r", F.row_number().over(group.orderBy("cell_id")) - 1).withColumn("n", F.count(F.lit(1)).over(group))
    steps = [F.pmod(F.col("r") * a + b, F.col("n")) for a, b in ((1, 1), (7, 1), (31, 3), (101, 7))]
    near = own.select("cell_id", "grp", F.explode(F.array(*steps)).alias("to")).join(own.select(F.col("cell_id").alias("nbr_id"), "grp", F.col("r").alias("to")), ["grp", "to"])
    across = own.filter("cell_id % 20 = 0").select("cell_id", (F.col("cell_id") + 1).alias("nbr_id")).join(own.select(F.col("cell_id").alias("nbr_id")), "nbr_id")
    return near.select("cell_id", "nbr_id").unionByName(across.select("cell_id", "nbr_id")).filter("cell_id <> nbr_id")


def _by_least(found, column):
    return found.join(found.groupBy(column).agg(F.min("cell_id").alias("first")), column).select("cell_id", "first")


@query(f"WITH {_PLANTED} SELECT cell_id, min(cell_id) OVER (PARTITION BY grp) AS first FROM g")
def planted_spectral(spark, d):
    """Spectral clusters of a graph of five groups, each named by its least cell."""
    return _by_least(clusters.spectral(_planted(spark, d), 5), "spectral")


@query(f"WITH {_PLANTED} SELECT cell_id, min(cell_id) OVER (PARTITION BY grp) AS first FROM g")
def planted_communities(spark, d):
    """Leiden communities of the same graph."""
    return _by_least(clusters.modularity_communities(_planted(spark, d), 0.5), "community")


_WIDE = "w AS (SELECT l_suppkey AS cell_id, p_brand || '_' || p_partkey AS gene, sum(l_quantity) AS x FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


@query(f"WITH RECURSIVE {_WIDE}, gram AS (SELECT a.cell_id AS i, b.cell_id AS j, sum(a.x * b.x) AS s FROM w a JOIN w b USING (gene) GROUP BY ALL), "
       "it AS (SELECT 0 AS step, cell_id AS i, 1.0::DOUBLE AS u FROM (SELECT DISTINCT cell_id FROM w) UNION ALL SELECT step + 1, i, y / sqrt(sum(y * y) OVER ()) FROM (SELECT any_value(step) AS step, gram.i, sum(s * u) AS y FROM gram JOIN it ON it.i = gram.j GROUP BY gram.i) WHERE step < 30), "
       "top AS (SELECT * FROM it WHERE step = 30), v AS (SELECT gram.i, sum(s * u) AS y FROM gram JOIN top ON top.i = gram.j GROUP BY gram.i) SELECT top.i AS cell_id, round(u * sqrt((SELECT sum(v.y * t.u) FROM v JOIN top t ON t.i = v.i)), 4) AS first, 10 AS width FROM top")  # fmt: skip
def network_components(spark, d):
    """Ten components of cells over a network as wide as there are parts, 20,000 edges at a tenth; SQL follows the first."""
    lines, parts = v.table(spark, d, "lineitem"), v.table(spark, d, "part")
    wide = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).groupBy(F.col("l_suppkey").alias("cell_id"), F.concat_ws("_", "p_brand", "p_partkey").alias("gene")).agg(F.sum("l_quantity").alias("x"))
    return clusters.components(wide, 10).select("cell_id", R(F.col("pc")[0], 4).alias("first"), F.size("pc").alias("width"))


@query()
def network_layout(spark, d):
    """Layout of cells by the neighbours of their components."""
    from lattica.operators import layout

    pc = clusters.components(v.expr_dense(spark, d), 20)
    return layout.umap(masks.nearest(pc.select("cell_id", F.posexplode("pc").alias("gene", "x")), 15))
