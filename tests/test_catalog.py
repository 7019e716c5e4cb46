"""Registered queries without SQL on the smallest table."""

from lattica.plans import catalog
from lattica.sources import views

SF = "/root/testdata/sf0.001"


def test_ensemble_network_has_all_genes(spark):
    genes = {r.gene for r in views.expr_counts(spark, SF).select("gene").distinct().collect()}
    pairs = catalog.ensemble_network(spark, SF).select("source", "target").distinct().collect()
    assert {(r.source, r.target) for r in pairs} == {(a, b) for a in genes for b in genes}
