"""A small graph with planted errors: every rule finds exactly its own."""

import datetime

import pytest
from pyspark.sql import functions as F

from corrobora.model import EvidenceGraph
from corrobora.operators import rules as V

DAY = datetime.date(2026, 1, 1)
TEXTS = {"PMID:1": "Change one in X stops the channel entirely.", "PMID:2": "Change two in X opens the channel wide."}


@pytest.fixture(scope="module")
def world(spark):
    nodes = [(i, t) for t, ids in {
        "Disease": ["DA", "DB"], "Gene": ["GX"], "Variant": ["V1", "V2"], "Mechanism": ["ML", "MG"], "Phenotype": ["P"],
        "Paper": ["PMID:1", "PMID:2"], "Claim": ["C1", "C2", "CBAD"], "Widget": ["W"]}.items() for i in ids]
    claims = [("C1", "Change one in X stops", "PMID:1"), ("C2", "Change two in X opens", "PMID:2"), ("CBAD", "nowhere to be found", "PMID:1")]
    e = lambda s, d, rel, status="observation", tier=1, method="curated_import", sup=(), source="s": (
        f"{rel}:{s}->{d}:{status}", s, d, rel, source, tier, DAY, status, method, list(sup))
    edges = [
        e("V1", "GX", "IN_GENE"), e("V2", "GX", "IN_GENE"), e("DA", "GX", "ASSOCIATED_WITH"), e("DA", "P", "HAS_PHENOTYPE"),
        e("V1", "ML", "DISRUPTS", method="llm_extracted", tier=2, sup=["C1"]), e("V2", "MG", "DISRUPTS", method="llm_extracted", tier=2, sup=["C2"]),
        e("PMID:1", "CBAD", "CONTAINS", method="llm_extracted"), e("DA", "ML", "INVOLVES", "inference", 2, "computed", ["C1"]),
        e("DB", "ML", "INVOLVES", "inference", 3, "llm_extracted"), e("DB", "DA", "HAS_PHENOTYPE"), e("DB", "GX", "RELATES"),
        e("DB", "GX", "ASSOCIATED_WITH", "rumour"), e("DB", "P", "HAS_PHENOTYPE", source=None),
    ]
    graph = EvidenceGraph(
        spark.createDataFrame(nodes, "id string, type string").withColumn("name", F.col("id")),
        spark.createDataFrame(edges, "edge_id string, src string, dst string, rel string, source string, source_tier int, retrieved date, status string, method string, supported_by array<string>"))
    claims = spark.createDataFrame(claims, "id string, quote string, pmid string").selectExpr("*", "'observation' AS status", "0.9 AS confidence", "'m' AS model", "'v1' AS prompt_version")
    return graph, claims, spark.createDataFrame(list(TEXTS.items()), "source_id string, text string")


def test_schema_violations(world):
    graph, claims, _ = world
    got = {(r.what, r.id, r.reason) for r in V.schema_violations(graph, claims).collect()}
    assert got == {
        ("node", "W", "missing or unknown type"),
        ("edge", "HAS_PHENOTYPE:DB->DA:observation", "HAS_PHENOTYPE not allowed between Disease and Disease"),
        ("edge", "RELATES:DB->GX:observation", "unknown relation RELATES"), ("edge", "ASSOCIATED_WITH:DB->GX:rumour", "bad status rumour"),
        ("edge", "HAS_PHENOTYPE:DB->P:observation", "missing props source"),
    }


def test_claim_and_support_rules(world):
    graph, claims, sources = world
    assert [r.id for r in V.unverified_claims(claims, sources).collect()] == ["CBAD"]
    assert [r.id for r in V.unsupported_inferences(graph).collect()] == ["INVOLVES:DB->ML:inference"]
    assert [r.id for r in V.single_weak_source(graph.edges).collect()] == ["INVOLVES:DB->ML:inference"]
    split = {(r.gene, r.mechanisms, r.n_variants) for r in V.same_gene_different_mechanism(graph).collect()}
    assert split == {("GX", "ML", 1), ("GX", "MG", 1)}


def test_clean_graph(world):
    clean = V.clean_graph(*world)
    edges = {r.edge_id for r in clean.edges.collect()}
    assert not any("CBAD" in e or e.endswith("rumour") or e.startswith("RELATES") for e in edges) and len(edges) == 7
    assert "CBAD" not in {r.id for r in clean.nodes.collect()}


def test_clean_graph_with_repeated_and_missing_ids(world, spark):
    graph, claims, sources = world
    more = [("IN_GENE:V1->GX:observation", "V2", "V1", "IN_GENE"), (None, "DB", "DA", "HAS_PHENOTYPE"), (None, "PMID:1", "CBAD", "CONTAINS"),
            ("two types", "DA", "W2", "HAS_PHENOTYPE")]
    rows = [(i, s, d, r, "s", 1, DAY, "observation", "curated_import", []) for i, s, d, r in more]
    nodes = graph.nodes.unionByName(spark.createDataFrame([("W2", "Phenotype", "W2"), ("W2", "Widget", "W2")], "id string, type string, name string"))
    clean = V.clean_graph(EvidenceGraph(nodes, graph.edges.unionByName(spark.createDataFrame(rows, graph.edges.schema))), claims, sources)
    found = [(r.edge_id, r.src, r.dst) for r in clean.edges.collect()]
    assert clean.edges.columns == graph.edges.columns
    assert (None, "DB", "DA") in found and len(found) == 7  # the edge without an id stays, both of the repeated id go


def hash_exchanges(spark, make):
    """How often rows are laid out by a key when nothing is broadcast."""
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in plain}
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        return make()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_edges_are_laid_out_three_times_to_be_cleaned(world, spark):
    """By either end and by their id; ends, ids and cited claims take the other exchanges."""
    assert hash_exchanges(spark, lambda: V.clean_graph(*world).edges) <= 8


def test_profiles(world):
    graph, _, _ = world
    assert {r.key for r in V.absent_vocabulary(graph).filter("kind = 'node'").collect()} == {"Study", "PatientOrg", "Registry", "Researcher", "Intervention", "Outcome"}
    assert {r.rel: r.n_missing for r in V.missing_props_count(graph.edges).collect()}["HAS_PHENOTYPE"] == 1
