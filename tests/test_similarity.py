import math

import pytest

from corrobora.model import EvidenceGraph
from corrobora.operators import similarity as S
from corrobora.operators.cluster import cluster, modularity


def test_closure_is_reflexive_transitive_and_survives_a_cycle(spark):
    parents = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x")], "child string, parent string")
    got = {(r.term, r.ancestor) for r in S.ancestor_closure(parents).collect()}
    assert {("a", t) for t in "abcd"} <= got and ("d", "d") in got
    assert {("x", "y"), ("y", "x"), ("x", "x"), ("y", "y")} <= got
    assert len(got) == len(list(S.ancestor_closure(parents).collect()))


def test_information_content(spark):
    annotations = spark.createDataFrame([("e1", "a"), ("e2", "b"), ("e3", "z"), ("e4", "z")], "entity string, term string")
    closure = S.ancestor_closure(spark.createDataFrame([("a", "r"), ("b", "r")], "child string, parent string"))
    ic = {r.term: r.ic for r in S.information_content(annotations, closure).collect()}
    assert ic["r"] == pytest.approx(1.0) and ic["a"] == pytest.approx(2.0) and ic["z"] == pytest.approx(1.0)


FEATURES = [
    ("A", "mechanism", "M1", 0.81), ("B", "mechanism", "M1", 0.9), ("A", "gene", "G1", 1.0), ("B", "gene", "G1", 1.0),
    ("A", "phenotype", "P1", 1.0), ("B", "phenotype", "P1", 0.8), ("C", "gene", "G1", 1.0), ("C", "mechanism", "M2", 0.5),
    ("C", "phenotype", "P2", 1.0),
]


def test_pair_connection_by_hand(spark):
    features = spark.createDataFrame(FEATURES, "entity string, kind string, item string, support double")
    terms = spark.createDataFrame([("A", "t1", 2.0), ("B", "t1", 2.0), ("B", "t2", 2.0), ("C", "t3", 1.0)], "entity string, item string, weight double")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C")], "a string, b string")
    got = {(r.a, r.b): r for r in S.pair_connection(pairs, features, terms).collect()}
    ab, ac = got["A", "B"], got["A", "C"]
    mech, gene, pheno = 0.81 / 0.9, 1.0, 0.5 * 0.35  # shared rarity 1/2 is below the floor
    evidence = (math.sqrt(0.81 * 0.9) + 1.0 + 0.8) / 3
    raw = mech * 0.5 + gene * 0.2 + pheno * 0.3
    assert ab.score == pytest.approx(100 * raw * (0.6 + 0.4 * evidence))
    assert ab.connection_type == "mechanistic" and not ab.meaningful_phenotype_link
    assert ac.same_gene_different_mechanism and ac.connection_type == "same_gene_different_mechanism"
    assert ac.score == pytest.approx(100 * 1.0 * 1.0 * 0.35)


def test_all_connections_and_focus_agree(spark):
    features = spark.createDataFrame(FEATURES, "entity string, kind string, item string, support double")
    terms = spark.createDataFrame([("A", "t1", 2.0), ("B", "t1", 2.0)], "entity string, item string, weight double")
    all_pairs = {(r.a, r.b): r.score for r in S.all_connections(features, terms).collect()}
    focus = spark.createDataFrame([("A",)], "entity string")
    mine = {(r.a, r.b): r.score for r in S.connections_of(focus, features, terms).collect()}
    assert mine == {k: v for k, v in all_pairs.items() if "A" in k} and mine


@pytest.mark.parametrize("similarity,evidence,score", [(0.391, 0.979, 38.77)])
def test_published_score_formula(similarity, evidence, score):
    assert 100 * similarity * (0.6 + 0.4 * evidence) == pytest.approx(score, abs=0.05)


def test_evidence_score_scales_with_numeric_confidence_only(spark):
    edges = spark.createDataFrame(
        [("e1", "observation", 1, "curated_import", []), ("e2", "inference", 2, "llm_extracted", ["c1", "c2", "zz"]),
         ("e3", "inference", None, "computed", ["c2"]), ("e4", "odd", 1, "computed", [])],
        "edge_id string, status string, source_tier int, method string, supported_by array<string>")
    claims = spark.createDataFrame([("c1", "0.5"), ("c2", "n/a")], "id string, confidence string")
    got = {r.edge_id: r.evidence for r in S.edge_evidence_score(edges, claims).collect()}
    assert got["e1"] == 1.0 and got["e4"] == 0.0
    assert got["e2"] == pytest.approx(0.8 * 0.9 * 0.9 * 0.5) and got["e3"] == pytest.approx(0.8 * 0.65 * 0.95)


def test_features_of_paper_scoped_diseases(spark):
    nodes = spark.createDataFrame([("D1", "Disease", False), ("D2", "Disease", True), ("G", "Gene", None)], "id string, type string, paper_scoped boolean")
    edge = lambda i, s: (i, s, "G", "ASSOCIATED_WITH", "observation", 1, "curated_import", [])
    edges = spark.createDataFrame([edge("1", "D1"), edge("2", "D2")], "edge_id string, src string, dst string, rel string, status string, source_tier int, method string, supported_by array<string>")
    claims = spark.createDataFrame([], "id string, confidence string")
    g = EvidenceGraph(nodes, edges)
    assert {r.entity for r in S.feature_table(g, claims).collect()} == {"D1", "D2"}
    assert {r.entity for r in S.feature_table(g, claims, core_only=True).collect()} == {"D1"}


def test_clusters_two_cliques_and_isolated_nodes(spark):
    clique = lambda names: [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1:]]
    rows = clique(["a1", "a2", "a3", "a4"]) + clique(["b1", "b2", "b3"]) + [("a1", "b1", 0.1)]
    pairs = spark.createDataFrame(rows, "a string, b string, weight double")
    nodes = spark.createDataFrame([(n,) for n in ["a1", "a2", "a3", "a4", "b1", "b2", "b3", "lone"]], "id string")
    out = cluster(pairs, nodes)
    got = {r.id: r.cluster for r in out.collect()}
    assert len({got[f"a{i}"] for i in range(1, 5)}) == 1 and got["a1"] == 0
    assert len({got[f"b{i}"] for i in range(1, 4)}) == 1 and got["b1"] == 1 and got["lone"] == 2
    assert modularity(pairs, out) > 0.3
    assert got == {r.id: r.cluster for r in cluster(pairs, nodes).collect()}


def test_communities_use_all_matches_until_nothing_gains(spark, monkeypatch):
    from corrobora.plans import serving_queries

    scored = spark.createDataFrame([("d1", "d2", 21.0), ("d3", "d4", 50.0)], "a string, b string, score double")
    disease = spark.createDataFrame([(f"d{i}", False) for i in range(1, 5)], "id string, paper_scoped boolean")
    monkeypatch.setattr(serving_queries, "connections", lambda t, least: scored.where(f"score >= {least}"))
    got = {r.id: r.cluster for r in serving_queries._a17(type("T", (), {"disease": disease})).collect()}
    assert got["d1"] == got["d2"] != got["d3"] == got["d4"]
    with pytest.raises(RuntimeError):
        cluster(scored.withColumnRenamed("score", "weight"), disease, max_rounds=1)
