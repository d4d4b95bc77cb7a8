"""Operators that no query runs, on small tables."""

import hashlib
import json

import pytest

from corrobora.model import EvidenceGraph
from corrobora.operators import build, explore, resolve, rules, serve
from corrobora.sources import ontology, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_unknown_types_and_unresolved_mentions(spark):
    nodes = spark.createDataFrame([("a", "Gene"), ("b", "Planet"), ("c", None), ("MENTION:x", "Gene"), ("MENTION:y", "Gene")], "id string, type string")
    assert rows(build.unknown_types(nodes).fillna("-")) == [("b", "Planet"), ("c", "-")]
    assert rows(rules.unresolved_mentions(nodes)) == [("Gene", 2)]


def test_alias_candidates_and_problems(spark):
    index = spark.createDataFrame([("big heart", "M1"), ("big heart", "M2"), ("x", "M3")], "key string, id string")
    mentions = spark.createDataFrame([("Big-Heart",), ("none",)], "mention string")
    assert rows(resolve.alias_candidates(mentions, index)) == [("Big-Heart", "M1"), ("Big-Heart", "M2")]
    aliases = spark.createDataFrame([("a", "M1", "me"), ("b", " ", "me"), ("c", "M1", None)], "mention string, canonical_id string, reviewer string")
    assert [r[0] for r in rows(resolve.alias_problems(aliases))] == ["b", "c"]


def test_snapshot_hashes(spark, tmp_path):
    (tmp_path / "terms.json").write_bytes(b"some terms")
    found = resolve.snapshot_hashes(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert [r.sha256 for r in found] == [hashlib.sha256(b"some terms").hexdigest()]


def test_hub_lines(spark):
    links = spark.createDataFrame([("trials", "h1", "d1"), ("trials", "h1", "d2"), ("trials", "h2", "d1")], "lens string, hub string, disease string")
    visible = spark.createDataFrame([("h1",), ("d1",), ("d1",)], "id string")
    assert rows(explore.hub_lines(links, visible).select("hub", "disease")) == [("h1", "d1")]


def test_bridge_items_keep_ids_whole(spark):
    assets = spark.createDataFrame([("d1", "orgs", "ORGSET:x"), ("d2", "orgs", "ORGSET:x"), ("d2", "studies", "S1"), ("d3", "studies", "S1")], "entity string, kind string, item string")
    bridges = spark.createDataFrame([("d1", "d2"), ("d2", "d3"), ("d1", "d3")], "a string, b string")
    assert rows(serve.bridge_items(bridges, assets)) == [("d1", "d2", "orgs", "ORGSET:x"), ("d2", "d3", "studies", "S1")]


def test_type_counts(spark):
    nodes = spark.createDataFrame([("a", "Gene"), ("b", "Gene"), ("c", "Paper")], "id string, type string")
    edges = spark.createDataFrame([("a", "b", "IN_GENE")], "src string, dst string, rel string")
    totals = serve.type_counts(EvidenceGraph(nodes, edges))
    assert rows(totals.nodes) == [("Gene", 2), ("Paper", 1)] and rows(totals.edges) == [("IN_GENE", 1)]


def test_read_ontology_nodes(spark, tmp_path):
    nodes = [
        {"id": "http://x/MONDO_0000001", "type": "CLASS", "lbl": "one", "meta": {"xrefs": [{"val": "Orphanet:7"}], "synonyms": [{"pred": "hasExactSynonym", "val": "uno"}]}},
        {"id": "http://x/HP_1", "type": "CLASS", "lbl": "other"}, {"id": "http://x/MONDO_2", "type": "PROPERTY"},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"graphs": [{"nodes": nodes, "edges": []}]}, indent=1))
    found = ontology.read_ontology_nodes(spark, str(tmp_path / "o.json"), "MONDO").collect()
    assert [(r.id, r.label, r.synonyms, r.xrefs) for r in found] == [("MONDO:0000001", "one", ["uno"], ["ORPHA:7"])]


def test_write_similarity_matrix(spark, tmp_path):
    cells = spark.createDataFrame([("a", "a", 1.0), ("a", "b", 0.25), ("b", "a", 0.25), ("b", "b", 1.0), ("c", "a", 0.5)], "row string, col string, similarity double")
    sinks.write_similarity_matrix(cells, ["a", "b"], str(tmp_path / "m"))
    back = spark.read.option("header", True).csv(str(tmp_path / "m"))
    assert rows(back) == [("a", "1.0", "0.25"), ("b", "0.25", "1.0")]


@pytest.mark.parametrize("status", ["curated", None])
def test_papers_have_authors_and_sentences_in_order(spark, status):
    papers = spark.createDataFrame([("P1", "s1"), ("P2", "s2")], "id string, source_id string")
    claims = spark.createDataFrame([("P1", 2, "result", "approved", "m2", "v2"), ("P1", 1, "finding", status, "m1", "v1"), ("P1", 0, "authorship", None, "m0", "v0")],
                                   "paper string, seq int, category string, review_status string, model string, prompt_version string")
    authored = spark.createDataFrame([("P1", 2, "Bo"), ("P1", 1, "Zoe")], "paper string, seq int, name string")
    sentences = spark.createDataFrame([("s1", 10, "last"), ("s1", 9, "first")], "source_id string, idx int, text string")
    audits = spark.createDataFrame([("s1", "{}", "abstract")], "source_id string, summary_audit string, scope_note string")
    one, two = sorted(serve.normalise_papers(papers, claims, authored, sentences, audits).collect())
    assert tuple(one) == ("P1", 2, ["Zoe", "Bo"], "approved" if status else "auto_verified", "m1", "v1", ["first", "last"], "{}", "abstract")
    assert tuple(two) == ("P2", 0, [], "auto_verified", None, None, [], None, None)


def test_names_are_listed_after_nodes_were_spread(spark):
    """One file of nodes is one task: its names must not be made distinct there, and an index of them is no broadcast."""
    nodes = spark.createDataFrame(
        [("A", "Big Heart", ["x-1", None], ["OMIM:1"], False), ("A", "Big Heart", ["x-1"], None, None), ("B", "big  heart", None, ["OMIM:2"], False),
         ("C", "gone", ["x-2"], None, True), (None, "lost", None, None, False)],
        "id string, label string, synonyms array<string>, xrefs array<string>, deprecated boolean").coalesce(1)
    index = resolve.build_alias_index(nodes)
    assert sorted(map(tuple, index.collect()), key=str) == sorted(
        [("big heart", "A"), ("x 1", "A"), (None, "A"), ("omim 1", "A"), ("big heart", "B"), ("omim 2", "B"), ("lost", None)], key=str)
    plan = index._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("RepartitionByExpression")
    mentions = spark.createDataFrame([("BIG heart",), ("X 1",), ("gone",), ("lost",)], "mention string")
    found = resolve.resolve_alias(mentions, index)
    assert {(r.mention, r.n, r.id, r.status) for r in found.collect()} == {
        ("BIG heart", 2, None, "ambiguous"), ("X 1", 1, "A", "resolved"), ("gone", 0, None, "unresolved"), ("lost", 1, None, "resolved")}
    assert "rightHint=(strategy=merge)" in found._jdf.queryExecution().optimizedPlan().toString()
