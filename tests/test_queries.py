"""Whole-table comparison of registered queries with their SQL at the smallest scale."""

import oracle
import pytest

import __spark_entry__ as entry
from corrobora.plans import all_queries
from corrobora.plans.registry import ORACLES

SAMPLE = [
    "a01_ancestor_closure", "a03_ic_jaccard", "a05_edge_evidence_score", "a14_all_connections", "v01_schema_violations", "v03_unsupported_inferences",
    "r02_select_variants", "r04_rank_variants", "r06_select_trials", "n07_resolve_alias", "n13_resolve_genes", "n22_resolve_report_url", "t02_chunk_text",
    "t03_locate_span", "t07_screen_documents", "t10_validate_candidates", "t16_validate_bundle", "t20_import_claims", "t21_promote_claims", "s01_ontology_nodes",
    "s09_read_pubmed_xml", "s13_collapse_communities", "s15_extract_org_cards", "g02_add_edges", "g07_annotation_links", "k02_similarity_matrix",
    "e04_link_papers", "e08_shared_asset_bridges", "q05_mode_pairs_groups", "q12_reveal", "q21_funding_summary",
]


@pytest.fixture(scope="module")
def duck():
    return oracle.connect("0.001")


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, oracle.DATA.format("0.001"))
    problem, _ = oracle.compare(df, duck, entry.oracle_sql()[name])
    assert problem is None


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    queries, oracles = all_queries(), ORACLES
    assert set(queries) - set(oracles) == {"a17_cluster", "n18_suggest_candidates"}


def test_entry(spark):
    df = entry.entry(spark)
    assert {"a", "b", "score", "connection_type"} <= set(df.columns)
