"""Data model: a typed property graph whose every edge carries its provenance.

A graph is two tables. ``nodes(id, type, name, ...)`` and
``edges(edge_id, src, dst, rel, seq, source, source_tier, retrieved, status, method, supported_by, ...)``.
Evidence is kept as rows (``evidence(edge_id, seq, ...)``) and not as arrays on the edge, because one
edge may be supported by any number of source rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The node vocabulary, the relation vocabulary with its allowed end types, the
# provenance properties every edge must have, and the closed value sets.
NODE_TYPES = [
    "Disease", "Gene", "Variant", "Mechanism", "Phenotype", "Paper", "Claim", "Study",
    "PatientOrg", "Registry", "Researcher", "Intervention", "Outcome",
]
EDGE_TYPES = {
    "IN_GENE": (["Variant"], ["Gene"]),
    "DISRUPTS": (["Variant"], ["Mechanism"]),
    "ASSOCIATED_WITH": (["Disease"], ["Gene", "Variant"]),
    "HAS_PHENOTYPE": (["Disease"], ["Phenotype"]),
    "INVOLVES": (["Disease"], ["Mechanism"]),
    "CONTAINS": (["Paper"], ["Claim"]),
    "ABOUT": (["Claim"], ["Disease", "Gene", "Variant", "Mechanism", "Phenotype", "Researcher",
                          "Study", "Intervention", "Outcome"]),
    "AUTHORED": (["Researcher"], ["Paper"]),
    "STUDIES": (["Study"], ["Disease"]),
    "REPRESENTED_BY": (["Disease"], ["PatientOrg"]),
    "MAINTAINS": (["PatientOrg"], ["Registry"]),
}
REQUIRED_EDGE_PROPS = ["method", "rel", "retrieved", "source", "source_tier", "status"]
REQUIRED_CLAIM_PROPS = ["confidence", "model", "pmid", "prompt_version", "quote", "status"]
STATUSES = ["observation", "inference", "hypothesis"]
STRUCTURAL_RELATIONS = ["CONTAINS", "ABOUT"]
MECHANISMS = {
    "MECH:loss_of_function": "Loss of function",
    "MECH:gain_of_function": "Gain of function",
}
# Relation -> end types checked on extracted claims, and the relations a claim may turn into an edge.
CLAIM_ENDPOINTS = {
    "ASSOCIATED_WITH": (["Disease"], ["Gene", "Variant"]),
    "HAS_PHENOTYPE": (["Disease"], ["Phenotype"]),
    "IN_GENE": (["Variant"], ["Gene"]),
    "AUTHORED": (["Researcher"], ["Paper"]),
}
PROMOTABLE = ["ASSOCIATED_WITH", "HAS_PHENOTYPE", "IN_GENE"]
UNRESOLVED_VARIANT_OK = ["ASSOCIATED_WITH", "IN_GENE"]

# Evidence weights by status, source tier and method.
STATUS_WEIGHT = {"observation": 1.00, "inference": 0.80, "hypothesis": 0.50}
TIER_WEIGHT = {1: 1.00, 2: 0.90, 3: 0.65}
METHOD_WEIGHT = {"curated_import": 1.00, "computed": 0.95, "llm_extracted": 0.90}

# Pair scoring.
LINK_FLOOR = 1.0
PAIR_WEIGHTS = {"mechanism": 0.50, "gene": 0.20, "phenotype": 0.30}
DAMPING = 0.35
EVIDENCE_MIX = (0.60, 0.40)
MIN_SCORE = 20.0


@dataclass(frozen=True)
class EvidenceGraph:
    """Nodes and edges of one graph; both are ordinary DataFrames."""

    nodes: DataFrame
    edges: DataFrame

    def of_type(self, *types: str) -> DataFrame:
        return self.nodes.filter(F.col("type").isin(*types))

    def of_rel(self, *rels: str) -> DataFrame:
        return self.edges.filter(F.col("rel").isin(*rels))


def lookup(key: Column, values: dict, default=None) -> Column:
    """A small fixed mapping as a CASE expression (stays inside generated code, no join)."""
    out = None
    for k, v in values.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return out.otherwise(F.lit(default)) if default is not None else out


def endpoint_allowed(rel: Column, src_type: Column, dst_type: Column, table: dict = EDGE_TYPES) -> Column:
    """True where the relation permits this pair of node types."""
    ok = F.lit(False)
    for name, (left, right) in table.items():
        ok = ok | ((rel == F.lit(name)) & src_type.isin(*left) & dst_type.isin(*right))
    return F.coalesce(ok, F.lit(False))
