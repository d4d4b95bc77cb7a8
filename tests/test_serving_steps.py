"""Steps that the serving queries share: neighbourhoods, layers and pair cards."""

from __future__ import annotations

from collections import Counter

from corrobora.model import EvidenceGraph
from corrobora.operators import explore as Q
from corrobora.operators import serve


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def odd_graph(spark) -> EvidenceGraph:
    nodes = [("D1", "Disease"), ("D2", "Disease"), ("G1", "Gene"), ("G1", "Gene"), ("V1", "Variant"), ("P1", "Phenotype"), ("X", None), (None, "Gene")]
    ends = [("D1", "G1"), ("D1", "G1"), ("D2", "D2"), ("D1", "D2"), ("V1", "G1"), ("V1", "D1"), ("D1", "P1"), (None, "D1"), ("D1", None), ("D1", "X"), ("D1", "gone"), ("gone", "G1")]
    edges = [(f"e{i}", a, b, "R") for i, (a, b) in enumerate(ends)]
    return EvidenceGraph(spark.createDataFrame(nodes, "id string, type string"), spark.createDataFrame(edges, "edge_id string, src string, dst string, rel string"))


def expected(graph, focus, ok) -> Counter:
    edges, nodes = graph.edges.collect(), graph.nodes.collect()
    turned = [(e.src, e.dst, e.edge_id) for e in edges] + [(e.dst, e.src, e.edge_id) for e in edges]
    return Counter((a, b, n.type, i) for a, b, i in turned for n in nodes if a is not None and a in focus and b is not None and n.id == b and ok(n.type))


def test_neighbours_of_odd_rows(spark):
    graph = odd_graph(spark)
    focus = spark.createDataFrame([("D1",), ("D1",), ("D2",), ("V1",), ("gone",), (None,)], "id string")
    got = lambda **kw: Counter((r.id, r.nbr, r.nbr_type, r.edge_id) for r in Q.neighbours(graph, focus, **kw).collect())
    ids = {"D1", "D2", "V1", "gone"}
    assert got() == expected(graph, ids, lambda t: True)
    assert got(types=["Gene", "Disease"]) == expected(graph, ids, lambda t: t in ("Gene", "Disease"))
    assert got(without=Q.DETAIL_TYPES) == expected(graph, ids, lambda t: t is not None and t not in Q.DETAIL_TYPES)


def test_an_edge_travels_once_not_once_per_direction(spark):
    graph = odd_graph(spark)
    lines = plan_of(Q.neighbours(graph, graph.of_type("Disease"), ["Gene"])).splitlines()
    first = lambda word: next(i for i, line in enumerate(lines) if word in line)
    assert first("Generate") < first("Join")  # edges are turned after they have met both of their ends
    assert not any("Generate" in line for line in lines[first("Join"):])


def test_links_read_the_names_of_genes_only(spark):
    nodes = [("D1", "Disease", "d", False), ("G1", "Gene", "gene", False), ("G1", "Paper", "a title", False), ("GG1", "GeneGroup", "g", False)]
    edges = [("e1", "D1", "G1", "ASSOCIATED_WITH", None), ("e2", "G1", "GG1", "MEMBER_OF", None)]
    graph = EvidenceGraph(
        spark.createDataFrame(nodes, "id string, type string, name string, paper_scoped boolean"),
        spark.createDataFrame(edges, "edge_id string, src string, dst string, rel string, reason string"))
    assert [(r.hub, r.disease, r.via) for r in Q.hub_links(graph, "family").collect()] == [("GG1", "D1", "via gene")]


def test_links_of_other_diseases_go_before_they_are_joined(spark):
    nodes = [("D1", "Disease", False), ("D2", "Disease", True), ("I1", "Intervention", False)]
    edges = [("e1", "S1", "D1", "STUDIES"), ("e2", "S1", "D2", "STUDIES"), ("e3", "S1", "I1", "TESTS")]
    graph = EvidenceGraph(
        spark.createDataFrame([(*n, None) for n in nodes], "id string, type string, paper_scoped boolean, name string"),
        spark.createDataFrame([(*e, None) for e in edges], "edge_id string, src string, dst string, rel string, reason string"))
    found = Q.hub_links(graph, "treatments")
    assert [(r.hub, r.disease, r.via) for r in found.collect()] == [("I1", "D1", "trial S1")]
    joins = [line for line in plan_of(found).splitlines() if "Join" in line]
    assert "LeftSemi" not in joins[0]


def test_pair_cards_need_no_join(spark):
    rows = [("a", "b", "family", 0.5), ("a", "b", "trials", 0.75), ("a", "c", "trials", 0.5)]
    card = Q.pair_card(spark.createDataFrame(rows, "a string, b string, lens string, strength double"))
    got = {(r.a, r.b, r.lens): round(r.combined, 9) for r in card.collect()}
    both = round(1 - (1 - 0.85 * 0.5) * (1 - 0.85 * 0.75), 9)
    assert got == {("a", "b", "family"): both, ("a", "b", "trials"): both, ("a", "c", "trials"): round(0.425, 9)}
    assert "Join" not in plan_of(card)


def test_induced_edges_keep_their_columns(spark):
    graph = odd_graph(spark)
    visible = spark.createDataFrame([("D1",), ("G1",), ("G1",), (None,)], "id string")
    found = Q.induced_edges(graph.edges, visible)
    assert found.columns == graph.edges.columns
    assert sorted(r.edge_id for r in found.collect()) == ["e0", "e1"]


def test_assets_of_core_diseases_move_by_disease_once(spark):
    link = lambda *rows: spark.createDataFrame(list(rows), "src string, dst string")
    core = spark.createDataFrame([("D1",), ("D2",), (None,)], "entity string")
    given = (link(("D1", "G1"), ("D1", "G1"), ("D2", "G1"), ("D3", "G1"), (None, "G1")), link(("G1", "F"), ("G1", "F")), link(("S", "D1"), ("S", "D3")), link(("S", "I")),
             link(("R", "G1")), link(("P", "R")), link(("D1", "O"), ("D2", "O"), ("D2", None), ("D3", "O")))
    found = serve.disease_assets(*given, core)
    rows = sorted((r.entity, r.kind, r.item or "") for r in found.collect())
    assert rows == sorted([("D1", k, i) for k, i in (("gene_groups", "F"), ("studies", "S"), ("interventions", "I"), ("researchers", "P"), ("orgs", "O"))]
                          + [("D2", k, i) for k, i in (("gene_groups", "F"), ("researchers", "P"), ("orgs", "O"), ("orgs", ""))])
    # distinct assets are not made distinct again
    again = found.select("entity", "kind", "item").distinct()
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate")
    assert plan(again) == plan(found)
    twice = found.unionByName(found)
    assert [(r.a, r.b, r.shared_gene_groups, r.shared_studies, r.shared_researchers, r.shared_orgs) for r in serve.shared_asset_bridges(twice).collect()] == [("D1", "D2", 1, 0, 1, 1)]
