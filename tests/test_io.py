import json

from corrobora.model import EvidenceGraph
from corrobora.sources import ontology, sinks


def test_read_ontology_and_annotations(spark, tmp_path):
    doc = {"graphs": [{"nodes": [
        {"id": "http://x/obo/HP_1", "type": "CLASS", "lbl": "Root"}, {"id": "http://x/obo/HP_2", "type": "CLASS"},
        {"id": "http://x/obo/HP_3", "type": "CLASS", "lbl": "C", "meta": {"deprecated": True, "basicPropertyValues": [{"pred": "x#hasAlternativeId", "val": "HP:9"}]}}],
        "edges": [{"sub": "http://x/obo/HP_2", "pred": "is_a", "obj": "http://x/obo/HP_1"}, {"sub": "http://x/obo/HP_2", "pred": "is_a", "obj": "http://x/obo/GO_1"}]}]}
    (tmp_path / "hp.json").write_text(json.dumps(doc, indent=1))
    docs = ontology.read_obo(spark, str(tmp_path / "hp.json"))
    assert {r.id: r.label for r in ontology.term_names(ontology.obo_nodes(docs), "HP").collect()} == {"HP:1": "Root", "HP:2": "HP:2", "HP:3": "C"}
    assert [(r.child, r.parent) for r in ontology.term_parents(ontology.obo_edges(docs), "HP").collect()] == [("HP:2", "HP:1")]
    assert [(r.old, r.current) for r in ontology.term_alternatives(ontology.obo_nodes(docs), "HP").collect()] == [("HP:9", "HP:3")]
    cols = ontology.ANNOTATION_SCHEMA.replace(" STRING", "").replace(", ", "\t")
    (tmp_path / "a.tsv").write_text(f"# comment\n{cols}\nOMIM:1\tn\t\tHP:1\tr\tIEA\t\t\t\t\tP\tb\nOMIM:1\tn\tNOT\tHP:2\tr\tIEA\t\t\t\t\tP\tb\nOMIM:1\tn\t\tHP:3\tr\tIEA\t\t\t\t\tI\tb\n")
    rows = ontology.read_annotations(spark, str(tmp_path / "a.tsv")).collect()
    assert [(r.hpo_id, r.frequency) for r in rows] == [("HP:1", "")]


def test_graph_round_trip(spark, tmp_path):
    g = EvidenceGraph(spark.createDataFrame([("a", "Gene"), ("b", "Disease")], "id string, type string"), spark.createDataFrame([("b", "a", "ASSOCIATED_WITH")], "src string, dst string, rel string"))
    sinks.write_graph(g, str(tmp_path / "g"))
    back = sinks.read_graph(spark, str(tmp_path / "g"))
    assert back.nodes.count() == 2 and back.of_rel("ASSOCIATED_WITH").count() == 1


def test_export_is_compressed_and_reads_back_whole(spark, tmp_path):
    nodes = spark.range(500).selectExpr("concat('n', id) AS id", "'Gene' AS type", "'a name that repeats' AS name")
    edges = spark.range(400).selectExpr("concat('n', id) AS src", "concat('n', id + 1) AS dst", "'ABOUT' AS rel", "array('C1', 'C2') AS supported_by")
    sizes = {}
    for name, codec in (("packed", {}), ("plain", {"compression": "none"})):
        at = tmp_path / name
        sinks.write_export(EvidenceGraph(nodes, edges), str(at), "2026-01-01", **codec)
        assert sorted(spark.read.schema(nodes.schema).json(f"{at}/nodes").collect()) == sorted(nodes.collect())
        assert sorted(spark.read.schema(edges.schema).json(f"{at}/links").collect()) == sorted(edges.collect())
        assert [r.asDict() for r in spark.read.json(f"{at}/meta").select("nodes", "edges").collect()] == [{"nodes": 500, "edges": 400}]
        sizes[name] = sum(f.stat().st_size for part in ("nodes", "links") for f in (at / part).iterdir())
    assert 2 * sizes["packed"] < sizes["plain"]
