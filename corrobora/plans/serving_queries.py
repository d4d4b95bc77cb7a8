"""Queries for clustering, the serving export and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.functions import text as X
from corrobora.model import EvidenceGraph
from corrobora.operators import explore as Q
from corrobora.operators import serve as E
from corrobora.operators import similarity as S
from corrobora.operators.cluster import cluster
from corrobora.operators.pairs import best_partners
from corrobora.operators.search import build_index, search_all
from corrobora.plans.registry import query
from corrobora.plans.similarity_queries import CONN_SQL, annotated, closed_terms, connections, scored_terms
from corrobora.session import cut_lineage

def today():
    return F.lit("2026-01-01").cast("date")


@query("a17_cluster")
def _a17(t):
    """Communities over all scored matches (20 and up), moved until modularity gains nothing."""
    pairs = connections(t, 20.0).select("a", "b", F.col("score").alias("weight"))
    return cluster(pairs, t.disease)


# ---------------------------------------------------------------- serving export


@query("e01_base_serving_graph", """
SELECT CASE rel WHEN 'HAS_PHENOTYPE' THEN 'HPO' WHEN 'IN_GENE' THEN 'ClinVar' WHEN 'ASSOCIATED_WITH' THEN CASE WHEN source_tier=1 THEN 'MONDO definition' ELSE 'team seed list (unverified)' END
 ELSE source END AS source_name, rel, count(*) AS n FROM edges GROUP BY ALL""")
def _e01(t):
    return E.base_serving_graph(t.edges).groupBy("source_name", "rel").agg(F.count(F.lit(1)).alias("n"))


@query("e02_match_edges_rich", CONN_SQL + """
, direct AS (SELECT a, b, string_agg(d||'='||coalesce(p.name,d), '; ' ORDER BY d) AS labels FROM (SELECT a, b, unnest(string_split(shared_p, ',')) AS d FROM conn WHERE shared_p IS NOT NULL AND round(score,2)>=20) q
  LEFT JOIN phenotype p ON p.id=d GROUP BY a,b)
SELECT 'DISEASE_MATCH:'||c.a||':'||c.b AS edge_id, c.a AS src, c.b AS dst, CASE connection_type WHEN 'mechanistic_and_phenotypic' THEN 'Shared mechanism and symptoms' WHEN 'mechanistic' THEN 'Shared mechanism' WHEN 'genetic_overlap' THEN 'Shared gene'
 WHEN 'phenotypic_neighbor' THEN 'Similar symptoms' WHEN 'same_gene_different_mechanism' THEN 'Same gene, different mechanism' ELSE 'No supported route' END AS connection_label,
 coalesce(d.labels,'') AS shared_phenotypes, round(mechanism,3) AS mechanism, round(genetic,3) AS genetic, round(pheno,3) AS phenotype, round(ev,3) AS evidence_quality
FROM conn c LEFT JOIN direct d ON d.a=c.a AND d.b=c.b WHERE round(score,2)>=20""")
def _e02(t):
    found = annotated(t)
    rich = E.match_edges_rich(found, today())
    named = F.array_join(F.transform("shared_phenotypes", lambda p: F.concat_ws("=", p["id"], p["name"])), "; ")
    return rich.select("edge_id", "src", "dst", "connection_label", named.alias("shared_phenotypes"), "components.*", "evidence_quality")


def _bundle(t):
    papers = t.table("documents").selectExpr("concat('PMID:', doc_id) AS source_id", "concat('paper ', doc_id) AS title", "2 AS source_tier", "doc_id % 2 = 0 AS approved")
    claims = t.claim.select("id", F.col("pmid").alias("source_id"), F.col("pos").alias("seq"), F.col("id").alias("statement"), "category", "polarity")
    entities = t.claim.select(F.col("id").alias("claim_id"), F.col("pos").alias("seq"), F.when(F.col("pos") % 4 == 0, "Intervention").when(F.col("object").startswith("P"), "Phenotype").otherwise("Gene").alias("kind"),
                              F.concat(F.lit("Mention "), "object").alias("mention"), F.col("object").alias("canonical_id"))
    nodes = t.gene.select("id", "type", F.lit(None).cast("string").alias("source_id")).unionByName(
        t.table("labels").filter("quality = 0").selectExpr("concat('PAPER:', doc_id) AS id", "'Paper' AS type", "concat('PMID:', doc_id) AS source_id"))
    return EvidenceGraph(nodes, t.edges), papers, claims, entities


PAPERS = """
, np AS (SELECT doc_id FROM documents WHERE doc_id%2=0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality=0)), c AS (SELECT * FROM claim WHERE doc_id IN (SELECT doc_id FROM np)),
sc AS (SELECT *, CASE WHEN pos%4=0 THEN 'INT:mention '||lower(object) WHEN object[1]='P' OR object IN (SELECT id FROM gene) THEN object END AS target FROM c WHERE category<>'authorship')"""


@query("e03_paper_layer", PAPERS + """
SELECT 'AUTHORED' AS rel, 'RES:'||pmid||':'||pos AS src, pmid AS dst, 'observation' AS status FROM c WHERE category='authorship' UNION ALL SELECT 'CONTAINS', pmid, id, 'observation' FROM sc
UNION ALL SELECT 'ABOUT', id, target, CASE WHEN polarity='affirmed' THEN 'observation' ELSE 'hypothesis' END FROM sc WHERE target IS NOT NULL""")
def _e03(t):
    return E.paper_layer(*_bundle(t), include_pending=False).edges.select("rel", "src", "dst", "status")


@query("e04_link_papers", """
, ab AS (SELECT pmid AS paper, pos, dst FROM about a JOIN claim c ON c.id=a.src WHERE pos<>2),
r AS (SELECT paper, a.src AS disease, 0 AS p, pos AS s, 'paper discusses '||g.name||', the gene of this disease' AS why FROM ab JOIN gene g ON g.id=ab.dst JOIN associated_with a ON a.dst=ab.dst WHERE a.src IN (SELECT id FROM core)
 UNION ALL SELECT paper, dst, 0, pos, 'paper claims name this disease' FROM ab WHERE dst IN (SELECT id FROM core)
 UNION ALL SELECT 'PMID:'||doc_id, 'D'||(doc_id*3), 1, 0, 'title names “condition '||(doc_id*3)||'.”' FROM documents WHERE 'D'||(doc_id*3) IN (SELECT id FROM core))
SELECT paper AS src, disease AS dst, arg_min(why, (p, s, why)) AS link_reason FROM r GROUP BY ALL""")
def _e04(t):
    papers = t.table("documents").selectExpr("concat('PMID:', doc_id) AS id", "concat('On Condition ', doc_id * 3, '. A report') AS name")
    about = t.about.join(t.claim.select(F.col("id").alias("src"), "pmid", "pos"), "src").filter("pos <> 2").select(F.col("pmid").alias("paper"), F.col("pos").alias("seq"), "dst")
    core = Q.core_entities(t.disease)
    genes = t.associated_with.select(F.col("src").alias("disease"), F.col("dst").alias("gene")).join(core.select(F.col("id").alias("disease")), "disease", "left_semi")
    diseases = core.selectExpr("id", "concat('condition ', num, '.') AS name", "array('x', 'DS') AS synonyms")
    return E.link_papers(papers, about, t.nodes, genes, diseases).select("src", "dst", "link_reason")


@query("e05_drop_partial_papers", """
, h AS (SELECT pmid, count(*) FILTER (category<>'authorship') AS have FROM claim WHERE pos<=5 GROUP BY pmid), f AS (SELECT pmid, count(*) FILTER (category<>'authorship') AS n FROM claim GROUP BY pmid),
bad AS (SELECT p.id FROM paper p JOIN f ON f.pmid=p.id LEFT JOIN h ON h.pmid=p.id WHERE coalesce(have,0)<n), dc AS (SELECT id FROM claim WHERE pos<=5 AND pmid IN (SELECT id FROM bad))
SELECT id FROM paper WHERE id NOT IN (SELECT id FROM bad) UNION ALL SELECT id FROM claim WHERE pos<=5 AND id NOT IN (SELECT id FROM dc)
UNION ALL SELECT 'RES:'||id FROM paper WHERE id NOT IN (SELECT id FROM bad)""")
def _e05(t):
    claims = t.claim.filter("pos <= 5")
    none = F.lit(None).cast("string")
    nodes = t.paper.select("id", "type", F.col("id").alias("source_id"), none.alias("category"), "paper_scoped").unionByName(
        claims.select("id", "type", none.alias("source_id"), "category", F.lit(False).alias("paper_scoped"))).unionByName(
        t.paper.select(F.concat(F.lit("RES:"), "id").alias("id"), F.lit("Researcher").alias("type"), none.alias("source_id"), none.alias("category"), F.lit(True).alias("paper_scoped")))
    edges = claims.select(F.col("pmid").alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("rel")).unionByName(
        t.paper.select(F.concat(F.lit("RES:"), "id").alias("src"), F.col("id").alias("dst"), F.lit("AUTHORED").alias("rel")))
    full = t.claim.filter("category <> 'authorship'").groupBy(F.col("pmid").alias("source_id")).agg(F.count(F.lit(1)).alias("n_claims"))
    return E.drop_partial_papers(EvidenceGraph(nodes, edges), full).nodes.select("id")


@query("e06_normalise_papers", """
, au AS (SELECT pmid, string_agg(id, ';' ORDER BY pos) AS authors FROM claim WHERE category='authorship' GROUP BY pmid),
se AS (SELECT 'PMID:'||conv_id AS id, md5(string_agg(text, ' | ' ORDER BY turn)) AS summary FROM conversations GROUP BY conv_id)
SELECT p.id, count(c.id) FILTER (c.category<>'authorship') AS claim_count, coalesce(any_value(au.authors), '') AS authors,
 CASE WHEN bool_and(c.polarity='affirmed') FILTER (c.category<>'authorship') THEN 'approved' ELSE 'auto_verified' END AS review_status,
 arg_min('m'||c.pos%3, c.pos) FILTER (c.category<>'authorship') AS model, arg_min('v'||c.pos%2, c.pos) FILTER (c.category<>'authorship') AS prompt_version,
 coalesce(any_value(se.summary), md5('')) AS summary, any_value('quality '||l.quality) AS summary_audit, any_value(CASE WHEN l.toxic=1 THEN 'abstract only' END) AS scope_note
FROM paper p LEFT JOIN claim c ON c.pmid=p.id LEFT JOIN labels l ON 'PMID:'||l.doc_id=p.id LEFT JOIN au ON au.pmid=p.id LEFT JOIN se ON se.id=p.id GROUP BY p.id""")
def _e06(t):
    claims = t.claim.select(
        F.col("pmid").alias("paper"), F.col("pos").alias("seq"), "category", F.when(F.col("polarity") == "affirmed", "approved").alias("review_status"),
        F.concat(F.lit("m"), (F.col("pos") % 3).cast("string")).alias("model"), F.concat(F.lit("v"), (F.col("pos") % 2).cast("string")).alias("prompt_version"))
    authored = t.claim.filter("category = 'authorship'").select(F.col("pmid").alias("paper"), F.col("pos").alias("seq"), F.col("id").alias("name"))
    sentences = t.table("conversations").selectExpr("concat('PMID:', conv_id) AS source_id", "turn AS idx", "text")
    audits = t.table("labels").selectExpr("concat('PMID:', doc_id) AS source_id", "concat('quality ', quality) AS summary_audit", "CASE WHEN toxic = 1 THEN 'abstract only' END AS scope_note")
    found = E.normalise_papers(t.paper.withColumn("source_id", F.col("id")), claims, authored, sentences, audits)
    return found.select("id", "claim_count", F.array_join("authors", ";").alias("authors"), "review_status", "model", "prompt_version",
                        F.md5(F.array_join("summary_sentences", " | ")).alias("summary"), "summary_audit", "scope_note")


@query("e06_drop_authorship", """
SELECT 'node' AS what, id FROM paper UNION ALL SELECT 'node', id FROM claim WHERE category<>'authorship'
UNION ALL SELECT 'edge', edge_id FROM edges WHERE rel='CONTAINS' AND dst NOT IN (SELECT id FROM claim WHERE category='authorship')
UNION ALL SELECT 'edge', edge_id FROM edges WHERE rel='ABOUT' AND src NOT IN (SELECT id FROM claim WHERE category='authorship')""")
def _e06b(t):
    nodes = t.paper.select("id", "type", F.lit(None).cast("string").alias("category")).unionByName(t.claim.select("id", "type", "category"))
    left = E.drop_authorship_claims(EvidenceGraph(nodes, t.contains.unionByName(t.about)))
    return left.nodes.select(F.lit("node").alias("what"), "id").unionByName(left.edges.select(F.lit("edge").alias("what"), F.col("edge_id").alias("id")))


@query("e07_merge_enrichment", """
SELECT 'node' AS what, id AS a, CASE WHEN paper_scoped THEN 'enriched' ELSE name END AS b FROM disease UNION ALL SELECT 'node', 'S'||s_suppkey, 'enriched' FROM supplier
UNION ALL SELECT 'edge', 'STUDIES:'||s_suppkey, 'D'||s_suppkey FROM supplier WHERE 'D'||s_suppkey IN (SELECT id FROM disease) UNION ALL SELECT 'edge', edge_id, dst FROM associated_with""")
def _e07(t):
    base = EvidenceGraph(t.disease.select("id", "type", F.when(~F.col("paper_scoped"), F.col("name")).alias("name")), t.associated_with.select("edge_id", "src", "dst", "rel"))
    new = t.disease.select("id", "type").unionByName(t.table("supplier").selectExpr("concat('S', s_suppkey) AS id", "'Study' AS type")).withColumn("name", F.lit("enriched"))
    edges = t.table("supplier").selectExpr("concat('STUDIES:', s_suppkey) AS edge_id", "concat('S', s_suppkey) AS src", "explode(array(concat('D', s_suppkey), concat('X', s_suppkey))) AS dst", "'STUDIES' AS rel")
    edges = edges.filter("dst LIKE 'D%'").unionByName(edges.filter("dst LIKE 'X%'").withColumn("edge_id", F.concat("edge_id", F.lit("x"))))
    g = E.merge_enrichment(base, new, edges)
    return g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("name").alias("b")).unionByName(g.edges.select(F.lit("edge").alias("what"), F.col("edge_id").alias("a"), F.col("dst").alias("b")))


def assets(t):
    core = t.disease.filter("NOT paper_scoped").select(F.col("id").alias("entity"))
    res = t.grant.select(F.col("id").alias("src"), F.col("gene").alias("dst"))
    leads = t.grant.select(F.col("researcher").alias("src"), F.col("id").alias("dst"))
    return E.disease_assets(t.associated_with, t.member_of, t.studies, t.tests, res, leads, t.represented_by, core)


ASSETS = """
, assets AS (SELECT DISTINCT entity, kind, item FROM (
 SELECT a.src AS entity, 'gene_groups' AS kind, m.dst AS item FROM associated_with a JOIN member_of m ON m.src=a.dst UNION ALL SELECT dst, 'studies', src FROM studies
 UNION ALL SELECT s.dst, 'interventions', t.dst FROM studies s JOIN tests t ON t.src=s.src UNION ALL SELECT a.src, 'researchers', g.researcher FROM associated_with a JOIN grants g ON g.gene=a.dst
 UNION ALL SELECT src, 'orgs', dst FROM represented_by) WHERE entity IN (SELECT id FROM core)),
br AS (SELECT x.entity AS a, y.entity AS b, count(*) FILTER (x.kind='gene_groups') AS shared_gene_groups, count(*) FILTER (x.kind='studies') AS shared_studies, count(*) FILTER (x.kind='interventions') AS shared_interventions,
 count(*) FILTER (x.kind='researchers') AS shared_researchers, count(*) FILTER (x.kind='orgs') AS shared_orgs FROM assets x JOIN assets y ON x.kind=y.kind AND x.item=y.item AND x.entity<y.entity GROUP BY ALL)
"""


@query("e08_shared_asset_bridges", ASSETS + f"""
SELECT *, CASE WHEN shared_gene_groups>0 THEN 'Same gene family' WHEN shared_studies>0 THEN 'Studied in the same trial' WHEN shared_interventions>0 THEN 'Same drug tested'
 WHEN shared_researchers>0 THEN 'Shared NIH-funded researcher' ELSE 'Same patient organisation' END AS connection_label FROM br""")
def _e08(t):
    return E.shared_asset_bridges(assets(t))


@query("e08_best_bridges", ASSETS + """
, n AS (SELECT a, b, shared_gene_groups+shared_studies+shared_interventions+shared_researchers+shared_orgs AS n FROM br),
both_ways AS (SELECT a AS entity, b AS partner, n FROM n UNION ALL SELECT b, a, n FROM n)
SELECT entity, partner, n AS n_shared, CAST(row_number() OVER (PARTITION BY entity ORDER BY n DESC, partner) AS INTEGER) AS rank FROM both_ways QUALIFY rank<=5""")
def _e08b(t):
    """The five diseases each one shares most assets with: linear in the diseases."""
    items = assets(t).select("entity", F.concat_ws(":", "kind", "item").alias("item"), F.lit(1.0).alias("weight")).distinct()
    return best_partners(cut_lineage(items), 5).select("entity", "partner", "n_shared", "rank")


@query("e09_variant_counts", "SELECT gene, CASE WHEN num%4=0 THEN 'Unknown' ELSE classification END AS classification, count(*) AS n FROM variant GROUP BY ALL")
def _e09(t):
    return E.variant_counts(t.in_gene, t.variant.withColumn("classification", F.when(F.col("num") % 4 == 0, "").otherwise(F.col("classification"))))


# ---------------------------------------------------------------- neighbourhoods

SERVING = """
, ntype AS (SELECT id, type FROM nodes UNION ALL SELECT DISTINCT 'GG'||(c_custkey//3), 'GeneGroup' FROM customer UNION ALL SELECT DISTINCT src, 'Study' FROM studies
 UNION ALL SELECT DISTINCT dst, 'Intervention' FROM tests UNION ALL SELECT id, 'Grant' FROM grants UNION ALL SELECT DISTINCT researcher, 'Researcher' FROM grants UNION ALL SELECT id, 'PatientOrg' FROM org),
se AS (SELECT edge_id, src, dst, rel FROM edges UNION ALL SELECT 'STUDIES:'||src||':'||dst, src, dst, 'STUDIES' FROM studies UNION ALL SELECT 'TESTS:'||src||':'||dst, src, dst, 'TESTS' FROM tests
 UNION ALL SELECT 'MEMBER_OF:'||src||':'||dst, src, dst, 'MEMBER_OF' FROM member_of UNION ALL SELECT 'REPRESENTED_BY:'||src||':'||dst, src, dst, 'REPRESENTED_BY' FROM represented_by
 UNION ALL SELECT 'DISCUSSES:'||src||':'||dst, src, dst, 'DISCUSSES' FROM discusses UNION ALL SELECT 'RESEARCHES:'||id||':'||gene, id, gene, 'RESEARCHES' FROM grants
 UNION ALL SELECT 'LEADS:'||researcher||':'||id, researcher, id, 'LEADS' FROM grants),
adj AS (SELECT src AS id, dst AS nbr, rel FROM se UNION ALL SELECT dst, src, rel FROM se)
"""


@query("q01_neighbours", SERVING + """
SELECT a.id, t.type AS nbr_type, count(*) AS n FROM adj a JOIN ntype t ON t.id=a.nbr WHERE a.id IN (SELECT id FROM core) AND t.type IN ('Gene','Study','PatientOrg') GROUP BY ALL""")
def _q01(t):
    g = t.serving
    return Q.neighbours(g, Q.core_entities(t.disease), ["Gene", "Study", "PatientOrg"]).groupBy("id", "nbr_type").agg(F.count(F.lit(1)).alias("n"))


SEARCH_SQL = r"""
, named AS (SELECT id, type, name FROM nodes UNION ALL SELECT id, 'PatientOrg', name FROM org),
val AS (SELECT DISTINCT type, id, field, weight, value FROM (
  SELECT type, id, 'name' AS field, 3.0::DOUBLE AS weight, name AS value FROM named UNION ALL SELECT 'Disease', id, 'short', 2.0::DOUBLE, short FROM disease
  UNION ALL SELECT type, id, 'synonyms', 2.0::DOUBLE, name||' syndrome' FROM named UNION ALL SELECT type, id, 'id', 1.0::DOUBLE, id FROM named) WHERE value IS NOT NULL),
v AS MATERIALIZED (SELECT *, row_number() OVER () AS vid, list_distinct(list_filter(regexp_split_to_array(lower(value), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS held FROM val),
vt AS MATERIALIZED (SELECT vid, unnest(held) AS term FROM v),
q AS (SELECT query, list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS words FROM (
  SELECT replace(s_name, 'pp', 'p') AS query FROM supplier UNION SELECT 'urgnet disorder 7' UNION SELECT 'chan 12' UNION SELECT 'ORG disease' UNION SELECT 'syndrme blue' UNION SELECT 'x')
  WHERE length(trim(query)) >= 2),
qw AS MATERIALIZED (SELECT query, len(words) AS n, unnest(words) AS word FROM q),
sim AS MATERIALIZED (SELECT * FROM (SELECT word, term, CASE WHEN word = term THEN 1.0::DOUBLE WHEN starts_with(term, word) THEN 0.9::DOUBLE WHEN length(word) >= 3 AND contains(term, word) THEN 0.75::DOUBLE
  WHEN levenshtein(word, term) <= CASE WHEN length(word) < 4 THEN 0 WHEN length(word) < 8 THEN 1 ELSE 2 END
    THEN 0.6::DOUBLE * (1.0::DOUBLE - levenshtein(word, term)::DOUBLE / greatest(length(word), length(term))) END AS s
  FROM (SELECT DISTINCT word FROM qw), (SELECT DISTINCT term FROM vt)) WHERE s IS NOT NULL),
hit AS (SELECT query, vid, any_value(n) AS n, sum(s) AS s FROM (SELECT query, n, qw.word, vid, max(s) AS s FROM qw JOIN sim ON sim.word = qw.word JOIN vt ON vt.term = sim.term GROUP BY ALL)
  GROUP BY query, vid HAVING count(*) = any_value(n)),
scored AS (SELECT query, type, id, field, value AS matched, round(weight * s / n * (0.5::DOUBLE + 0.5::DOUBLE * least(1.0::DOUBLE, n::DOUBLE / len(held))), 6) AS score FROM hit JOIN v USING (vid)),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query, type, id ORDER BY score DESC, field DESC, matched DESC) = 1),
shown AS (SELECT *, row_number() OVER (PARTITION BY query, type ORDER BY score DESC, id) AS rank FROM best
  QUALIFY rank <= CASE type WHEN 'Disease' THEN 5 WHEN 'Phenotype' THEN 5 WHEN 'Gene' THEN 4 WHEN 'Study' THEN 4 ELSE 3 END)
SELECT query, type, id, field, matched, score, CAST(rank AS INT) AS rank FROM shown QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, type, id) <= 80
"""


def search_nodes(t) -> DataFrame:
    nodes = t.nodes.select("id", "type", "name").unionByName(t.org.select("id", "type", "name"))
    return nodes.join(t.disease.select("id", "short"), "id", "left").withColumn("synonyms", F.array(F.concat("name", F.lit(" syndrome"))))


@query("q02_search", SEARCH_SQL)
def _q02(t):
    """Misspelt names of all mechanisms, and a few queries of other kinds, against everything that has a name."""
    some = t.spark.createDataFrame([(q,) for q in ("urgnet disorder 7", "chan 12", "ORG disease", "syndrme blue", "x")], "query string")
    queries = t.table("supplier").select(F.replace("s_name", F.lit("pp"), F.lit("p")).alias("query")).unionByName(some)
    return search_all(build_index(search_nodes(t)), queries)


LENS = """
, h AS (SELECT 'family' AS lens, m.dst AS hub, a.src AS disease, 'via '||g.name AS via FROM associated_with a JOIN gene g ON g.id=a.dst JOIN member_of m ON m.src=a.dst
 UNION ALL SELECT 'mechanism', dst, src, 'quoted paper evidence' FROM involves UNION ALL SELECT 'trials', src, dst, 'listed condition' FROM studies
 UNION ALL SELECT 'treatments', t.dst, s.dst, 'trial '||s.src FROM studies s JOIN tests t ON t.src=s.src
 UNION ALL SELECT 'researchers', gr.researcher, a.src, 'NIH project on '||g.name FROM associated_with a JOIN gene g ON g.id=a.dst JOIN grants gr ON gr.gene=a.dst
 UNION ALL SELECT 'groups', 'ORGSET:'||o.focus, r.src, o.name FROM represented_by r JOIN org o ON o.id=r.dst WHERE scope='shared' AND focus IN ('Disease-specific','Epilepsy','Children & disability')
 UNION ALL SELECT 'papers', src, dst, 'linked paper' FROM discusses),
links AS (SELECT lens, hub, disease, min(via) AS via FROM h WHERE disease IN (SELECT id FROM core) GROUP BY ALL)
"""


def lens_links(t, lenses=None, via=False):
    """Links of the layers; with ``via`` also what each link goes through, which only the links themselves show."""
    out = None
    for lens in lenses or Q.HUB_LENSES:
        part = Q.hub_links(t.serving, lens)
        part = part if via else part.drop("via")
        out = part if out is None else out.unionByName(part)
    return cut_lineage(out)


@query("q03_hub_links", LENS + "SELECT * FROM links")
def _q03(t):
    return lens_links(t, via=True)


@query("q04_shared_hubs", LENS + "SELECT lens, hub, count(*) AS n_diseases FROM links GROUP BY ALL HAVING count(*)>1")
def _q04(t):
    return Q.shared_hubs(lens_links(t))


PAIRS = LENS + """
, small AS (SELECT * FROM links WHERE lens<>'groups'),
mp AS (SELECT x.disease AS a, y.disease AS b, x.lens, 1-pow(0.5::DOUBLE, count(*)) AS strength, count(*) AS n_items, min(x.hub) AS first_item
  FROM small x JOIN small y ON x.lens=y.lens AND x.hub=y.hub AND x.disease<y.disease GROUP BY ALL),
gs AS MATERIALIZED (SELECT disease, list_sort(list(DISTINCT hub)) AS hubs FROM links WHERE lens='groups' GROUP BY disease)
"""
#: Layers whose pairs are formed; the few bundles of organisations reach a large part of all diseases and are told by lists.
PAIR_LENSES = [x for x in Q.HUB_LENSES if x != "groups"]


def group_signatures(t) -> DataFrame:
    return cut_lineage(Q.layer_signatures(lens_links(t, ["groups"])))


@query("q05_mode_pairs", LENS + """
SELECT x.disease AS a, y.disease AS b, x.lens, 1-pow(0.5::DOUBLE, count(*)) AS strength, count(*) AS n_items
FROM links x JOIN links y ON x.lens=y.lens AND x.hub=y.hub AND x.disease<y.disease GROUP BY ALL""")
def _q05(t):
    """Every pair of every layer, those of patient groups too."""
    return Q.mode_pairs(lens_links(t)).drop("first_item")


@query("q05_mode_pairs_groups", LENS + "SELECT lens, hub, disease, count(*) OVER (PARTITION BY hub) AS n_diseases FROM links WHERE lens='groups'")
def _q05b(t):
    """The layer of patient groups as hub and member."""
    links = lens_links(t, ["groups"]).select("lens", "hub", "disease")
    return links.join(Q.hub_card(links), ["lens", "hub"])


@query("q05_group_signatures", PAIRS + "SELECT 'groups' AS lens, disease, array_to_string(hubs, ',') AS hubs FROM gs")
def _q05c(t):
    return group_signatures(t).withColumn("hubs", F.array_join("hubs", ","))


@query("q05_group_pairs", PAIRS + """
, cl AS (SELECT hubs, count(*) AS n FROM gs GROUP BY hubs)
SELECT 'groups' AS lens, array_to_string(x.hubs, ',') AS hubs_a, array_to_string(y.hubs, ',') AS hubs_b, len(list_intersect(x.hubs, y.hubs)) AS n_items,
 1-pow(0.5::DOUBLE, len(list_intersect(x.hubs, y.hubs))) AS strength, CASE WHEN x.hubs=y.hubs THEN CAST(x.n*(x.n-1)/2 AS BIGINT) ELSE x.n*y.n END AS n_pairs
FROM cl x JOIN cl y ON array_to_string(x.hubs, '|')<=array_to_string(y.hubs, '|') AND len(list_intersect(x.hubs, y.hubs))>0 AND (x.hubs<>y.hubs OR x.n>1)""")
def _q05d(t):
    """Every pair of the layer of patient groups, factorised: lists of bundles, and how many pairs they stand for."""
    found = Q.signature_pairs(group_signatures(t))
    return found.withColumn("hubs_a", F.array_join("hubs_a", ",")).withColumn("hubs_b", F.array_join("hubs_b", ","))


SYMPTOMS = """
, items AS (SELECT c.entity, c.term AS item, i.ic AS w FROM closed c JOIN ic i ON i.term=c.term WHERE i.ic>0 AND c.entity IN (SELECT id FROM disease)),
tot AS (SELECT entity, sum(w) AS t FROM items GROUP BY entity),
ov AS (SELECT x.entity AS a, y.entity AS b, sum(x.w) AS o FROM items x JOIN items y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL),
sy AS (SELECT a, b, 'symptoms' AS lens, least(1.0::DOUBLE, o/(ta.t+tb.t-o)*50/40) AS strength, 1 AS n_items, NULL AS first_item
  FROM ov JOIN tot ta ON ta.entity=a JOIN tot tb ON tb.entity=b WHERE o/(ta.t+tb.t-o)>=0.4)
"""


def matched_symptoms(t) -> DataFrame:
    alike = S.ic_jaccard(scored_terms(t), 0.4)
    return Q.symptom_pairs(alike.select("a", "b", (F.col("similarity") * 50).alias("score")))


@query("q06_mode_counts", PAIRS + SYMPTOMS + """
, hm AS (SELECT disease, CAST(sum(1 << (i-1)) AS BIGINT) AS mask FROM (SELECT disease, hub, CAST(dense_rank() OVER (ORDER BY hub) AS INTEGER) AS i FROM (SELECT DISTINCT disease, hub FROM links WHERE lens='groups')) GROUP BY disease),
inc AS (SELECT m, count(*) AS c FROM hm, range(1, 16) r(m) WHERE mask & m = m GROUP BY m)
SELECT lens, count(*) AS n_pairs FROM mp GROUP BY lens UNION ALL SELECT lens, count(*) FROM sy GROUP BY lens
UNION ALL SELECT 'groups', CAST(sum(CASE WHEN bit_count(m)%2=1 THEN 1 ELSE -1 END * c*(c-1)/2) AS BIGINT) FROM inc""")
def _q06(t):
    pairs = Q.mode_pairs(lens_links(t, PAIR_LENSES)).unionByName(matched_symptoms(t))
    return Q.mode_counts(pairs, Q.signature_pairs(group_signatures(t)))


def layers(t) -> DataFrame:
    """All layers of every pair that a layer other than patient groups ties; ``q05_group_pairs`` tells the pairs tied by
    groups alone."""
    pairs = Q.mode_pairs(lens_links(t, PAIR_LENSES)).unionByName(matched_symptoms(t))
    return Q.with_signatures(cut_lineage(Q.pair_layers(pairs, 25.0)), group_signatures(t))


LAYERS = PAIRS + SYMPTOMS + """
, lay0 AS MATERIALIZED (SELECT * FROM mp UNION ALL SELECT * FROM sy WHERE strength*40>=25),
lay AS MATERIALIZED (SELECT * FROM lay0 UNION ALL SELECT a, b, 'groups', 1-pow(0.5::DOUBLE, len(hs)), len(hs), hs[1] FROM (
  SELECT a, b, list_sort(list_intersect(x.hubs, y.hubs)) AS hs FROM (SELECT DISTINCT a, b FROM lay0) JOIN gs x ON x.disease=a JOIN gs y ON y.disease=b) WHERE len(hs)>0)
"""


@query("q07_pair_layers", LAYERS + f"SELECT a, b, lens, round(strength,6) AS strength, n_items FROM lay")
def _q07(t):
    found = layers(t).drop("first_item")
    return found.withColumn("strength", F.round("strength", 6))


@query("q08_combined_strength", LAYERS + f"SELECT a, b, round(1-exp(sum(ln(1-0.85::DOUBLE*strength))),6) AS strength, count(*) AS n_layers FROM lay GROUP BY ALL")
def _q08(t):
    found = layers(t)
    return Q.combined_strength(found).withColumn("strength", F.round("strength", 6))


@query("q09_describe_contribution", LAYERS + """
, sets AS (SELECT 'ORGSET:'||focus AS id, CASE focus WHEN 'Disease-specific' THEN 'Gene-specific groups' WHEN 'Children & disability' THEN 'Disability groups' ELSE focus||' groups' END||' · '||count(*) AS name
  FROM org WHERE scope='shared' GROUP BY focus)
SELECT a, b, lens, CASE WHEN lens='symptoms' THEN 'similar symptoms ('||CAST(round(strength*40) AS INT)||')' WHEN n_items=1 THEN CASE lens WHEN 'family' THEN 'gene family' WHEN 'treatments' THEN 'drug' WHEN 'trials' THEN 'study'
  WHEN 'researchers' THEN 'researcher' WHEN 'groups' THEN 'group' WHEN 'papers' THEN 'paper' ELSE lens END||': '||
  CASE lens WHEN 'family' THEN replace(first_item, 'GG', 'family ') ELSE coalesce(m.name, p.name, sets.name, first_item) END
 ELSE n_items||' '||CASE lens WHEN 'family' THEN 'gene families' WHEN 'mechanism' THEN 'mechanisms' WHEN 'treatments' THEN 'drugs' WHEN 'trials' THEN 'studies' ELSE lens END END AS text
FROM lay LEFT JOIN mechanism m ON m.id=first_item LEFT JOIN paper p ON p.id=first_item LEFT JOIN sets ON sets.id=first_item""")
def _q09(t):
    g = t.serving
    names = g.of_type("GeneGroup", "Mechanism", "Paper").select("id", "name").unionByName(Q.org_sets(t.org).select("id", "name"))
    named = layers(t).join(names.withColumnRenamed("id", "first_item"), "first_item", "left")
    text = Q.describe_contribution(F.col("lens"), F.col("strength"), F.col("n_items"), F.coalesce("name", "first_item"))
    return named.select("a", "b", "lens", text.alias("text"))


@query("q10_org_sets", """
SELECT 'ORGSET:'||focus AS id, CASE focus WHEN 'Disease-specific' THEN 'Gene-specific groups' WHEN 'Children & disability' THEN 'Disability groups' ELSE focus||' groups' END||' · '||count(*) AS name, count(*) AS n_members FROM org WHERE scope='shared' GROUP BY focus""")
def _q10(t):
    return Q.org_sets(t.org)


@query("q11_core_entities", "SELECT id FROM core")
def _q11(t):
    return Q.core_entities(t.nodes).select("id")


HIDE = "('Phenotype','Variant','Claim','Researcher','Intervention','Study','Grant','PatientOrg')"


@query("q12_expand", SERVING + f"SELECT DISTINCT a.id, a.nbr FROM adj a JOIN ntype t ON t.id=a.nbr WHERE a.id IN (SELECT id FROM core) AND t.type NOT IN {HIDE}")
def _q12(t):
    return Q.expand(t.serving, Q.core_entities(t.disease))


@query("q12_reveal", SERVING + f"""
, f AS (SELECT id, type FROM ntype WHERE type IN ('Variant','Phenotype','Study')), nr AS (SELECT DISTINCT f.id, f.type, a.nbr, t.type AS nt FROM f JOIN adj a ON a.id=f.id JOIN ntype t ON t.id=a.nbr),
sh AS (SELECT id, nbr FROM nr WHERE CASE WHEN type='Variant' THEN nt='Gene' ELSE nt NOT IN {HIDE} OR (type='Phenotype' AND nt='Disease') END),
al AS (SELECT id, nbr, row_number() OVER (PARTITION BY id ORDER BY nbr) AS rn FROM nr WHERE id NOT IN (SELECT id FROM sh))
SELECT * FROM sh UNION ALL SELECT id, nbr FROM al WHERE rn<=12""")
def _q12b(t):
    g = t.serving
    return Q.reveal(g, g.of_type("Variant", "Phenotype", "Study"))


@query("q13_collapse", SERVING + """
, vis AS (SELECT id FROM disease UNION SELECT id FROM gene UNION SELECT id FROM phenotype), nb AS (SELECT DISTINCT nbr AS id FROM adj WHERE id='D10' AND nbr IN (SELECT id FROM ntype)),
kept AS (SELECT DISTINCT a.id FROM adj a WHERE a.nbr<>'D10' AND a.id IN (SELECT id FROM nb) AND a.nbr IN (SELECT id FROM vis))
SELECT id FROM vis WHERE NOT (id IN (SELECT id FROM nb) AND id NOT IN (SELECT id FROM disease) AND id NOT IN (SELECT id FROM kept))""")
def _q13(t):
    visible = t.disease.select("id").unionByName(t.gene.select("id")).unionByName(t.phenotype.select("id"))
    return Q.collapse(t.serving, "D10", visible, t.disease.select("id"))


@query("q14_induced_edges", """
, vis AS (SELECT id FROM core UNION SELECT id FROM gene) SELECT edge_id FROM edges WHERE src IN (SELECT id FROM vis) AND dst IN (SELECT id FROM vis)""")
def _q14(t):
    visible = Q.core_entities(t.disease).select("id").unionByName(t.gene.select("id"))
    return Q.induced_edges(t.edges, visible).select("edge_id")


@query("q15_strength_label", "SELECT o_orderkey, CASE WHEN o_totalprice>=300000 THEN 'strong' WHEN o_totalprice>=240000 THEN 'moderate' ELSE 'weak' END AS label FROM orders")
def _q15(t):
    scored = t.table("orders").select("o_orderkey", (F.col("o_totalprice") / 10000).alias("score"))
    return scored.select("o_orderkey", X.strength_label("score").alias("label"))


@query("q16_node_label", """
SELECT id, CASE WHEN length(name)<=22 THEN name ELSE short||' · AB-1' END AS label FROM (SELECT 'D'||o_orderkey AS id, o_orderpriority||' disorder '||o_orderkey AS name, 'C'||o_custkey AS short FROM orders)
UNION ALL SELECT 'PMID:'||doc_id, CASE WHEN length(t)>34 THEN rtrim(t[1:33])||'…' ELSE t END FROM (SELECT doc_id, 'A study of source '||source||' and '||doc_id AS t FROM documents)
UNION ALL SELECT id, coalesce(CASE WHEN num%2=0 THEN 'p.'||num END, name) FROM variant""")
def _q16(t):
    none = F.lit(None).cast("string")
    nodes = (
        t.disease.select("id", "type", "name", "short", none.alias("protein_change"))
        .unionByName(t.table("documents").select(F.concat(F.lit("PMID:"), "doc_id").alias("id"), F.lit("Paper").alias("type"), F.concat(F.lit("A study of source "), "source", F.lit(" and "), "doc_id").alias("name"), none.alias("short"), none.alias("protein_change")))
        .unionByName(t.variant.select("id", "type", "name", none.alias("short"), F.when(F.col("num") % 2 == 0, F.concat(F.lit("p."), "num")).otherwise("").alias("protein_change"))))
    return nodes.select("id", X.node_label("type", "name", "short", F.array(F.lit("lower"), F.lit("AB-1")), "protein_change", F.lit("")).alias("label"))


@query("q16_node_subtitle", """
SELECT id, short||' gene' AS subtitle FROM disease UNION ALL SELECT g.id, CASE WHEN n>0 THEN n||' variants' ELSE '' END FROM gene g LEFT JOIN (SELECT dst, count(*) AS n FROM in_gene GROUP BY dst) v ON v.dst=g.id""")
def _q16b(t):
    none = F.lit(None).cast("string")
    nodes = t.disease.select("id", "type", "short", none.alias("full_name"), none.alias("classification"), none.alias("source_id")).unionByName(
        t.gene.select("id", "type", none.alias("short"), none.alias("full_name"), none.alias("classification"), none.alias("source_id")))
    return Q.node_subtitles(nodes, t.in_gene)


@query("q17_external_links", """
SELECT id, 'MONDO' AS label, 'https://monarchinitiative.org/'||id AS url FROM disease UNION ALL SELECT id, 'OMIM', 'https://omim.org/entry/'||num FROM disease UNION ALL SELECT id, 'Orphanet', 'https://www.orpha.net/en/disease/detail/'||(num+1) FROM disease
UNION ALL SELECT 'CLINVAR:VCV000'||num, 'ClinVar', 'https://www.ncbi.nlm.nih.gov/clinvar/variation/'||num||'/' FROM variant UNION ALL SELECT id, 'PubMed', 'https://pubmed.ncbi.nlm.nih.gov/'||num||'/' FROM paper""")
def _q17(t):
    none = F.lit(None).cast("string")
    rows = t.disease.selectExpr("id", "type", "array(concat('OMIM:', num), 'SCTID:1', concat('ORPHA:', num + 1)) AS xrefs").unionByName(
        t.variant.selectExpr("concat('CLINVAR:VCV000', num) AS id", "type", "cast(NULL AS array<string>) AS xrefs")).unionByName(t.paper.selectExpr("id", "type", "cast(NULL AS array<string>) AS xrefs"))
    return rows.select("id", F.explode(X.external_links("type", "id", "xrefs", none, none, none, none)).alias("l")).select("id", "l.label", "l.url")


# ---------------------------------------------------------------- cards


@query("q18_disease_card", ASSETS + """
, n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM br UNION ALL SELECT b FROM br) GROUP BY id)
SELECT c.id, 1 AS n_genes, (SELECT count(*) FROM discusses d WHERE d.dst=c.id) AS n_papers, (SELECT count(*) FROM studies s WHERE s.dst=c.id) AS n_trials, 1 AS n_orgs,
 (SELECT count(*) FROM associated_with a JOIN grants g ON g.gene=a.dst WHERE a.src=c.id) AS n_grants, (SELECT count(DISTINCT dst) FROM involves i WHERE i.src=c.id) AS n_mechanisms, coalesce(n.n,0) AS n_bridges
FROM core c LEFT JOIN n ON n.id=c.id""")
def _q18(t):
    return Q.disease_card(t.serving, E.shared_asset_bridges(assets(t)))


@query("q18_symptom_list", """
, m AS (SELECT DISTINCT src, dst FROM has_phenotype WHERE src IN (SELECT id FROM core)) SELECT src AS id, dst AS phenotype, count(*) OVER (PARTITION BY dst) AS n_sharing FROM m""")
def _q18b(t):
    return Q.symptom_list(t.has_phenotype, Q.core_entities(t.disease)).select("id", "phenotype", "n_sharing")


@query("q18_mechanism_rows", "SELECT src, dst, arg_min(edge_id, (-len(supported_by), edge_id)) AS edge_id FROM involves GROUP BY ALL")
def _q18c(t):
    return Q.mechanism_rows(t.involves)


@query("q19_active_trials", """
SELECT * FROM (SELECT dst AS disease, src AS study, CAST(row_number() OVER (PARTITION BY dst ORDER BY hash_free DESC, split_part(src,'-',2) DESC, src) AS INTEGER) AS rank FROM (SELECT *, CAST(split_part(src,'-',2) AS BIGINT)%2=0 AS hash_free FROM studies)) WHERE rank<=3""")
def _q19(t):
    day = F.split_part("src", F.lit("-"), F.lit(2))
    s = t.studies.select(F.col("dst").alias("disease"), F.col("src").alias("study"), F.when(day.cast("bigint") % 2 == 0, "RECRUITING").otherwise("COMPLETED").alias("status"), day.alias("start"), F.array(F.lit("PHASE1"), F.lit("PHASE2")).alias("phases"))
    return Q.active_trials(s, 3).select("disease", "study", "rank")


@query("q20_org_groups", "SELECT r.src AS disease, r.dst AS org, o.focus, false AS umbrella, count(*) OVER (PARTITION BY r.dst)-1 AS n_other FROM represented_by r JOIN org o ON o.id=r.dst")
def _q20(t):
    return Q.org_groups(t.represented_by, t.org)


@query("q21_funding_summary", """
, o AS (SELECT gene, organization, sum(value) AS amount FROM grants WHERE value>0 GROUP BY ALL), r AS (SELECT gene, organization, row_number() OVER (PARTITION BY gene ORDER BY amount DESC, organization) AS rank FROM o)
SELECT g.gene, round(sum(value),2) AS total, max(value) AS largest, count(*) AS n, min(fiscal_year) AS first_year, max(fiscal_year) AS last_year, list_sort(list(value))[CAST(count(*)//2 AS INTEGER)+1] AS median,
 (SELECT string_agg(organization, ',' ORDER BY rank) FROM r WHERE r.gene=g.gene AND rank<=4) AS top_orgs FROM grants g WHERE value>0 GROUP BY g.gene""")
def _q21(t):
    totals, orgs = Q.funding_summary(t.grant.select("gene", F.col("id").alias("grant"), F.col("value").alias("award_amount"), "fiscal_year", "organization"))
    top = orgs.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("rank", "organization"))).alias("x")).select("gene", F.array_join(F.transform("x", lambda y: y["organization"]), ",").alias("top_orgs"))
    return totals.withColumn("total", F.round("total", 2)).join(top, "gene")


@query("q22_bridge_list", ASSETS + """
, k AS (SELECT a, b, concat_ws(',', CASE WHEN shared_gene_groups>0 THEN 'gene_groups' END, CASE WHEN shared_studies>0 THEN 'studies' END, CASE WHEN shared_interventions>0 THEN 'interventions' END,
 CASE WHEN shared_researchers>0 THEN 'researchers' END, CASE WHEN shared_orgs>0 THEN 'orgs' END) AS kinds FROM br)
SELECT a AS id, b AS other, kinds FROM k UNION ALL SELECT b, a, kinds FROM k""")
def _q22(t):
    found = E.shared_asset_bridges(assets(t))
    return Q.bridge_list(found)


@query("q23_gene_card", """
SELECT g.id, (SELECT count(*) FROM associated_with a WHERE a.dst=g.id) AS n_diseases, (SELECT count(*) FROM variant v WHERE v.gene=g.id) AS n_variants, (SELECT count(*) FROM variant v WHERE v.gene=g.id AND classification LIKE 'Pathogenic%') AS n_pathogenic,
 (SELECT count(DISTINCT src) FROM about b WHERE b.dst=g.id) AS n_claims, 1 AS n_families, (SELECT count(*) FROM grants r WHERE r.gene=g.id) AS n_grants FROM gene g""")
def _q23(t):
    return Q.gene_card(t.serving, t.variant)


@query("q24_paper_card", "SELECT pmid AS paper, category, count(*) AS n FROM claim GROUP BY ALL")
def _q24(t):
    return Q.paper_card(t.claim.withColumnRenamed("pmid", "paper"))


@query("q24_paper_treatments", "SELECT DISTINCT pmid AS paper, dst AS item FROM claim c JOIN about a ON a.src=c.id")
def _q24b(t):
    return Q.paper_treatments(t.claim.withColumnRenamed("pmid", "paper"), t.about.select("src", "dst"))


@query("q24_claim_card", "SELECT c.id, polarity, count(DISTINCT dst) AS n_mentions FROM claim c LEFT JOIN about a ON a.src=c.id GROUP BY ALL")
def _q24c(t):
    return Q.claim_card(t.claim, t.about)


@query("q25_study_card", "SELECT src AS id, count(DISTINCT dst) AS n_diseases, (SELECT count(DISTINCT dst) FROM tests t WHERE t.src=s.src) AS n_drugs FROM studies s GROUP BY src")
def _q25(t):
    return Q.study_card(t.serving)


@query("q25_grant_card", 'SELECT id AS "grant", researcher, count(*) OVER (PARTITION BY researcher)-1 AS n_other FROM grants')
def _q25b(t):
    return Q.grant_card(t.grant.select(F.col("researcher").alias("src"), F.col("id").alias("dst"))).select("grant", "researcher", "n_other")


@query("q26_hub_card", LENS + "SELECT lens, hub, count(DISTINCT disease) AS n_diseases FROM links WHERE lens IN ('family','treatments','mechanism') GROUP BY ALL")
def _q26(t):
    return Q.hub_card(lens_links(t, ["family", "treatments", "mechanism"]))


@query("q26_mechanism_card", "SELECT dst AS id, count(*) AS n_diseases, count(*) FILTER (d) AS n_variant_dependent FROM (SELECT dst, src, bool_or(len(supported_by)=0) AS d FROM involves GROUP BY ALL) GROUP BY dst")
def _q26b(t):
    return Q.mechanism_card(t.involves.withColumn("variant_dependent", F.size("supported_by") == 0))


@query("q27_prevalence", "SELECT dst AS phenotype, count(DISTINCT src) AS seen_in, (SELECT count(*) FROM core) AS \"of\" FROM has_phenotype WHERE src IN (SELECT id FROM core) GROUP BY dst")
def _q27(t):
    return Q.prevalence(t.has_phenotype, Q.core_entities(t.disease))


@query("q28_match_card", """
, items AS (SELECT c.entity, c.term AS item, i.ic AS w FROM closed c JOIN ic i ON i.term=c.term WHERE i.ic>0 AND c.entity IN (SELECT id FROM disease)), tot AS (SELECT entity, sum(w) AS t FROM items GROUP BY entity),
ov AS (SELECT x.entity AS a, y.entity AS b, sum(x.w) AS o FROM items x JOIN items y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL),
p AS MATERIALIZED (SELECT a, b FROM ov JOIN tot ta ON ta.entity=a JOIN tot tb ON tb.entity=b WHERE o/(ta.t+tb.t-o)>=0.4), hp AS (SELECT DISTINCT src, dst FROM has_phenotype),
tk AS (SELECT a, b, x.term, row_number() OVER (PARTITION BY a, b ORDER BY round(i.ic,9) DESC, x.term) AS r FROM p JOIN closed x ON x.entity=a JOIN closed y ON y.entity=b AND y.term=x.term JOIN ic i ON i.term=x.term)
SELECT p.a, p.b, x.dst AS phenotype, tk.term IS NOT NULL AS informative FROM p JOIN hp x ON x.src=p.a JOIN hp y ON y.src=p.b AND y.dst=x.dst LEFT JOIN tk ON tk.a=p.a AND tk.b=p.b AND tk.term=x.dst AND tk.r<=3""")
def _q28(t):
    _, closed = closed_terms(t)
    ic = cut_lineage(S.information_content(t.annotation, closed=closed).withColumn("ic", F.round("ic", 9)))
    pairs = cut_lineage(S.ic_jaccard(scored_terms(t), 0.4))
    return Q.match_card(pairs, t.has_phenotype, S.top_shared_terms(pairs, closed, ic)).select("a", "b", "phenotype", "informative")


@query("q28_pair_card", LAYERS + "SELECT a, b, lens, round(strength,6) AS strength, round(1-exp(sum(ln(1-0.85::DOUBLE*strength)) OVER (PARTITION BY a, b)),6) AS combined FROM lay")
def _q28b(t):
    found = layers(t)
    card = Q.pair_card(found).select("a", "b", "lens", F.round("strength", 6).alias("strength"), F.round("combined", 6).alias("combined"))
    return card


@query("q29_coverage_gap", SERVING + """
, sp AS (SELECT id, unnest(['Study','Grant','Mechanism','Paper']) AS type FROM core)
SELECT id, type FROM sp WHERE (id, type) NOT IN (SELECT (a.id, t.type) FROM adj a JOIN ntype t ON t.id=a.nbr WHERE a.id IN (SELECT id FROM core))""")
def _q29(t):
    return Q.coverage_gap(t.serving, ["Study", "Grant", "Mechanism", "Paper"])
