"""Queries for closure, similarity and pair scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corrobora.operators import similarity as S
from corrobora.operators.pairs import best_partners, sharing_pairs
from corrobora.plans.registry import query
from corrobora.session import checkpoint_dir, cut_lineage
from corrobora.sources import sinks


# The brute-force pair score in SQL: all pairs that share a feature or a closed term.
PAIR_SQL = """
, items AS (SELECT c.entity, c.term AS item, i.ic AS w FROM closed c JOIN ic i ON i.term=c.term
  WHERE i.ic>0 AND c.entity IN (SELECT id FROM disease)),
tot AS (SELECT entity, sum(w) AS t FROM items GROUP BY entity),
ov AS (SELECT x.entity AS a, y.entity AS b, sum(x.w) AS o FROM items x JOIN items y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL),
sim AS (SELECT a, b, o/(ta.t+tb.t-o) AS s FROM ov JOIN tot ta ON ta.entity=a JOIN tot tb ON tb.entity=b),
fr AS (SELECT f.*, r.weight AS rare FROM features f LEFT JOIN rarity r ON r.entity=f.entity AND r.item=f.item AND f.kind='phenotype'),
sh AS (SELECT x.entity AS a, y.entity AS b,
  sum(least(x.support,y.support)) FILTER (x.kind='mechanism') AS mmin, avg(sqrt(x.support*y.support)) FILTER (x.kind='mechanism') AS msup,
  count(*) FILTER (x.kind='mechanism') AS mn, count(*) FILTER (x.kind='gene') AS gn, count(*) FILTER (x.kind='phenotype') AS pn,
  avg(sqrt(x.support*y.support)) FILTER (x.kind='gene') AS gsup, sum(least(x.support,y.support)) FILTER (x.kind='phenotype') AS pmin,
  sum(x.rare) FILTER (x.kind='phenotype') AS prare
  FROM fr x JOIN fr y ON x.item=y.item AND x.kind=y.kind AND x.entity<y.entity GROUP BY ALL),
tt AS (SELECT entity, coalesce(sum(support) FILTER (kind='mechanism'),0) AS mt, count(*) FILTER (kind='mechanism') AS mc,
  count(*) FILTER (kind='gene') AS gc FROM features GROUP BY entity),
p0 AS (SELECT a, b FROM sh UNION SELECT a, b FROM sim WHERE s>=0.5),
p1 AS (SELECT p.a, p.b, coalesce(mn,0) AS mn, coalesce(gn,0) AS gn, coalesce(pn,0) AS pn, coalesce(mmin,0) AS mmin, coalesce(msup,0) AS msup,
  coalesce(gsup,0) AS gsup, coalesce(pmin,0) AS pmin, coalesce(prare,0) AS prare, coalesce(s,0) AS ics,
  ta.mt+tb.mt AS mtt, ta.mc AS mca, tb.mc AS mcb, ta.gc+tb.gc AS gcc
  FROM p0 p LEFT JOIN sh ON sh.a=p.a AND sh.b=p.b LEFT JOIN sim ON sim.a=p.a AND sim.b=p.b
  JOIN tt ta ON ta.entity=p.a JOIN tt tb ON tb.entity=p.b),
p2 AS (SELECT *, CASE WHEN mtt-mmin>0 THEN mmin/(mtt-mmin) ELSE 0 END AS mechanism,
  CASE WHEN gcc-gn>0 THEN CAST(gn AS DOUBLE)/(gcc-gn) ELSE 0 END AS genetic, prare>=1.0-1e-9 AS meaningful,
  ics*CASE WHEN prare>=1.0-1e-9 THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END AS pheno,
  (CASE WHEN mn>0 THEN msup ELSE 0 END + CASE WHEN gn>0 THEN gsup ELSE 0 END + pmin)
   / greatest((mn>0)::INT+(gn>0)::INT+pn,1) AS ev, gn>0 AND mca>0 AND mcb>0 AND mn=0 AS counter FROM p1),
p3 AS (SELECT *, (CASE WHEN mn>0 THEN 0.5::DOUBLE ELSE 0 END+CASE WHEN gn>0 THEN 0.2::DOUBLE ELSE 0 END+CASE WHEN pheno>0 THEN 0.3::DOUBLE ELSE 0 END) AS used FROM p2),
scored AS MATERIALIZED (SELECT *, CASE WHEN used>0 THEN 100*(CASE WHEN mn>0 THEN 0.5::DOUBLE*mechanism ELSE 0 END+CASE WHEN gn>0 THEN 0.2::DOUBLE*genetic ELSE 0 END
   +CASE WHEN pheno>0 THEN 0.3::DOUBLE*pheno ELSE 0 END)/used ELSE 0 END*(0.6::DOUBLE+0.4::DOUBLE*ev)*CASE WHEN counter THEN 0.35::DOUBLE ELSE 1 END AS score,
  CASE WHEN mn>0 AND meaningful THEN 'mechanistic_and_phenotypic' WHEN mn>0 THEN 'mechanistic'
   WHEN gn>0 AND NOT counter THEN 'genetic_overlap' WHEN meaningful THEN 'phenotypic_neighbor'
   WHEN counter THEN 'same_gene_different_mechanism' ELSE 'no_supported_route' END AS connection_type FROM p3)
"""
# Items are listed for the pairs that reach the score only.
CONN_SQL = PAIR_SQL + """
, hi AS MATERIALIZED (SELECT * FROM scored WHERE round(score,2)>=20),
lists AS (SELECT h.a, h.b, string_agg(x.item, ',' ORDER BY x.item) FILTER (x.kind='mechanism') AS shared_m,
  string_agg(x.item, ',' ORDER BY x.item) FILTER (x.kind='gene') AS shared_g, string_agg(x.item, ',' ORDER BY x.item) FILTER (x.kind='phenotype') AS shared_p
  FROM hi h JOIN features x ON x.entity=h.a JOIN features y ON y.entity=h.b AND y.item=x.item AND y.kind=x.kind GROUP BY ALL),
conn AS MATERIALIZED (SELECT hi.*, shared_m, shared_g, shared_p FROM hi LEFT JOIN lists USING (a, b))
"""


def closed_terms(t):
    """(closure, closed terms), once per testbed however many parts of a query ask for them."""
    if "closed_terms" not in t.made:
        closure = S.ancestor_closure(t.ontology)
        t.made["closed_terms"] = closure, cut_lineage(S.close_terms(t.annotation, closure))
    return t.made["closed_terms"]


def scored_terms(t):
    """items(entity, item, ic weight) of every disease."""
    _, closed = closed_terms(t)
    ic = S.information_content(t.annotation, closed=closed)
    return cut_lineage(S.weighted_terms(closed, ic).join(t.disease.select(F.col("id").alias("entity")), "entity", "left_semi"))


def scored_features(t):
    return cut_lineage(S.feature_table(t.disease_graph, t.claim))


def connections(t, min_score: float = 20.0) -> DataFrame:
    return S.all_connections(scored_features(t), scored_terms(t), min_score)


def told_connections(t, min_score: float = 20.0) -> DataFrame:
    """The connections with the labels of what each pair shares."""
    _, closed = closed_terms(t)
    ic = cut_lineage(S.information_content(t.annotation, closed=closed).withColumn("ic", F.round("ic", 9)))
    features = scored_features(t)
    told = S.told_lists(features, closed, ic, t.phenotype.select("id", "name"))
    return S.all_connections(features, scored_terms(t), min_score, told)


@query("a01_ancestor_closure", """
, rc AS (SELECT child AS term, child AS ancestor FROM ontology UNION SELECT parent, parent FROM ontology
  UNION SELECT rc.term, o.parent FROM rc JOIN ontology o ON o.child=rc.ancestor)
SELECT term, ancestor FROM rc""")
def _a01(t):
    return S.ancestor_closure(t.ontology)


@query("a02_information_content", "SELECT term, n, round(ic,6) AS ic FROM ic")
def _a02(t):
    closure = S.ancestor_closure(t.ontology)
    return S.information_content(t.annotation, closure).select("term", "n", F.round("ic", 6).alias("ic"))


@query("a03_ic_jaccard", f"""
, items AS (SELECT c.entity, c.term AS item, i.ic AS w FROM closed c JOIN ic i ON i.term=c.term
  WHERE i.ic>0 AND c.entity IN (SELECT id FROM disease)),
tot AS (SELECT entity, sum(w) AS t FROM items GROUP BY entity),
ov AS (SELECT x.entity AS a, y.entity AS b, sum(x.w) AS o FROM items x JOIN items y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL)
SELECT a, b, round(o/(ta.t+tb.t-o),6) AS similarity FROM ov JOIN tot ta ON ta.entity=a JOIN tot tb ON tb.entity=b
WHERE o/(ta.t+tb.t-o) >= 0.4""")
def _a03(t):
    found = S.ic_jaccard(scored_terms(t), 0.4)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("a04_top_shared_terms", """
, items AS (SELECT c.entity, c.term AS item, i.ic AS w FROM closed c JOIN ic i ON i.term=c.term
  WHERE i.ic>0 AND c.entity IN (SELECT id FROM disease)),
tot AS (SELECT entity, sum(w) AS t FROM items GROUP BY entity),
ov AS (SELECT x.entity AS a, y.entity AS b, sum(x.w) AS o FROM items x JOIN items y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL),
sim AS (SELECT a, b FROM ov JOIN tot ta ON ta.entity=a JOIN tot tb ON tb.entity=b WHERE o/(ta.t+tb.t-o) >= 0.5)
SELECT a, b, term, ic, rank FROM (SELECT a, b, x.term, round(i.ic,6) AS ic,
  CAST(row_number() OVER (PARTITION BY a,b ORDER BY round(i.ic,9) DESC, x.term) AS INTEGER) AS rank
  FROM sim JOIN closed x ON x.entity=a JOIN closed y ON y.entity=b AND y.term=x.term JOIN ic i ON i.term=x.term) WHERE rank<=3""")
def _a04(t):
    _, closed = closed_terms(t)
    ic = cut_lineage(S.information_content(t.annotation, closed=closed).withColumn("ic", F.round("ic", 9)))
    pairs = S.ic_jaccard(scored_terms(t), 0.5)
    return S.top_shared_terms(pairs, closed, ic).select("a", "b", "term", F.round("ic", 6).alias("ic"), "rank")


@query("a05_edge_evidence_score", "SELECT edge_id, round(evidence,6) AS evidence, count(*) AS n FROM evidence GROUP BY ALL")
def _a05(t):
    scored = S.edge_evidence_score(t.disease_graph.edges, t.claim)
    return scored.groupBy("edge_id", F.round("evidence", 6).alias("evidence")).agg(F.count(F.lit(1)).alias("n"))


@query("a06_best_edge_support", "SELECT src, dst, rel, round(max(evidence),6) AS support FROM evidence GROUP BY ALL")
def _a06(t):
    best = S.best_edge_support(S.edge_evidence_score(t.disease_graph.edges, t.claim))
    return best.select("src", "dst", "rel", F.round("support", 6).alias("support"))


@query("a07_node_link_map", """
SELECT rel, src, dst, round(max(evidence),6) AS support FROM evidence WHERE src IN (SELECT id FROM disease)
AND dst IN (SELECT id FROM mechanism UNION ALL SELECT id FROM gene UNION ALL SELECT id FROM phenotype) GROUP BY ALL""")
def _a07(t):
    scored = cut_lineage(S.edge_evidence_score(t.disease_graph.edges, t.claim))
    links = None
    for rel, _ in S.FEATURE_RELATIONS.values():
        part = S.node_link_map(scored, t.disease_graph.nodes, "Disease", rel).select(F.lit(rel).alias("rel"), "src", "dst", F.round("support", 6).alias("support"))
        links = part if links is None else links.unionByName(part)
    return links


@query("a08_feature_table", "SELECT entity, kind, item, round(support,6) AS support FROM features")
def _a08(t):
    return S.feature_table(t.disease_graph, t.claim).withColumn("support", F.round("support", 6))


@query("a08_entity_spine", """
SELECT d.id AS entity, count(*) FILTER (f.kind='mechanism') AS n_mechanism, count(*) FILTER (f.kind='phenotype') AS n_phenotype, count(*) FILTER (f.kind='gene') AS n_gene
FROM (SELECT DISTINCT id FROM disease) d LEFT JOIN features f ON f.entity=d.id GROUP BY d.id""")
def _a08b(t):
    return S.entity_spine(t.disease_graph, scored_features(t))


@query("a09_shared_feature_weight", f"""
SELECT x.entity AS a, y.entity AS b, round(sum(x.weight),6) AS weight, count(*) AS n_shared
FROM rarity x JOIN rarity y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL""")
def _a09(t):
    rarity = cut_lineage(S.feature_rarity(scored_features(t)))
    found = sharing_pairs(rarity, lists=True)
    weights = S.shared_feature_weight(found, rarity)
    return weights.select("a", "b", F.round("weight", 6).alias("weight"), "n_shared")


@query("a09_best_partners", """
, ov AS (SELECT x.entity, y.entity AS partner, round(sum(x.weight),9) AS overlap, count(*) AS n_shared FROM rarity x JOIN rarity y ON x.item=y.item AND x.entity<>y.entity GROUP BY ALL)
SELECT entity, partner, round(overlap,6) AS overlap, n_shared, CAST(row_number() OVER (PARTITION BY entity ORDER BY overlap DESC, partner) AS INTEGER) AS rank FROM ov
QUALIFY rank<=5""")
def _a09b(t):
    """The five diseases each one shares its rarest phenotypes with: linear in the diseases."""
    rarity = cut_lineage(S.feature_rarity(scored_features(t)))
    return best_partners(rarity, 5).withColumn("overlap", F.round("overlap", 6))


def _jaccard_sql(kind: str, weight: str, t: float) -> str:
    return f"""
, it AS (SELECT entity, item, {weight} AS w FROM features WHERE kind='{kind}'),
tot AS (SELECT entity, sum(w) AS t FROM it GROUP BY entity),
ov AS (SELECT x.entity AS a, y.entity AS b, sum(least(x.w,y.w)) AS o FROM it x JOIN it y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL)
SELECT a, b, round(o/(ta.t+tb.t-o),6) AS similarity FROM ov JOIN tot ta ON ta.entity=a JOIN tot tb ON tb.entity=b
WHERE ta.t+tb.t-o > 0 AND o/(ta.t+tb.t-o) >= {t}"""


def _rounded(found: DataFrame):
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("a10_weighted_jaccard", _jaccard_sql("mechanism", "support", 0.203))
def _a10(t):
    return _rounded(S.weighted_jaccard(S.of_kind(scored_features(t), "mechanism"), 0.203))


@query("a11_shared_feature_support", f"""
SELECT x.entity AS a, y.entity AS b, round(avg(sqrt(x.support*y.support)),6) AS support FROM features x
JOIN features y ON x.kind='gene' AND y.kind='gene' AND x.item=y.item AND x.entity<y.entity GROUP BY ALL""")
def _a11(t):
    genes = S.of_kind(scored_features(t), "gene")
    found = sharing_pairs(genes, lists=True)
    support = S.shared_feature_support(found, genes)
    return support.select("a", "b", F.round("support", 6).alias("support"))


@query("a12_set_jaccard", _jaccard_sql("phenotype", "1.0::DOUBLE", 0.303))
def _a12(t):
    return _rounded(S.set_jaccard(S.of_kind(scored_features(t), "phenotype"), 0.303))


@query("a13_pair_connection", PAIR_SQL + f"""
SELECT a, b, round(mechanism,5) AS mechanism, round(genetic,5) AS genetic, round(pheno,5) AS phenotype, round(ev,5) AS evidence_quality,
 meaningful AS meaningful_phenotype_link, counter AS same_gene_different_mechanism, connection_type, round(score,4) AS score FROM scored WHERE gn>0""")
def _a13(t):
    features, terms = scored_features(t), scored_terms(t)
    lists = S.carried_lists(S.connection_lists(S.pair_items(features, terms)))
    found = sharing_pairs(S.of_kind(features, "gene"), carry=lists)
    records = S.pair_connection(found, features, terms).select(
        "a", "b", F.round("mechanism", 5).alias("mechanism"), F.round("genetic", 5).alias("genetic"),
        F.round("phenotype", 5).alias("phenotype"), F.round("evidence_quality", 5).alias("evidence_quality"),
        "meaningful_phenotype_link", "same_gene_different_mechanism", "connection_type", F.round("score", 4).alias("score"))
    return records


@query("a14_all_connections", CONN_SQL + f"""
SELECT a, b, round(score,4) AS score, connection_type, coalesce(shared_m,'') AS shared_mechanisms, coalesce(shared_g,'') AS shared_genes,
 coalesce(shared_p,'') AS shared_phenotypes FROM conn WHERE round(score,2)>=20""")
def flagship(t):
    found = connections(t)
    out = found.select(
        "a", "b", F.round("score", 4).alias("score"), "connection_type",
        *[F.array_join(c, ",").alias(c) for c in ("shared_mechanisms", "shared_genes", "shared_phenotypes")])
    return out


@query("a15_annotate_connections", CONN_SQL + f"""
, cx AS MATERIALIZED (SELECT c.a, c.b, x.term FROM conn c JOIN closed x ON x.entity=c.a WHERE round(c.score,2)>=20),
top AS (SELECT a, b, string_agg(name, ', ' ORDER BY rank) AS labels FROM (
  SELECT c.a, c.b, coalesce(p.name, c.term) AS name, row_number() OVER (PARTITION BY c.a,c.b ORDER BY round(i.ic,9) DESC, c.term) AS rank
  FROM cx c JOIN closed y ON y.entity=c.b AND y.term=c.term JOIN ic i ON i.term=c.term
  LEFT JOIN phenotype p ON p.id=c.term) WHERE rank<=3 GROUP BY a,b),
direct AS (SELECT a, b, string_agg(coalesce(p.name,d), '; ' ORDER BY d) AS labels
  FROM (SELECT a, b, unnest(string_split(shared_p, ',')) AS d FROM conn WHERE shared_p IS NOT NULL AND round(score,2)>=20) q
  LEFT JOIN phenotype p ON p.id=d GROUP BY a,b)
SELECT c.a, c.b, coalesce(d.labels,'') AS shared_phenotypes,
 CASE WHEN round(ev,3)>=0.85 THEN 'high' WHEN round(ev,3)>=0.6 THEN 'moderate' ELSE 'low' END AS confidence,
 concat_ws(' | ', CASE WHEN shared_m IS NOT NULL THEN 'Both diseases involve: '||replace(shared_m,',',', ')||'.' END,
  CASE WHEN shared_g IS NOT NULL THEN 'Shared gene(s): '||replace(shared_g,',',', ')||'.' END,
  CASE WHEN t.labels IS NOT NULL THEN 'Meaningful phenotype overlap: '||t.labels||'.' END,
  CASE WHEN counter THEN 'The diseases share a gene but have different supported mechanisms, so this is not treated as a direct mechanistic match.' END) AS why_connected
FROM conn c LEFT JOIN top t ON t.a=c.a AND t.b=c.b LEFT JOIN direct d ON d.a=c.a AND d.b=c.b WHERE round(c.score,2)>=20""")
def _a15(t):
    found = annotated(t)
    return found.select(
        "a", "b", F.array_join("shared_phenotype_labels", "; ").alias("shared_phenotypes"), "confidence",
        F.array_join("why_connected", " | ").alias("why_connected"))


def annotated(t) -> DataFrame:
    return S.annotate_connections(told_connections(t))


@query("a16_entity_projection", f"""
, it AS (SELECT entity, item, 2.0::DOUBLE AS w, 1 AS m FROM features WHERE kind='mechanism' UNION ALL SELECT entity, item, weight, 0 FROM rarity)
SELECT x.entity AS a, y.entity AS b, round(sum(x.w),6) AS weight, count(*) FILTER (x.m=1) AS n_mechanisms, count(*) FILTER (x.m=0) AS n_phenotypes,
 coalesce(string_agg(x.item, ',' ORDER BY x.item) FILTER (x.m=1), '') AS shared_mechanisms, coalesce(string_agg(x.item, ',' ORDER BY x.item) FILTER (x.m=0), '') AS shared_phenotypes
FROM it x JOIN it y ON x.item=y.item AND x.m=y.m AND x.entity<y.entity GROUP BY ALL HAVING sum(x.w)>=1.0-1e-9""")
def _a16(t):
    found = S.entity_projection(scored_features(t))
    text = lambda c: F.array_join(c, ",").alias(c)
    return found.select("a", "b", F.round("weight", 6).alias("weight"), "n_mechanisms", "n_phenotypes", text("shared_mechanisms"), text("shared_phenotypes"))


@query("a18_match_edges", CONN_SQL + """
SELECT 'DISEASE_MATCH:'||a||':'||b AS edge_id, a AS src, b AS dst, connection_type,
 CASE WHEN round(ev,3)>=0.85 THEN 'high' WHEN round(ev,3)>=0.6 THEN 'moderate' ELSE 'low' END AS confidence,
 coalesce(replace(shared_g,',','; '),'') AS shared_genes, coalesce(replace(shared_m,',','; '),'') AS shared_mechanisms
FROM conn WHERE round(score,2)>=20""")
def _a18(t):
    found = annotated(t)
    return S.match_edges(found, F.lit("2026-01-01").cast("date")).select(
        "edge_id", "src", "dst", "connection_type", "confidence", "shared_genes", "shared_mechanisms")


@query("a19_shortcut_edges", """
SELECT DISTINCT a.src, v.src AS dst, 'HAS_VARIANT' AS rel FROM associated_with a JOIN in_gene v ON v.dst=a.dst WHERE a.dst IN (SELECT id FROM gene)""")
def _a19(t):
    return S.shortcut_edges(t.graph)


@query("k02_similarity_tiles", """
, items AS (SELECT c.entity, c.term AS item, i.ic AS w FROM closed c JOIN ic i ON i.term=c.term WHERE i.ic>0 AND c.entity IN (SELECT id FROM disease)),
tot AS (SELECT entity, sum(w) AS t FROM items GROUP BY entity),
ov AS (SELECT x.entity AS a, y.entity AS b, sum(x.w) AS o FROM items x JOIN items y ON x.item=y.item AND x.entity<y.entity GROUP BY ALL),
sim AS (SELECT a, b, o/(ta.t+tb.t-o) AS s FROM ov JOIN tot ta ON ta.entity=a JOIN tot tb ON tb.entity=b WHERE o/(ta.t+tb.t-o) >= 0.4),
cell AS (SELECT a AS "row", b AS "col", s FROM sim UNION ALL SELECT b, a, s FROM sim UNION ALL SELECT d.id, d.id, CASE WHEN tot.t > 0 THEN 1 ELSE 0 END FROM disease d LEFT JOIN tot ON tot.entity=d.id),
n AS (SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 256 AS BIGINT) AS block FROM disease)
SELECT r.block AS row_block, c.block AS col_block, "row", "col", round(s, 6) AS similarity FROM cell JOIN n r ON r.id="row" JOIN n c ON "col"=c.id""")
def _k02b(t):
    """The IC similarity matrix of all diseases: both triangles and the diagonal, written in tiles and read back."""
    items, diseases = scored_terms(t), t.disease.select(F.col("id").alias("entity"))
    rows = S.similarity_matrix_rows(cut_lineage(S.ic_jaccard(items, 0.4)), items, diseases)
    path = f"{checkpoint_dir(t.spark)}/scratch/tiles-{uuid.uuid4().hex}"
    sinks.write_similarity_tiles(sinks.similarity_tiles(rows, diseases), path)
    cells = t.spark.read.parquet(path).select("row_block", "col_block", F.explode("cells").alias("c"))
    return cells.select("row_block", "col_block", "c.row", "c.col", F.round("c.similarity", 6).alias("similarity"))
