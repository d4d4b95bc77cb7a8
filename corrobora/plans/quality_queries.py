"""Queries for the data-quality rules and for ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import text as X
from corrobora.model import EvidenceGraph
from corrobora.operators import ranking as R
from corrobora.operators import rules as V
from corrobora.plans.registry import query

TYPED = """
, ids AS (SELECT id, type FROM nodes),
typed AS (SELECT e.edge_id, e.rel, e.status, s.type AS st, d.type AS dt FROM edges e LEFT JOIN ids s ON s.id=e.src LEFT JOIN ids d ON d.id=e.dst),
bad AS (SELECT edge_id AS id, rel||' not allowed between '||coalesce(st,'None')||' and '||coalesce(dt,'None') AS reason FROM typed
 WHERE NOT coalesce(CASE rel WHEN 'IN_GENE' THEN st='Variant' AND dt='Gene' WHEN 'DISRUPTS' THEN st='Variant' AND dt='Mechanism'
  WHEN 'ASSOCIATED_WITH' THEN st='Disease' AND dt IN ('Gene','Variant') WHEN 'HAS_PHENOTYPE' THEN st='Disease' AND dt='Phenotype'
  WHEN 'INVOLVES' THEN st='Disease' AND dt='Mechanism' WHEN 'CONTAINS' THEN st='Paper' AND dt='Claim'
  WHEN 'ABOUT' THEN st='Claim' AND dt IN ('Disease','Gene','Phenotype') END, false))
"""
UNSUPPORTED = """
, inferred AS (SELECT edge_id, supported_by FROM edges WHERE rel NOT IN ('CONTAINS','ABOUT')
  AND (status IN ('inference','hypothesis') OR method='llm_extracted')),
unsup AS (SELECT edge_id AS id FROM inferred WHERE len(supported_by)=0 UNION
  SELECT edge_id FROM (SELECT edge_id, unnest(supported_by) AS c FROM inferred) WHERE c NOT IN (SELECT id FROM claim))
"""


@query("v01_schema_violations", TYPED + """
SELECT 'edge' AS what, id, reason, count(*) AS n FROM bad GROUP BY ALL
UNION ALL SELECT 'edge', 'REV:'||event_id, 'IN_GENE not allowed between '||CASE WHEN g.id IS NULL THEN 'None' ELSE 'Gene' END||' and Variant', 1
 FROM events e LEFT JOIN gene g ON g.id='G'||e.user_id WHERE event_type='view'
UNION ALL SELECT 'node', id, 'claim missing model', 1 FROM claim WHERE pos=2""")
def _v01(t):
    claims = t.claim.withColumn("model", F.when(F.col("pos") != 2, "m")).withColumn("prompt_version", F.lit("v1"))
    reversed_edges = t.in_gene.join(t.variant.filter("classification = 'Likely pathogenic'").select(F.col("id").alias("src")), "src", "left_semi")
    edges = t.edges.unionByName(reversed_edges.selectExpr(
        "concat('REV:', seq) AS edge_id", "dst AS src", "src AS dst",
        *[c for c in t.edges.columns if c not in ("edge_id", "src", "dst")]))
    return V.schema_violations(EvidenceGraph(t.nodes, edges), claims).groupBy("what", "id", "reason").agg(F.count(F.lit(1)).alias("n"))


def _sources(t):
    """Source texts, from which every third document has lost its line breaks."""
    return t.table("documents").selectExpr(
        "concat('PMID:', doc_id) AS source_id",
        "CASE WHEN doc_id % 3 = 0 THEN replace(text, 'e', 'E') ELSE text END AS text")


@query("v02_unverified_claims", """
SELECT c.id, 'quote not found in source text' AS reason FROM claim c LEFT JOIN documents d ON d.doc_id=c.doc_id
WHERE c.quote='' OR NOT contains(CASE WHEN d.doc_id%3=0 THEN replace(text,'e','E') ELSE text END, c.quote)""")
def _v02(t):
    return V.unverified_claims(t.claim, _sources(t))


@query("v03_unsupported_inferences", UNSUPPORTED + "SELECT id, 'inferred edge without valid supporting claim' AS reason FROM unsup")
def _v03(t):
    return V.unsupported_inferences(t.graph)


@query("v04_single_weak_source", "SELECT edge_id AS id, 'only tier-3 source' AS reason FROM edges WHERE source_tier=3 AND status<>'observation'")
def _v04(t):
    return V.single_weak_source(t.edges)


@query("v05_same_gene_different_mechanism", """
, m AS (SELECT src, string_agg(DISTINCT dst, ',' ORDER BY dst) AS mechanisms FROM disrupts GROUP BY src),
tup AS (SELECT g.dst AS gene, coalesce(m.mechanisms,'') AS mechanisms, count(*) AS n_variants FROM in_gene g LEFT JOIN m ON m.src=g.src GROUP BY ALL)
SELECT * FROM tup WHERE gene IN (SELECT gene FROM tup GROUP BY gene HAVING count(*)>1)""")
def _v05(t):
    return V.same_gene_different_mechanism(t.graph)


@query("v06_clean_graph", TYPED + UNSUPPORTED + """
, lost AS (SELECT c.id FROM claim c LEFT JOIN documents d ON d.doc_id=c.doc_id
 WHERE NOT contains(CASE WHEN d.doc_id%3=0 THEN replace(text,'e','E') ELSE text END, c.quote)),
kept AS (SELECT * FROM edges WHERE edge_id NOT IN (SELECT id FROM bad) AND edge_id NOT IN (SELECT id FROM unsup)
 AND src NOT IN (SELECT id FROM lost) AND dst NOT IN (SELECT id FROM lost))
SELECT 'edge' AS what, rel AS key, count(*) AS n FROM kept GROUP BY ALL
UNION ALL SELECT 'node', type, count(*) FROM nodes WHERE id NOT IN (SELECT id FROM lost) GROUP BY ALL""")
def _v06(t):
    claims = t.claim.withColumn("model", F.lit("m")).withColumn("prompt_version", F.lit("v1"))
    g = V.clean_graph(t.graph, claims, _sources(t))
    edges = g.edges.groupBy(F.lit("edge").alias("what"), F.col("rel").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return edges.unionByName(g.nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n")))


@query("v07_missing_props_count", """
SELECT rel, count(*) FILTER (edge_id LIKE '%7') AS n_missing, count(*) AS n FROM edges GROUP BY rel""")
def _v07(t):
    holes = t.edges.withColumn("source", F.when(~F.col("edge_id").endswith("7"), F.col("source")))
    return V.missing_props_count(holes)


@query("v08_graph_profile", """
SELECT 'node' AS kind, type AS key, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY ALL
UNION ALL SELECT 'unnamed', type, count(*) FROM nodes WHERE name IS NULL OR name=id GROUP BY ALL""")
def _v08(t):
    return V.graph_profile(t.graph)


@query("v09_graph_summary", """
SELECT 'prov' AS part, rel||'/'||status||'/'||source_tier||'/'||method AS key, count(*) AS n FROM edges GROUP BY ALL
UNION ALL SELECT 'polarity', polarity||'/'||category, count(*) FROM claim GROUP BY ALL
UNION ALL SELECT 'disease', src||'/'||rel, count(*) FROM edges WHERE src IN (SELECT id FROM disease) GROUP BY ALL
UNION ALL SELECT 'disease', dst||'/claims', count(*) FROM about WHERE dst IN (SELECT id FROM disease) GROUP BY ALL
UNION ALL SELECT 'absent', k, 1 FROM (VALUES ('node/Study'),('node/PatientOrg'),('node/Registry'),('node/Researcher'),('node/Intervention'),
 ('node/Outcome'),('edge/AUTHORED'),('edge/STUDIES'),('edge/REPRESENTED_BY'),('edge/MAINTAINS')) v(k)""")
def _v09(t):
    part = lambda df, name, *keys: df.select(F.lit(name).alias("part"), F.concat_ws("/", *keys).alias("key"), F.col("n").cast("long").alias("n"))
    return (
        part(V.provenance_summary(t.edges), "prov", "rel", "status", "source_tier", "method")
        .unionByName(part(V.claim_polarity(t.claim), "polarity", "polarity", "category"))
        .unionByName(part(V.disease_summary(t.graph), "disease", "id", "rel"))
        .unionByName(part(V.absent_vocabulary(t.graph).withColumn("n", F.lit(1)), "absent", "kind", "key"))
    )


# ---------------------------------------------------------------- ranking

STARS = "CASE num%5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END"


@query("r01_review_stars", f"SELECT id, CAST({STARS} AS INTEGER) AS stars FROM variant")
def _r01(t):
    return t.variant.select("id", X.review_stars("review_status").alias("stars"))


SELECTED = f"""
, kept AS (SELECT *, {STARS} AS stars FROM variant WHERE classification IN ('Pathogenic','Likely pathogenic','Pathogenic/Likely pathogenic') AND num%7<>0),
sel AS (SELECT * FROM (SELECT gene AS symbol, id, stars, consequence, CAST(row_number() OVER (PARTITION BY gene ORDER BY stars DESC, last_evaluated DESC, id) AS INTEGER) AS rank FROM kept) WHERE rank<=20)
"""


def _records(t):
    return t.variant.withColumnRenamed("gene", "symbol").withColumnRenamed("id", "variation_id")


@query("r02_select_variants", SELECTED + "SELECT symbol, id AS variation_id, rank FROM sel")
def _r02(t):
    return R.select_variants(_records(t), 20).select("symbol", "variation_id", "rank")


@query("r03_variant_report", SELECTED + """
SELECT v.symbol, v.n_found, coalesce(n_kept,0) AS n_kept, coalesce(n_two_stars,0) AS n_two_stars, coalesce(n_loss,0) AS n_loss FROM
(SELECT gene AS symbol, count(*) AS n_found FROM variant GROUP BY gene) v LEFT JOIN
(SELECT symbol, count(*) AS n_kept, count(*) FILTER (stars>=2) AS n_two_stars,
 count(*) FILTER (contains(consequence,'nonsense') OR contains(consequence,'frameshift') OR contains(consequence,'splice')) AS n_loss FROM sel GROUP BY symbol) s ON s.symbol=v.symbol""")
def _r03(t):
    return R.variant_report(_records(t), R.select_variants(_records(t), 20))


RANKED = """
, lit AS (SELECT dst AS id, least(count(*)*5,10) AS p FROM (SELECT dst FROM about UNION ALL SELECT 'V'||(doc_id*10+1) FROM claim) GROUP BY dst),
mech AS (SELECT DISTINCT src AS id FROM disrupts),
sv AS (SELECT v.*, CASE lower(classification) WHEN 'pathogenic' THEN 30 WHEN 'likely pathogenic' THEN 24 WHEN 'uncertain significance' THEN 9 WHEN 'benign' THEN 0 ELSE 6 END
 + CASE num%5 WHEN 0 THEN 15 WHEN 1 THEN 14 WHEN 2 THEN 11 WHEN 3 THEN 6 ELSE 1 END
 + CASE num%6 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 20 WHEN 3 THEN 18 WHEN 4 THEN 2 ELSE 0 END
 + coalesce(lit.p,0) + CASE WHEN m.id IS NOT NULL THEN 5 ELSE 0 END AS base
 FROM variant v LEFT JOIN lit ON lit.id=v.id LEFT JOIN mech m ON m.id=v.id),
ranked AS (SELECT * FROM (SELECT a.src AS disease, a.dst AS gene, v.id AS variant, v.name,
  CAST(least(v.base+20,100) AS INTEGER) AS score,
  CAST(row_number() OVER (PARTITION BY a.src ORDER BY least(v.base+20,100) DESC, v.name, v.id) AS INTEGER) AS rank
  FROM associated_with a JOIN sv v ON v.gene=a.dst) WHERE rank<=5)
"""


def _ranked(t):
    claims = t.claim.selectExpr(
        "concat('ABOUTV:', id) AS edge_id", "id AS src", "concat('V', doc_id * 10 + 1) AS dst", "'ABOUT' AS rel")
    edges = t.edges.select("edge_id", "src", "dst", "rel").unionByName(claims)
    return R.rank_variants(EvidenceGraph(t.nodes, edges), t.disease, t.variant, 5)


@query("r04_rank_variants", RANKED + "SELECT disease, variant, score, rank FROM ranked")
def _r04(t):
    return _ranked(t).select("disease", "variant", F.col("score").cast("int").alias("score"), "rank")


@query("r05_attach_top_variants", RANKED + """
SELECT r.gene, r.disease, r.variant, r.rank FROM ranked r JOIN (SELECT gene, max(disease) AS disease FROM ranked GROUP BY gene) l ON l.gene=r.gene AND l.disease=r.disease""")
def _r05(t):
    return R.attach_top_variants(_ranked(t)).select("gene", "disease", "variant", "rank")


@query("r06_select_trials", """
, tr AS (SELECT 'D'||l_orderkey AS entity, 'N'||l_suppkey AS nct, l_linenumber, l_returnflag, l_linestatus, l_shipdate, l_partkey,
  row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rn FROM lineitem),
m AS (SELECT t.*, d.name, d.short, CASE WHEN l_partkey%3=0 THEN 'lists “'||d.name||'”' WHEN l_partkey%3=1 THEN 'mentions the gene '||d.short END AS why
  FROM tr t JOIN disease d ON d.id=t.entity WHERE rn=1),
r AS (SELECT entity, nct, why, CAST(row_number() OVER (PARTITION BY entity ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 3 ELSE 9 END,
  year(l_shipdate) DESC, strftime(l_shipdate,'%Y-%m'), nct) AS INTEGER) AS rank FROM m WHERE why IS NOT NULL)
SELECT * FROM r WHERE rank<=3""")
def _r06(t):
    entities = t.disease.selectExpr("id AS entity", "name", "array('short', 'ABCDEFG') AS synonyms", "short AS gene")
    trials = t.table("lineitem").join(
        t.disease.selectExpr("num AS l_orderkey", "name AS dname", "short"), "l_orderkey"
    ).selectExpr(
        "concat('D', l_orderkey) AS entity", "struct(l_linenumber, l_partkey, l_extendedprice) AS seq",
        "concat('N', l_suppkey) AS nct", "concat('study ', l_suppkey) AS title", "'' AS official_title",
        "CASE l_partkey % 3 WHEN 0 THEN array('other', upper(dname)) WHEN 1 THEN array(concat('gene (', short, ')')) "
        "ELSE array(concat(short, 'x')) END AS conditions",
        "CASE l_returnflag WHEN 'R' THEN 'RECRUITING' WHEN 'A' THEN 'COMPLETED' ELSE 'WITHDRAWN' END AS status",
        "date_format(l_shipdate, 'yyyy-MM') AS start")
    return R.select_trials(entities, trials, 3).select("entity", "nct", "why", "rank")


@query("r07_select_grants", """
, hit AS (SELECT gene, core_project, fiscal_year, value, event_id, event_id%4=1 AS in_title FROM grants WHERE event_id%4 IN (1,2)),
lat AS (SELECT *, row_number() OVER (PARTITION BY gene, core_project ORDER BY fiscal_year DESC, event_id) AS rn FROM hit),
r AS (SELECT gene, 'GR'||event_id AS id, CAST(row_number() OVER (PARTITION BY gene ORDER BY in_title DESC, fiscal_year DESC, value DESC, event_id) AS INTEGER) AS rank FROM lat WHERE rn=1)
SELECT * FROM r WHERE rank<=3""")
def _r07(t):
    grants = t.grant.selectExpr(
        "gene", "id", "event_id AS seq", "core_project AS core_project_num", "id AS project_num",
        "CASE event_id % 4 WHEN 1 THEN concat(lower(gene), ' function') ELSE 'model systems' END AS project_title",
        "CASE event_id % 4 WHEN 2 THEN concat('we study ', gene, '.') WHEN 3 THEN concat(gene, 'alpha') END AS abstract_text",
        "fiscal_year", "value AS award_amount")
    return R.select_grants(grants, 3).select("gene", "id", "rank")


@query("r08_org_focus", """
SELECT c_custkey, CASE c_custkey%6 WHEN 0 THEN 'Disease-specific' WHEN 1 THEN 'Epilepsy' WHEN 2 THEN 'Autism' WHEN 3 THEN 'Rare diseases (general)'
 ELSE 'Children & disability' END AS focus FROM customer""")
def _r08(t):
    named = t.table("customer").selectExpr("c_custkey", "concat(element_at(array('Dravet Foundation', 'EPILEPSY action', 'Autism Alliance', "
                                           "'Genetic Alliance', 'Kids first', 'Helping hands'), cast(c_custkey % 6 AS int) + 1), ' ', c_custkey) AS name")
    return named.select("c_custkey", X.org_focus("name").alias("focus"))


@query("r09_org_scope", """
, links AS (SELECT src, dst FROM represented_by UNION SELECT id, 'O-ALL' FROM disease),
n AS (SELECT dst AS id, count(DISTINCT src) AS n_diseases, count(DISTINCT src) FILTER (src IN (SELECT id FROM disease WHERE num%2=0)) AS nc FROM links GROUP BY dst)
SELECT id, n_diseases, CASE WHEN nc=(SELECT count(*) FROM disease WHERE num%2=0) THEN 'umbrella' WHEN n_diseases>1 THEN 'shared' ELSE 'specific' END AS scope FROM n""")
def _r09(t):
    links = t.represented_by.unionByName(t.disease.selectExpr("id AS src", "'O-ALL' AS dst"))
    orgs = links.select(F.col("dst").alias("id")).distinct().withColumn("name", F.col("id")).withColumn("directory", F.lit("Orphanet"))
    return R.org_scope(links, orgs, t.disease.filter("num % 2 = 0")).select("id", "n_diseases", "scope")


@query("r10_two_entity_subgraph", """
, pick AS (SELECT unnest(['D10','D20']) AS id),
near AS (SELECT dst AS id FROM edges WHERE src IN (SELECT id FROM pick) UNION SELECT src FROM edges WHERE dst IN (SELECT id FROM pick) UNION SELECT id FROM pick)
SELECT 'node' AS what, id AS key, count(*) AS n FROM nodes WHERE id IN (SELECT id FROM near) GROUP BY ALL
UNION ALL SELECT 'edge', edge_id, count(*) FROM edges WHERE src IN (SELECT id FROM near) AND dst IN (SELECT id FROM near) GROUP BY ALL""")
def _r10(t):
    g = R.two_entity_subgraph(t.graph, "D10", "D20")
    nodes = g.nodes.groupBy(F.lit("node").alias("what"), F.col("id").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.unionByName(g.edges.groupBy(F.lit("edge").alias("what"), F.col("edge_id").alias("key")).agg(F.count(F.lit(1)).alias("n")))
