"""Queries for normalisation, identity resolution and matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from corrobora.functions import text as X
from corrobora.operators import resolve as N
from corrobora.plans.registry import query

BASE = "https://reports.example.org/rare-diseases/"


@query("n01_norm_name", r"SELECT doc_id, md5(trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'),' ')) AS norm FROM documents")
def _n01(t):
    return t.table("documents").select("doc_id", F.md5(X.norm_name("text")).alias("norm"))


@query("n02_norm_mention", r"SELECT id, md5(trim(regexp_replace(replace(lower(quote),'ß','ss'),'[\s\x0b\x1c-\x1f\x85\xa0]+',' ','g'),' ')) AS norm FROM claim")
def _n02(t):
    return t.claim.select("id", F.md5(X.norm_mention("quote")).alias("norm"))


@query("n03_norm_xref", """
SELECT o_orderkey, CASE o_orderkey%3 WHEN 0 THEN 'ORPHA:'||o_custkey WHEN 1 THEN 'ORPHA:'||o_custkey ELSE 'OMIM:'||o_custkey END AS xref FROM orders""")
def _n03(t):
    raw = t.table("orders").selectExpr("o_orderkey", "concat(element_at(array('Orphanet:', 'ORPHANET:', 'OMIM:'), cast(o_orderkey % 3 AS int) + 1), o_custkey) AS x")
    return raw.select("o_orderkey", X.norm_xref("x").alias("xref"))


@query("n04_slug", r"SELECT p_partkey, trim(regexp_replace(lower(p_name||' & ('||p_brand||')'),'[^a-z0-9]+','-','g'),'-') AS slug FROM part")
def _n04(t):
    return t.table("part").select("p_partkey", X.slug(F.expr("concat(p_name, ' & (', p_brand, ')')")).alias("slug"))


@query("n05_curie", "SELECT p_partkey, CASE WHEN p_partkey%4=0 THEN NULL ELSE 'HP:'||p_partkey END AS curie FROM part")
def _n05(t):
    return t.table("part").select("p_partkey", X.curie(F.expr(
        "concat('http://purl.example.org/obo/', CASE WHEN p_partkey % 4 = 0 THEN 'plain' ELSE 'HP_' END, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE cast(p_partkey AS string) END)")).alias("curie"))


def _onto_nodes(t):
    """Parts as ontology records: two neighbours share a label, every fifth is deprecated."""
    return t.table("part").selectExpr(
        "concat('P', p_partkey) AS id", "concat(p_name, ' ', p_partkey div 2) AS label",
        "array(concat(p_type, '-', p_partkey), concat(p_brand, '/', p_partkey)) AS synonyms",
        "array(concat('OMIM:', p_partkey), concat('ORPHA:', p_partkey div 3)) AS xrefs", "p_partkey % 5 = 0 AS deprecated",
        "concat('definition mentions G', p_size) AS definition", "p_partkey AS num")


ALIAS = r"""
, nrm AS (SELECT 'P'||p_partkey AS id, trim(regexp_replace(lower(x),'[^a-z0-9]+',' ','g'),' ') AS key FROM (SELECT p_partkey,
  unnest([p_name||' '||(p_partkey//2), p_type||'-'||p_partkey, p_brand||'/'||p_partkey, 'OMIM:'||p_partkey, 'ORPHA:'||(p_partkey//3)]) AS x
  FROM part WHERE p_partkey%5<>0)),
idx AS (SELECT DISTINCT key, id FROM nrm)
"""


@query("n06_build_alias_index", ALIAS + "SELECT * FROM idx")
def _n06(t):
    return N.build_alias_index(_onto_nodes(t))


@query("n07_resolve_alias", ALIAS + r"""
, m AS (SELECT p_partkey, upper(p_name)||'  '||(p_partkey//2) AS mention FROM part),
k AS (SELECT key, count(*) AS n, min(id) AS onl FROM idx GROUP BY key)
SELECT m.p_partkey, coalesce(n,0) AS n, CASE WHEN n=1 THEN onl END AS id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n=1 THEN 'resolved' ELSE 'ambiguous' END AS status
FROM m LEFT JOIN k ON k.key=trim(regexp_replace(lower(mention),'[^a-z0-9]+',' ','g'),' ')""")
def _n07(t):
    mentions = t.table("part").selectExpr("p_partkey", "concat(upper(p_name), '  ', p_partkey div 2) AS mention")
    return N.resolve_alias(mentions, N.build_alias_index(_onto_nodes(t))).select("p_partkey", "n", "id", "status")


def _seeds(t):
    return t.table("supplier").selectExpr(
        "concat('P', s_suppkey * 21) AS mondo", "array(concat('G', s_nationkey), 'GX') AS genes",
        "CASE WHEN s_suppkey % 4 = 0 THEN array(concat('Orphanet:', s_suppkey)) ELSE cast(array() AS array<string>) END AS extra_xrefs")


def _resolved(t):
    return N.resolve_seeds(_seeds(t), _onto_nodes(t))


SEEDS = """
, seed AS (SELECT s_suppkey AS k, 'P'||(s_suppkey*21) AS id, s_nationkey, CASE WHEN s_suppkey%4=0 THEN 'ORPHA:'||s_suppkey END AS manual,
  p.p_partkey, p.p_size, p.p_partkey IS NOT NULL AS found FROM supplier LEFT JOIN part p ON p.p_partkey=s_suppkey*21),
ids AS (SELECT DISTINCT id AS mondo, x AS source_id FROM (SELECT id, unnest(['OMIM:'||p_partkey,'ORPHA:'||(p_partkey//3),manual]) AS x FROM seed WHERE found) WHERE x IS NOT NULL),
ann AS (SELECT CASE WHEN l_partkey%2=0 THEN 'OMIM:'||l_partkey ELSE 'ORPHA:'||(l_partkey//3) END AS database_id, 'HP:'||l_suppkey AS hpo_id, l_returnflag AS evidence FROM lineitem),
ph AS (SELECT mondo, source_id, hpo_id, evidence FROM ids JOIN ann ON ann.database_id=ids.source_id)
"""


def _annotations(t):
    return t.table("lineitem").selectExpr(
        "CASE WHEN l_partkey % 2 = 0 THEN concat('OMIM:', l_partkey) ELSE concat('ORPHA:', l_partkey div 3) END AS database_id",
        "concat('HP:', l_suppkey) AS hpo_id", "'' AS frequency", "l_returnflag AS evidence", "'ref' AS reference")


@query("n08_resolve_seeds", SEEDS + """
SELECT id, found, CASE WHEN found THEN 'OMIM:'||p_partkey ELSE '' END AS omim, CASE WHEN found THEN 'ORPHA:'||(p_partkey//3) ELSE '' END AS orpha, '' AS gard, coalesce(manual,'') AS manual FROM seed""")
def _n08(t):
    j = lambda c, a: F.array_join(c, ",").alias(a)
    return _resolved(t).select("id", "found", j("omim", "omim"), j("orpha", "orpha"), j("gard", "gard"), j("manual_xrefs", "manual"))


@query("n09_join_annotations", SEEDS + "SELECT mondo, source_id, hpo_id, evidence, count(*) AS n FROM ph GROUP BY ALL")
def _n09(t):
    return N.join_annotations(_resolved(t), _annotations(t)).groupBy("mondo", "source_id", "hpo_id", "evidence").agg(F.count(F.lit(1)).alias("n"))


@query("n10_terms_by_source", SEEDS + "SELECT mondo, source_id, count(DISTINCT hpo_id) AS n_terms FROM ph GROUP BY ALL")
def _n10(t):
    return N.terms_by_source(N.join_annotations(_resolved(t), _annotations(t)))


@query("n11_gene_mentioned", SEEDS + """
SELECT id, 'G'||s_nationkey AS gene, s_nationkey=p_size AS mentioned FROM seed WHERE found UNION ALL SELECT id, 'GX', false FROM seed WHERE found""")
def _n11(t):
    return N.gene_mentioned(_resolved(t))


@query("n12_coverage_report", SEEDS + """
SELECT id, found, CASE WHEN found THEN 1 END AS n_omim, CASE WHEN found THEN 1 END AS n_orpha, CASE WHEN found THEN 0 END AS n_gard, CASE WHEN found THEN 2 END AS n_synonyms,
CASE WHEN found THEN (SELECT count(DISTINCT hpo_id) FROM ph WHERE ph.mondo=seed.id) END AS n_terms FROM seed""")
def _n12(t):
    return N.coverage_report(_resolved(t), N.join_annotations(_resolved(t), _annotations(t)))


@query("n12_coverage_gaps", SEEDS + """
SELECT id, 'no annotations' AS gap FROM seed WHERE found AND id NOT IN (SELECT mondo FROM ph) UNION ALL SELECT id, 'gene not mentioned' FROM seed WHERE found
UNION ALL SELECT id, 'manual xrefs used' FROM seed WHERE found AND manual IS NOT NULL UNION ALL SELECT id, 'several source ids' FROM seed WHERE found""")
def _n12b(t):
    return N.coverage_gaps(_resolved(t), N.join_annotations(_resolved(t), _annotations(t)))


def _gene_docs(t):
    """Customers as gene records; aliases and previous symbols overlap between neighbours."""
    return t.table("customer").selectExpr(
        "concat('HGNC:', c_custkey) AS hgnc_id", "concat('GN', c_custkey) AS symbol", "c_name AS name",
        "array(concat('AL', c_custkey div 2)) AS alias_symbol", "array(concat('PV', c_custkey), concat('al', c_custkey)) AS prev_symbol",
        "CASE WHEN c_custkey % 10 = 0 THEN 'Entry Withdrawn' ELSE 'Approved' END AS status",
        "array(concat('AL', c_custkey div 2), concat('PV', c_custkey)) AS aliases", "false AS ambiguous")


def _symbols(t):
    return t.table("orders").selectExpr("concat(element_at(array('GN', 'gn', 'AL', 'al', 'pv'), cast(o_orderkey % 5 AS int) + 1), o_custkey) AS input").distinct()


GENES = """
, sym AS (SELECT DISTINCT (['GN','gn','AL','al','pv'])[o_orderkey%5+1]||o_custkey AS input FROM orders),
idx AS (SELECT DISTINCT * FROM (SELECT 'GN'||c_custkey AS key, c_custkey AS c, 0 AS tier, 'symbol' AS match FROM customer
 UNION ALL SELECT 'AL'||(c_custkey//2), c_custkey, 2, 'alias' FROM customer
 UNION ALL SELECT 'PV'||c_custkey, c_custkey, 4, 'previous' FROM customer UNION ALL SELECT 'al'||c_custkey, c_custkey, 4, 'previous' FROM customer)),
h AS (SELECT input, c, match, tier AS step FROM sym JOIN idx ON key=input UNION ALL SELECT input, c, match, tier+1 FROM sym JOIN idx ON key=upper(input) WHERE upper(input)<>input),
w AS (SELECT DISTINCT input, match, c FROM h JOIN (SELECT input AS i, min(step) AS s FROM h GROUP BY input) b ON b.i=h.input AND b.s=h.step),
res AS (SELECT input, match, 'HGNC:'||c AS hgnc_id, 'GN'||c AS symbol, count(*) OVER (PARTITION BY input)>1 AS ambiguous, c FROM w)
"""


@query("n13_resolve_genes", GENES + "SELECT input, match, hgnc_id, symbol, ambiguous FROM res")
def _n13(t):
    return N.resolve_genes(_symbols(t), _gene_docs(t))


@query("n14_gene_problems", GENES + """
SELECT input, 'not found' AS problem FROM sym WHERE input NOT IN (SELECT input FROM res) UNION ALL SELECT DISTINCT input, 'ambiguous' FROM res WHERE ambiguous
UNION ALL SELECT input, 'renamed' FROM res WHERE NOT ambiguous AND symbol<>input UNION ALL SELECT input, 'not approved' FROM res WHERE NOT ambiguous AND c%10=0""")
def _n14(t):
    return N.gene_problems(_symbols(t), N.resolve_genes(_symbols(t), _gene_docs(t)), _gene_docs(t))


@query("n15_gene_alias_map", r"""
SELECT DISTINCT trim(regexp_replace(lower(x),'[^a-z0-9]+',' ','g'),' ') AS alias, 'HGNC:'||c_custkey AS hgnc_id
FROM (SELECT c_custkey, unnest(['GN'||c_custkey, c_name, 'AL'||(c_custkey//2), 'PV'||c_custkey]) AS x FROM customer)""")
def _n15(t):
    return N.gene_alias_map(_gene_docs(t))


def _vocabulary(t):
    nodes = _onto_nodes(t).withColumn("exact_synonyms", F.slice("synonyms", 1, 1))
    return N.build_vocabulary("Phenotype", nodes).unionByName(N.gene_vocabulary(_gene_docs(t)))


VOCAB = r"""
, voc AS (SELECT DISTINCT 'Phenotype' AS kind, lower(x) AS key, 'P'||p_partkey AS id, p_name||' '||(p_partkey//2) AS label FROM (SELECT p_partkey, p_name,
  unnest(['P'||p_partkey, p_name||' '||(p_partkey//2), p_type||'-'||p_partkey]) AS x FROM part WHERE p_partkey%5<>0)
  UNION SELECT DISTINCT 'Gene', lower(x), 'HGNC:'||c_custkey, 'GN'||c_custkey FROM (SELECT c_custkey,
  unnest(['HGNC:'||c_custkey,'GN'||c_custkey,c_name,'AL'||(c_custkey//2),'PV'||c_custkey]) AS x FROM customer WHERE c_custkey%10<>0))
"""


@query("n16_build_vocabulary", VOCAB + "SELECT * FROM voc")
def _n16(t):
    return _vocabulary(t)


def _mentions(t):
    return t.table("part").selectExpr("p_partkey", "'Phenotype' AS kind", "concat(upper(p_name), ' ', p_partkey div 2 + p_partkey % 3) AS mention").unionByName(
        t.table("customer").selectExpr("c_custkey AS p_partkey", "'Gene' AS kind", "concat('al', c_custkey) AS mention"))


@query("n17_resolve_mentions", VOCAB + """
, m AS (SELECT p_partkey, 'Phenotype' AS kind, upper(p_name)||' '||(p_partkey//2+p_partkey%3) AS mention FROM part UNION ALL SELECT c_custkey, 'Gene', 'al'||c_custkey FROM customer),
k AS (SELECT kind, key, count(DISTINCT id) AS n, min(id) AS onl FROM voc GROUP BY ALL)
SELECT m.kind, p_partkey, mention, coalesce(n,0) AS n_candidates, CASE WHEN n=1 THEN onl END AS canonical_id,
CASE WHEN n=1 THEN 'resolved' WHEN n>1 THEN 'ambiguous' ELSE 'unresolved' END AS status FROM m LEFT JOIN k ON k.kind=m.kind AND k.key=lower(mention)""")
def _n17(t):
    return N.resolve_mentions(_mentions(t), _vocabulary(t)).select("kind", "p_partkey", "mention", "n_candidates", "canonical_id", "status")


@query("n18_suggest_candidates")
def _n18(t):
    """Labels, found by all of their words, and misspelt mentions of them."""
    words = "concat('wa', hex(p_partkey div 7), 'k xo', hex(p_partkey div 5), 'm')"
    vocabulary = N.build_vocabulary("Phenotype", t.table("part").selectExpr(
        "concat('P', p_partkey) AS id", f"concat({words}, ' ', p_name) AS label", "false AS deprecated", "cast(array() AS array<string>) AS exact_synonyms")
    )
    mentions = t.table("part").selectExpr("'Phenotype' AS kind", f"concat({words}, ' ', substr(p_name, 2)) AS mention")
    return N.suggest_candidates(mentions, vocabulary)


@query("n19_search_catalog", """
SELECT p_partkey, CAST(CASE WHEN p_name='small ring' OR p_brand='Brand#7' THEN 0 ELSE 1 END AS INTEGER) AS tier FROM part
WHERE p_name='small ring' OR contains(p_name,'small ring') ORDER BY tier, p_partkey LIMIT 20""")
def _n19(t):
    catalog = t.table("part").selectExpr("p_partkey", "p_partkey AS seq", "p_name AS name", "array(p_type) AS aliases")
    return N.search_catalog(catalog, " Small Ring ").select("p_partkey", "tier")


def _communities(t):
    return t.table("supplier").selectExpr(
        "concat('community-', s_suppkey) AS slug", "concat('Disorder Group ', s_suppkey) AS name", "s_name AS default_name",
        "concat('for nation ', s_nationkey) AS description", "cast(s_acctbal AS int) AS total_members")


@query("n20_search_communities", """
SELECT slug, tier FROM (SELECT 'community-'||s_suppkey AS slug, CAST(s_acctbal AS INTEGER) AS m, 'disorder group '||s_suppkey AS name,
 CASE WHEN contains('disorder group '||s_suppkey,'1') OR contains(lower(s_name),'1') THEN 1 WHEN contains('for nation '||s_nationkey,'1') THEN 2 END AS tier,
 trunc(s_acctbal) AS tm FROM supplier) WHERE tier IS NOT NULL ORDER BY tier, tm DESC, name, slug LIMIT 20""")
def _n20(t):
    return N.search_communities(_communities(t), "1").select("slug", "tier")


@query("n21_get_by_slug", "SELECT 'community-'||s_suppkey AS slug FROM supplier WHERE s_suppkey IN (SELECT c_custkey*2 FROM customer)")
def _n21(t):
    slugs = t.table("customer").selectExpr("concat(' COMMUNITY-', c_custkey * 2, ' ') AS slug")
    return N.get_by_slug(_communities(t), slugs).select("slug")


@query("n21_get_by_padded_id", "SELECT min(p_partkey) AS p_partkey FROM part WHERE p_partkey//2 IN (SELECT s_suppkey*3 FROM supplier) GROUP BY p_partkey//2")
def _n21b(t):
    catalog = t.table("part").selectExpr("p_partkey", "p_partkey AS seq", "lpad(cast(p_partkey div 2 AS string), 7, '0') AS gard_id")
    ids = t.table("supplier").selectExpr("concat('00', s_suppkey * 3, ' ') AS id")
    return N.get_by_padded_id(catalog, ids).select("p_partkey")


def _slug_map(t):
    return t.table("supplier").selectExpr("s_suppkey AS seq", "concat('syndrome ', lpad(s_suppkey, 6, '0')) AS key",
                                          f"concat('{BASE}syndrome-', lpad(s_suppkey, 6, '0'), '/') AS url")


REPORT = f"""
, sm AS (SELECT s_suppkey AS seq, 'syndrome '||lpad(s_suppkey::VARCHAR,6,'0') AS key, '{BASE}syndrome-'||lpad(s_suppkey::VARCHAR,6,'0')||'/' AS url FROM supplier),
qq AS (SELECT DISTINCT CASE c_custkey%4 WHEN 0 THEN 'https://x.org/'||c_custkey WHEN 1 THEN 'Syndrome '||lpad(c_custkey::VARCHAR,6,'0')
  WHEN 2 THEN 'the syndrome '||lpad(c_custkey::VARCHAR,6,'0')||' type' ELSE lpad(c_custkey::VARCHAR,6,'0') END AS query FROM customer),
opt AS (SELECT query, 0 AS tier, 0 AS seq, query||'/' AS url FROM qq WHERE query LIKE 'https%'
 UNION ALL SELECT query, CASE WHEN lower(query)=key THEN 1 ELSE 3 END, seq, url FROM qq JOIN sm ON contains(key,lower(query)) OR contains(lower(query),key) WHERE query NOT LIKE 'https%'
 UNION ALL SELECT query, 4, 0, '{BASE}'||replace(lower(query),' ','-')||'/' FROM qq WHERE query NOT LIKE 'https%'),
best AS (SELECT query, tier, url FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY tier, seq) AS rn FROM opt) WHERE rn=1)
"""


def _report_queries(t):
    return t.table("customer").selectExpr(
        "CASE c_custkey % 4 WHEN 0 THEN concat('https://x.org/', c_custkey) WHEN 1 THEN concat('Syndrome ', lpad(c_custkey, 6, '0')) "
        "WHEN 2 THEN concat('the syndrome ', lpad(c_custkey, 6, '0'), ' type') ELSE lpad(c_custkey, 6, '0') END AS query", "c_custkey")


@query("n22_resolve_report_url", REPORT + "SELECT query, CAST(tier AS INTEGER) AS tier, url FROM best")
def _n22(t):
    return N.resolve_report_url(_report_queries(t).select("query"), _slug_map(t), BASE)


@query("n23_trusted_url_only", REPORT + """
SELECT c_custkey//4 AS entity, arg_min(url, c_custkey%4) AS url FROM (SELECT c_custkey, CASE c_custkey%4 WHEN 0 THEN 'https://x.org/'||c_custkey WHEN 1 THEN 'Syndrome '||lpad(c_custkey::VARCHAR,6,'0')
  WHEN 2 THEN 'the syndrome '||lpad(c_custkey::VARCHAR,6,'0')||' type' ELSE lpad(c_custkey::VARCHAR,6,'0') END AS query FROM customer) c
JOIN best ON best.query=c.query WHERE url IN (SELECT url FROM sm) AND c_custkey%4<3 GROUP BY 1""")
def _n23(t):
    terms = _report_queries(t).selectExpr("c_custkey div 4 AS entity", "cast(c_custkey % 4 AS int) AS pos", "query AS term")
    return N.trusted_url_only(terms, _slug_map(t), BASE, tries=3).select("entity", "url")


@query("n24_specific_terms", """
SELECT o_orderkey, array_to_string(CASE WHEN o_orderkey%2=0 THEN [o_orderpriority||' disorder', 'Longer name '||o_custkey] ELSE [o_orderpriority||' disorder','abcdef'] END, '|') AS terms FROM orders""")
def _n24(t):
    src = t.table("orders").selectExpr("o_orderkey", "concat(o_orderpriority, ' disorder') AS name",
        "CASE WHEN o_orderkey % 2 = 0 THEN array('DS', 'ABCDEFGH', concat('Longer name ', o_custkey), concat('LONGER name ', o_custkey)) "
        "ELSE array(upper(concat(o_orderpriority, ' disorder')), 'abcdef', 'short', 'Abcdef') END AS synonyms")
    return src.select("o_orderkey", F.array_join(X.specific_terms("name", "synonyms"), "|").alias("terms"))


@query("n25_match_reason", """
SELECT o_orderkey, CASE o_orderkey%4 WHEN 0 THEN 'lists “Alpha syndrome”' WHEN 1 THEN 'lists “beta”' WHEN 2 THEN 'mentions the gene C'||o_custkey END AS why FROM orders""")
def _n25(t):
    src = t.table("orders").selectExpr("o_orderkey", "array('Alpha syndrome', 'beta') AS terms", "concat('C', o_custkey) AS gene",
        "CASE o_orderkey % 4 WHEN 0 THEN array('x', 'ALPHA SYNDROME and Beta') WHEN 1 THEN array('Beta carriers', concat('C', o_custkey)) "
        "WHEN 2 THEN array(concat('(c', o_custkey, ')')) ELSE array(concat('c', o_custkey, 'z')) END AS texts")
    return src.select("o_orderkey", X.match_reason("texts", "terms", "gene").alias("why"))


@query("n26_orpha_code", """
SELECT 'D'||o_orderkey AS entity, CASE WHEN o_orderkey%3=0 THEN CAST(o_custkey AS VARCHAR) WHEN o_orderkey%5=0 THEN 'F'||o_orderkey END AS code,
 CASE WHEN o_orderkey%3<>0 AND o_orderkey%5=0 THEN 'closest entry' END AS closest FROM orders""")
def _n26(t):
    entities = t.table("orders").selectExpr("concat('D', o_orderkey) AS entity",
        "CASE WHEN o_orderkey % 3 = 0 THEN array('OMIM:1', concat('Orphanet:', o_custkey), 'ORPHA:9') ELSE array('OMIM:2') END AS xrefs")
    fallback = t.table("orders").filter("o_orderkey % 5 = 0").selectExpr("concat('D', o_orderkey) AS entity", "concat('F', o_orderkey) AS code", "'closest entry' AS closest")
    return N.orpha_code(entities, fallback)


@query("n27_match_communities", """
, ent AS (SELECT c_custkey AS entity, 'disorder group '||c_custkey AS term, CASE WHEN c_custkey%2=0 THEN 'g'||c_custkey ELSE 'grinx'||c_custkey END AS gene FROM customer),
com AS (SELECT 'community-'||s_suppkey AS slug, CASE s_suppkey%3 WHEN 0 THEN 'disorder group '||s_suppkey WHEN 1 THEN 'the disorder group '||s_suppkey||' families' ELSE CASE WHEN s_suppkey%2=0 THEN 'families of (g'||s_suppkey||')' ELSE 'the mygrinx'||s_suppkey||'foo group' END END AS name FROM supplier)
SELECT DISTINCT entity, slug FROM ent JOIN com ON contains(name, term) OR regexp_matches(name, '\\b'||gene||'\\b') OR (length(gene)>5 AND contains(name, gene))""")
def _n27(t):
    entities = t.table("customer").selectExpr("c_custkey AS entity", "concat('Disorder group ', c_custkey) AS name", "array('DG') AS synonyms", "concat(CASE WHEN c_custkey % 2 = 0 THEN 'G' ELSE 'GRINX' END, c_custkey) AS gene")
    communities = t.table("supplier").selectExpr("concat('community-', s_suppkey) AS slug", "'' AS default_name",
        "CASE s_suppkey % 3 WHEN 0 THEN concat('Disorder Group ', s_suppkey) WHEN 1 THEN concat('The disorder group ', s_suppkey, ' families') "
        "ELSE CASE WHEN s_suppkey % 2 = 0 THEN concat('Families of (G', s_suppkey, ')') ELSE concat('The myGRINX', s_suppkey, 'foo group') END END AS name")
    return N.match_communities(entities, communities)


@query("n28_norm_intervention", """
SELECT p_partkey, CASE p_partkey%5 WHEN 0 THEN 'RC'||p_partkey WHEN 1 THEN upper(p_name[1])||p_name[2:] WHEN 2 THEN 'Drug '||p_partkey
 WHEN 3 THEN 'Zan-x'||p_partkey ELSE 'Arm A' END AS label FROM part""")
def _n28(t):
    raw = t.table("part").selectExpr("p_partkey",
        "CASE p_partkey % 5 WHEN 0 THEN concat('RC', p_partkey, ' injection-Fixed Dose') WHEN 1 THEN concat(p_name, ' (blinded) 20 mg daily') "
        "WHEN 2 THEN concat('Drug ', p_partkey, ' oral solution, low dose') WHEN 3 THEN concat('Zan-x', p_partkey, ' - open label') ELSE 'Arm A: cohort 1' END AS name")
    return raw.select("p_partkey", X.intervention_label("name").alias("label"))


@query("n29_apply_reviewed_alias", """
SELECT o_orderkey, CASE WHEN o_orderkey%4=0 THEN 'KNOWN' WHEN kind='Disease' AND o_custkey%2=0 THEN 'D'||o_custkey END AS canonical_id,
 CASE WHEN o_orderkey%4<>0 AND kind='Disease' AND o_custkey%2=0 THEN 'reviewed_alias' ELSE 'exact_label_or_synonym' END AS method
FROM (SELECT *, CASE WHEN o_orderkey%3=0 THEN 'Gene' ELSE 'Disease' END AS kind FROM orders)""")
def _n29(t):
    entities = t.table("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 3 = 0 THEN 'Gene' ELSE 'Disease' END AS kind",
        "concat('Mention  ', o_custkey) AS mention", "CASE WHEN o_orderkey % 4 = 0 THEN 'KNOWN' END AS canonical_id",
        "CASE WHEN o_orderkey % 4 = 0 THEN 'resolved' ELSE 'unresolved' END AS status")
    aliases = t.table("customer").selectExpr("concat('mention ', c_custkey) AS mention", "concat('D', c_custkey) AS canonical_id",
        "CASE WHEN c_custkey % 2 = 0 THEN 'reviewer' ELSE ' ' END AS reviewer", "'' AS note")
    return N.apply_reviewed_alias(entities, aliases).select("o_orderkey", "canonical_id", "method")
