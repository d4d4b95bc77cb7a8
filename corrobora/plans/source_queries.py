"""Queries for sources, graph construction and sinks. Feed documents are derived from the driver tables as JSON, HTML
or XML text and then go through the same parsing as landed files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corrobora.functions import text as X
from corrobora.model import EvidenceGraph
from corrobora.operators import build as G
from corrobora.operators import similarity as S
from corrobora.operators.pairs import sharing_pairs
from corrobora.plans.registry import query
from corrobora.session import checkpoint_dir, cut_lineage
from corrobora.sources import feeds, ontology, pages, sinks

def today():
    return F.lit("2026-01-01").cast("date")
J = lambda c, sep=",": F.array_join(c, sep)


def parsed(df, schema: str, *keep: str):
    """Columns through JSON text and back with the declared schema of the feed."""
    body = F.to_json(F.struct(*[c for c in df.columns if c not in keep]))
    return df.select(*keep, F.from_json(body, schema).alias("_j")).select(*keep, "_j.*")


def _scratch(t, name: str) -> str:
    return f"{checkpoint_dir(t.spark)}/sinks/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- ontology


def obo_documents(t):
    """One OBO-graph document per part size, i.e. many files rather than one."""
    node = F.expr(
        "named_struct('id', concat('http://x.org/obo/', CASE WHEN p_partkey % 10 = 9 THEN 'HP_' ELSE 'MONDO_' END, lpad(p_partkey, 7, '0')), "
        "'type', CASE WHEN p_partkey % 7 = 0 THEN 'PROPERTY' ELSE 'CLASS' END, 'lbl', CASE WHEN p_partkey % 8 <> 0 THEN p_name END, "
        "'meta', named_struct('definition', named_struct('val', p_type), 'deprecated', p_partkey % 5 = 0, "
        "'subsets', array('http://x.org/obo#a_rare', 'http://x.org/obo#other'), "
        "'synonyms', array(named_struct('pred', 'x#hasExactSynonym', 'val', p_brand, 'synonymType', cast(NULL AS string)), "
        "named_struct('pred', 'x#hasRelatedSynonym', 'val', 'old', 'synonymType', 'http://x#DEPRECATED')), "
        "'xrefs', array(named_struct('val', concat('Orphanet:', p_partkey)), named_struct('val', 'OMIM:1')), "
        "'basicPropertyValues', array(named_struct('pred', 'x#hasAlternativeId', 'val', concat('MONDO:9', lpad(p_partkey, 6, '0'))))))")
    edge = F.expr("named_struct('sub', concat('http://x.org/obo/MONDO_', lpad(p_partkey, 7, '0')), 'pred', CASE WHEN p_partkey % 3 = 0 THEN 'part_of' ELSE 'is_a' END, "
                  "'obj', concat('http://x.org/obo/MONDO_', lpad(p_partkey div 2, 7, '0')))")
    docs = t.table("part").groupBy(F.expr("p_partkey div 50").alias("doc")).agg(F.collect_list(node).alias("nodes"), F.collect_list(edge).alias("edges"))
    return parsed(docs.select(F.array(F.struct("nodes", "edges")).alias("graphs")), ontology.OBO_SCHEMA)


@query("s01_ontology_nodes", """
SELECT 'MONDO:'||lpad(p_partkey::VARCHAR,7,'0') AS id, CASE WHEN p_partkey%8<>0 THEN p_name END AS label, p_brand AS synonyms, 'OMIM:1,ORPHA:'||p_partkey AS xrefs,
p_type AS definition, p_partkey%5=0 AS deprecated, 'a_rare' AS rare_subsets FROM part WHERE p_partkey%10<>9 AND p_partkey%7<>0""")
def _s01(t):
    n = ontology.ontology_nodes(ontology.obo_nodes(obo_documents(t)), "MONDO")
    return n.select("id", "label", J("synonyms").alias("synonyms"), J("xrefs").alias("xrefs"), "definition", "deprecated", J("rare_subsets").alias("rare_subsets"))


@query("s02_ontology_hierarchy", """
SELECT 'name' AS what, 'MONDO:'||lpad(p_partkey::VARCHAR,7,'0') AS a, CASE WHEN p_partkey%8<>0 THEN p_name ELSE 'MONDO:'||lpad(p_partkey::VARCHAR,7,'0') END AS b FROM part WHERE p_partkey%10<>9
UNION ALL SELECT 'parent', 'MONDO:'||lpad(p_partkey::VARCHAR,7,'0'), 'MONDO:'||lpad((p_partkey//2)::VARCHAR,7,'0') FROM part WHERE p_partkey%3<>0
UNION ALL SELECT 'alt', 'MONDO:9'||lpad(p_partkey::VARCHAR,6,'0'), 'MONDO:'||lpad(p_partkey::VARCHAR,7,'0') FROM part WHERE p_partkey%10<>9""")
def _s02(t):
    raw, edges = ontology.obo_nodes(obo_documents(t)), ontology.obo_edges(obo_documents(t))
    row = lambda df, what, a, b: df.select(F.lit(what).alias("what"), F.col(a).alias("a"), F.col(b).alias("b"))
    return (row(ontology.term_names(raw, "MONDO"), "name", "id", "label").unionByName(row(ontology.term_parents(edges, "MONDO"), "parent", "child", "parent"))
            .unionByName(row(ontology.term_alternatives(raw, "MONDO"), "alt", "old", "current")))


@query("s03_kept_annotations", "SELECT 'D'||l_orderkey AS database_id, 'P'||l_partkey AS hpo_id, '' AS frequency, count(*) AS n FROM lineitem WHERE l_returnflag='R' AND l_linestatus='O' GROUP BY ALL")
def _s03(t):
    raw = t.table("lineitem").selectExpr("concat('D', l_orderkey) AS database_id", "concat('P', l_partkey) AS hpo_id", "cast(NULL AS string) AS frequency",
        "CASE l_returnflag WHEN 'R' THEN 'P' ELSE 'I' END AS aspect", "CASE l_linestatus WHEN 'F' THEN 'NOT' END AS qualifier")
    return ontology.kept_annotations(raw).groupBy("database_id", "hpo_id", "frequency").agg(F.count(F.lit(1)).alias("n"))


@query("s04_read_seeds", "SELECT 'D'||o_orderkey AS mondo, unnest(['C'||o_custkey, 'GX']) AS gene FROM orders")
def _s04(t):
    return ontology.read_seeds(t.table("orders").selectExpr("concat('D', o_orderkey) AS mondo", "array(concat('C', o_custkey), 'GX') AS genes"))


@query("s05_flatten_gene_docs", "SELECT 'HGNC:'||c_custkey AS hgnc_id, CASE WHEN c_custkey%2=0 THEN 'AL,B'||c_custkey||',Z' ELSE 'AL,Z' END AS aliases FROM customer")
def _s05(t):
    raw = t.table("customer").selectExpr("concat('HGNC:', c_custkey) AS hgnc_id", "'s' AS symbol", "c_name AS name", "array('Z', 'AL') AS alias_symbol",
        "CASE WHEN c_custkey % 2 = 0 THEN array(concat('B', c_custkey), 'Z') END AS prev_symbol", "cast(array() AS array<string>) AS alias_name", "cast(NULL AS array<string>) AS prev_name",
        "'1' AS entrez_id", "'e' AS ensembl_gene_id", "'1q' AS location", "'gene' AS locus_type", "'Approved' AS status")
    return ontology.flatten_gene_docs(raw).select("hgnc_id", J("aliases").alias("aliases"))


@query("s06_flatten_variants", """
SELECT id AS variation_id, CASE WHEN num%3=0 THEN '' ELSE classification END AS classification, CASE WHEN num%3=0 THEN 0 ELSE CASE num%5 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END END AS review_stars,
consequence||'; x' AS consequence, CASE WHEN num%2=0 THEN 'c.'||num END AS cdna_change, CASE WHEN num%3=0 THEN '' ELSE traits||'; other' END AS traits, genes_on_record FROM variant""")
def _s06(t):
    cls = "named_struct('description', classification, 'review_status', review_status, 'last_evaluated', last_evaluated, 'trait_set', array(named_struct('trait_name', traits), named_struct('trait_name', 'other')))"
    raw = t.variant.selectExpr("id AS uid", "name AS title", "array(consequence, 'x') AS molecular_consequence_list",
        f"CASE WHEN num % 3 = 1 THEN {cls} END AS germline_classification", f"CASE WHEN num % 3 = 2 THEN {cls} END AS clinical_significance",
        "CASE WHEN num % 2 = 0 THEN array(named_struct('cdna_change', concat('c.', num)), named_struct('cdna_change', 'no')) ELSE array() END AS variation_set",
        "transform(split(genes_on_record, ';'), g -> named_struct('symbol', g)) AS genes")
    return feeds.flatten_variants(parsed(raw, feeds.VARIANT_SCHEMA)).select("variation_id", "classification", "review_stars", "consequence", "cdna_change", "traits", "genes_on_record")


def raw_trials(t):
    return t.table("orders").selectExpr(
        "concat('D', o_orderkey) AS entity", "o_orderkey AS seq",
        "named_struct('identificationModule', named_struct('nctId', CASE WHEN o_orderkey % 9 <> 0 THEN concat('N', o_orderkey) END, 'briefTitle', concat('study of ', o_orderkey)), "
        "'conditionsModule', named_struct('conditions', array(o_orderpriority)), "
        "'statusModule', named_struct('overallStatus', o_orderstatus, 'startDateStruct', named_struct('date', date_format(o_orderdate, 'yyyy-MM'))), "
        "'designModule', named_struct('phases', array('PHASE1', 'PHASE2'), 'enrollmentInfo', named_struct('count', o_custkey)), "
        "'armsInterventionsModule', named_struct('interventions', array(named_struct('name', concat('compound ', o_custkey, ' 20 mg'), 'type', 'DRUG'), named_struct('name', 'Placebo', 'type', 'DRUG'), "
        "named_struct('name', '', 'type', 'DRUG'), named_struct('name', 'Yoga', 'type', 'BEHAVIORAL'))), "
        "'contactsLocationsModule', named_struct('locations', array(named_struct('country', 'Spain'), named_struct('country', 'France'), named_struct('country', 'Spain'), named_struct('country', cast(NULL AS string)))), "
        "'descriptionModule', named_struct('briefSummary', repeat(o_orderpriority, 100))) AS protocolSection")


def trials(t):
    return feeds.flatten_trials(parsed(raw_trials(t), feeds.STUDY_SCHEMA, "entity", "seq"))


@query("s07_flatten_trials", """
SELECT 'N'||o_orderkey AS nct, o_orderstatus AS status, strftime(o_orderdate,'%Y-%m') AS start, o_custkey AS enrollment, 'France,Spain' AS countries, 3 AS n_interventions,
CAST(least(length(o_orderpriority)*100,600) AS INTEGER) AS n_summary FROM orders WHERE o_orderkey%9<>0""")
def _s07(t):
    return trials(t).select("nct", "status", "start", "enrollment", J("countries").alias("countries"), F.size("interventions").alias("n_interventions"), F.length("summary").alias("n_summary"))


def grants(t):
    raw = t.grant.selectExpr(
        "gene", "event_id AS seq", "core_project AS core_project_num", "id AS project_num", "event_id AS appl_id", "title AS project_title", "'text' AS abstract_text", "fiscal_year", "value AS award_amount",
        "named_struct('org_name', organization, 'org_city', 'X', 'org_country', 'Y') AS organization",
        "array(named_struct('profile_id', user_id + 1, 'full_name', concat('ANNA-maria o''neil ', user_id)), named_struct('profile_id', cast(NULL AS bigint), 'full_name', 'NO ID')) AS principal_investigators",
        "'2024-01-01T00:00:00' AS project_start_date", "cast(NULL AS string) AS project_end_date")
    return feeds.flatten_grants(parsed(raw, feeds.GRANT_SCHEMA, "gene", "seq"))


@query("s08_flatten_grants", """
SELECT core_project AS core, organization, '2024-01-01' AS start, '' AS "end", (user_id+1)||':Anna-Maria O''Neil '||user_id AS investigators, count(*) AS n FROM grants GROUP BY ALL""")
def _s08(t):
    who = F.array_join(F.transform("investigators", lambda i: F.concat_ws(":", i["profile_id"], i["name"])), "|")
    return grants(t).groupBy("core", "organization", "start", "end", who.alias("investigators")).agg(F.count(F.lit(1)).alias("n"))


def _article_xml(t):
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    records = t.table("benchmark").select("item_id", F.concat(
        F.lit("<PubmedArticle><MedlineCitation><PMID Version='1'>"), F.col("item_id").cast("string"), F.lit("</PMID><Article><Journal><Title>J</Title><JournalIssue><PubDate><Year>2020</Year></PubDate></JournalIssue></Journal><ArticleTitle>"),
        F.lit("Study "), F.col("item_id").cast("string"), F.lit("</ArticleTitle><Abstract>"),
        F.when(F.col("item_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("<AbstractText Label='Methods'>"), esc(F.regexp_replace("text", r"\s+", " ")), F.lit("</AbstractText><AbstractText Label='Results'>done</AbstractText>"))),
        F.lit("</Abstract><AuthorList><Author><LastName>Li</LastName><ForeName>Bo</ForeName><Initials>B</Initials></Author><Author><CollectiveName>Group X</CollectiveName></Author></AuthorList></Article></MedlineCitation></PubmedArticle>")).alias("xml"))
    sets = records.groupBy(F.expr("item_id div 20").alias("s")).agg(F.array_join(F.collect_list("xml"), "\n").alias("x"))
    return sets.select(F.concat(F.lit("<PubmedArticleSet>\n"), "x", F.lit("\n</PubmedArticleSet>")).alias("value"))


@query("s09_read_pubmed_xml", r"""
SELECT item_id::VARCHAR AS pmid, 'Study '||item_id AS title, 'Li B;Group X' AS authors, 'J' AS journal, '2020' AS year,
CASE WHEN item_id%4=0 THEN '' ELSE md5('METHODS: '||trim(regexp_replace(text,'\s+',' ','g'))) END AS h FROM benchmark""")
def _s09(t):
    """Writes the records as XML files and reads them back with the XML source."""
    path = _scratch(t, "articles")
    _article_xml(t).write.option("maxRecordsPerFile", 1).text(path)
    a = feeds.flatten_articles(feeds.read_pubmed(t.spark, path))
    first = F.get(F.col("abstract_lines"), F.lit(0))
    return a.select("pmid", "title", J("authors", ";").alias("authors"), "journal", "year", F.coalesce(F.md5(first), F.lit("")).alias("h"))


@query("s10_to_document_text", r"""
SELECT 'PMID:'||item_id AS source_id, md5('Title: Study '||item_id||chr(10)||'Authors: Bo Li; Group X'||chr(10)||'Abstract:'||chr(10)||'METHODS: '||trim(regexp_replace(text,'\s+',' ','g'))||chr(10)||'RESULTS: done') AS h FROM benchmark WHERE item_id%4<>0
UNION ALL SELECT 'missing '||(item_id+1000000), NULL FROM benchmark""")
def _s10(t):
    path = _scratch(t, "articles")
    _article_xml(t).write.option("maxRecordsPerFile", 1).text(path)
    articles = feeds.flatten_articles(feeds.read_pubmed(t.spark, path), initials=False)
    requested = t.table("benchmark").selectExpr("explode(array(cast(item_id AS string), cast(item_id + 1000000 AS string))) AS pmid")
    lost = feeds.missing_articles(requested, articles).select(F.concat(F.lit("missing "), "pmid").alias("source_id"), F.lit(None).cast("string").alias("h"))
    return feeds.to_document_text(articles).select("source_id", F.md5("text").alias("h")).unionByName(lost)


# ---------------------------------------------------------------- pages


@query("s11_parse_catalog_html", """
SELECT p_partkey//40 AS page_id, p_name AS name, 'a;b '||p_partkey AS aliases, 'G1' AS genes, 'GARD'||p_partkey AS gard_id, CAST(CASE WHEN p_partkey%2=0 THEN p_size ELSE 0 END AS INTEGER) AS pmid_count, count(*) AS n FROM part WHERE p_partkey%11<>0 GROUP BY ALL""")
def _s11(t):
    cell = lambda *v: "concat('<td class=\"c\">', " + ", ".join(v) + ", '</td>')"
    cells = [cell("'1'"), cell("'<a href=\"/x\">'", "p_name", "'</a> '"), cell("'a // b '", "p_partkey", "' // '"), cell("'G1 //'"), cell("''"), cell("'u'"), cell("'GARD'", "p_partkey"),
             *[cell("'x'")] * 9, cell("CASE WHEN p_partkey % 2 = 0 THEN cast(p_size AS string) ELSE 'n/a' END")]
    row = "concat('<tr>', " + ", ".join(cells[:4]) + ", CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat(" + ", ".join(cells[4:]) + ") END, '</tr>')"
    made = t.table("part").groupBy(F.expr("p_partkey div 40").alias("page_id")).agg(F.array_join(F.collect_list(F.expr(row)), "\n").alias("rows"))
    html = made.select("page_id", F.concat(F.lit("<table id='summary-table'><tr><th>h</th></tr>"), "rows", F.lit("</table>")).alias("html"))
    return pages.parse_catalog_html(html).groupBy("page_id", "name", J("aliases", ";").alias("aliases"), J("genes", ";").alias("genes"), "gard_id", "pmid_count").agg(F.count(F.lit(1)).alias("n"))


@query("s12_normalise_disease_details", """
SELECT 'D'||o_orderkey AS disease_name, CASE WHEN o_orderkey%6=0 THEN '' ELSE 'GARD'||o_orderkey END AS gard_id, CASE WHEN o_orderkey%5=0 THEN '' ELSE 'o'||o_orderkey END AS omim,
CASE WHEN o_orderkey%4=0 THEN '' ELSE o_custkey||':title '||o_custkey END AS literature, o_orderkey%6<>0 AS is_found FROM orders""")
def _s12(t):
    raw = t.table("orders").selectExpr("concat('D', o_orderkey) AS disease_name", "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('GARD', o_orderkey) END AS gardId",
        "CASE WHEN o_orderkey % 4 = 0 THEN '{\"error\": 1}' ELSE to_json(array(named_struct('pmid', concat(' ', o_custkey), 'articleTitle', concat('title ', o_custkey, ' ')))) END AS totem",
        "CASE WHEN o_orderkey % 5 <> 0 THEN array(named_struct('gard', '1', 'omim', concat('o', o_orderkey)), named_struct('gard', '2', 'omim', 'no')) END AS diseaseIds",
        "array(named_struct('gene_symbol', concat('C', o_custkey))) AS geneInfo")
    d = feeds.normalise_disease_details(parsed(raw, feeds.DETAIL_SCHEMA, "disease_name"))
    lit = F.array_join(F.transform("literature", lambda x: F.concat_ws(":", x["pmid"], x["title"])), "|")
    return d.select("disease_name", "gard_id", "omim", lit.alias("literature"), "is_found")


def raw_communities(t):
    """Five language rows per supplier; English is missing for every fourth and empty for every fifth."""
    return t.table("supplier").selectExpr("*", "explode(array('de', 'en', 'fr', 'es', 'it')) AS lang").filter("NOT (lang = 'en' AND s_suppkey % 4 = 0)").selectExpr(
        "cast(s_suppkey AS string) AS id", "concat('disorder-', s_suppkey) AS slug", "concat(' ', s_name) AS default_name", "'desc' AS default_description", "concat('st', s_suppkey) AS stream_id",
        "cast(s_acctbal AS int) AS total_members", "cast(NULL AS int) AS total_posts", "lang", "CASE WHEN lang = 'en' AND s_suppkey % 5 = 0 THEN ' ' ELSE concat(lang, ' disorder ', s_suppkey) END AS name",
        "'' AS description", "s_suppkey * 10 + position(lang IN 'de en fr es it') AS seq")


@query("s13_collapse_communities", """
SELECT 'disorder-'||s_suppkey AS slug, CASE WHEN s_suppkey%4=0 OR s_suppkey%5=0 THEN s_name ELSE 'en disorder '||s_suppkey END AS name, 'desc' AS description, 0 AS total_posts,
CASE WHEN s_suppkey%4=0 THEN 'de,es,fr,it' ELSE 'de,en,es,fr,it' END AS available_languages FROM supplier""")
def _s13(t):
    return feeds.collapse_communities(raw_communities(t)).select("slug", "name", "description", "total_posts", J("available_languages").alias("available_languages"))


def post_pages(t):
    posts = t.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.expr(
        "named_struct('id', concat(conv_id, '-', turn), 'title', concat(' ', role, ' '), 'body', text, 'lang', 'en', 'comment_count', CASE WHEN turn > 1 THEN turn END)").alias("p")))).alias("x"))
    return parsed(posts.select(F.concat(F.lit("st"), "conv_id").alias("stream_id"), F.lit(0).alias("page"), F.transform("x", lambda y: y["p"]).alias("data")), feeds.POST_SCHEMA, "stream_id", "page")


@query("s14_flatten_posts", """
SELECT stream_id, id, title, CAST(CASE WHEN turn>1 THEN turn ELSE 0 END AS BIGINT) AS comment_count FROM (SELECT 'st'||conv_id AS stream_id, conv_id||'-'||turn AS id, role AS title, turn,
 row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n BETWEEN 2 AND 4""")
def _s14(t):
    return feeds.flatten_posts(post_pages(t), limit=3, skip=1).select("stream_id", "id", "title", "comment_count")


def report_pages(t):
    """Report pages, one per supplier, with two organisation cards."""
    return t.table("supplier").selectExpr("s_suppkey AS page_id", "concat('https://reports.example.org/p', s_suppkey) AS url",
        "concat('<html><section class=\"s\" data-id=\"orgs\"><div class=\"single-rd-resource\"><h5><a href=\" /org/', s_suppkey, ' \">Org &amp; ', s_suppkey, '</a></h5><span class=\"phone\">Phone: 55-', s_suppkey, '</span>"
        "<span class=\"email\">Email: <span class=\"__cf_email__\" data-cfemail=\"422302206c21\">[email protected]</span></span><span class=\"fax\">Fax: 9</span><div class=\"rd-details\"><a href=\"#\">A</a>, <a>B</a></div></div>"
        "<div class=\"single-rd-resource\"><h5>Second</h5><span class=\"phone\"><a href=\"tel:1\">77</a></span><span class=\"email\">Email: a@', s_suppkey, '.org</span></div></section></html>') AS html")


@query("s15_extract_org_cards", """
SELECT s_suppkey AS page_id, 1 AS card, 'Org & '||s_suppkey AS name, '/org/'||s_suppkey AS nord_url, '55-'||s_suppkey AS phone, 'a@b.c' AS email, '9' AS fax, 'A,B' AS related FROM supplier
UNION ALL SELECT s_suppkey, 2, 'Second', '', '77', 'a@'||s_suppkey||'.org', '', '' FROM supplier""")
def _s15(t):
    return pages.extract_org_cards(report_pages(t)).select("page_id", "card", "name", "nord_url", "phone", "email", "fax", J("related_diseases").alias("related"))


def profile_pages(t):
    return t.table("supplier").selectExpr("concat('/org/', s_suppkey) AS url",
        "concat('<div class=\"contact-info\"><i class=\"bi bi-pin-map\"></i> <p>Calle Espa&ntilde;a&#8217;s ', s_suppkey, '<br/>Town</p><i class=\"bi-telephone\"></i><p> 12 </p><i class=\"bi-envelope\"></i><p>x@y.org</p>"
        "<i class=\"bi-link\"></i><p><a href=\"https://o', s_suppkey, '.org\">site</a></p></div><h2>About Us</h2><p>First.</p><div><p> </p><p>Second <b>x</b>.</p></div><h2>Next</h2><p>no</p>') AS html")


@query("s16_extract_org_profile", """
SELECT '/org/'||s_suppkey AS url, 'Calle España’s '||s_suppkey||' Town' AS address, '12' AS phone, 'x@y.org' AS email, 'https://o'||s_suppkey||'.org' AS website, 'First. Second x.' AS description FROM supplier""")
def _s16(t):
    return pages.extract_org_profile(profile_pages(t))


@query("s17_enrich_orgs", """
SELECT s_suppkey AS page_id, '55-'||s_suppkey AS phone, 'a@b.c' AS email, 'Calle España’s '||s_suppkey||' Town' AS address, 'https://o'||s_suppkey||'.org' AS website FROM supplier
UNION ALL SELECT s_suppkey, '77', 'a@'||s_suppkey||'.org', '', '' FROM supplier""")
def _s17(t):
    out = pages.enrich_orgs(pages.extract_org_cards(report_pages(t)), pages.extract_org_profile(profile_pages(t)))
    return out.select("page_id", "phone", "email", "address", "website")


@query("s18_decode_obfuscated", "SELECT c_custkey, CASE WHEN c_custkey%7=0 THEN '' ELSE c_name END AS mail FROM customer")
def _s18(t):
    key = F.col("c_custkey") % 250 + 1
    cipher = F.concat(F.lpad(F.hex(key), 2, "0"), F.array_join(F.transform(F.sequence(F.lit(1), F.length("c_name")), lambda i: F.lpad(F.hex(
        F.ascii(F.substring(F.col("c_name"), i, F.lit(1))).cast("long").bitwiseXOR(key)), 2, "0")), ""))
    return t.table("customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, F.lit("zz")).otherwise(cipher).alias("x")).select("c_custkey", X.decode_obfuscated("x").alias("mail"))


@query("s19_sitemap_to_slug_map", """
SELECT unnest(['type '||s_suppkey||' disorder','type-'||s_suppkey||'-disorder']) AS key, 'https://reports.example.org/rare-diseases/type-'||s_suppkey||'-disorder/' AS url FROM supplier""")
def _s19(t):
    maps = t.table("supplier").groupBy(F.expr("s_suppkey div 50").alias("page_id")).agg(F.array_join(F.collect_list(F.expr("concat('<loc>https://reports.example.org/rare-diseases/type-', s_suppkey, '-disorder</loc><loc>https://other.org/x</loc>')")), "").alias("html"))
    return pages.sitemap_to_slug_map(maps, "https://reports.example.org/rare-diseases").select("key", "url")


@query("s20_extract_directory_orgs", """
SELECT s_suppkey//50 AS page_id, s_suppkey::VARCHAR AS id, 'Verein für '||s_suppkey AS name, 'Côte-D''Or' AS country, 'Saint-Ouen' AS city FROM supplier""")
def _s20(t):
    card = ("concat('<div class=\"fw-bold\">CÔTE-D''OR</div><div>Region</div><div>SAINT-OUEN</div><a class=\"x\" href=\"/en/patient-organisations/patient/', s_suppkey, '?a=1\"> Verein f&uuml;r ', s_suppkey, ' </a>"
            "<div class=\"fw-bold\">Second</div><a href=\"/en/patient-organisations/patient/', s_suppkey, '\">copy</a>')")
    html = t.table("supplier").groupBy(F.expr("s_suppkey div 50").alias("page_id")).agg(F.array_join(F.collect_list(F.expr(card)), "").alias("html"))
    return pages.extract_directory_orgs(html).select("page_id", "id", "name", "country", "city")


@query("s21_har_entries", """
SELECT p.page_id//10 AS archive, p.url, CAST(p.page_id%10 AS INTEGER) AS pos FROM pages p JOIN (SELECT page_id//10 AS a, min(page_id%10) AS m FROM pages WHERE contains(url,'/en/') AND contains(html,'<title>') GROUP BY 1) f ON f.a=p.page_id//10 AND f.m=p.page_id%10""")
def _s21(t):
    entry = F.expr("named_struct('request', named_struct('url', url, 'method', 'GET'), 'response', named_struct('status', 200, 'content', named_struct('text', html)))")
    raw = t.table("pages").groupBy(F.expr("page_id div 10").alias("archive")).agg(F.array_sort(F.collect_list(F.struct("page_id", entry.alias("e")))).alias("x"))
    archives = parsed(raw.select("archive", F.struct(F.transform("x", lambda y: y["e"]).alias("entries")).alias("log")), feeds.HAR_SCHEMA, "archive")
    return feeds.first_har_entry(feeds.har_entries(archives, "/en/", "GET", "<title>")).select("archive", "url", "pos")


@query("s22_read_bundles", "SELECT 'PMID:'||doc_id AS source_id, CAST(pos-1 AS INTEGER) AS position, id FROM claim")
def _s22(t):
    """Writes claim bundles as JSON files and reads the glob back."""
    path = _scratch(t, "bundles")
    per_paper = t.claim.groupBy("pmid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "category"))).alias("claims"))
    paper = F.struct(F.struct(F.col("pmid").alias("source_id")).alias("source"), "claims")
    per_paper.groupBy(F.expr("doc_id div 20").alias("b")).agg(F.collect_list(paper).alias("papers")).select(
        F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"), "papers").write.option("maxRecordsPerFile", 1).json(path)
    schema = "model STRING, prompt_version STRING, papers ARRAY<STRUCT<source: STRUCT<source_id: STRING>, claims: ARRAY<STRUCT<pos: BIGINT, id: STRING, category: STRING>>>>"
    return feeds.bundle_claims(feeds.read_bundles(t.spark, path + "/*.json", schema)).select("source_id", F.expr("cast(claim.pos - 1 AS int)").alias("position"), F.col("claim.id").alias("id"))


@query("s23_merge_knowledge_bundle", """
, com AS (SELECT 'community-'||s_suppkey AS slug, 'group '||lpad(s_suppkey::VARCHAR,6,'0') AS name FROM supplier),
det AS (SELECT c_custkey, 'q'||c_custkey AS query, CASE WHEN c_custkey%3=0 THEN 'Group '||lpad((c_custkey//3)::VARCHAR,6,'0') ELSE 'none'||c_custkey END AS canonical, lpad((c_custkey//3)::VARCHAR,6,'0') AS syn FROM customer)
SELECT query, slug FROM det LEFT JOIN com ON CASE WHEN c_custkey%3=0 THEN lower(canonical)=name WHEN c_custkey%3=1 THEN contains(name, syn) ELSE false END""")
def _s23(t):
    details = t.table("customer").selectExpr("concat('q', c_custkey) AS query", "CASE WHEN c_custkey % 3 = 0 THEN concat('Group ', lpad(c_custkey div 3, 6, '0')) ELSE concat('none', c_custkey) END AS canonical_name",
        "CASE WHEN c_custkey % 3 = 1 THEN array('zzz', lpad(c_custkey div 3, 6, '0')) ELSE cast(array() AS array<string>) END AS synonyms")
    communities = t.table("supplier").selectExpr("concat('community-', s_suppkey) AS slug", "concat('Group ', lpad(s_suppkey, 6, '0')) AS name", "'' AS default_name", "'' AS description", "cast(s_acctbal AS int) AS total_members")
    orgs = t.table("customer").selectExpr("concat('none', c_custkey) AS canonical_name")
    return feeds.merge_knowledge_bundle(details, communities, orgs).select("query", "slug")


# ---------------------------------------------------------------- graph construction


@query("g01_add_nodes", """
SELECT id, name FROM disease UNION ALL SELECT 'D'||(c_custkey*20+3), min('late '||c_custkey) FROM customer WHERE c_custkey*20+3 NOT IN (SELECT num FROM disease) GROUP BY 1""")
def _g01(t):
    new = t.table("customer").selectExpr("concat('D', c_custkey * 20 + 3) AS id", "concat('late ', c_custkey) AS name", "c_custkey AS seq")
    again = new.withColumn("name", F.lit("second")).withColumn("seq", F.col("seq") + 1_000_000_000)
    return G.add_nodes(t.disease.select("id", "name"), new.unionByName(again), "seq")


@query("g02_add_edges", """
, n AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst ORDER BY edge_id)-1 AS k FROM has_phenotype), b AS (SELECT src, dst, count(*) AS off FROM has_phenotype WHERE edge_id LIKE '%7' GROUP BY ALL)
SELECT 'HAS_PHENOTYPE:'||n.src||'->'||n.dst||':'||(k+coalesce(off,0)) AS edge_id FROM n LEFT JOIN b ON b.src=n.src AND b.dst=n.dst UNION ALL SELECT edge_id FROM has_phenotype WHERE edge_id LIKE '%7'""")
def _g02(t):
    new = t.has_phenotype.withColumn("seq", F.col("edge_id"))
    base = t.has_phenotype.filter("edge_id LIKE '%7'").withColumn("seq", F.col("edge_id"))
    return G.add_edges(base, new.drop("edge_id")).select("edge_id")


@query("g03_mechanism_nodes", """
SELECT v.id, 'Mechanism' AS type, v.name, n_claims FROM (VALUES ('MECH:loss_of_function', 'Loss of function'), ('MECH:gain_of_function', 'Gain of function')) v(id, name)
LEFT JOIN (SELECT CASE WHEN pos=1 THEN 'MECH:loss_of_function' ELSE 'MECH:gain_of_function' END AS id, count(*) AS n_claims FROM claim GROUP BY 1) u ON u.id=v.id""")
def _g03(t):
    """The vocabulary joined with the claims that name it; without claims there is no edge."""
    used = t.claim.selectExpr("CASE WHEN pos = 1 THEN 'MECH:loss_of_function' ELSE 'MECH:gain_of_function' END AS id").groupBy("id").agg(F.count(F.lit(1)).alias("n_claims"))
    return G.mechanism_nodes(t.spark).join(used, "id", "left")


def resolved(t):
    return t.table("orders").selectExpr("concat('D', o_orderkey) AS id", "true AS found", "concat(o_orderpriority, ' disorder') AS label", "array(concat('C', o_custkey), 'GX') AS genes", "array('syn') AS synonyms",
        "array('OMIM:1') AS xrefs", "CASE WHEN o_orderkey % 2 = 0 THEN array('ORPHA:2') ELSE cast(array() AS array<string>) END AS manual_xrefs",
        "CASE WHEN o_orderkey % 3 = 0 THEN concat('caused by C', o_custkey, '.') ELSE 'unknown' END AS definition")


@query("g04_entity_nodes", "SELECT 'D'||o_orderkey AS id, o_orderpriority||' disorder' AS name, 'C'||o_custkey||',GX' AS short, CASE WHEN o_orderkey%2=0 THEN 'OMIM:1,ORPHA:2' ELSE 'OMIM:1' END AS xrefs FROM orders")
def _g04(t):
    return G.entity_nodes(resolved(t)).select("id", "name", "short", J("xrefs").alias("xrefs"))


@query("g05_gene_nodes_and_links", """
SELECT 'D'||o_orderkey AS src, 'HGNC:'||o_custkey AS dst, CASE WHEN o_orderkey%3=0 THEN 1 ELSE 3 END AS source_tier, CASE WHEN o_orderkey%3=0 THEN 'observation' ELSE 'hypothesis' END AS status FROM orders
UNION ALL SELECT 'D'||o_orderkey, 'GENE:GX', 3, 'hypothesis' FROM orders""")
def _g05(t):
    genes = t.table("customer").selectExpr("concat('C', c_custkey) AS symbol", "concat('HGNC:', c_custkey) AS hgnc_id", "c_name AS name")
    return G.gene_nodes_and_links(resolved(t), genes, today()).edges.select("src", "dst", "source_tier", "status")


@query("g06_rewrite_alt_ids", "SELECT l_orderkey, CASE WHEN l_partkey%3=0 THEN 'P'||(l_partkey//3) ELSE 'P'||l_partkey END AS hpo_id, count(*) AS n FROM lineitem GROUP BY ALL")
def _g06(t):
    alt = t.table("part").filter("p_partkey % 3 = 0").selectExpr("concat('P', p_partkey) AS old", "concat('P', p_partkey div 3) AS current")
    df = t.table("lineitem").selectExpr("l_orderkey", "concat('P', l_partkey) AS hpo_id")
    return ontology.rewrite_alt_ids(df, alt, "hpo_id").groupBy("l_orderkey", "hpo_id").agg(F.count(F.lit(1)).alias("n"))


@query("g07_annotation_links", """
SELECT 'edge' AS what, src AS a, dst AS b, count(*) AS n FROM has_phenotype GROUP BY ALL UNION ALL SELECT 'node', dst, coalesce(max(p.name), dst), 1 FROM has_phenotype h LEFT JOIN phenotype p ON p.id=h.dst GROUP BY dst""")
def _g07(t):
    ph = t.table("lineitem").selectExpr("concat('D', l_orderkey) AS mondo", "concat('P', l_partkey) AS hpo_id", "concat('M', l_suppkey) AS source_id", "'' AS frequency", "'IEA' AS evidence", "'ref' AS reference")
    g, _ = G.annotation_links(ph, t.phenotype.selectExpr("id", "name AS label"), today())
    return g.edges.select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("n_evidence").alias("n")).unionByName(
        g.nodes.select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("name").alias("b"), F.lit(1).cast("long").alias("n")))


@query("g08_variant_nodes_and_links", """
SELECT 'CLINVAR:'||CASE WHEN num%2=0 THEN 'VCV'||num ELSE num::VARCHAR END AS src, gene AS dst, CASE WHEN num%3=0 THEN 0 ELSE CAST(num%5 AS INTEGER) END AS review_stars FROM variant WHERE gene IN (SELECT id FROM gene) AND CAST(gene[2:] AS BIGINT)%2=0""")
def _g08(t):
    v = t.variant.selectExpr("gene AS hgnc_id", "CASE WHEN num % 2 = 0 THEN concat('VCV', num) ELSE '' END AS accession", "cast(num AS string) AS variation_id", "name AS title", "classification", "consequence", "traits",
        "'' AS protein_change", "'' AS cdna_change", "review_status", "CASE WHEN num % 3 = 0 THEN 'bad' ELSE cast(num % 5 AS string) END AS review_stars")
    genes = t.gene.filter("cast(substr(id, 2) AS bigint) % 2 = 0")
    return G.variant_nodes_and_links(v, genes, today()).edges.select("src", "dst", "review_stars")


@query("g09_trial_layer", """
SELECT 'NCT:N'||o_orderkey AS src, 'D'||o_orderkey AS dst, 'STUDIES' AS rel FROM orders WHERE o_orderkey%9<>0 UNION ALL SELECT 'NCT:N'||o_orderkey, 'INT:compound-'||o_custkey, 'TESTS' FROM orders WHERE o_orderkey%9<>0""")
def _g09(t):
    return G.trial_layer(trials(t).withColumn("why", F.lit("w")), today()).edges.select("src", "dst", "rel")


@query("g10_org_layer", """
SELECT 'D'||o_orderkey AS src, 'ORG:nord:org-'||o_custkey AS dst, 'listed on the NORD disease report' AS match_reason FROM orders
UNION ALL SELECT 'D'||o_orderkey, 'ORG:rareconnect:c'||o_custkey, 'community name matches the disease' FROM orders WHERE o_orderkey%2=0
UNION ALL SELECT 'D'||o_orderkey, 'ORG:orphanet:'||o_custkey, 'Orphanet lists it for ORPHA:'||o_custkey||CASE WHEN o_orderkey%6=0 THEN ' (near, closest Orphanet entry)' ELSE '' END FROM orders WHERE o_orderkey%3=0""")
def _g10(t):
    o = t.table("orders")
    cards = o.selectExpr("concat('D', o_orderkey) AS entity", "concat('Org: ', o_custkey) AS name")
    com = o.filter("o_orderkey % 2 = 0").selectExpr("concat('D', o_orderkey) AS entity", "concat('c', o_custkey) AS slug", "'c' AS name")
    dr = o.filter("o_orderkey % 3 = 0").selectExpr("concat('D', o_orderkey) AS entity", "cast(o_custkey AS string) AS id", "'n' AS name", "cast(o_custkey AS string) AS code", "CASE WHEN o_orderkey % 6 = 0 THEN 'near' END AS closest")
    return G.org_layer(cards, com, dr, today()).edges.select("src", "dst", "match_reason")


@query("g11_grant_layer", """
SELECT DISTINCT 'RES:nih:'||(user_id+1) AS src, 'NIH:'||core_project AS dst, 'LEADS' AS rel, 1 AS n FROM grants UNION ALL SELECT 'NIH:'||core_project, gene, 'RESEARCHES', count(*) FROM grants GROUP BY ALL""")
def _g11(t):
    e = G.grant_layer(grants(t).withColumn("symbol", F.col("gene")), today()).edges
    return e.groupBy("src", "dst", "rel").agg(F.count(F.lit(1)).alias("n"))


@query("g12_gene_group_layer", "SELECT 'G'||c_custkey AS src, 'HGNC_GROUP:'||(c_custkey//3) AS dst FROM customer UNION ALL SELECT 'G'||c_custkey, 'HGNC_GROUP:'||(c_custkey+1000000) FROM customer WHERE c_custkey%2=0")
def _g12(t):
    genes = t.table("customer").selectExpr("concat('G', c_custkey) AS id", "array(c_custkey div 3, c_custkey + 1000000) AS gene_group_id", "CASE WHEN c_custkey % 2 = 0 THEN array('a', 'b') ELSE array('a') END AS gene_group")
    return G.gene_group_layer(genes, today()).edges.select("src", "dst")


@query("g13_entity_props", "SELECT 'D'||o_orderkey AS id, CASE WHEN o_orderkey%6<>0 THEN 'GARD'||o_orderkey END AS gard_id, CASE WHEN o_orderkey%6=0 THEN NULL ELSE 6 END AS n_reading FROM orders")
def _g13(t):
    details = t.table("orders").selectExpr("concat('D', o_orderkey) AS entity", "o_orderkey % 6 <> 0 AS is_found", "concat('GARD', o_orderkey) AS gard_id",
        "transform(sequence(1, 8), i -> named_struct('pmid', i, 'title', 't', 'year', '2020', 'journal', 'j')) AS literature")
    out = G.entity_props(t.disease.select("id"), details)
    return out.select("id", "gard_id", F.when(F.col("reading").isNotNull(), F.size("reading")).alias("n_reading"))


@query("g14_bundle_to_graph", """
, d AS (SELECT o_orderkey AS k, o_custkey AS c, 'Disease:'||CASE WHEN o_orderkey%6=0 THEN 'name'||o_orderkey ELSE 'GARD'||o_orderkey END AS d FROM orders)
SELECT d AS src, 'Gene:C'||c AS dst, 'ASSOCIATED_WITH' AS rel FROM d UNION ALL SELECT 'PMID:'||k, 'CLAIM:'||k||':1', 'CONTAINS' FROM d WHERE k%4<>0 UNION ALL SELECT 'CLAIM:'||k||':1', d, 'ABOUT' FROM d WHERE k%4<>0
UNION ALL SELECT d, 'PatientOrg:c'||c, 'REPRESENTED_BY' FROM d WHERE k%2=0 UNION ALL SELECT d, 'PatientOrg:nord:org-'||c, 'REPRESENTED_BY' FROM d""")
def _g14(t):
    o = t.table("orders")
    q = "concat('q', o_orderkey) AS query"
    return G.bundle_to_graph(
        o.selectExpr(q, "concat('name', o_orderkey) AS canonical_name", "CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE concat('GARD', o_orderkey) END AS gard_id"), o.selectExpr(q, "concat('C', o_custkey) AS gene_symbol"),
        o.selectExpr(q, "CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE cast(o_orderkey AS string) END AS pmid", "'' AS title"), o.filter("o_orderkey % 2 = 0").selectExpr(q, "concat('c', o_custkey) AS slug", "'n' AS name"),
        o.selectExpr(q, "concat('Org: ', o_custkey) AS name"), today()).edges.select("src", "dst", "rel")


@query("g15_clean_text", "SELECT p_partkey, p_name||'–x' AS name FROM part")
def _g15(t):
    return t.table("part").select("p_partkey", X.clean_text(F.concat("p_name", F.lit("�x"))).alias("name"))


@query("g16_entity_to_gene", "SELECT 'D'||(o_orderkey//2) AS entity, 'G'||arg_max(o_custkey, o_orderkey) AS gene FROM orders GROUP BY 1")
def _g16(t):
    e = t.associated_with.selectExpr("concat('D', seq div 2) AS src", "dst", "rel", "seq")
    return G.entity_to_gene(e, t.gene)


# ---------------------------------------------------------------- sinks


@query("k01_write_graph", "SELECT 'node' AS what, type AS key, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'edge', rel, count(*) FROM edges GROUP BY ALL")
def _k01(t):
    path = _scratch(t, "graph")
    sinks.write_graph(t.graph, path)
    g = sinks.read_graph(t.spark, path)
    return g.nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n")).unionByName(
        g.edges.groupBy(F.lit("edge").alias("what"), F.col("rel").alias("key")).agg(F.count(F.lit(1)).alias("n")))


NATIONS = [f"N{i}" for i in range(25)]
MATRIX = """
, it AS (SELECT DISTINCT 'N'||s_nationkey AS entity, (l_partkey//10) AS item FROM lineitem JOIN supplier ON s_suppkey=l_suppkey), sz AS (SELECT entity, count(*) AS n FROM it GROUP BY entity),
pr AS (SELECT x.entity AS a, y.entity AS b, count(*) AS o FROM it x JOIN it y ON x.item=y.item GROUP BY ALL), s AS (SELECT a, b, round(o/(sa.n+sb.n-o),6) AS v FROM pr JOIN sz sa ON sa.entity=a JOIN sz sb ON sb.entity=b)
SELECT a AS row, """ + ", ".join(f"coalesce(max(v) FILTER (b='{n}'), 0) AS \"{n}\"" for n in NATIONS) + " FROM s GROUP BY a"


@query("k02_similarity_matrix", MATRIX)
def _k02(t):
    """Similarity of the nations by the part families their suppliers deliver."""
    items = t.table("lineitem").join(t.table("supplier").selectExpr("s_suppkey AS l_suppkey", "s_nationkey"), "l_suppkey").selectExpr(
        "concat('N', s_nationkey) AS entity", "cast(l_partkey div 10 AS string) AS item", "cast(1 AS double) AS weight").distinct()
    items = cut_lineage(items)
    pairs = S.jaccard_of_pairs(sharing_pairs(items), items)
    wide = sinks.matrix(S.similarity_matrix_rows(pairs, items, items.select("entity").distinct()), NATIONS)
    return wide.select("row", *[F.round(c, 6).alias(c) for c in NATIONS])


@query("k03_write_connections", "SELECT 'D'||o_orderkey AS a, 'D'||(o_orderkey+1) AS b, o_totalprice AS score FROM orders")
def _k03(t):
    path = _scratch(t, "connections")
    sinks.write_connections(t.table("orders").selectExpr("concat('D', o_orderkey) AS a", "concat('D', o_orderkey + 1) AS b", "o_totalprice AS score"), path)
    return t.spark.read.schema("a STRING, b STRING, score DOUBLE").json(path)


@query("k04_stringify_complex", """SELECT o_orderkey, '["'||o_orderstatus||'","x"]' AS tags, '{"k":'||o_custkey||'}' AS props FROM orders""")
def _k04(t):
    df = t.table("orders").selectExpr("o_orderkey", "array(o_orderstatus, 'x') AS tags", "named_struct('k', o_custkey) AS props")
    return sinks.stringify_complex(df)


@query("k05_write_tables", "SELECT id, classification FROM variant")
def _k05(t):
    path = _scratch(t, "tables")
    sinks.write_tables({"variants": t.variant.select("id", "classification")}, path, "csv")
    return t.spark.read.option("header", True).schema("id STRING, classification STRING").csv(f"{path}/variants")


@query("k06_write_export", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges, false AS includes_pending_papers")
def _k06(t):
    path = _scratch(t, "export")
    sinks.write_export(EvidenceGraph(t.nodes, t.edges), path, "2026-01-01")
    return t.spark.read.schema("nodes BIGINT, edges BIGINT, includes_pending_papers BOOLEAN").json(f"{path}/meta")
