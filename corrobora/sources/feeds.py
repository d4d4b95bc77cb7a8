"""Landed JSON and XML feeds flattened to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions.text import nonempty, review_stars, title_case
from corrobora.operators.resolve import community_tier
from corrobora.session import first_by

NONE = "cast(array() AS array<string>)"

VARIANT_SCHEMA = """
uid STRING, accession STRING, title STRING, protein_change STRING, obj_type STRING, molecular_consequence_list ARRAY<STRING>,
germline_classification STRUCT<description: STRING, review_status: STRING, last_evaluated: STRING, trait_set: ARRAY<STRUCT<trait_name: STRING>>>,
clinical_significance STRUCT<description: STRING, review_status: STRING, last_evaluated: STRING, trait_set: ARRAY<STRUCT<trait_name: STRING>>>,
variation_set ARRAY<STRUCT<cdna_change: STRING>>, genes ARRAY<STRUCT<symbol: STRING>>
"""
STUDY_SCHEMA = """
protocolSection STRUCT<
  identificationModule: STRUCT<nctId: STRING, briefTitle: STRING, officialTitle: STRING>,
  conditionsModule: STRUCT<conditions: ARRAY<STRING>>,
  statusModule: STRUCT<overallStatus: STRING, startDateStruct: STRUCT<date: STRING>>,
  designModule: STRUCT<phases: ARRAY<STRING>, studyType: STRING, enrollmentInfo: STRUCT<count: BIGINT>>,
  sponsorCollaboratorsModule: STRUCT<leadSponsor: STRUCT<name: STRING>>,
  armsInterventionsModule: STRUCT<interventions: ARRAY<STRUCT<name: STRING, type: STRING>>>,
  contactsLocationsModule: STRUCT<locations: ARRAY<STRUCT<country: STRING>>>,
  descriptionModule: STRUCT<briefSummary: STRING>>
"""
GRANT_SCHEMA = """
core_project_num STRING, project_num STRING, appl_id BIGINT, project_title STRING, abstract_text STRING, fiscal_year INT, award_amount DOUBLE,
organization STRUCT<org_name: STRING, org_city: STRING, org_country: STRING>, agency_ic_admin STRUCT<abbreviation: STRING>,
principal_investigators ARRAY<STRUCT<profile_id: BIGINT, full_name: STRING>>, project_start_date STRING, project_end_date STRING
"""
DETAIL_SCHEMA = """
gardId STRING, totem STRING, geneInfo ARRAY<STRUCT<gene_symbol: STRING, gene_id: STRING, ensembl_gene_id: STRING, hgnc_gene_id: STRING, uniprot_id: STRING, gene_description: STRING>>,
diseaseIds ARRAY<STRUCT<gard: STRING, omim: STRING, orphanet: STRING, umls: STRING>>, diseaseSynonyms ARRAY<STRING>
"""
ARTICLE_SCHEMA = "ARRAY<STRUCT<pmid: STRING, articleTitle: STRING, authors: STRING, journalTitle: STRING, publicationYear: STRING, volume: STRING, source: STRING>>"
POST_SCHEMA = "data ARRAY<STRUCT<id: STRING, title: STRING, body: STRING, lang: STRING, post_type: STRING, comment_count: BIGINT, reaction_score: BIGINT, created_at: STRING>>"
HAR_SCHEMA = "log STRUCT<entries: ARRAY<STRUCT<request: STRUCT<url: STRING, method: STRING>, response: STRUCT<status: INT, content: STRUCT<text: STRING>>>>>"
PUBMED_SCHEMA = """
MedlineCitation STRUCT<PMID: STRUCT<_VALUE: STRING>, Article: STRUCT<ArticleTitle: STRING,
  Journal: STRUCT<Title: STRING, JournalIssue: STRUCT<PubDate: STRUCT<Year: STRING, MedlineDate: STRING>>>,
  AuthorList: STRUCT<Author: ARRAY<STRUCT<LastName: STRING, ForeName: STRING, Initials: STRING, CollectiveName: STRING>>>,
  Abstract: STRUCT<AbstractText: ARRAY<STRUCT<_VALUE: STRING, _Label: STRING>>>>>
"""


def _or_empty(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _listed(c: str) -> Column:
    return F.coalesce(F.col(c), F.expr("array()"))


def flatten_variants(raw: DataFrame) -> DataFrame:
    """Variant summaries; the germline classification is preferred to the older field."""
    cls = F.coalesce("germline_classification", "clinical_significance")
    return raw.select(
        F.col("uid").alias("variation_id"), "accession", "title", "protein_change",
        F.get(F.col("variation_set"), F.lit(0))["cdna_change"].alias("cdna_change"), F.col("obj_type").alias("variant_type"),
        F.array_join(F.coalesce("molecular_consequence_list", F.expr(NONE)), "; ").alias("consequence"),
        _or_empty(cls["description"]).alias("classification"), _or_empty(cls["review_status"]).alias("review_status"),
        review_stars(cls["review_status"]).alias("review_stars"), _or_empty(cls["last_evaluated"]).alias("last_evaluated"),
        F.array_join(F.transform(F.coalesce(cls["trait_set"], F.expr("array()")), lambda x: F.coalesce(x["trait_name"], F.lit(""))), "; ").alias("traits"),
        F.array_join(F.transform(_listed("genes"), lambda g: F.coalesce(g["symbol"], F.lit(""))), ";").alias("genes_on_record"))


def flatten_trials(raw: DataFrame) -> DataFrame:
    p = F.col("protocolSection")
    ident, status, design = p["identificationModule"], p["statusModule"], p["designModule"]
    named = F.filter(F.coalesce(p["armsInterventionsModule"]["interventions"], F.expr("array()")), lambda i: _or_empty(i["name"]) != "")
    countries = F.filter(F.transform(F.coalesce(p["contactsLocationsModule"]["locations"], F.expr("array()")), lambda x: x["country"]), lambda c: _or_empty(c) != "")
    keep = [c for c in raw.columns if c != "protocolSection"]
    return raw.select(
        *keep, ident["nctId"].alias("nct"), _or_empty(ident["briefTitle"]).alias("title"), _or_empty(ident["officialTitle"]).alias("official_title"),
        _or_empty(status["overallStatus"]).alias("status"), _or_empty(status["startDateStruct"]["date"]).alias("start"),
        F.coalesce(design["phases"], F.expr(NONE)).alias("phases"), _or_empty(design["studyType"]).alias("study_type"),
        design["enrollmentInfo"]["count"].alias("enrollment"), _or_empty(p["sponsorCollaboratorsModule"]["leadSponsor"]["name"]).alias("sponsor"),
        F.coalesce(p["conditionsModule"]["conditions"], F.expr(NONE)).alias("conditions"), named.alias("interventions"),
        F.array_sort(F.array_distinct(countries)).alias("countries"),
        F.left(_or_empty(p["descriptionModule"]["briefSummary"]), F.lit(600)).alias("summary"),
    ).filter(nonempty("nct").isNotNull())


def flatten_grants(raw: DataFrame) -> DataFrame:
    pis = F.filter(_listed("principal_investigators"), lambda i: i["profile_id"].isNotNull() & (i["profile_id"] != 0))
    keep = [c for c in raw.columns if c in ("gene", "seq")]
    return raw.select(
        *keep, F.coalesce("core_project_num", "project_num").alias("core"), "core_project_num", "project_num", "appl_id", "project_title", "abstract_text",
        "fiscal_year", "award_amount", F.col("organization.org_name").alias("organization"), F.col("organization.org_city").alias("city"),
        F.col("organization.org_country").alias("country"), F.col("agency_ic_admin.abbreviation").alias("institute"),
        F.left(_or_empty("project_start_date"), F.lit(10)).alias("start"), F.left(_or_empty("project_end_date"), F.lit(10)).alias("end"),
        F.transform(pis, lambda i: F.struct(i["profile_id"].alias("profile_id"), F.trim(title_case(_or_empty(i["full_name"]))).alias("name"))).alias("investigators"))


# ---------------------------------------------------------------- article XML


def read_pubmed(spark: SparkSession, path: str) -> DataFrame:
    """Article records with the built-in XML source, which splits large files at the row tag."""
    return spark.read.format("xml").option("rowTag", "PubmedArticle").schema(PUBMED_SCHEMA).load(path)


def flatten_articles(raw: DataFrame, initials: bool = True) -> DataFrame:
    """pmid, title, authors, labelled abstract lines, journal, year. Names are surname + initials or forename + surname."""
    a = F.col("MedlineCitation")["Article"]
    person = lambda x: F.concat_ws(" ", x["LastName"], x["Initials"]) if initials else F.concat_ws(" ", x["ForeName"], x["LastName"])
    authors = F.filter(
        F.transform(F.coalesce(a["AuthorList"]["Author"], F.expr("array()")), lambda x: F.coalesce(nonempty(x["CollectiveName"]), person(x))), lambda n: n != "")
    lines = F.transform(F.coalesce(a["Abstract"]["AbstractText"], F.expr("array()")), lambda t: F.concat(
        F.coalesce(F.concat(F.upper(nonempty(t["_Label"])), F.lit(": ")), F.lit("")), _or_empty(t["_VALUE"])))
    date = a["Journal"]["JournalIssue"]["PubDate"]
    return raw.select(
        F.col("MedlineCitation")["PMID"]["_VALUE"].alias("pmid"), _or_empty(a["ArticleTitle"]).alias("title"), authors.alias("authors"),
        F.filter(lines, lambda x: F.trim(x) != "").alias("abstract_lines"), _or_empty(a["Journal"]["Title"]).alias("journal"),
        F.coalesce(nonempty(date["Year"]), nonempty(date["MedlineDate"]), F.lit("")).alias("year"))


def to_document_text(articles: DataFrame) -> DataFrame:
    """Title, authors and abstract as one text; records without an abstract are left out."""
    text = F.concat_ws(
        "\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Authors: "), F.array_join("authors", "; ")), F.lit("Abstract:"), F.array_join("abstract_lines", "\n"))
    return articles.filter(F.size("abstract_lines") > 0).select(
        F.concat(F.lit("PMID:"), "pmid").alias("source_id"), "title", text.alias("text"),
        F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "pmid", F.lit("/")).alias("url"), F.lit("abstract").alias("source_kind"), F.lit(2).alias("source_tier"))


def missing_articles(requested: DataFrame, articles: DataFrame) -> DataFrame:
    return requested.select("pmid").distinct().join(articles.select("pmid"), "pmid", "left_anti")


# ---------------------------------------------------------------- disease details, communities, posts


def normalise_disease_details(raw: DataFrame) -> DataFrame:
    """Detail records; a literature field that is not a list counts as empty."""
    articles = F.coalesce(F.from_json("totem", ARTICLE_SCHEMA), F.expr("array()"))
    literature = F.transform(F.filter(articles, lambda x: x.isNotNull()), lambda x: F.struct(
        F.trim(_or_empty(x["pmid"])).alias("pmid"), F.trim(_or_empty(x["articleTitle"])).alias("title"), F.trim(_or_empty(x["authors"])).alias("authors"),
        F.trim(_or_empty(x["journalTitle"])).alias("journal"), F.trim(_or_empty(x["publicationYear"])).alias("year")))
    literature = F.when(F.ltrim("totem").startswith("["), literature).otherwise(F.filter(literature, lambda x: F.lit(False)))
    ids = F.get(F.col("diseaseIds"), F.lit(0))
    return raw.select(
        "disease_name", F.col("gardId").alias("gard_id"), *[_or_empty(ids[c]).alias(c) for c in ("gard", "omim", "orphanet", "umls")],
        F.coalesce("diseaseSynonyms", F.expr(NONE)).alias("synonyms"), _listed("geneInfo").alias("genes"), literature.alias("literature"),
        nonempty("gardId").isNotNull().alias("is_found"))


def collapse_communities(raw: DataFrame, lang: str = "en", base: str = "https://www.rareconnect.org") -> DataFrame:
    """One row per community from one row per language. Names fall back requested language -> English -> default,
    and an empty text falls through as well. The translations of one community are bounded by the languages."""
    rows = raw.filter(nonempty("slug").isNotNull())
    heads = first_by(rows, ["slug"], [F.asc("seq")]).select(
        "slug", "id", F.trim(_or_empty("default_name")).alias("default_name"), F.trim(_or_empty("default_description")).alias("default_description"),
        "stream_id", F.coalesce("total_members", F.lit(0)).alias("total_members"), F.coalesce("total_posts", F.lit(0)).alias("total_posts"))
    spoken = rows.filter(nonempty("lang").isNotNull())
    pick = lambda c, code: F.max_by(F.when(F.col("lang") == code, F.trim(_or_empty(c))), F.when(F.col("lang") == code, F.col("seq")))
    texts = spoken.groupBy("slug").agg(
        F.bool_or(F.col("lang") == lang).alias("_has"), F.array_sort(F.collect_set("lang")).alias("available_languages"),
        *[pick(c, code).alias(f"_{c}_{i}") for c in ("name", "description") for i, code in enumerate((lang, "en"))])
    chosen = lambda c: nonempty(F.when(F.col("_has"), F.col(f"_{c}_0")).otherwise(F.col(f"_{c}_1")))
    return heads.join(texts, "slug", "left").select(
        "id", "slug", F.coalesce(chosen("name"), "default_name").alias("name"), F.coalesce(chosen("description"), "default_description").alias("description"),
        "default_name", "total_members", "total_posts", "stream_id", F.concat(F.lit(f"{base}/{lang}/community/"), "slug").alias("url"),
        F.coalesce("available_languages", F.expr(NONE)).alias("available_languages"))


def flatten_posts(raw: DataFrame, limit: int = 10, skip: int = 0) -> DataFrame:
    """One page of posts per stream (page order). ``raw(stream_id, page, data)``."""
    posts = raw.select("stream_id", "page", F.posexplode("data").alias("pos", "p"))
    from corrobora.session import top_by

    return top_by(posts, ["stream_id"], [F.asc("page"), F.asc("pos")], skip + limit, "n").filter(F.col("n") > skip).select(
        "stream_id", F.col("p.id").alias("id"), F.trim(_or_empty("p.title")).alias("title"), F.trim(_or_empty("p.body")).alias("body"), F.col("p.lang").alias("lang"),
        F.col("p.post_type").alias("post_type"), F.coalesce("p.comment_count", F.lit(0)).alias("comment_count"),
        F.coalesce("p.reaction_score", F.lit(0)).alias("reaction_score"), F.col("p.created_at").alias("created_at"))


def har_entries(raw: DataFrame, url_like: str | None = None, method: str | None = None, body_like: str | None = None) -> DataFrame:
    """Archive entries that pass the filters: (archive, pos, url, method, text)."""
    e = raw.select("archive", F.posexplode("log.entries").alias("pos", "e")).select(
        "archive", "pos", F.col("e.request.url").alias("url"), F.col("e.request.method").alias("method"), F.col("e.response.content.text").alias("text"))
    if url_like:
        e = e.filter(F.col("url").contains(url_like))
    if method:
        e = e.filter(F.col("method") == method)
    if body_like:
        e = e.filter(F.col("text").contains(body_like))
    return e.filter(nonempty("text").isNotNull())


def first_har_entry(entries: DataFrame) -> DataFrame:
    return first_by(entries, ["archive"], [F.asc("pos")])


# ---------------------------------------------------------------- claim bundles


def read_bundles(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """Bundle documents of a glob with their file path, one row per paper."""
    reader = spark.read.option("multiLine", True)
    reader = reader.schema(schema) if schema else reader
    return reader.json(glob).select("*", F.col("_metadata.file_path").alias("path")).select("path", "model", "prompt_version", F.posexplode("papers").alias("position", "paper"))


def bundle_claims(papers: DataFrame) -> DataFrame:
    return papers.select("path", F.col("paper.source.source_id").alias("source_id"), F.posexplode("paper.claims").alias("position", "claim"))


def merge_knowledge_bundle(details: DataFrame, communities: DataFrame, orgs: DataFrame, posts: DataFrame | None = None) -> DataFrame:
    """Community and organisations of each disease. A community is looked for by canonical name, then by the query,
    then by the first five synonyms; the first text with any hit decides and its best hit is taken.

    Names and slugs are matched by equality or containment through :func:`containment_pairs`.
    """
    from corrobora.operators.resolve import containment_pairs

    texts = F.array_distinct(F.concat(F.array("canonical_name", "query"), F.slice(F.coalesce("synonyms", F.expr(NONE)), 1, 5)))
    asked = details.select("query", F.posexplode(texts).alias("pos", "_t")).select("query", "pos", F.lower(F.trim("_t")).alias("pattern")).filter("pattern <> ''")
    fields = communities.select("slug", F.explode(F.array_distinct(F.transform(
        F.array("name", "default_name", "slug", "description"), lambda x: F.lower(_or_empty(x))))).alias("text")).distinct()
    hits = containment_pairs(asked, fields).join(fields, "text").select("pattern", "slug").distinct()
    ranked = hits.join(communities, "slug").withColumn("tier", community_tier(F.col("pattern"))).filter("tier is not null")
    best = first_by(ranked, ["pattern"], [F.asc("tier"), F.desc("total_members"), F.asc(F.lower("name")), F.asc("slug")]).select("pattern", "slug")
    chosen = first_by(asked.join(best, "pattern"), ["query"], [F.asc("pos")]).select("query", "slug")
    n_orgs = orgs.groupBy("canonical_name").agg(F.count(F.lit(1)).alias("n_orgs"))
    out = details.join(chosen, "query", "left").join(n_orgs, "canonical_name", "left").withColumn("n_orgs", F.coalesce("n_orgs", F.lit(0)))
    if posts is not None:
        n_posts = posts.groupBy("slug").agg(F.count(F.lit(1)).alias("n_posts"))
        out = out.join(n_posts, "slug", "left").withColumn("n_posts", F.coalesce("n_posts", F.lit(0)))
    return out
