"""Importing reviewed claims into a graph: promotion, corroboration and counter-evidence.

Claims are ordered by ``seq``. The order-dependent rules reduce to aggregates per (src, dst, rel): the first
qualifying claim creates the edge, every later one corroborates it, and a counter-claim attaches to the edges that
exist before it. Evidence stays in rows, so an edge with millions of supporting claims is never one array.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import first_at, norm_mention
from corrobora.model import MECHANISMS, PROMOTABLE, UNRESOLVED_VARIANT_OK, EvidenceGraph
from corrobora.session import cut_lineage, first_by


class ClaimImport(NamedTuple):
    nodes: DataFrame
    edges: DataFrame
    problems: DataFrame


class Promotion(NamedTuple):
    edges: DataFrame  # base and new edges with updated status, tier and flags
    evidence: DataFrame  # (src, dst, rel, claim, polarity, role) of every claim that counts for an edge


def _digest(*cols) -> Column:
    return F.sha2(F.concat_ws("\x1f", *cols), 256)


def paper_id(source_id="source_id", sha256="sha256") -> Column:
    return F.concat(F.lit("PAPER:"), _digest(source_id, sha256))


def _edge(src, dst, rel: str, *extra) -> list:
    return [src.alias("src"), dst.alias("dst"), F.lit(rel).alias("rel"), *extra]


def approved_new_claims(graph: EvidenceGraph, claims: DataFrame, approved: DataFrame) -> DataFrame:
    """Approved claims the graph does not hold yet; importing the same bundle twice adds nothing."""
    return claims.join(approved.select("id"), "id", "left_semi").join(graph.nodes.select("id"), "id", "left_anti")


def located_entities(claims: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """Claim entities with their node id: the canonical id, else a mention id that is local to the paper."""
    papers = sources.select("source_id", paper_id().alias("paper"))
    return (
        entities.join(claims.select(F.col("id").alias("claim_id"), "source_id", "seq"), "claim_id").join(papers, "source_id")
        .withColumn("node_id", F.coalesce("canonical_id", F.concat(F.lit("MENTION:"), _digest("paper", "kind", "mention"))))
    )


def import_claims(
    graph: EvidenceGraph, claims: DataFrame, entities: DataFrame, sources: DataFrame, approved: DataFrame, retrieved: Column
) -> ClaimImport:
    """New nodes and edges for the approved claims, and what is wrong with them.

    claims(id, source_id, seq, statement, quote, subject, object, relation, polarity, status, category);
    entities(claim_id, local_id, kind, mention, canonical_id, status, method); sources(source_id, sha256, title,
    source_tier); approved(id).
    """
    new = approved_new_claims(graph, claims, approved)
    papers = sources.withColumn("paper", paper_id())
    with_paper = new.join(papers.select("source_id", "paper", "source_tier"), "source_id")
    located = located_entities(new, entities, sources)
    known = graph.nodes.select(F.col("id").alias("node_id"), F.col("type").alias("_type"))
    checked = located.join(known, "node_id", "left")
    problems = (
        checked.filter(F.col("_type").isNotNull() & (F.col("_type") != F.col("kind")))
        .select(F.col("node_id").alias("id"), F.lit("canonical ID conflicts with existing node type").alias("reason"))
        .unionByName(checked.filter(F.col("_type").isNull() & (F.col("method") == "reviewed_alias"))
                     .select(F.col("node_id").alias("id"), F.lit("alias target is not in the graph").alias("reason")))
        .distinct()
    )
    no = F.lit(None).cast("string")
    paper_nodes = papers.join(with_paper.select("paper").distinct(), "paper", "left_semi").select(
        F.col("paper").alias("id"), F.lit("Paper").alias("type"), F.coalesce("title", "source_id").alias("name"), F.lit(False).alias("paper_scoped"), no.alias("name_key"))
    claim_nodes = new.select("id", F.lit("Claim").alias("type"), F.col("statement").alias("name"), F.lit(False).alias("paper_scoped"), no.alias("name_key"))
    entity_nodes = first_by(checked.filter("_type is null"), ["node_id"], [F.asc("seq"), F.asc("local_id")]).select(
        F.col("node_id").alias("id"), F.col("kind").alias("type"), F.col("mention").alias("name"),
        (F.col("canonical_id").isNull() | (F.col("kind") == "Disease")).alias("paper_scoped"),
        F.when(F.col("kind") == "Researcher", norm_mention("mention")).alias("name_key"))
    nodes = paper_nodes.join(graph.nodes.select("id"), "id", "left_anti").unionByName(claim_nodes).unionByName(entity_nodes)
    prov = [F.col("source_id").alias("source"), "source_tier", retrieved.alias("retrieved"), "status",
            F.lit("llm_extracted").alias("method"), F.array("id").alias("supported_by"), "polarity", "seq"]
    contains = with_paper.select(*_edge(F.col("paper"), F.col("id"), "CONTAINS", *prov))
    about = with_paper.join(located.select(F.col("claim_id").alias("id"), "node_id"), "id").select(*_edge(F.col("id"), F.col("node_id"), "ABOUT", *prov))
    authors = (
        with_paper.filter("relation = 'AUTHORED' AND object = 'PAPER' AND polarity = 'affirmed'")
        .join(located.select(F.col("claim_id").alias("id"), F.col("local_id").alias("subject"), "node_id"), ["id", "subject"])
        .select(*_edge(F.col("node_id"), F.col("paper"), "AUTHORED", *prov))
    )
    return ClaimImport(nodes, contains.unionByName(about).unionByName(authors), problems)


def promotable(claims: DataFrame, located: DataFrame) -> DataFrame:
    """Claims with a promotable relation and usable ends, as (id, seq, src, dst, rel, polarity, status, source_tier).

    Both ends must be resolved; an unresolved variant is accepted on two of the relations.
    """
    side = lambda end, a: located.select(
        F.col("claim_id").alias("id"), F.col("local_id").alias(end), F.col("node_id").alias(a),
        (F.col("canonical_id").isNotNull()).alias(f"_{a}_ok"), (F.col("kind") == "Variant").alias(f"_{a}_var"))
    lenient = F.col("relation").isin(*UNRESOLVED_VARIANT_OK)
    return (
        claims.filter(F.col("relation").isin(*PROMOTABLE))
        .join(side("subject", "src"), ["id", "subject"]).join(side("object", "dst"), ["id", "object"])
        .filter((F.col("_src_ok") | (F.col("_src_var") & lenient)) & (F.col("_dst_ok") | (F.col("_dst_var") & lenient)))
        .select("id", "seq", "src", "dst", F.col("relation").alias("rel"), "polarity", "status", "source_tier")
    )


def promote_claims(base: DataFrame, claims: DataFrame) -> Promotion:
    """Applies promotable claims to the base edges.

    base(edge_id, src, dst, rel, seq, status, source_tier); claims as returned by :func:`promotable`. Affirmed
    observations create the edge or corroborate the first existing one; a hypothesis becomes an observation with the
    smaller tier of itself and the first claim that confirms it. Negated and uncertain claims only flag the edges
    that exist before them.
    """
    key = ["src", "dst", "rel"]
    pro = claims.filter("polarity = 'affirmed' AND status = 'observation'")
    con = claims.filter("polarity <> 'affirmed'")
    support = pro.groupBy(*key).agg(
        F.min("seq").alias("_first"), F.min_by("source_tier", "seq").alias("_tier"), F.count(F.lit(1)).alias("n_support"))
    first = base.groupBy(*key).agg(F.min_by("edge_id", F.struct("seq", "edge_id")).alias("edge_id")).withColumn("_lead", F.lit(True))
    lifted = F.col("_lead") & F.col("_tier").isNotNull()
    old = (
        base.join(first, [*key, "edge_id"], "left").withColumn("_lead", F.coalesce("_lead", F.lit(False)))
        .join(support, key, "left")
        .select(
            "edge_id", *key, "seq",
            F.when(lifted & (F.col("status") == "hypothesis"), "observation").otherwise(F.col("status")).alias("status"),
            F.when(lifted & (F.col("status") == "hypothesis"), F.least("source_tier", "_tier")).otherwise(F.col("source_tier")).alias("source_tier"),
            F.when(F.col("_lead"), F.coalesce("n_support", F.lit(0))).otherwise(0).alias("n_support"),
            F.lit(None).cast("long").alias("_created"))
    )
    new = support.join(base.select(*key).distinct(), key, "left_anti").select(
        F.concat(F.concat_ws(":", "rel", F.concat_ws("->", "src", "dst")), F.lit(":0")).alias("edge_id"), *key, F.col("_first").alias("seq"),
        F.lit("observation").alias("status"), F.col("_tier").alias("source_tier"), "n_support", F.col("_first").alias("_created"))
    edges = old.unionByName(new)
    hits = con.select(*key, F.col("id").alias("claim"), "polarity", F.col("seq").alias("_cs")).join(edges, key).filter("_created is null OR _cs > _created")
    flags = hits.groupBy("edge_id", *key).agg(
        F.bool_or(F.col("polarity") == "negated").alias("contradicted"), F.bool_or(F.col("polarity") != "negated").alias("uncertain"))
    no = F.lit(False)
    flagged = (
        edges.join(flags, ["edge_id", *key], "left").drop("_created")
        .withColumn("contradicted", F.coalesce("contradicted", no)).withColumn("uncertain", F.coalesce("uncertain", no))
    )
    evidence = pro.select(*key, F.col("id").alias("claim"), "polarity", F.lit("support").alias("role")).unionByName(
        hits.select(*key, "claim", "polarity", F.lit("counter").alias("role")).distinct())
    return Promotion(flagged, evidence)


def curated_problems(rows: DataFrame, sources: DataFrame, nodes: DataFrame) -> DataFrame:
    """First problem of each curated row (disease, mechanism, source_id, quote, reviewer).

    Rows meet the text of their source once and bring away what it tells: ``start`` of the quote, and the ``sha256`` and
    ``source_tier`` of the source where it has them.
    """
    told = [c for c in ("sha256", "source_tier") if c in sources.columns]
    located = cut_lineage(
        rows.join(sources.select("source_id", "text", *told), "source_id", "left")
        .withColumn("start", first_at("text", "quote")).withColumn("_known", F.col("text").isNotNull()).drop("text")
    )
    vocabulary = F.col("mechanism").isin(*MECHANISMS)
    reason = (
        F.when(~F.col("_known"), "unknown source")
        .when((F.coalesce("quote", F.lit("")) == "") | (F.col("start") < 0), "quote not found verbatim")
        .when(~F.coalesce(F.col("_t") == "Disease", F.lit(False)), "unknown disease")
        .when(~vocabulary, "unknown mechanism")
        .when(F.trim(F.coalesce("reviewer", F.lit(""))) == "", "curated mechanism needs a reviewer"))
    joined = located.join(nodes.select(F.col("id").alias("disease"), F.col("type").alias("_t")), "disease", "left")
    return joined.withColumn("reason", reason).drop("_t", "_known")


def import_curated_mechanisms(rows: DataFrame, sources: DataFrame, nodes: DataFrame, retrieved: Column) -> ClaimImport:
    """Disease INVOLVES mechanism rows recorded by people, each with a verbatim quote and its claim node."""
    checked = curated_problems(rows, sources, nodes)
    good = (
        checked.filter("reason is null")
        .withColumn("claim", F.concat(F.lit("CLAIM:"), _digest("source_id", "disease", "mechanism", "quote")))
        .withColumn("paper", paper_id())
        .dropDuplicates(["claim"]).join(nodes.select(F.col("id").alias("claim")), "claim", "left_anti")
    )
    claim_nodes = good.select(F.col("claim").alias("id"), F.lit("Claim").alias("type"), F.col("quote").alias("name"))
    paper_nodes = good.select(F.col("paper").alias("id"), F.lit("Paper").alias("type"), F.col("source_id").alias("name")).distinct().join(nodes.select("id"), "id", "left_anti")
    prov = [F.col("source_id").alias("source"), "source_tier", retrieved.alias("retrieved"), F.lit("observation").alias("status"),
            F.lit("curated_import").alias("method"), F.array("claim").alias("supported_by"), "start", (F.col("start") + F.length("quote")).alias("end")]
    links = [("paper", "claim", "CONTAINS"), ("claim", "disease", "ABOUT"), ("claim", "mechanism", "ABOUT"), ("disease", "mechanism", "INVOLVES")]
    edges = None
    for src, dst, rel in links:
        part = good.select(*_edge(F.col(src), F.col(dst), rel, *prov))
        edges = part if edges is None else edges.unionByName(part)
    return ClaimImport(claim_nodes.unionByName(paper_nodes), edges, checked.filter("reason is not null").select("disease", "mechanism", "source_id", "reason"))


class QuotedMechanisms(NamedTuple):
    involves: DataFrame
    evidence: DataFrame
    discusses: DataFrame
    dropped: DataFrame


def verified_quote_mechanisms(rows: DataFrame, abstracts: DataFrame, existing_papers: DataFrame) -> QuotedMechanisms:
    """Curated rows checked against abstracts; rows whose quote is not verbatim are reported, never repaired.

    rows(disease, mechanism, pmid, quote, variant_dependent); abstracts(pmid, title, year, abstract);
    existing_papers(source_id, id): a paper that is already in the graph keeps its node id.
    """
    joined = rows.join(abstracts, "pmid", "left")
    ok = F.coalesce(F.contains("abstract", "quote"), F.lit(False))
    kept = (
        joined.filter(ok).withColumn("source_id", F.concat(F.lit("PMID:"), "pmid"))
        .join(existing_papers.select("source_id", F.col("id").alias("_id")), "source_id", "left")
        .withColumn("paper", F.coalesce("_id", "source_id"))
    )
    evidence = kept.select("disease", "mechanism", "paper", "source_id", "quote", "title", "year")
    involves = kept.groupBy("disease", "mechanism").agg(
        F.count(F.lit(1)).alias("n_quotes"), F.count_distinct("paper").alias("n_papers"), F.bool_or("variant_dependent").alias("variant_dependent"))
    discusses = kept.select(F.col("paper").alias("src"), F.col("disease").alias("dst"), F.lit("DISCUSSES").alias("rel"), F.lit("cited as mechanism evidence").alias("link_reason"))
    return QuotedMechanisms(involves, evidence, discusses, joined.filter(~ok).select("disease", "mechanism", "pmid"))
