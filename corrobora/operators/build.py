"""Building node and edge tables with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import CONTROL_ARM, DRUG_TYPES, intervention_label, nonempty, slug, whole_word
from corrobora.model import MECHANISMS, NODE_TYPES, EvidenceGraph
from corrobora.session import first_by, ordinal_within

NONE = "cast(array() AS array<string>)"


def provenance(source: str | Column, tier: int | Column, retrieved: Column, status: str | Column = "observation", method: str = "curated_import") -> list[Column]:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return [lit(source).alias("source"), lit(tier).alias("source_tier"), retrieved.alias("retrieved"), lit(status).alias("status"), F.lit(method).alias("method")]


def add_nodes(base: DataFrame, new: DataFrame, order: str | None = None) -> DataFrame:
    """Base nodes plus the new ids; the first writer of an id wins."""
    fresh = new.join(base.select("id"), "id", "left_anti")
    fresh = first_by(fresh, ["id"], [F.asc(order)]) if order else fresh.dropDuplicates(["id"])
    return base.unionByName(fresh.drop(order) if order and order not in base.columns else fresh, allowMissingColumns=True)


def unknown_types(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~F.coalesce(F.col("type").isin(*NODE_TYPES), F.lit(False))).select("id", "type")


def add_edges(base: DataFrame, new: DataFrame) -> DataFrame:
    """Appends edges with ids ``rel:src->dst:k``, k counting all edges of the same two ends in ``seq`` order."""
    numbered = ordinal_within(new, ["src", "dst"], ["seq"], "_k")
    offset = base.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("_off"))
    keyed = numbered.join(offset, ["src", "dst"], "left").withColumn(
        "edge_id", F.concat("rel", F.lit(":"), "src", F.lit("->"), "dst", F.lit(":"), F.col("_k") + F.coalesce("_off", F.lit(0))))
    return base.unionByName(keyed.drop("_k", "_off"), allowMissingColumns=True)


def mechanism_nodes(spark) -> DataFrame:
    """The closed mechanism vocabulary; edges to it need evidence."""
    return spark.createDataFrame([(k, "Mechanism", v) for k, v in MECHANISMS.items()], "id string, type string, name string")


def entity_nodes(resolved: DataFrame) -> DataFrame:
    """Disease nodes of the resolved seeds; manual cross references are appended and the genes give the short name."""
    return resolved.filter("found").select(
        "id", F.lit("Disease").alias("type"), F.col("label").alias("name"), F.array_join("genes", ",").alias("short"),
        "synonyms", F.concat(F.coalesce("xrefs", F.expr(NONE)), "manual_xrefs").alias("xrefs"), "definition")


def gene_nodes_and_links(resolved: DataFrame, genes: DataFrame, retrieved: Column) -> EvidenceGraph:
    """Gene nodes and their disease links: an observation when the ontology text names the gene, else a hypothesis."""
    text = F.concat_ws(" ", "label", "definition", F.array_join(F.coalesce("synonyms", F.expr(NONE)), " "))
    pairs = resolved.filter("found").select("id", text.alias("_t"), F.explode("genes").alias("symbol"))
    linked = pairs.join(genes.select("symbol", "hgnc_id", F.col("name").alias("full_name")), "symbol", "left").withColumn(
        "gene", F.coalesce("hgnc_id", F.concat(F.lit("GENE:"), "symbol"))).withColumn("_named", whole_word("_t", "symbol"))
    nodes = linked.select(F.col("gene").alias("id"), F.lit("Gene").alias("type"), F.col("symbol").alias("name"), "full_name", "hgnc_id").dropDuplicates(["id"])
    named = F.col("_named")
    edges = linked.select(
        F.col("id").alias("src"), F.col("gene").alias("dst"), F.lit("ASSOCIATED_WITH").alias("rel"),
        *provenance(F.when(named, "ontology definition").otherwise("seed list (unverified)"), F.when(named, 1).otherwise(3), retrieved,
                    F.when(named, "observation").otherwise("hypothesis")))
    return EvidenceGraph(nodes, edges)


def annotation_links(phenotypes: DataFrame, names: DataFrame, retrieved: Column) -> tuple[EvidenceGraph, DataFrame]:
    """One edge per (disease, term), and the source rows behind it as evidence rows.

    phenotypes(mondo, source_id, hpo_id, frequency, evidence, reference), ids already current.
    """
    terms = phenotypes.select(F.col("hpo_id").alias("id")).distinct().join(names.select("id", "label"), "id", "left").select(
        "id", F.lit("Phenotype").alias("type"), F.coalesce("label", "id").alias("name"))
    edges = phenotypes.groupBy(F.col("mondo").alias("src"), F.col("hpo_id").alias("dst")).agg(F.count(F.lit(1)).alias("n_evidence")).select(
        "src", "dst", F.lit("HAS_PHENOTYPE").alias("rel"), *provenance("HPO", 1, retrieved), "n_evidence")
    evidence = phenotypes.select(F.col("mondo").alias("src"), F.col("hpo_id").alias("dst"), F.col("source_id").alias("via"), "reference", F.col("evidence").alias("code"), "frequency")
    return EvidenceGraph(terms, edges), evidence


def variant_nodes_and_links(variants: DataFrame, genes: DataFrame, retrieved: Column) -> EvidenceGraph:
    """Variant nodes and one IN_GENE edge per row; rows of genes that are not nodes are skipped."""
    known = variants.join(genes.select(F.col("id").alias("hgnc_id")), "hgnc_id", "left_semi").withColumn(
        "vid", F.concat(F.lit("CLINVAR:"), F.coalesce(nonempty("accession"), "variation_id")))
    stars = F.coalesce(F.col("review_stars").cast("string").try_cast("int"), F.lit(0))
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("classification", "consequence", "traits", "protein_change", "cdna_change")]
    nodes = known.select(F.col("vid").alias("id"), F.lit("Variant").alias("type"), F.coalesce(nonempty("title"), "vid").alias("name"), *text).dropDuplicates(["id"])
    edges = known.select(F.col("vid").alias("src"), F.col("hgnc_id").alias("dst"), F.lit("IN_GENE").alias("rel"), *provenance("ClinVar", 1, retrieved),
                         F.coalesce("review_status", F.lit("")).alias("review_status"), stars.alias("review_stars"))
    return EvidenceGraph(nodes, edges)


def trial_layer(trials: DataFrame, retrieved: Column) -> EvidenceGraph:
    """Studies, what they study (with the match reason) and the substances they test.

    trials(entity, nct, title, status, why, interventions ARRAY<STRUCT<name, type>>).
    """
    study = F.concat(F.lit("NCT:"), "nct")
    nodes = trials.select(study.alias("id"), F.lit("Study").alias("type"), F.col("title").alias("name")).dropDuplicates(["id"])
    studies = trials.select(study.alias("src"), F.col("entity").alias("dst"), F.lit("STUDIES").alias("rel"), F.col("why").alias("match_reason"))
    arms = trials.select(study.alias("src"), F.explode("interventions").alias("i")).filter(
        F.col("i.type").isin(*DRUG_TYPES) & ~F.rlike("i.name", F.lit(CONTROL_ARM))).withColumn("label", intervention_label("i.name")).filter(F.length("label") >= 3)
    drug = F.concat(F.lit("INT:"), slug("label"))
    drugs = arms.groupBy(drug.alias("id")).agg(F.min("label").alias("name")).select("id", F.lit("Intervention").alias("type"), "name")
    tests = arms.select("src", drug.alias("dst"), F.lit("TESTS").alias("rel"), F.lit(None).cast("string").alias("match_reason")).distinct()
    edges = studies.unionByName(tests).select("*", *provenance("ClinicalTrials.gov", 1, retrieved))
    return EvidenceGraph(nodes.unionByName(drugs), edges)


def org_layer(cards: DataFrame, communities: DataFrame, directory: DataFrame, retrieved: Column) -> EvidenceGraph:
    """Patient organisations of three directories: cards(entity, name), communities(entity, slug, name),
    directory(entity, id, name, code, closest)."""
    closest = F.coalesce(F.concat(F.lit(" ("), "closest", F.lit(", closest Orphanet entry)")), F.lit(""))
    parts = [
        cards.select("entity", F.concat(F.lit("ORG:nord:"), slug("name")).alias("id"), "name", F.lit("NORD").alias("directory"), F.lit("listed on the NORD disease report").alias("why")),
        communities.select("entity", F.concat(F.lit("ORG:rareconnect:"), "slug").alias("id"), "name", F.lit("RareConnect").alias("directory"), F.lit("community name matches the disease").alias("why")),
        directory.select("entity", F.concat(F.lit("ORG:orphanet:"), "id").alias("id"), "name", F.lit("Orphanet").alias("directory"),
                         F.concat(F.lit("Orphanet lists it for ORPHA:"), "code", closest).alias("why")),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    nodes = rows.groupBy("id").agg(F.min("name").alias("name"), F.first("directory").alias("directory")).withColumn("type", F.lit("PatientOrg"))
    edges = rows.select(F.col("entity").alias("src"), F.col("id").alias("dst"), F.lit("REPRESENTED_BY").alias("rel"), F.col("why").alias("match_reason"),
                        *provenance(F.col("directory"), 3, retrieved))
    return EvidenceGraph(nodes, edges)


def grant_layer(grants: DataFrame, retrieved: Column) -> EvidenceGraph:
    """Grants, the genes they research, and investigators, who are identified by their profile id only.

    grants(core, gene, symbol, project_title, investigators ARRAY<STRUCT<profile_id, name>>).
    """
    gid = F.concat(F.lit("NIH:"), "core")
    nodes = grants.select(gid.alias("id"), F.lit("Grant").alias("type"), F.col("project_title").alias("name")).dropDuplicates(["id"])
    led = grants.select(gid.alias("dst"), F.explode("investigators").alias("p")).select(F.concat(F.lit("RES:nih:"), "p.profile_id").alias("src"), "dst", F.col("p.name").alias("name"))
    people = led.groupBy(F.col("src").alias("id")).agg(F.min("name").alias("name")).select("id", F.lit("Researcher").alias("type"), "name")
    researches = grants.select(gid.alias("src"), F.col("gene").alias("dst"), F.lit("RESEARCHES").alias("rel"), F.concat(F.lit("project text mentions "), "symbol").alias("match_reason"))
    leads = led.select("src", "dst", F.lit("LEADS").alias("rel"), F.lit(None).cast("string").alias("match_reason")).distinct()
    return EvidenceGraph(nodes.unionByName(people), researches.unionByName(leads).select("*", *provenance("NIH RePORTER", 1, retrieved)))


def gene_group_layer(genes: DataFrame, retrieved: Column) -> EvidenceGraph:
    """genes(id, gene_group_id ARRAY, gene_group ARRAY): the two lists are parallel; the longer one is cut."""
    pairs = genes.select("id", F.explode(F.arrays_zip(F.col("gene_group_id").alias("gid"), F.col("gene_group").alias("name"))).alias("g")).filter(
        F.col("g.gid").isNotNull() & F.col("g.name").isNotNull())
    group = F.concat(F.lit("HGNC_GROUP:"), "g.gid")
    nodes = pairs.select(group.alias("id"), F.lit("GeneGroup").alias("type"), F.col("g.name").alias("name")).dropDuplicates(["id"])
    edges = pairs.select(F.col("id").alias("src"), group.alias("dst"), F.lit("MEMBER_OF").alias("rel"), F.lit("HGNC gene group membership").alias("match_reason"),
                         *provenance("HGNC", 1, retrieved))
    return EvidenceGraph(nodes, edges)


def entity_props(diseases: DataFrame, details: DataFrame, n: int = 6) -> DataFrame:
    """External id and the first reading items of the found details on the disease nodes."""
    items = F.transform(F.slice("literature", 1, n), lambda x: F.struct(x["pmid"].alias("pmid"), x["title"].alias("title"), x["year"].alias("year"), x["journal"].alias("journal")))
    return diseases.join(details.filter("is_found").select(F.col("entity").alias("id"), "gard_id", items.alias("reading")), "id", "left")


def bundle_to_graph(diseases: DataFrame, genes: DataFrame, papers: DataFrame, communities: DataFrame, orgs: DataFrame, retrieved: Column) -> EvidenceGraph:
    """Knowledge bundles as nodes and edges. diseases(query, canonical_name, gard_id); the other tables carry ``query``.

    Papers without a pmid are skipped; each paper contributes its title as one claim about the disease.
    """
    did = diseases.select("query", F.concat(F.lit("Disease:"), F.coalesce(nonempty("gard_id"), "canonical_name")).alias("d"), "canonical_name")
    node = lambda df, i, t, name: df.select(i.alias("id"), F.lit(t).alias("type"), name.alias("name"))
    edge = lambda df, s, d, rel, source, tier: df.select(s.alias("src"), d.alias("dst"), F.lit(rel).alias("rel"), *provenance(source, tier, retrieved))
    g = did.join(genes, "query").withColumn("g", F.concat(F.lit("Gene:"), "gene_symbol"))
    p = did.join(papers.filter(nonempty("pmid").isNotNull()), "query").withColumn("p", F.concat(F.lit("PMID:"), "pmid")).withColumn("c", F.concat(F.lit("CLAIM:"), "pmid", F.lit(":1")))
    m = did.join(communities, "query").withColumn("o", F.concat(F.lit("PatientOrg:"), "slug"))
    o = did.join(orgs, "query").withColumn("o", F.concat(F.lit("PatientOrg:nord:"), slug("name")))
    title = F.coalesce(nonempty("title"), F.concat(F.lit("Literature citation for "), "canonical_name"))
    nodes = [
        node(did, F.col("d"), "Disease", F.col("canonical_name")), node(g, F.col("g"), "Gene", F.col("gene_symbol")),
        node(p, F.col("p"), "Paper", F.col("title")), node(p, F.col("c"), "Claim", title),
        node(m, F.col("o"), "PatientOrg", F.col("name")), node(o, F.col("o"), "PatientOrg", F.col("name")),
    ]
    edges = [
        edge(g, F.col("d"), F.col("g"), "ASSOCIATED_WITH", "RARe-SOURCE", 1), edge(p, F.col("p"), F.col("c"), "CONTAINS", F.col("p"), 2),
        edge(p, F.col("c"), F.col("d"), "ABOUT", F.col("p"), 2), edge(m, F.col("d"), F.col("o"), "REPRESENTED_BY", "RareConnect", 3),
        edge(o, F.col("d"), F.col("o"), "REPRESENTED_BY", "NORD", 3),
    ]
    all_nodes, all_edges = nodes[0], edges[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n)
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e)
    return EvidenceGraph(all_nodes.groupBy("id", "type").agg(F.min("name").alias("name")), all_edges)


def entity_to_gene(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity, gene): the gene of the last association of each disease."""
    genes = nodes.filter("type = 'Gene'").select(F.col("id").alias("dst"))
    return edges.filter("rel = 'ASSOCIATED_WITH'").join(genes, "dst", "left_semi").groupBy(F.col("src").alias("entity")).agg(
        F.max_by("dst", F.struct("seq", "dst")).alias("gene"))
