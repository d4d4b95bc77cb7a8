"""Data-quality rules. Each returns a table of violations and changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.model import (
    EDGE_TYPES, NODE_TYPES, REQUIRED_CLAIM_PROPS, REQUIRED_EDGE_PROPS, STATUSES, STRUCTURAL_RELATIONS,
    EvidenceGraph, endpoint_allowed, lookup,
)
from corrobora.session import cut_lineage


def _missing(columns: list[str], df: DataFrame):
    """Sorted names of the properties a row lacks; a column the table does not have is missing everywhere."""
    return F.array_compact(F.array(*[
        F.when(F.col(c).isNull(), F.lit(c)) if c in df.columns else F.lit(c) for c in sorted(columns)
    ]))


def with_end_types(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    types = nodes.select("id", "type")
    return (
        edges.join(types.select(F.col("id").alias("src"), F.col("type").alias("src_type")), "src", "left")
        .join(types.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    )


def schema_violations(graph: EvidenceGraph, claims: DataFrame | None = None) -> DataFrame:
    """(what, id, reason): unknown node types, incomplete claims, and edges that break the schema.

    A missing property or an unknown relation ends the checks of that edge; a wrong end type and a bad status can
    both be reported. ``claims`` is the table with the claim properties when they are not columns of the nodes.
    """
    nodes, edges = graph.nodes, graph.edges
    bad_type = nodes.filter(F.col("type").isNull() | ~F.col("type").isin(*NODE_TYPES)).select(
        F.lit("node").alias("what"), "id", F.lit("missing or unknown type").alias("reason"))
    claims = nodes.filter(F.col("type") == "Claim") if claims is None else claims
    missing_claim = _missing(REQUIRED_CLAIM_PROPS, claims)
    bad_claim = claims.filter(F.size(missing_claim) > 0).select(
        F.lit("node").alias("what"), "id", F.concat(F.lit("claim missing "), F.array_join(missing_claim, ", ")).alias("reason"))
    missing = _missing(REQUIRED_EDGE_PROPS, edges)
    typed = with_end_types(edges, nodes)
    known = F.col("rel").isin(*EDGE_TYPES)
    stop = F.when(F.size(missing) > 0, F.concat(F.lit("missing props "), F.array_join(missing, ", "))).when(
        ~known, F.concat(F.lit("unknown relation "), F.col("rel")))
    wrong_ends = F.when(
        ~endpoint_allowed(F.col("rel"), F.col("src_type"), F.col("dst_type")),
        F.concat(F.col("rel"), F.lit(" not allowed between "), F.coalesce("src_type", F.lit("None")), F.lit(" and "),
                 F.coalesce("dst_type", F.lit("None"))))
    bad_status = F.when(~F.col("status").isin(*STATUSES), F.concat(F.lit("bad status "), F.col("status")))
    reasons = F.when(stop.isNotNull(), F.array(stop)).otherwise(F.array_compact(F.array(wrong_ends, bad_status)))
    bad_edges = typed.select(
        F.lit("edge").alias("what"), F.col("edge_id").alias("id"), F.explode(reasons).alias("reason"))
    return bad_type.unionByName(bad_claim).unionByName(bad_edges)


def unverified_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Claims whose quote is empty or not verbatim in their source; ``sources(source_id, text)``."""
    return (
        claims.select("id", "quote", "pmid")
        .join(sources.select(F.col("source_id").alias("pmid"), "text"), "pmid", "left")
        .filter((F.coalesce("quote", F.lit("")) == "") | ~F.contains(F.coalesce("text", F.lit("")), F.col("quote")))
        .select("id", F.lit("quote not found in source text").alias("reason"))
    )


def unsupported_inferences(graph: EvidenceGraph) -> DataFrame:
    """Inferred or extracted edges, apart from the structural ones, without support by existing claims only."""
    inferred = graph.edges.filter(_inferred())
    claims = graph.of_type("Claim").select("id", F.lit(True).alias("_known"))
    return (
        inferred.select("edge_id", F.explode_outer("supported_by").alias("id"))
        .join(claims, "id", "left")
        .groupBy("edge_id").agg(F.bool_and(F.coalesce("_known", F.lit(False))).alias("_ok"))
        .filter(~F.col("_ok"))
        .select(F.col("edge_id").alias("id"), F.lit("inferred edge without valid supporting claim").alias("reason"))
    )


def single_weak_source(edges: DataFrame) -> DataFrame:
    return edges.filter((F.col("source_tier") == 3) & (F.col("status") != "observation")).select(
        F.col("edge_id").alias("id"), F.lit("only tier-3 source").alias("reason"))


def same_gene_different_mechanism(graph: EvidenceGraph) -> DataFrame:
    """Genes whose variants disrupt different sets of mechanisms: (gene, mechanisms, n_variants)."""
    variants = graph.of_type("Variant").select(F.col("id").alias("src"))
    genes = graph.of_rel("IN_GENE").join(variants, "src", "left_semi").select("src", F.col("dst").alias("gene")).distinct()
    sets = (
        graph.of_rel("DISRUPTS").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("mechanisms"))
    )
    tuples = (
        genes.join(sets, "src", "left").groupBy("gene", F.coalesce("mechanisms", F.lit("")).alias("mechanisms"))
        .agg(F.count(F.lit(1)).alias("n_variants"))
    )
    several = tuples.groupBy("gene").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return tuples.join(several, "gene", "left_semi")


_TYPE_BIT = {t: 1 << i for i, t in enumerate(NODE_TYPES)}
_OTHER_TYPE = 1 << len(NODE_TYPES)


def _bits(types: list[str]) -> int:
    return sum(_TYPE_BIT[t] for t in set(types))


def _ends_allowed(rel, src_bits, dst_bits):
    """True where the relation permits every type the ids of both ends have; an id without a node has none."""
    within = lambda held, types: held.bitwiseAND(F.lit(~_bits(types)).cast("long")) == 0
    ok = F.lit(False)
    for name, (left, right) in EDGE_TYPES.items():
        ok = ok | ((rel == F.lit(name)) & within(src_bits, left) & within(dst_bits, right))
    return F.coalesce(ok & (src_bits != 0) & (dst_bits != 0), F.lit(False))


def _inferred():
    """An inferred or extracted edge, apart from the structural ones."""
    return F.coalesce(
        ~F.col("rel").isin(*STRUCTURAL_RELATIONS)
        & (F.col("status").isin("inference", "hypothesis") | (F.col("method") == "llm_extracted")), F.lit(False))


def clean_graph(graph: EvidenceGraph, claims: DataFrame, sources: DataFrame) -> EvidenceGraph:
    """The graph without violating edges, without unverified claims and without the edges that touched them.

    An edge that violates no rule by itself meets what is known of each of its ends once (the types of the id, as bits, and
    whether it is an unverified claim); then it meets the other edges of its id: all of them go when one violates a rule.
    Edges without an id are only removed when they touched an unverified claim.
    """
    bad_nodes = unverified_claims(claims, sources).select("id")
    known = graph.nodes.select("id", lookup(F.col("type"), _TYPE_BIT, _OTHER_TYPE).cast("long").alias("bits"), F.lit(False).alias("lost"))
    ends = cut_lineage(
        known.unionByName(bad_nodes.select("id", F.lit(0).cast("long").alias("bits"), F.lit(True).alias("lost")))
        .groupBy("id").agg(F.bit_or("bits").alias("bits"), F.bool_or("lost").alias("lost")))
    end = lambda e: ends.select(F.col("id").alias(e), F.col("bits").alias(f"_{e}_bits"), F.col("lost").alias(f"_{e}_lost"))

    edges, support = graph.edges, F.col("supported_by")
    unsupported = _inferred() & (F.coalesce(F.size(support), F.lit(0)) <= 0)
    own = (F.size(_missing(REQUIRED_EDGE_PROPS, edges)) > 0) | ~F.col("rel").isin(*EDGE_TYPES) | ~F.col("status").isin(*STATUSES) | unsupported
    # an edge without an id meets its ends whatever it violates, because it may stay
    alone = F.coalesce(own, F.lit(True)) & F.col("edge_id").isNotNull()
    wrong = F.col("edge_id").isNotNull() & ~_ends_allowed(F.col("rel"), F.col("_src_bits"), F.col("_dst_bits"))
    touched = F.coalesce("_src_lost", F.lit(False)) | F.coalesce("_dst_lost", F.lit(False))
    met = edges.filter(~alone).join(end("src"), "src", "left").join(end("dst"), "dst", "left")
    judged = met.select(*edges.columns, wrong.alias("_bad"), touched.alias("_touched")).unionByName(
        edges.filter(alone).select("edge_id", F.lit(True).alias("_bad"), F.lit(False).alias("_touched")), allowMissingColumns=True)
    judged = judged.withColumn("_bad", F.bool_or("_bad").over(Window.partitionBy("edge_id")))
    cited = edges.filter(_inferred()).select("edge_id", F.explode("supported_by").alias("id"))
    unknown = cited.join(graph.of_type("Claim").select("id"), "id", "left_anti").select("edge_id")
    kept = judged.filter(~F.col("_bad") & ~F.col("_touched")).join(unknown, "edge_id", "left_anti").select(*edges.columns)
    return EvidenceGraph(graph.nodes.join(ends.filter("lost").select("id"), "id", "left_anti"), kept)


def missing_props_count(edges: DataFrame) -> DataFrame:
    """Edges lacking a required property, per relation, in one pass."""
    return edges.groupBy("rel").agg(
        F.count_if(F.size(_missing(REQUIRED_EDGE_PROPS, edges)) > 0).alias("n_missing"), F.count(F.lit(1)).alias("n"))


def graph_profile(graph: EvidenceGraph) -> DataFrame:
    """(kind, key, n): nodes per type, edges per relation, and nodes without a name per type."""
    types = graph.nodes.groupBy(F.lit("node").alias("kind"), F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    rels = graph.edges.groupBy(F.lit("edge").alias("kind"), F.col("rel").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    unnamed = (
        graph.nodes.filter(F.col("name").isNull() | (F.col("name") == F.col("id")))
        .groupBy(F.lit("unnamed").alias("kind"), F.col("type").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    )
    return types.unionByName(rels).unionByName(unnamed)


def absent_vocabulary(graph: EvidenceGraph) -> DataFrame:
    """Expected node types and relations that do not occur at all."""
    spark = graph.nodes.sparkSession
    expected = spark.createDataFrame(
        [("node", t) for t in NODE_TYPES] + [("edge", r) for r in EDGE_TYPES], "kind string, key string")
    present = graph_profile(graph).filter("kind <> 'unnamed'").select("kind", "key")
    return expected.join(present, ["kind", "key"], "left_anti")


def provenance_summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel", "status", "source_tier", "method").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("supported_by") > 0).alias("n_supported"))


def unresolved_mentions(nodes: DataFrame) -> DataFrame:
    """Nodes that stand for a mention nobody could resolve, per type."""
    return nodes.filter(F.col("id").startswith("MENTION:")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def disease_summary(graph: EvidenceGraph) -> DataFrame:
    """Per disease: number of outgoing edges per relation, and claims about it as relation ``claims``."""
    diseases = graph.of_type("Disease").select("id")
    out = graph.edges.filter("rel <> 'DISEASE_MATCH'").select(F.col("src").alias("id"), "rel")
    claims = graph.of_rel("ABOUT").select(F.col("dst").alias("id"), F.lit("claims").alias("rel"))
    return out.unionByName(claims).join(diseases, "id", "left_semi").groupBy("id", "rel").agg(F.count(F.lit(1)).alias("n"))


def claim_polarity(claims: DataFrame) -> DataFrame:
    return claims.groupBy("polarity", "category").agg(F.count(F.lit(1)).alias("n"))
