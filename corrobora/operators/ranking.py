"""Selection and ranking per entity. Every top-k is a row_number filter, which Spark limits before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import match_reason, org_focus, review_stars, specific_terms, whole_word
from corrobora.model import EvidenceGraph
from corrobora.operators.resolve import containment_pairs
from corrobora.session import cut_lineage, first_by, top_by

KEPT_CLASSES = ["pathogenic", "likely pathogenic", "pathogenic/likely pathogenic"]
LOSS_CONSEQUENCES = ["nonsense", "frameshift", "splice"]
STATUS_RANK = {"RECRUITING": 0, "NOT_YET_RECRUITING": 1, "ACTIVE_NOT_RECRUITING": 2, "ENROLLING_BY_INVITATION": 2, "COMPLETED": 3}
MAX_TRIALS, MAX_GRANTS, MAX_VARIANTS = 60, 15, 200

# Points of the display ranking.
CLASS_POINTS = {"pathogenic": 30, "likely pathogenic": 24, "uncertain significance": 9, "vus": 9, "likely benign": 3, "benign": 0}
OTHER_CLASS_POINTS = 6
REVIEW_POINTS = [
    ("practice guideline", 15), ("reviewed by expert panel", 14),
    ("criteria provided, multiple submitters, no conflicts", 11), ("criteria provided, single submitter", 6),
    ("no assertion criteria provided", 1),
]
CONSEQUENCE_POINTS = [
    ("frameshift", 20), ("nonsense", 20), ("stop gained", 20), ("splice acceptor", 18), ("splice donor", 18),
    ("start lost", 16), ("missense", 10), ("in-frame deletion", 8), ("in-frame insertion", 8), ("synonymous", 2),
]


def select_variants(variants: DataFrame, k: int = MAX_VARIANTS, multigene: bool = False) -> DataFrame:
    """Best-reviewed, then newest pathogenic variants of each gene symbol.

    Input columns: symbol, variation_id, classification, genes_on_record (``;`` list), review_status, last_evaluated.
    """
    on_record = F.split("genes_on_record", ";")
    kept = variants.filter(
        F.lower("classification").isin(*KEPT_CLASSES) & F.array_contains(on_record, F.col("symbol"))
        & (F.lit(multigene) | (F.size(on_record) == 1))
    ).withColumn("review_stars", review_stars("review_status"))
    return top_by(kept, ["symbol"], [F.desc("review_stars"), F.desc("last_evaluated"), F.asc("variation_id")], k)


def variant_report(variants: DataFrame, selected: DataFrame) -> DataFrame:
    """Per gene: records found, kept, with at least two stars, with a loss-type consequence."""
    loss = F.lit(False)
    for word in LOSS_CONSEQUENCES:
        loss = loss | F.col("consequence").contains(word)
    found = variants.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_found"))
    kept = selected.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("review_stars") >= 2).alias("n_two_stars"),
        F.count_if(loss).alias("n_loss"))
    return found.join(kept, "symbol", "left").na.fill(0, ["n_kept", "n_two_stars", "n_loss"])


def _first_points(text: Column, table: list) -> Column:
    out = F.lit(0)
    for label, points in reversed(table):
        out = F.when(text.contains(label), F.lit(points)).otherwise(out)
    return out


def rank_variants(
    graph: EvidenceGraph, diseases: DataFrame, variants: DataFrame, k: int = 5
) -> DataFrame:
    """Display ranking (0-100, not clinical) of the variants of each disease's genes.

    ``diseases(id, name)``; ``variants(id, name, classification, review_status, consequence, traits)``. Everything
    that depends on the variant alone is scored once, before the join with the diseases.
    """
    about = graph.of_rel("ABOUT").groupBy(F.col("dst").alias("id")).agg(F.least(F.count(F.lit(1)) * 5, F.lit(10)).alias("literature"))
    breaks = graph.of_rel("DISRUPTS").groupBy(F.col("src").alias("id")).agg(F.lit(5).alias("mechanism"))
    low = lambda c: F.trim(F.lower(F.coalesce(F.col(c), F.lit(""))))
    cls = low("classification")
    class_points = F.lit(OTHER_CLASS_POINTS)
    for label, points in CLASS_POINTS.items():
        class_points = F.when(cls == label, F.lit(points)).otherwise(class_points)
    scored = (
        variants.select("id", "name", "classification", "review_status", "consequence", "traits")
        .join(about, "id", "left").join(breaks, "id", "left")
        .withColumn("_class", class_points).withColumn("_review", _first_points(low("review_status"), REVIEW_POINTS))
        .withColumn("_cons", _first_points(low("consequence"), CONSEQUENCE_POINTS))
        .withColumn("_lit", F.coalesce("literature", F.lit(0))).withColumn("_mech", F.coalesce("mechanism", F.lit(0)))
        .withColumn("_traits", F.lower(F.coalesce("traits", F.lit(""))))
    )
    genes = graph.of_type("Gene").select(F.col("id").alias("gene"))
    links = graph.of_rel("ASSOCIATED_WITH").select(F.col("src").alias("disease"), F.col("dst").alias("gene")).distinct()
    in_gene = graph.of_rel("IN_GENE").select(F.col("src").alias("id"), F.col("dst").alias("gene")).distinct()
    named = diseases.select(F.col("id").alias("disease"), F.lower("name").alias("_name"))
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: F.length(w) >= 4))
    # Score = base(variant) + 20 if the trait matches. So a variant can only reach the top k of a disease if it is in the
    # top k by base of its gene, or of its gene and a shared trait word, or of its gene and a trait text that contains the
    # disease name. A gene with very many diseases and variants never multiplies the two.
    base = cut_lineage(scored.withColumn("_base", F.col("_class") + F.col("_review") + F.col("_cons") + F.col("_lit") + F.col("_mech")).join(in_gene, "id"))
    order = [F.desc("_base"), F.asc("name"), F.asc("id")]
    columns = base.columns
    by_gene = top_by(base, ["gene"], order, k).select(*columns)
    by_word = top_by(base.withColumn("_word", F.explode(words(F.col("_traits")))), ["gene", "_word"], order, k).select("_word", *columns)
    by_text = top_by(base, ["gene", "_traits"], order, k).select(*columns)
    pairs = cut_lineage(links.join(named, "disease").join(genes, "gene", "left_semi"))
    inside = containment_pairs(named.select(F.col("_name").alias("pattern")), base.select(F.col("_traits").alias("text"))).select(
        F.col("pattern").alias("_name"), F.col("text").alias("_traits"))
    wanted = ["disease", "_name", *columns]
    options = (
        pairs.join(by_gene, "gene").select(*wanted)
        .unionByName(pairs.withColumn("_word", F.explode(words(F.col("_name")))).join(by_word, ["gene", "_word"]).select(*wanted))
        .unionByName(pairs.join(inside, "_name").join(by_text, ["gene", "_traits"]).select(*wanted))
        .dropDuplicates(["disease", "gene", "id"])
    )
    match = ((F.col("_name") != "") & F.contains(F.col("_traits"), F.col("_name"))) | F.arrays_overlap(words(F.col("_name")), words(F.col("_traits")))
    trait = F.when(match, 20).otherwise(0)
    total = F.least(F.col("_base") + trait, F.lit(100))
    reasons = F.array_compact(F.array(
        F.when(F.col("_class") >= 24, "pathogenic classification"),
        F.when(F.col("_review") >= 11, "strong review").when(F.col("_review") >= 6, "review evidence"),
        F.when(match, "trait matches selected disease"),
        F.when(F.col("_cons") > 0, F.concat("consequence", F.lit(" consequence"))),
        F.when(F.col("_lit") > 0, F.concat(F.col("_lit").cast("string"), F.lit(" points literature support"))),
        F.when(F.col("_mech") > 0, "mechanism evidence"),
    ))
    candidates = options.select(
        "disease", "gene", F.col("id").alias("variant"), "name", "classification", "consequence", total.alias("score"), reasons.alias("reasons"))
    return top_by(candidates, ["disease"], [F.desc("score"), F.asc("name"), F.asc("variant")], k)


def attach_top_variants(ranked: DataFrame) -> DataFrame:
    """The ranked list shown on each gene; a gene of several diseases shows the list of the last one."""
    last = ranked.groupBy("gene").agg(F.max("disease").alias("disease"))
    return ranked.join(last, ["gene", "disease"], "left_semi")


def select_trials(entities: DataFrame, trials: DataFrame, k: int = MAX_TRIALS) -> DataFrame:
    """Trials of each entity that name it or its gene, most active first, then most recent.

    ``entities(entity, name, synonyms, gene)``; ``trials(entity, seq, nct, title, official_title, conditions,
    status, start)`` is the landed result of the entity's searches, so a trial may occur more than once.
    """
    matched = (
        first_by(trials.filter(F.col("nct") != ""), ["entity", "nct"], [F.asc("seq")])
        .join(entities.select("entity", specific_terms("name", "synonyms").alias("_terms"), "gene"), "entity")
        .withColumn("why", match_reason(F.concat("conditions", F.array("title", "official_title")), "_terms", "gene"))
        .filter(F.col("why").isNotNull())
    )
    rank = F.lit(9)
    for status, value in STATUS_RANK.items():
        rank = F.when(F.col("status") == status, F.lit(value)).otherwise(rank)
    year = F.coalesce(F.left("start", F.lit(4)).try_cast("int"), F.lit(0))
    return top_by(
        matched.withColumn("_status", rank).withColumn("_year", year), ["entity"],
        [F.asc("_status"), F.desc("_year"), F.asc("start"), F.asc("nct")], k,
    ).drop("_terms", "_status", "_year")


def select_grants(grants: DataFrame, k: int = MAX_GRANTS) -> DataFrame:
    """Grants whose text has the gene as a whole word: latest year per core project, then the ``k`` best per gene.

    Columns: gene, seq, core_project_num, project_num, project_title, abstract_text, fiscal_year, award_amount.
    """
    text = F.concat_ws(" ", F.coalesce("project_title", F.lit("")), F.coalesce("abstract_text", F.lit("")))
    hits = grants.filter(whole_word(text, "gene", ignore_case=True)).withColumn(
        "core", F.coalesce("core_project_num", "project_num"))
    year, amount = F.coalesce("fiscal_year", F.lit(0)), F.coalesce("award_amount", F.lit(0.0))
    latest = first_by(hits, ["gene", "core"], [F.desc(year), F.asc("seq")])
    in_title = F.contains(F.lower(F.coalesce("project_title", F.lit(""))), F.lower("gene"))
    return top_by(latest, ["gene"], [F.desc(in_title), F.desc(year), F.desc(amount), F.asc("seq")], k)


def org_scope(represented: DataFrame, orgs: DataFrame, covered: DataFrame, directory: str = "Orphanet") -> DataFrame:
    """Focus and scope of each organisation (src = disease, dst = organisation).

    ``umbrella``: an entry of the directory that is listed for every covered disease (needs more than two).
    Counting the covered diseases of an organisation replaces comparing sets.
    """
    links = represented.select(F.col("src").alias("disease"), F.col("dst").alias("id")).distinct()
    total = covered.select("id").distinct().agg(F.count(F.lit(1)).alias("_total"))
    per_org = (
        links.join(covered.select(F.col("id").alias("disease"), F.lit(1).alias("_covered")).distinct(), "disease", "left")
        .groupBy("id").agg(F.count(F.lit(1)).alias("n_diseases"), F.count("_covered").alias("_n_covered"))
    )
    umbrella = (F.col("directory") == directory) & (F.col("_total") > 2) & (F.col("_n_covered") == F.col("_total"))
    return (
        per_org.join(orgs, "id").withColumn("_total", total.scalar())
        .select("id", "n_diseases", org_focus("name").alias("focus"),
                F.when(umbrella, "umbrella").when(F.col("n_diseases") > 1, "shared").otherwise("specific").alias("scope"))
    )


def two_entity_subgraph(graph: EvidenceGraph, a: str, b: str, matches: DataFrame | None = None) -> EvidenceGraph:
    """Both entities, all their direct neighbours, the edges among those, and the pair's match edge."""
    near = graph.edges.filter(F.col("src").isin(a, b) | F.col("dst").isin(a, b))
    ids = near.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(
        graph.nodes.filter(F.col("id").isin(a, b)).select("id")).distinct()
    nodes = graph.nodes.join(ids, "id", "left_semi").withColumn("selected", F.col("id").isin(a, b))
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    if matches is not None:
        pair = matches.filter(F.col("src").isin(a, b) & F.col("dst").isin(a, b))
        edges = edges.unionByName(pair, allowMissingColumns=True)
    return EvidenceGraph(nodes, edges)
