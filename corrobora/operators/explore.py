"""Exploration queries over the serving graph: neighbourhoods, layers, shared hubs and cards.

Adjacency is undirected and by neighbour type. Cards are computed for all entities of a type at once, or for a
``focus(id)`` table; a client reads single rows from the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corrobora.functions.text import DEFAULT_FOCUS, ORG_FOCUS
from corrobora.model import EvidenceGraph
from corrobora.operators.pairs import computed, meetings, shared_items
from corrobora.session import cut_lineage, first_by, ordinal_within, running_before, top_by

# Fixed values.
LENSES = ["symptoms", "mechanism", "family", "treatments", "trials", "researchers", "groups", "papers"]
HUB_LENSES = LENSES[1:]
NOUNS = {"mechanism": ("mechanism", "mechanisms"), "family": ("gene family", "gene families"), "treatments": ("drug", "drugs"), "trials": ("study", "studies"),
         "researchers": ("researcher", "researchers"), "groups": ("group", "groups"), "papers": ("paper", "papers")}
GROUP_FOCUS = [ORG_FOCUS[0][0], ORG_FOCUS[1][0], ORG_FOCUS[2][0], DEFAULT_FOCUS]
DETAIL_TYPES = ["Phenotype", "Variant", "Claim", "Researcher", "Intervention", "Study", "Grant", "PatientOrg"]
ACTIVE_STATUSES = ["RECRUITING", "NOT_YET_RECRUITING", "ENROLLING_BY_INVITATION", "ACTIVE_NOT_RECRUITING"]
SYMPTOM_SCALE, LAYER_FACTOR = 40.0, 0.85


# ---------------------------------------------------------------- neighbourhoods


def core_entities(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("type") == "Disease") & ~F.coalesce("paper_scoped", F.lit(False)))


def adjacency(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: (id, nbr, rel, edge_id)."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("nbr")), F.struct(F.col("dst").alias("id"), F.col("src").alias("nbr")))
    return edges.select(F.explode(ends).alias("e"), "rel", "edge_id").select("e.id", "e.nbr", "rel", "edge_id")


def neighbours(graph: EvidenceGraph, focus: DataFrame, types: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """(id, nbr, nbr_type, rel, edge_id) around the focus ids; neighbours of ``types``, or of all types but ``without``.

    Every edge travels once to each of its ends as one row; one whose first end is neither in focus nor a neighbour that is
    asked for goes no further.
    """
    nodes = graph.nodes if types is None else graph.of_type(*types)
    if without:
        nodes = nodes.filter(~F.col("type").isin(*without))
    none = F.lit(None).cast("string")
    # one row per id: whether it is in focus, and the types of its node rows that are asked for
    known = nodes.select("id", F.lit(False).alias("focus"), F.struct("type").alias("type")).unionByName(
        focus.select("id", F.lit(True).alias("focus"), F.when(F.lit(False), F.struct(none.alias("type"))).alias("type")))
    known = known.where("id is not null").groupBy("id").agg(F.max("focus").alias("focus"), F.collect_list("type").alias("types"))
    end = lambda e: known.select(F.col("id").alias(e), F.col("focus").alias(f"{e}_focus"), F.col("types").alias(f"{e}_types"))
    met = graph.edges.select("src", "dst", "rel", "edge_id").join(end("src"), "src").join(end("dst"), "dst")
    side = lambda here, there: F.when(F.col(f"{here}_focus"), F.transform(f"{there}_types", lambda t: F.struct(
        F.col(here).alias("id"), F.col(there).alias("nbr"), t["type"].alias("nbr_type")))).otherwise(F.array())
    return met.where("src_focus or dst_focus").select(
        F.explode(F.concat(side("src", "dst"), side("dst", "src"))).alias("e"), "rel", "edge_id").select("e.*", "rel", "edge_id")


def expand(graph: EvidenceGraph, focus: DataFrame) -> DataFrame:
    """Neighbours that open around a node: all but the detail types."""
    return neighbours(graph, focus, without=DETAIL_TYPES).select("id", "nbr").distinct()


def reveal(graph: EvidenceGraph, focus: DataFrame, visible: DataFrame | None = None, links: int = 12) -> DataFrame:
    """What becomes visible with each focus id: a variant brings its genes, a phenotype also its diseases, everything else
    its expansion; a node that would stand alone brings up to ``links`` direct neighbours."""
    near = cut_lineage(neighbours(graph, focus).join(graph.nodes.select("id", "type"), "id"))
    is_variant = F.col("type") == "Variant"
    shown = near.filter(
        F.when(is_variant, F.col("nbr_type") == "Gene")
        .otherwise(~F.col("nbr_type").isin(*DETAIL_TYPES) | ((F.col("type") == "Phenotype") & (F.col("nbr_type") == "Disease")))
    ).select("id", "nbr").distinct()
    touching = shown.select("id")
    if visible is not None:
        touching = touching.unionByName(near.join(visible.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id"))
    alone = near.join(touching.distinct(), "id", "left_anti")
    return shown.unionByName(top_by(alone.select("id", "nbr").distinct(), ["id"], [F.asc("nbr")], links).drop("rank"))


def collapse(graph: EvidenceGraph, node_id: str, visible: DataFrame, seeds: DataFrame) -> DataFrame:
    """The visible ids without the neighbours of a node that no other visible node keeps."""
    near = neighbours(graph, visible.select(F.lit(node_id).alias("id")).limit(1)).select(F.col("nbr").alias("id")).distinct()
    candidates = near.join(seeds.select("id"), "id", "left_anti")
    kept = (
        adjacency(graph.edges).filter(F.col("nbr") != node_id).join(candidates, "id", "left_semi")
        .join(visible.select(F.col("id").alias("nbr")), "nbr", "left_semi").select("id").distinct()
    )
    return visible.select("id").join(candidates.join(kept, "id", "left_anti"), "id", "left_anti")


def induced_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    # edges point from what is shown to its details, so the second end tells most of them
    ids = visible.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").select(*edges.columns)


def hub_lines(links: DataFrame, visible: DataFrame) -> DataFrame:
    """Lines between a visible hub and a visible disease."""
    ids = visible.select("id").distinct()
    return links.join(ids.withColumnRenamed("id", "hub"), "hub", "left_semi").join(ids.withColumnRenamed("id", "disease"), "disease", "left_semi")


# ---------------------------------------------------------------- layers


def hub_links(graph: EvidenceGraph, lens: str, group_focus: list[str] | None = None) -> DataFrame:
    """(lens, hub, disease, via) of one layer; the first ``via`` of a pair counts.

    graph.nodes(id, type, name, paper_scoped, scope, focus, ref); graph.edges(src, dst, rel, edge_id, reason).
    """
    core = core_entities(graph.nodes).select(F.col("id").alias("l"))

    def pair(left, right):  # other diseases go before their links meet anything
        links = _typed_links(graph, left, right)
        return links.join(core, "l", "left_semi") if left == "Disease" else links

    names = graph.of_type("Gene").select("id", "name")
    named = lambda df, c: df.join(names.select(F.col("id").alias(c), F.col("name").alias(f"{c}_name")), c)
    text = F.lit
    if lens == "family":
        d = named(pair("Disease", "Gene").toDF("disease", "gene", "reason"), "gene").join(pair("Gene", "GeneGroup").toDF("gene", "hub", "_r"), "gene")
        via = F.concat(text("via "), "gene_name")
    elif lens == "mechanism":
        d, via = pair("Disease", "Mechanism").toDF("disease", "hub", "reason"), text("quoted paper evidence")
    elif lens == "trials":
        d, via = pair("Disease", "Study").toDF("disease", "hub", "reason"), F.coalesce("reason", text("listed condition"))
    elif lens == "treatments":
        trials = pair("Disease", "Study").toDF("disease", "study", "_a").join(pair("Study", "Intervention").toDF("study", "hub", "_b"), "study").select(
            "disease", "hub", F.concat(text("trial "), "study").alias("v"), text(0).alias("o"))
        papers = (
            pair("Disease", "Paper").toDF("disease", "paper", "_a").join(pair("Paper", "Claim").toDF("paper", "claim", "_b"), "paper")
            .join(pair("Claim", "Intervention").toDF("claim", "hub", "_c"), "claim").select("disease", "hub", F.concat(text("paper "), "paper").alias("v"), text(1).alias("o"))
        )
        d = trials.unionByName(papers).groupBy("disease", "hub").agg(F.min_by("v", F.struct("o", "v")).alias("v"))
        via = F.col("v")
    elif lens == "researchers":
        d = named(pair("Disease", "Gene").toDF("disease", "gene", "_a"), "gene").join(pair("Gene", "Grant").toDF("gene", "grant", "_b"), "gene").join(
            pair("Grant", "Researcher").toDF("grant", "hub", "_c"), "grant")
        via = F.concat(text("NIH project on "), "gene_name")
    elif lens == "groups":
        focus = F.coalesce("focus", text(ORG_FOCUS[0][0]))
        orgs = graph.of_type("PatientOrg").filter(~F.coalesce("scope", text("shared")).isin("umbrella", "specific") & focus.isin(*(group_focus or GROUP_FOCUS)))
        d = pair("Disease", "PatientOrg").toDF("disease", "org", "_a").join(orgs.select(F.col("id").alias("org"), F.col("name").alias("org_name"), F.concat(text("ORGSET:"), focus).alias("hub")), "org")
        via = F.col("org_name")
    elif lens == "papers":
        d, via = pair("Disease", "Paper").toDF("disease", "hub", "reason"), F.coalesce("reason", text("linked paper"))
    else:
        raise ValueError(f"{lens} has no hubs")
    return (
        d.withColumn("via", via).groupBy("hub", "disease").agg(F.min("via").alias("via"))
        .select(F.lit(lens).alias("lens"), "hub", "disease", "via")
    )


# relations that can connect two node types, so that only those edges are read
_RELATIONS = {
    ("Disease", "Gene"): ["ASSOCIATED_WITH"], ("Gene", "GeneGroup"): ["MEMBER_OF"], ("Disease", "Mechanism"): ["INVOLVES"], ("Disease", "Study"): ["STUDIES"],
    ("Study", "Intervention"): ["TESTS"], ("Disease", "Paper"): ["DISCUSSES"], ("Paper", "Claim"): ["CONTAINS"], ("Claim", "Intervention"): ["ABOUT"],
    ("Gene", "Grant"): ["RESEARCHES"], ("Grant", "Researcher"): ["LEADS"], ("Disease", "PatientOrg"): ["REPRESENTED_BY"],
}
_OUTGOING = {("Disease", "Gene"), ("Gene", "GeneGroup"), ("Disease", "Mechanism"), ("Study", "Intervention"), ("Paper", "Claim"), ("Claim", "Intervention"), ("Disease", "PatientOrg")}


def _typed_links(graph: EvidenceGraph, left: str, right: str) -> DataFrame:
    """(left id, right id, reason) between two node types; the relation fixes which end is which."""
    edges = graph.of_rel(*_RELATIONS[(left, right)])
    a, b = ("src", "dst") if (left, right) in _OUTGOING else ("dst", "src")
    out = edges.select(F.col(a).alias("l"), F.col(b).alias("r"), "reason")
    # ASSOCIATED_WITH and ABOUT may end in several node types; the others have one
    if right in ("Gene", "Intervention"):
        out = out.join(graph.of_type(right).select(F.col("id").alias("r")), "r", "left_semi").select("l", "r", "reason")
    return out


def shared_hubs(links: DataFrame) -> DataFrame:
    return links.groupBy("lens", "hub").agg(F.count(F.lit(1)).alias("n_diseases")).filter("n_diseases > 1")


def symptom_pairs(matches: DataFrame) -> DataFrame:
    """matches(a, b, score): strength = score / 40, at most 1."""
    return matches.select(
        "a", "b", F.lit("symptoms").alias("lens"), F.least(F.lit(1.0), F.col("score") / SYMPTOM_SCALE).alias("strength"),
        F.lit(1).cast("long").alias("n_items"), F.lit(None).cast("string").alias("first_item"))


def _item_strength(n_items: Column) -> Column:
    """One shared item 0.5, two 0.75, and so on."""
    return 1.0 - F.pow(F.lit(0.5), n_items)


def mode_pairs(links: DataFrame) -> DataFrame:
    """(a, b, lens, strength, n_items, first_item): every pair in every hub layer, told where its members meet.

    Hubs of one disease tie nothing and are left out first; the others are numbered in their order. The row of a link brings
    the numbers of its disease's hubs in the layer along, and a pair is kept at the first hub it shares, so no pair is shuffled.
    """
    items = links.where("disease is not null").select(F.col("disease").alias("entity"), F.concat_ws("|", "lens", "hub").alias("hub_key"), "lens", "hub").distinct()
    items = cut_lineage(items)
    hubs = items.groupBy("hub_key").agg(F.min("lens").alias("lens"), F.min("hub").alias("hub"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    numbered = ordinal_within(hubs.withColumn("_none", F.col("hub").isNull()), [], ["lens", "_none", "hub", "hub_key"], "code").select("hub_key", "code")
    known = items.join(numbered.hint("merge"), "hub_key").groupBy("entity", "lens").agg(F.array_sort(F.collect_list(F.struct("code", "hub"))).alias("_l"))
    rows = cut_lineage(known.select("entity", "lens", F.col("_l")["code"].alias("codes"), F.col("_l")["hub"].alias("hubs")))
    rows = rows.select("entity", "lens", "codes", F.explode(F.arrays_zip("codes", "hubs")).alias("at")).select(
        "entity", F.col("at.codes").alias("item"), "lens", F.col("at.hubs").alias("hub"), "codes")
    met = meetings(rows, ["lens", "hub", "codes"])
    met = computed(met, F.array_intersect("x_codes", "y_codes"), "shared").where(F.get("shared", F.lit(0)) == F.col("item"))
    n_items = F.size("shared").cast("long")
    # read from both sides, so that both have the same columns and are shuffled once
    return met.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.coalesce("x_lens", "y_lens").alias("lens"), _item_strength(n_items).alias("strength"),
        n_items.alias("n_items"), F.coalesce("x_hub", "y_hub").alias("first_item"))


def layer_signatures(links: DataFrame) -> DataFrame:
    """(lens, disease, hubs): the hubs of each disease in a layer as one sorted list.

    Meant for layers with few hubs of many diseases each, such as bundles of organisations: diseases with equal lists are
    tied to every other one in the same way, so the layer is told by its lists instead of by its pairs.
    """
    return links.groupBy("lens", "disease").agg(F.array_sort(F.collect_set("hub")).alias("hubs"))


def signature_pairs(signatures: DataFrame) -> DataFrame:
    """(lens, hubs_a, hubs_b, n_items, strength, n_pairs): how many disease pairs each two lists stand for.

    The rows grow with the number of different lists, whatever the number of diseases; with ``layer_signatures`` they
    give every pair of the layer once.
    """
    classes = signatures.groupBy("lens", "hubs").agg(F.count(F.lit(1)).alias("n"))
    by_hub = classes.withColumn("hub", F.explode("hubs"))
    left, right = (by_hub.select("lens", "hub", F.col("hubs").alias(f"hubs_{e}"), F.col("n").alias(f"n_{e}")) for e in "ab")
    key = lambda c: F.concat_ws("|", c)
    met = left.join(right, ["lens", "hub"]).where(key("hubs_a") <= key("hubs_b")).drop("hub").distinct()
    inside = F.col("n_a") * (F.col("n_a") - 1) / 2
    n_items = F.size(F.array_intersect("hubs_a", "hubs_b")).cast("long")
    return met.select(
        "lens", "hubs_a", "hubs_b", n_items.alias("n_items"), _item_strength(n_items).alias("strength"),
        F.when(key("hubs_a") == key("hubs_b"), inside).otherwise(F.col("n_a") * F.col("n_b")).cast("long").alias("n_pairs"),
    ).where("n_pairs > 0")


def with_signatures(layers: DataFrame, signatures: DataFrame) -> DataFrame:
    """``layers`` and, for each of its pairs, what the two diseases share in the layers told by ``signatures``."""
    side = lambda e: signatures.select("lens", F.col("disease").alias(e), F.col("hubs").alias(f"hubs_{e}"))
    shared = F.array_intersect("hubs_a", "hubs_b")
    more = (
        layers.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "lens"])
        .select("a", "b", "lens", F.size(shared).cast("long").alias("n_items"), F.array_min(shared).alias("first_item")).where("n_items > 0")
    )
    return layers.unionByName(more.withColumn("strength", _item_strength(F.col("n_items"))))


def mode_counts(pairs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """(lens, n_pairs) over pairs, and over the ``signature_pairs`` of layers that are told by lists."""
    counts = pairs.groupBy("lens").agg(F.count(F.lit(1)).alias("n_pairs"))
    return counts if classes is None else counts.unionByName(classes.groupBy("lens").agg(F.sum("n_pairs").alias("n_pairs")))


def pair_layers(pairs: DataFrame, min_score: float) -> DataFrame:
    """All contributions of the active layers; symptom pairs below the threshold are left out."""
    return pairs.filter((F.col("lens") != "symptoms") | (F.col("strength") * SYMPTOM_SCALE >= min_score))


def combined_strength(layers: DataFrame) -> DataFrame:
    """1 - product of (1 - 0.85 * strength) over the layers of a pair. The factors are at least 0.15, so logs are safe."""
    return layers.groupBy("a", "b").agg(
        (1.0 - F.exp(F.sum(F.log1p(-LAYER_FACTOR * F.col("strength"))))).alias("strength"), F.count(F.lit(1)).alias("n_layers"))


def describe_contribution(lens: Column, strength: Column, n_items: Column, first_item: Column) -> Column:
    one, many = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (single, plural) in NOUNS.items():
        one = F.when(lens == name, F.lit(single)).otherwise(one)
        many = F.when(lens == name, F.lit(plural)).otherwise(many)
    return (
        F.when(lens == "symptoms", F.format_string("similar symptoms (%d)", F.round(strength * SYMPTOM_SCALE).cast("int")))
        .when(n_items == 1, F.concat(one, F.lit(": "), first_item)).otherwise(F.concat_ws(" ", n_items.cast("string"), many)))


def org_sets(nodes: DataFrame) -> DataFrame:
    """Synthetic nodes that stand for all shared organisations of one focus; members stay rows of the node table."""
    focus = F.coalesce("focus", F.lit(ORG_FOCUS[0][0]))
    label = F.when(focus == ORG_FOCUS[0][0], "Gene-specific groups").when(focus == DEFAULT_FOCUS, "Disability groups").otherwise(F.concat(focus, F.lit(" groups")))
    orgs = nodes.filter((F.col("type") == "PatientOrg") & ~F.coalesce("scope", F.lit("shared")).isin("umbrella", "specific"))
    sets = orgs.groupBy(focus.alias("focus"), label.alias("_l")).agg(F.count(F.lit(1)).alias("n_members"))
    return sets.select(F.concat(F.lit("ORGSET:"), "focus").alias("id"), F.concat("_l", F.lit(" · "), F.col("n_members").cast("string")).alias("name"), "n_members")


# ---------------------------------------------------------------- cards


def node_subtitles(nodes: DataFrame, in_gene: DataFrame) -> DataFrame:
    """Second line of a node: gene of a disease, number of variants of a gene, class of a variant, source of a paper."""
    n = in_gene.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_v"))
    t = F.col("type")
    text = (
        F.when((t == "Disease") & (F.length("short") > 0), F.concat("short", F.lit(" gene")))
        .when((t == "Gene") & (F.col("_v") > 0), F.concat(F.col("_v").cast("string"), F.lit(" variants"))).when(t == "Gene", F.coalesce("full_name", F.lit("")))
        .when(t == "Variant", F.coalesce("classification", F.lit(""))).when(t == "Paper", F.coalesce("source_id", "id")).otherwise(""))
    return nodes.join(n, "id", "left").select("id", F.coalesce(text, F.lit("")).alias("subtitle"))


def _counts(df: DataFrame, key: str, item: str, name: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("id")).agg(F.count_distinct(item).alias(name))


def _join_all(spine: DataFrame, parts: list[DataFrame]) -> DataFrame:
    out = spine
    for p in parts:
        out = out.join(p, "id", "left")
    return out.na.fill(0)


def disease_card(graph: EvidenceGraph, bridges: DataFrame) -> DataFrame:
    """Per core disease: numbers of genes, papers, trials, organisations, grants, mechanisms and bridges."""
    core = core_entities(graph.nodes).select("id")
    link = lambda l, r: _typed_links(graph, l, r)
    grants = link("Disease", "Gene").toDF("d", "g", "_a").join(link("Gene", "Grant").toDF("g", "gr", "_b"), "g")
    both = bridges.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_bridges"))
    return _join_all(core, [
        _counts(link("Disease", "Gene"), "l", "r", "n_genes"), _counts(link("Disease", "Paper"), "l", "r", "n_papers"), _counts(link("Disease", "Study"), "l", "r", "n_trials"),
        _counts(link("Disease", "PatientOrg"), "l", "r", "n_orgs"), _counts(grants, "d", "gr", "n_grants"), _counts(link("Disease", "Mechanism"), "l", "r", "n_mechanisms"), both])


def symptom_list(has_phenotype: DataFrame, core: DataFrame) -> DataFrame:
    """(id, phenotype, n_sharing): symptoms of each disease with the number of core diseases that have them."""
    mine = has_phenotype.select(F.col("src").alias("id"), F.col("dst").alias("phenotype")).distinct().join(core.select("id"), "id", "left_semi")
    return mine.join(mine.groupBy("phenotype").agg(F.count(F.lit(1)).alias("n_sharing")), "phenotype")


def mechanism_rows(involves: DataFrame) -> DataFrame:
    """One row per (disease, mechanism): the edge with evidence comes first."""
    return first_by(involves, ["src", "dst"], [F.desc(F.size("supported_by")), F.asc("edge_id")]).select("src", "dst", "edge_id")


def active_trials(studies: DataFrame, k: int = 60) -> DataFrame:
    """studies(disease, study, status, start, phases): active ones first, then most recent, with the phase in words."""
    active = F.col("status").isin(*ACTIVE_STATUSES)
    phase = F.array_join(F.transform("phases", lambda p: F.replace(p, F.lit("PHASE"), F.lit("Phase "))), " / ")
    return top_by(studies.withColumn("active", active).withColumn("phase", phase), ["disease"], [F.desc("active"), F.desc("start"), F.asc("study")], k)


def org_groups(represented: DataFrame, orgs: DataFrame) -> DataFrame:
    """(disease, org, focus, umbrella, n_other): organisations of each disease with how many other diseases they have."""
    links = represented.select(F.col("src").alias("disease"), F.col("dst").alias("id")).distinct()
    n = links.groupBy("id").agg((F.count(F.lit(1)) - 1).alias("n_other"))
    return links.join(n, "id").join(orgs.select("id", "focus", "scope"), "id").select(
        "disease", F.col("id").alias("org"), "focus", (F.col("scope") == "umbrella").alias("umbrella"), "n_other")


def funding_summary(grants: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """grants(gene, grant, award_amount, fiscal_year, organization) -> totals per gene, and its ``k`` best funded organisations.

    The upper median (element n div 2 of the sorted awards) is selected by rank: equal awards are counted, the counts are
    summed over a range partitioning, and the award whose ranks hold the place is it. No task holds the awards of a gene.
    """
    paid = grants.filter("award_amount > 0")
    totals = paid.groupBy("gene").agg(
        F.sum("award_amount").alias("total"), F.max("award_amount").alias("largest"), F.count(F.lit(1)).alias("n"),
        F.min("fiscal_year").alias("first_year"), F.max("fiscal_year").alias("last_year"))
    counts = paid.groupBy("gene", "award_amount").agg(F.count(F.lit(1)).alias("_same"))
    ranked = running_before(counts, ["gene"], ["award_amount"], F.col("_same"), "_below")
    place = F.floor(F.col("n") / 2)
    median = (
        ranked.join(totals.select("gene", "n"), "gene").where((F.col("_below") <= place) & (place < F.col("_below") + F.col("_same")))
        .select("gene", F.col("award_amount").alias("median"))
    )
    totals = totals.join(median, "gene")
    orgs = paid.groupBy("gene", "organization").agg(F.sum("award_amount").alias("amount"))
    return totals, top_by(orgs, ["gene"], [F.desc("amount"), F.asc("organization")], k)


def bridge_list(bridges: DataFrame) -> DataFrame:
    """(id, other, kinds): the bridges of each disease with their kinds in order of strength."""
    kinds = [c for c in bridges.columns if c.startswith("shared_")]
    text = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(c[7:])) for c in kinds])), ",")
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    return bridges.select(F.explode(ends).alias("e"), text.alias("kinds")).select("e.id", "e.other", "kinds")


def gene_card(graph: EvidenceGraph, variants: DataFrame) -> DataFrame:
    """Per gene: diseases, variants, pathogenic variants, claims, families and grants."""
    genes = graph.of_type("Gene").select("id")
    link = lambda l, r: _typed_links(graph, l, r)
    cls = variants.select(F.col("id").alias("src"), F.rlike("classification", F.lit("(?i)^pathogenic")).alias("_p"))
    v = graph.of_rel("IN_GENE").join(cls, "src", "left").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_variants"), F.count_if("_p").alias("n_pathogenic"))
    claims = graph.of_rel("ABOUT").groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("n_claims"))
    return _join_all(genes, [
        _counts(link("Disease", "Gene"), "r", "l", "n_diseases"), v, claims, _counts(link("Gene", "GeneGroup"), "l", "r", "n_families"), _counts(link("Gene", "Grant"), "l", "r", "n_grants")])


def paper_card(claims: DataFrame) -> DataFrame:
    return claims.groupBy("paper", "category").agg(F.count(F.lit(1)).alias("n"))


def paper_treatments(claims: DataFrame, about: DataFrame) -> DataFrame:
    """(paper, item): distinct things the claims of a paper are about."""
    return claims.select("paper", F.col("id").alias("src")).join(about, "src").select("paper", F.col("dst").alias("item")).distinct()


def claim_card(claims: DataFrame, about: DataFrame) -> DataFrame:
    n = about.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n_mentions"))
    return claims.join(n, "id", "left").select("id", "polarity", F.coalesce("n_mentions", F.lit(0)).alias("n_mentions"))


def study_card(graph: EvidenceGraph) -> DataFrame:
    d = _counts(_typed_links(graph, "Disease", "Study"), "r", "l", "n_diseases")
    i = _counts(_typed_links(graph, "Study", "Intervention"), "l", "r", "n_drugs")
    return d.join(i, "id", "left").na.fill(0)


def grant_card(leads: DataFrame) -> DataFrame:
    """(grant, researcher, n_other): other projects of each investigator."""
    links = leads.select(F.col("src").alias("researcher"), F.col("dst").alias("grant")).distinct()
    return links.join(links.groupBy("researcher").agg((F.count(F.lit(1)) - 1).alias("n_other")), "researcher")


def hub_card(links: DataFrame) -> DataFrame:
    """Diseases per hub of any layer (gene family, intervention, mechanism)."""
    return links.groupBy("lens", "hub").agg(F.count_distinct("disease").alias("n_diseases"))


def mechanism_card(involves: DataFrame) -> DataFrame:
    """involves(src, dst, variant_dependent)."""
    per = involves.groupBy("dst", "src").agg(F.bool_or("variant_dependent").alias("_d"))
    return per.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n_diseases"), F.count_if("_d").alias("n_variant_dependent"))


def prevalence(has_phenotype: DataFrame, core: DataFrame) -> DataFrame:
    """(phenotype, seen_in, of): seen in k of n core diseases."""
    total = core.agg(F.count(F.lit(1)).alias("of"))
    seen = has_phenotype.join(core.select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("phenotype")).agg(F.count_distinct("src").alias("seen_in"))
    return seen.withColumn("of", total.scalar())


def match_card(match_pairs: DataFrame, has_phenotype: DataFrame, informative: DataFrame) -> DataFrame:
    """(a, b, phenotype, informative): shared phenotypes of given pairs, the informative ones marked."""
    items = has_phenotype.select(F.col("src").alias("entity"), F.col("dst").alias("item")).distinct()
    shared = shared_items(match_pairs, items, []).select("a", "b", F.col("item").alias("phenotype"))
    top = informative.select("a", "b", F.col("term").alias("phenotype"), F.lit(True).alias("informative"))
    return shared.join(top, ["a", "b", "phenotype"], "left").withColumn("informative", F.coalesce("informative", F.lit(False)))


def pair_card(layers: DataFrame) -> DataFrame:
    """Every contribution of every pair with the combined strength of the pair."""
    return layers.withColumn("combined", 1.0 - F.exp(F.sum(F.log1p(-LAYER_FACTOR * F.col("strength"))).over(Window.partitionBy("a", "b"))))


def coverage_gap(graph: EvidenceGraph, expected: list[str]) -> DataFrame:
    """(id, type): expected neighbour types that nothing was collected for."""
    core = core_entities(graph.nodes).select("id")
    spine = core.select("id", F.explode(F.array(*[F.lit(t) for t in expected])).alias("type"))
    have = neighbours(graph, core, expected).select("id", F.col("nbr_type").alias("type")).distinct()
    return spine.join(have, ["id", "type"], "left_anti")
