"""Ontology closure, information content, IC-weighted similarity and evidence-weighted pair scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.model import (
    DAMPING, EVIDENCE_MIX, LINK_FLOOR, METHOD_WEIGHT, MIN_SCORE, PAIR_WEIGHTS, STATUS_WEIGHT,
    TIER_WEIGHT, EvidenceGraph, lookup,
)
from corrobora.operators.pairs import (
    Bound, alike, computed, looked_up, overlap, partners_of, shared_items, shared_keys, summed, tagged_lists, tagged_pairs, with_lists, with_shared,
)
from corrobora.session import cut_lineage, ordinal_within, top_by


# ---------------------------------------------------------------- closure and information content


def ancestor_closure(parents: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """term -> itself and all its ancestors in a multi-parent DAG; ``parents(child, parent)``.

    Path doubling: every round joins the pairs found so far with themselves, so paths of twice the length are known after
    it and the number of rounds is the logarithm of the depth. A cycle ends by itself, because only distinct pairs are
    kept and the rounds end when their number stays. Every round reads a written table.
    """
    edges = parents.select("child", "parent").distinct()
    if terms is None:
        terms = edges.select(F.col("child").alias("term")).unionByName(edges.select(F.col("parent").alias("term")))
    above = cut_lineage(edges.select(F.col("child").alias("term"), F.col("parent").alias("ancestor")))
    known = above.count()
    while known:
        further = above.select("term", F.col("ancestor").alias("via")).join(above.select(F.col("term").alias("via"), "ancestor"), "via")
        above = cut_lineage(above.unionByName(further.select("term", "ancestor")).distinct())
        before, known = known, above.count()
        if known == before:
            break
    itself = terms.select("term").distinct().withColumn("ancestor", F.col("term"))
    return cut_lineage(above.join(terms.select("term").distinct(), "term", "left_semi").unionByName(itself).distinct())


def close_terms(annotations: DataFrame, closure: DataFrame) -> DataFrame:
    """(entity, term) for every annotated term and its ancestors; a term outside the ontology is its own closure."""
    direct = annotations.select("entity", "term").distinct()
    return (
        direct.join(closure, "term", "left")
        .select("entity", F.coalesce("ancestor", "term").alias("term"))
        .distinct()
    )


def information_content(annotations: DataFrame, closure: DataFrame | None = None, closed: DataFrame | None = None) -> DataFrame:
    """term -> IC = -log2(n / N), n = annotated entities whose closed set has the term, N = annotated entities.

    ``closed`` is the result of :func:`close_terms`, when it is at hand already.
    """
    closed = close_terms(annotations, closure) if closed is None else closed
    total = annotations.agg(F.count_distinct("entity").alias("_total"))
    return (
        closed.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        .select("term", "n", F.log2(total.scalar() / F.col("n")).alias("ic"))
    )


def weighted_terms(closed: DataFrame, ic: DataFrame, n_entities: DataFrame | None = None) -> DataFrame:
    """items(entity, item, weight) for the IC-weighted Jaccard; terms without information are left out.

    A term with IC 0 adds nothing to either sum, and it is exactly the most widespread kind of term. A term the
    corpus has never seen counts as seen once, which needs the corpus size ``n_entities(n)``.
    """
    joined = closed.join(ic.select("term", "ic"), "term", "left")
    if n_entities is not None:
        weight = F.coalesce("ic", F.log2(F.greatest(n_entities.select("n").scalar(), F.lit(1))))
    else:
        weight = F.coalesce("ic", F.lit(0.0))
    return (
        joined.select("entity", F.col("term").alias("item"), weight.alias("weight")).filter("weight > 0")
    )


def jaccard_of_pairs(pairs: DataFrame, items: DataFrame, name: str = "similarity") -> DataFrame:
    """Weighted Jaccard of the given pairs; union = sum a + sum b - shared, so only shared items are joined.

    For item weights that depend on the item alone min = the weight itself; for entity-specific weights the
    shared part is the sum of minima and the union the sum of maxima, which is the same identity.
    """
    if "left" not in pairs.columns:
        totals = items.groupBy("entity").agg(F.sum("weight").alias("_t"))
        shared = (
            shared_items(pairs, items, ["weight"])
            .groupBy("a", "b")
            .agg(F.sum(F.least("left_weight", "right_weight")).alias("_o"), F.count(F.lit(1)).alias("n_shared"))
        )
        union = F.col("_ta") + F.col("_tb") - F.col("_o")
        return (
            shared.join(totals.select(F.col("entity").alias("a"), F.col("_t").alias("_ta")), "a")
            .join(totals.select(F.col("entity").alias("b"), F.col("_t").alias("_tb")), "b")
            .select("a", "b", "n_shared", F.when(union > 0, F.col("_o") / union).otherwise(0.0).alias(name))
        )
    x, y = F.col("left"), F.col("right")
    counted = computed(with_shared(pairs), F.struct(overlap(x, y, F.col("shared")).alias("o"), (x["total"] + y["total"]).alias("t"), F.size("shared").cast("long").alias("n")), "s")
    union = F.col("s.t") - F.col("s.o")
    return counted.where("s.n > 0").select("a", "b", F.col("s.n").alias("n_shared"), F.when(union > 0, F.col("s.o") / union).otherwise(0.0).alias(name))


def similar_pairs(items: DataFrame, min_similarity: float) -> DataFrame:
    """All pairs a < b whose weighted Jaccard is at least ``min_similarity`` (> 0)."""
    union = F.col("total") - F.col("overlap")
    found = alike(items, Bound(min_similarity)).select(
        "a", "b", F.size("shared").cast("long").alias("n_shared"), F.when(union > 0, F.col("overlap") / union).otherwise(0.0).alias("similarity"))
    return found.where(F.col("similarity") >= min_similarity)


def ic_jaccard(items: DataFrame, min_similarity: float) -> DataFrame:
    """IC-weighted Jaccard of closed term sets: sum of IC over the intersection / over the union."""
    return similar_pairs(items, min_similarity)


def similarity_matrix_rows(pairs: DataFrame, items: DataFrame, entities: DataFrame) -> DataFrame:
    """Both triangles and the diagonal of the similarity matrix in long form (row, col, similarity)."""
    has = items.groupBy("entity").agg(F.lit(1.0).alias("similarity"))
    diagonal = entities.select("entity").join(has, "entity", "left").select(
        F.col("entity").alias("row"), F.col("entity").alias("col"), F.coalesce("similarity", F.lit(0.0)).alias("similarity")
    )
    upper = pairs.select(F.col("a").alias("row"), F.col("b").alias("col"), "similarity")
    lower = pairs.select(F.col("b").alias("row"), F.col("a").alias("col"), "similarity")
    return upper.unionByName(lower).unionByName(diagonal)


def top_shared_terms(pairs: DataFrame, closed: DataFrame, ic: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` most informative closed terms each pair shares, with their rank (ties by term id)."""
    pairs = with_lists(pairs.select("a", "b"), lists=informative_lists(closed, ic))
    first = F.slice(shared_keys(F.col("left"), F.col("right")), 1, k)
    found = pairs.select("a", "b", "left", F.posexplode(first).alias("pos", "term"))
    return found.select("a", "b", "term", looked_up(F.col("left"), F.col("term"), "ic").alias("ic"), (F.col("pos") + 1).cast("int").alias("rank"))


def informative_lists(closed: DataFrame, ic: DataFrame) -> DataFrame:
    """(entity, list): the closed terms of an entity in one row, the most informative first (ties by term id)."""
    items = closed.join(ic.select("term", "ic").hint("merge"), "term").groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("ic")).alias("_neg"), "term", "ic"))).alias("_l"))
    return items.select("entity", F.struct(F.col("_l")["term"].alias("keys"), F.col("_l")["ic"].alias("ic")).alias("list"))


# ---------------------------------------------------------------- evidence and features


def provenance_weight(status: Column, tier: Column, method: Column) -> Column:
    """status x tier x method; unknown values weigh nothing, a missing tier counts as tier 3."""
    return (
        lookup(status, STATUS_WEIGHT, 0.0)
        * lookup(F.coalesce(tier, F.lit(3)), TIER_WEIGHT, 0.0)
        * lookup(method, METHOD_WEIGHT, 0.0)
    )


def edge_evidence_score(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """Edges plus ``evidence`` in 0..1. The mean confidence of the supporting claims scales the weight when at
    least one of them has a numeric confidence; ``claims(id, confidence)``."""
    support = edges.filter(F.size("supported_by") > 0).select("edge_id", F.explode("supported_by").alias("id"))
    confidence = (
        support.join(claims.select("id", F.col("confidence").try_cast("double").alias("_c")), "id")
        .filter(F.col("_c").isNotNull())
        .groupBy("edge_id").agg(F.avg("_c").alias("_conf"))
    )
    score = provenance_weight(F.col("status"), F.col("source_tier"), F.col("method")) * F.coalesce("_conf", F.lit(1.0))
    return (
        edges.join(confidence, "edge_id", "left")
        .withColumn("evidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
        .drop("_conf")
    )


def best_edge_support(scored: DataFrame) -> DataFrame:
    """Best evidence among parallel edges of one relation."""
    return scored.groupBy("src", "dst", "rel").agg(F.max("evidence").alias("support"))


def node_link_map(scored: DataFrame, nodes: DataFrame, node_type: str, rel: str) -> DataFrame:
    """node -> neighbour -> best evidence over one relation, for gene, mechanism and phenotype targets."""
    return (
        best_edge_support(scored.filter(F.col("rel") == rel))
        .join(nodes.filter(F.col("type") == node_type).select(F.col("id").alias("src")), "src", "left_semi")
        .join(
            nodes.filter(F.col("type").isin("Gene", "Mechanism", "Phenotype")).select(F.col("id").alias("dst")),
            "dst", "left_semi",
        )
        .select("src", "dst", "support")
    )


FEATURE_RELATIONS = {
    "mechanism": ("INVOLVES", "Mechanism"),
    "phenotype": ("HAS_PHENOTYPE", "Phenotype"),
    "gene": ("ASSOCIATED_WITH", "Gene"),
}


def feature_table(graph: EvidenceGraph, claims: DataFrame, core_only: bool = False) -> DataFrame:
    """features(entity, kind, item, support): the best evidence of each disease feature.

    Diseases that only papers name are scored like others; ``core_only`` leaves them out.
    """
    diseases = graph.of_type("Disease")
    if core_only:
        diseases = diseases.filter(~F.coalesce("paper_scoped", F.lit(False)))
    kind = F.lit(None).cast("string")
    for name, (rel, target) in FEATURE_RELATIONS.items():
        kind = F.when((F.col("rel") == rel) & (F.col("dst_type") == target), F.lit(name)).otherwise(kind)
    edges = graph.of_rel(*[rel for rel, _ in FEATURE_RELATIONS.values()])
    targets = graph.of_type(*[t for _, t in FEATURE_RELATIONS.values()])
    return (
        edge_evidence_score(edges, claims)
        .join(diseases.select(F.col("id").alias("src")), "src", "left_semi")
        .join(targets.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst")
        .withColumn("kind", kind).filter("kind is not null")
        .groupBy(F.col("src").alias("entity"), "kind", F.col("dst").alias("item"))
        .agg(F.max("evidence").alias("support"))
    )


def entity_spine(graph: EvidenceGraph, features: DataFrame) -> DataFrame:
    """Every disease with its number of features of each kind; those without any have zeros."""
    counts = features.groupBy(F.col("entity").alias("id")).agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in FEATURE_RELATIONS])
    return (
        graph.of_type("Disease").select("id").distinct().join(counts, "id", "left")
        .na.fill(0, [f"n_{k}" for k in FEATURE_RELATIONS]).withColumnRenamed("id", "entity")
    )


def of_kind(features: DataFrame, kind: str) -> DataFrame:
    return features.filter(F.col("kind") == kind).select("entity", "item", F.col("support").alias("weight"))


def feature_rarity(features: DataFrame) -> DataFrame:
    """items(entity, item, weight = 1 / number of entities with the phenotype)."""
    phenotypes = features.filter(F.col("kind") == "phenotype").select("entity", "item")
    freq = phenotypes.groupBy("item").agg((1.0 / F.count(F.lit(1))).alias("weight"))
    return phenotypes.join(freq, "item").select("entity", "item", "weight")


def shared_feature_weight(pairs: DataFrame, rarity: DataFrame) -> DataFrame:
    """Sum of 1/frequency over the phenotypes a pair shares."""
    if "left" not in pairs.columns:
        return (
            shared_items(pairs, rarity, ["weight"]).groupBy("a", "b")
            .agg(F.sum("left_weight").alias("weight"), F.count(F.lit(1)).alias("n_shared"))
        )
    x = F.col("left")
    counted = computed(with_shared(pairs), F.struct(
        summed(F.col("shared"), lambda k: looked_up(x, k, "weight")).alias("weight"), F.size("shared").cast("long").alias("n_shared")), "s")
    return counted.where("s.n_shared > 0").select("a", "b", "s.weight", "s.n_shared")


def weighted_jaccard(items: DataFrame, min_similarity: float) -> DataFrame:
    """Evidence-weighted Jaccard: sum of minima over sum of maxima of the two supports."""
    return similar_pairs(items, min_similarity)


def set_jaccard(items: DataFrame, min_similarity: float) -> DataFrame:
    """Plain Jaccard: |A and B| / |A or B|."""
    return similar_pairs(items.withColumn("weight", F.lit(1.0)), min_similarity)


def shared_feature_support(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Mean of sqrt(x * y) over the features a pair shares."""
    if "left" not in pairs.columns:
        return (
            shared_items(pairs, items, ["weight"]).groupBy("a", "b")
            .agg(F.avg(F.sqrt(F.col("left_weight") * F.col("right_weight"))).alias("support"))
        )
    x, y = F.col("left"), F.col("right")
    counted = computed(with_shared(pairs), F.struct(
        summed(F.col("shared"), lambda k: F.sqrt(looked_up(x, k, "weight") * looked_up(y, k, "weight"))).alias("o"), F.size("shared").alias("n")), "s")
    return counted.where("s.n > 0").select("a", "b", (F.col("s.o") / F.col("s.n")).alias("support"))


# ---------------------------------------------------------------- pair scoring


def pair_items(features: DataFrame, terms: DataFrame) -> DataFrame:
    """items(entity, kind, item, support, weight): features and closed terms of all entities in one long table.

    ``weight`` is what the kind's overlap is counted in: the support of a mechanism, 1 for a gene, the rarity of a
    phenotype, the information of a term.
    """
    rarity = feature_rarity(features).select("entity", "item", F.col("weight").alias("rarity"), F.lit("phenotype").alias("kind"))
    weight = F.when(F.col("kind") == "mechanism", F.col("support")).when(F.col("kind") == "gene", F.lit(1.0)).otherwise(F.col("rarity"))
    return (
        features.join(rarity, ["entity", "item", "kind"], "left").select("entity", "kind", "item", "support", weight.alias("weight"))
        .unionByName(terms.select("entity", F.lit("term").alias("kind"), "item", F.lit(None).cast("double").alias("support"), "weight"))
    )


def connection_candidates(
    items: DataFrame, min_score: float = MIN_SCORE, lists: DataFrame | None = None, carry: DataFrame | None = None
) -> DataFrame:
    """A superset of the pairs whose final score can reach ``min_score``, far smaller than all sharing pairs.

    The raw score is a weighted mean of the present parts and the other factors are at most 1, so one part must
    reach t = min_score / 100. For the phenotype part that means either a meaningful link (shared rarity of at
    least the link floor) or, because it is damped otherwise, an IC similarity of t / damping. Each kind of
    ``pair_items`` is met under its own bound; pairs that are alike in their terms alone are few, so they are formed on
    short rows. ``lists`` and ``carry`` are those of :func:`tagged_pairs`.
    """
    t = (min_score - 0.005) / 100.0
    return tagged_pairs(items, {
        "mechanism": Bound(t), "gene": Bound(t), "phenotype": Bound(LINK_FLOOR, absolute=True), "term": Bound(min(1.0, t / DAMPING), selective=True),
    }, lists=lists, carry=carry)


CONNECTION_KINDS = ("mechanism", "gene", "phenotype", "term")


def connection_lists(items: DataFrame) -> DataFrame:
    """(entity, list): all ``pair_items`` of an entity in one row, the terms as numbers and without a support."""
    lists = tagged_lists(items, CONNECTION_KINDS, numbered=("term",))
    return lists.withColumn("list", F.col("list").withField("term", F.col("list.term").dropFields("support")))


def carried_lists(lists: DataFrame) -> DataFrame:
    """What :func:`pair_connection` reads of the ``connection_lists``."""
    return lists.select("entity", F.struct(*[F.col("list")[k].dropFields("freq", "rest").alias(k) for k in CONNECTION_KINDS]).alias("list"))


def pair_connection(pairs: DataFrame, features: DataFrame, terms: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The full connection record of each given pair; ``items`` is ``pair_items`` when it is at hand.

    Pairs that bring the ``connection_lists`` of both sides as ``left`` and ``right`` are scored where they are.
    """
    if "left" not in pairs.columns:
        items = pair_items(features, terms) if items is None else items
        pairs = with_lists(pairs, lists=connection_lists(items), how="left")
    carried = [c for c in ("told_shared",) if c in pairs.columns]
    x, y = F.col("left"), F.col("right")
    of = lambda k: F.coalesce(shared_keys(x[k], y[k]), F.array().cast("array<string>" if k != "term" else "array<int>"))
    base = pairs.select("a", "b", "left", "right", *carried, *[F.array_sort(of(k)).alias(f"shared_{k}s") for k in ("mechanism", "gene", "phenotype")], of("term").alias("_terms"))
    both = lambda k, value: summed(F.col(f"shared_{k}s"), lambda key: value(looked_up(x[k], key, "support"), looked_up(y[k], key, "support")))
    mean = lambda a, b: F.sqrt(a * b)
    size = lambda held: F.coalesce(F.size(held["keys"]), F.lit(0))
    base = computed(base, F.struct(
        F.size("shared_mechanisms").alias("_m_n"), F.size("shared_genes").alias("_g_n"), F.size("shared_phenotypes").alias("_p_n"),
        both("mechanism", F.least).alias("_m_min"), both("mechanism", mean).alias("_m_sum"), both("gene", mean).alias("_g_sum"), both("phenotype", F.least).alias("_p_min"),
        summed(F.col("shared_phenotypes"), lambda key: looked_up(x["phenotype"], key, "weight")).alias("_p_rarity"),
        summed(F.col("_terms"), lambda key: looked_up(x["term"], key, "weight")).alias("_t_o"),
        *[x[k]["total"].alias(f"_{k[0]}_tota") for k in ("mechanism", "term")], *[y[k]["total"].alias(f"_{k[0]}_totb") for k in ("mechanism", "term")],
        *[size(side[k]).alias(f"_{k[0]}_cnt{e}") for e, side in (("a", x), ("b", y)) for k in ("mechanism", "gene")],
    ), "s").select("a", "b", *carried, "shared_mechanisms", "shared_genes", "shared_phenotypes", "s.*")
    base = base.withColumn("_m_sup", F.col("_m_sum") / F.greatest("_m_n", F.lit(1))).withColumn("_g_sup", F.col("_g_sum") / F.greatest("_g_n", F.lit(1)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    has_m, has_g = count("_m_n") > 0, count("_g_n") > 0
    m_union = zero("_m_tota") + zero("_m_totb") - zero("_m_min")
    g_union = count("_g_cnta") + count("_g_cntb") - count("_g_n")
    t_union = zero("_t_tota") + zero("_t_totb") - zero("_t_o")
    alike = F.when(t_union > 0, zero("_t_o") / t_union).otherwise(0.0)
    meaningful = zero("_p_rarity") >= LINK_FLOOR - 1e-9
    scored = base.select(
        "a", "b",
        *carried, "shared_mechanisms", "shared_genes", "shared_phenotypes",
        F.when(m_union > 0, zero("_m_min") / m_union).otherwise(0.0).alias("mechanism"),
        F.when(g_union > 0, count("_g_n") / g_union).otherwise(0.0).alias("genetic"),
        (F.greatest(F.lit(0.0), F.least(F.lit(1.0), alike)) * F.when(meaningful, 1.0).otherwise(DAMPING)).alias("phenotype"),
        meaningful.alias("meaningful_phenotype_link"),
        (has_g & (count("_m_cnta") > 0) & (count("_m_cntb") > 0) & ~has_m).alias("same_gene_different_mechanism"),
        has_m.alias("_has_m"), has_g.alias("_has_g"),
        ((F.when(has_m, zero("_m_sup")).otherwise(0.0) + F.when(has_g, zero("_g_sup")).otherwise(0.0) + zero("_p_min"))
         / F.greatest(has_m.cast("int") + has_g.cast("int") + count("_p_n"), F.lit(1))).alias("evidence_quality"),
    )
    wm, wg, wp = (PAIR_WEIGHTS[k] for k in ("mechanism", "gene", "phenotype"))
    in_m, in_g, in_p = F.col("_has_m"), F.col("_has_g"), F.col("phenotype") > 0
    used = F.when(in_m, wm).otherwise(0.0) + F.when(in_g, wg).otherwise(0.0) + F.when(in_p, wp).otherwise(0.0)
    raw = (
        F.when(in_m, F.col("mechanism") * wm).otherwise(0.0)
        + F.when(in_g, F.col("genetic") * wg).otherwise(0.0)
        + F.when(in_p, F.col("phenotype") * wp).otherwise(0.0)
    ) / used
    base_mix, evidence_mix = EVIDENCE_MIX
    score = (
        F.when(used > 0, 100.0 * raw).otherwise(0.0)
        * (base_mix + evidence_mix * F.col("evidence_quality"))
        * F.when(F.col("same_gene_different_mechanism"), DAMPING).otherwise(1.0)
    )
    kind = (
        F.when(in_m & F.col("meaningful_phenotype_link"), "mechanistic_and_phenotypic")
        .when(in_m, "mechanistic")
        .when(in_g & ~F.col("same_gene_different_mechanism"), "genetic_overlap")
        .when(F.col("meaningful_phenotype_link"), "phenotypic_neighbor")
        .when(F.col("same_gene_different_mechanism"), "same_gene_different_mechanism")
        .otherwise("no_supported_route")
    )
    # the score is computed once, so that a filter on it does not repeat what it is made of
    return computed(scored, score, "score").withColumn("connection_type", kind).drop("_has_m", "_has_g")


def all_connections(
    features: DataFrame, terms: DataFrame, min_score: float = MIN_SCORE, told: DataFrame | None = None
) -> DataFrame:
    """Every pair a < b whose rounded score reaches ``min_score``.

    With ``told``, the result of :func:`told_lists`, the rows also have the labels of what the pair shares.
    """
    items = pair_items(features, terms)
    lists = cut_lineage(connection_lists(items))
    if told is None:
        return pair_connection(connection_candidates(items, min_score, lists), features, terms, items).filter(F.round("score", 2) >= min_score)
    told = cut_lineage(told)
    pairs = connection_candidates(items, min_score, lists, told.select("entity", F.col("told_terms.keys").alias("told_keys")))
    pairs = pairs.select("a", "b", "left", "right", F.slice(F.array_intersect("left.told_keys", "right.told_keys"), 1, 3).alias("told_shared"))
    found = pair_connection(pairs, features, terms, items).filter(F.round("score", 2) >= min_score)
    # the names of what a pair shares are read from one side, for pairs that reach the score only
    named = found.join(told.withColumnRenamed("entity", "a").hint("merge"), "a", "left")
    return named.withColumn("shared_terms", _names_in("told_terms", F.col("told_shared"))).withColumn(
        "shared_phenotype_labels", _names_in("told_phenotypes", F.col("shared_phenotypes"))).drop("told_shared", "told_terms", "told_phenotypes")


def connections_of(
    focus: DataFrame, features: DataFrame, terms: DataFrame, min_score: float = MIN_SCORE
) -> DataFrame:
    """All connections of the ``focus(entity)`` diseases: work follows their posting lists."""
    items = features.select("entity", F.concat_ws(":", "kind", "item").alias("item")).unionByName(
        terms.select("entity", F.concat(F.lit("term:"), "item").alias("item"))
    )
    pairs = cut_lineage(partners_of(focus, items))
    return pair_connection(pairs, features, terms).filter(F.round("score", 2) >= min_score)


def confidence_band(evidence: Column) -> Column:
    return F.when(evidence >= 0.85, "high").when(evidence >= 0.60, "moderate").otherwise("low")


def told_lists(features: DataFrame, closed: DataFrame, ic: DataFrame, labels: DataFrame) -> DataFrame:
    """(entity, told_terms, told_phenotypes): closed terms as numbers, the most informative first, and phenotypes, with their
    names, so that pairs can be annotated without a row for each of their labels. ``labels(id, name)``; without a name the id stands."""
    names = labels.groupBy("id").agg(F.array_sort(F.collect_list(F.coalesce("name", "id"))).alias("names"))
    named = lambda df, c: df.join(names.withColumnRenamed("id", c).hint("merge"), c, "left").withColumn("names", F.coalesce("names", F.array(c)))
    numbers = ordinal_within(ic.select("term").distinct(), [], ["term"], "no")
    terms = named(closed.join(ic.select("term", "ic").hint("merge"), "term").join(numbers.hint("merge"), "term"), "term").groupBy("entity").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("ic")).alias("_neg"), "no", "names"))).alias("_l"))
    phenotypes = named(of_kind(features, "phenotype"), "item").groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("item", "names"))).alias("_l"))
    told = lambda df, key, name: df.select("entity", F.struct(F.col("_l")[key].alias("keys"), F.col("_l")["names"].alias("names")).alias(name))
    return told(terms, "no", "told_terms").join(told(phenotypes, "item", "told_phenotypes").hint("merge"), "entity", "full_outer")


def _names_in(told: str, keys: Column) -> Column:
    found = F.transform(F.coalesce(keys, F.array()), lambda key: looked_up(F.col(told), key, "names"))
    return F.coalesce(F.flatten(F.filter(found, lambda names: names.isNotNull())), F.array().cast("array<string>"))


def _labels_joined(connections: DataFrame, labels: DataFrame, top_terms: DataFrame) -> DataFrame:
    direct = (
        connections.select("a", "b", F.explode("shared_phenotypes").alias("id")).join(labels, "id", "left")
        .groupBy("a", "b")
        .agg(F.array_sort(F.collect_list(F.struct("id", F.coalesce("name", "id").alias("name")))).alias("_l"))
        .select("a", "b", F.transform("_l", lambda x: x["name"]).alias("shared_phenotype_labels"))
    )
    informative = (
        top_terms.join(labels.withColumnRenamed("id", "term"), "term", "left")
        .groupBy("a", "b")
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.coalesce("name", "term").alias("name")))).alias("_l"))
        .select("a", "b", F.transform("_l", lambda x: x["name"]).alias("informative_labels"))
    )
    none = F.array().cast("array<string>")
    return (
        connections.join(direct, ["a", "b"], "left").join(informative, ["a", "b"], "left")
        .withColumn("shared_phenotype_labels", F.coalesce("shared_phenotype_labels", none))
        .withColumn("informative_labels", F.coalesce("informative_labels", none))
    )


def annotate_connections(connections: DataFrame, labels: DataFrame | None = None, top_terms: DataFrame | None = None) -> DataFrame:
    """Adds term labels, the confidence band and the reasons in words.

    ``labels(id, name)``; ``top_terms(a, b, term, rank)`` are the informative shared terms, at most three a pair.
    Connections found with ``told_lists`` have both already, and nothing is joined to them.
    """
    if "shared_terms" in connections.columns:
        labelled = connections.withColumnRenamed("shared_terms", "informative_labels")
    else:
        labelled = _labels_joined(connections, labels, top_terms)
    listed = lambda text, c: F.when(F.size(c) > 0, F.concat(F.lit(text), F.array_join(c, ", "), F.lit(".")))
    why = F.array_compact(F.array(
        listed("Both diseases involve: ", "shared_mechanisms"),
        listed("Shared gene(s): ", "shared_genes"),
        listed("Meaningful phenotype overlap: ", "informative_labels"),
        F.when(F.col("same_gene_different_mechanism"), F.lit(
            "The diseases share a gene but have different supported mechanisms, "
            "so this is not treated as a direct mechanistic match.")),
    ))
    return (
        labelled.withColumn("confidence", confidence_band(F.round("evidence_quality", 3)))
        .withColumn("why_connected", F.when(F.size(why) > 0, why).otherwise(
            F.array(F.lit("No supported route was found in the current graph coverage."))))
    )


def entity_projection(features: DataFrame, min_weight: float = LINK_FLOOR) -> DataFrame:
    """Weighted disease graph: 2 per shared mechanism plus 1/frequency per shared phenotype, from ``min_weight`` up, with
    the sorted ids of what a pair shares."""
    mechanisms = of_kind(features, "mechanism").withColumn("weight", F.lit(2.0))
    items = (
        mechanisms.withColumn("kind", F.lit("mechanism"))
        .unionByName(feature_rarity(features).withColumn("kind", F.lit("phenotype")))
        .withColumn("item", F.concat_ws(":", "kind", "item"))
    )
    # one bound over both kinds together
    found = alike(items, Bound(min_weight, absolute=True), names=True)
    own = lambda kind: F.transform(F.filter(F.array_sort("shared"), lambda k: k.startswith(f"{kind}:")), lambda k: F.substr(k, F.lit(len(kind) + 2)))
    counted = computed(found.select("a", "b", F.col("overlap").alias("weight"), own("mechanism").alias("m"), own("phenotype").alias("p")), F.struct("weight", "m", "p"), "s")
    size = lambda c: F.size(c).cast("long")
    return counted.select(
        "a", "b", "s.weight", size("s.m").alias("n_mechanisms"), size("s.p").alias("n_phenotypes"), F.col("s.m").alias("shared_mechanisms"), F.col("s.p").alias("shared_phenotypes"),
    ).filter(F.col("weight") >= min_weight - 1e-9)


# ---------------------------------------------------------------- serving edges from scores


def match_edges(connections: DataFrame, retrieved: Column) -> DataFrame:
    """DISEASE_MATCH edges for the serving copy of the graph (never part of the scientific graph)."""
    text = lambda c, sep: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), sep)
    return connections.select(
        F.concat_ws(":", F.lit("DISEASE_MATCH"), "a", "b").alias("edge_id"),
        F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("DISEASE_MATCH").alias("rel"),
        F.concat(F.col("connection_type"), F.lit(" ("), F.format_string("%.1f", F.round("score", 2)), F.lit(")")).alias("label"),
        F.round("score", 2).alias("score"), "connection_type",
        F.round("evidence_quality", 3).alias("evidence_quality"), "confidence",
        F.lit("disease matching").alias("source"), F.lit(1).alias("source_tier"), retrieved.alias("retrieved"),
        F.lit("computed").alias("status"), F.lit("computed").alias("method"),
        text("why_connected", " | ").alias("why_connected"),
        text("informative_labels", "; ").alias("informative_shared_phenotypes"),
        text("shared_phenotype_labels", "; ").alias("shared_phenotypes"),
        text("shared_genes", "; ").alias("shared_genes"),
        text("shared_mechanisms", "; ").alias("shared_mechanisms"),
    )


def shortcut_edges(graph: EvidenceGraph) -> DataFrame:
    """disease -> gene -> variant collapsed into HAS_VARIANT edges for the serving copy."""
    genes = graph.of_type("Gene").select(F.col("id").alias("gene"))
    links = graph.of_rel("ASSOCIATED_WITH").select("src", F.col("dst").alias("gene")).distinct()
    variants = graph.of_rel("IN_GENE").select(F.col("src").alias("dst"), F.col("dst").alias("gene")).distinct()
    return (
        links.join(genes, "gene", "left_semi").join(variants, "gene")
        .select("src", "dst", F.lit("HAS_VARIANT").alias("rel")).distinct()
    )
