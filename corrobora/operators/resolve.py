"""Identity resolution: normalised equi-joins in tiers, ambiguity kept, suggestions never merged."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import (
    first_xref, nonempty, norm_mention, norm_name, norm_xref, specific_terms, unpadded, whole_word,
)
from corrobora.operators.pairs import BLOCK
from corrobora.session import cut_lineage, first_by, top_by


def _strings(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.expr("cast(array() AS array<string>)"))


# ---------------------------------------------------------------- substring joins


#: Windows are at most this long; longer ones would hardly be rarer.
WIDEST = 64


def _windows(text: Column, size: Column, piece: int = 256) -> Column:
    """The hashes of all substrings of ``size`` characters. Long texts are cut into overlapping pieces first, because a
    substring is found by counting characters from the start."""
    n = F.length(text)
    hashes = lambda t, last: F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.substring(t, i, size)))
    one = hashes(text, n - size + 1)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - size + 1, F.lit(1)), F.lit(piece)), lambda i: F.substring(text, i, F.lit(piece - 1) + size))
    many = F.flatten(F.transform(pieces, lambda p: hashes(p, F.length(p) - size + 1)))
    return F.when(n < size, F.expr("cast(array() AS array<bigint>)")).when(n <= piece, F.array_distinct(one)).otherwise(F.array_distinct(many))


def containment_candidates(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, text_hash): a superset of the distinct texts that contain each distinct pattern, found without their text.

    A window is a substring as long as the largest power of two that the pattern holds. A text that contains the pattern
    contains all its windows, so one missing window rules the pattern out, and the window that is rarest among the texts
    leads to the candidates. Texts send hashes only, and only those that are a window of some pattern.
    """
    size = F.least(F.lit(WIDEST), F.pow(F.lit(2.0), F.floor(F.log2(F.length("pattern")) + F.lit(1e-9)))).cast("int")
    patterns = patterns.select("pattern").where(F.length("pattern") > 0).distinct().withColumn("size", size)
    sizes = sorted(r[0] for r in patterns.select("size").distinct().collect())  # at most seven numbers
    asked = patterns.select("pattern", "size", F.explode(_windows(F.col("pattern"), F.col("size"))).alias("window"))
    wanted = asked.select("size", "window").distinct()
    texts = texts.select("text").where(F.length("text") > 0).distinct()

    def sized(n: int) -> Column:
        return F.transform(_windows(F.col("text"), F.lit(n)), lambda w: F.struct(F.lit(n).alias("size"), w.alias("window")))

    of_size = [sized(n) for n in sizes]
    if not of_size:
        return patterns.select("pattern", F.lit(0).cast("long").alias("text_hash")).limit(0)
    held = texts.select(F.xxhash64("text").alias("text_hash"), F.explode(F.concat(*of_size)).alias("w")).select("text_hash", "w.*").join(wanted, ["size", "window"], "left_semi")
    frequency = held.groupBy("size", "window").agg(F.count(F.lit(1)).alias("df"))
    rarest = (
        asked.join(frequency, ["size", "window"], "left").groupBy("pattern", "size")
        .agg(F.min(F.struct("df", "window")).alias("m"), F.min(F.col("df").isNotNull()).alias("possible")).where("possible")
        .select("pattern", "size", F.col("m.window").alias("window"))
    )
    return rarest.join(held, ["size", "window"]).select("pattern", "text_hash").distinct()


def containment_pairs(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """(pattern, text) for every distinct pattern that is a substring of a distinct text.

    Candidates come from :func:`containment_candidates`; their texts are joined once, by hash, and checked. Texts whose
    hashes agree are all checked, so the result is exact. Null and empty patterns and texts pair with nothing.
    """
    found = containment_candidates(patterns, texts)
    hashed = texts.select("text").where(F.length("text") > 0).distinct().withColumn("text_hash", F.xxhash64("text"))
    return found.join(hashed, "text_hash").where(F.contains("text", "pattern")).select("pattern", "text")


# ---------------------------------------------------------------- ontology names


def build_alias_index(nodes: DataFrame) -> DataFrame:
    """Distinct (key, id) over label, synonyms and cross references of usable nodes.

    Nodes are spread before their names are listed: a small file of nodes is one task, and its names are many times as large.
    """
    names = F.concat(F.array("label"), _strings("synonyms"), _strings("xrefs"))
    return (
        nodes.filter(~F.coalesce("deprecated", F.lit(False)) & nonempty("label").isNotNull())
        .select("id", "label", names.alias("_names")).repartition("id", "label")
        .select("id", F.explode("_names").alias("_n")).select(norm_name("_n").alias("key"), "id").distinct()
    )


def resolve_alias(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """Each mention with the number of its candidates and, when there is exactly one, its id."""
    keys = index.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only"))
    return (
        # the size of an index of exploded names is guessed too low for a broadcast
        mentions.withColumn("key", norm_name("mention")).join(keys.hint("merge"), "key", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("id", F.when(F.col("n") == 1, F.col("only")))
        .withColumn("status", F.when(F.col("n") == 0, "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous"))
        .drop("only", "key")
    )


def alias_candidates(mentions: DataFrame, index: DataFrame) -> DataFrame:
    """All candidate ids of each mention, one row each."""
    return mentions.withColumn("key", norm_name("mention")).join(index, "key").drop("key")


# ---------------------------------------------------------------- seeds and annotations


def resolve_seeds(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Seeds with the attributes of their ontology node; ``found`` is false for unknown ids.

    Cross references are split by authority; manual ones stay apart so that their use is visible.
    """
    of = lambda p: F.filter(_strings("xrefs"), lambda x: x.startswith(p))
    return (
        seeds.withColumnRenamed("mondo", "id").join(nodes.withColumn("found", F.lit(True)), "id", "left")
        .withColumn("found", F.coalesce("found", F.lit(False)))
        .withColumn("omim", of("OMIM:")).withColumn("orpha", of("ORPHA:")).withColumn("gard", of("GARD:"))
        .withColumn("manual_xrefs", F.transform(_strings("extra_xrefs"), norm_xref))
    )


def join_annotations(resolved: DataFrame, annotations: DataFrame) -> DataFrame:
    """Annotation rows whose source id is one of the seed's; a term from several sources keeps all its rows."""
    ids = resolved.filter("found").select(
        F.col("id").alias("mondo"), F.explode(F.array_distinct(F.concat("omim", "orpha", "manual_xrefs"))).alias("database_id"))
    return ids.join(annotations, "database_id").select(
        "mondo", F.col("database_id").alias("source_id"), "hpo_id", "frequency", "evidence", "reference")


def terms_by_source(seed_phenotypes: DataFrame) -> DataFrame:
    return seed_phenotypes.groupBy("mondo", "source_id").agg(F.count_distinct("hpo_id").alias("n_terms"))


def gene_mentioned(resolved: DataFrame) -> DataFrame:
    """(id, gene, mentioned): the declared gene occurs as a whole word in label, definition or synonyms."""
    text = F.concat_ws(" ", F.coalesce("label", F.lit("")), F.coalesce("definition", F.lit("")), F.array_join(_strings("synonyms"), " "))
    return resolved.filter("found").select("id", F.explode("genes").alias("gene"), text.alias("_t")).select(
        "id", "gene", whole_word("_t", "gene").alias("mentioned"))


def coverage_report(resolved: DataFrame, seed_phenotypes: DataFrame) -> DataFrame:
    terms = seed_phenotypes.groupBy(F.col("mondo").alias("id")).agg(F.count_distinct("hpo_id").alias("n_terms"))
    size = lambda c: F.when(F.col("found"), F.size(_strings(c))).alias("n_" + c)
    return resolved.join(terms, "id", "left").select(
        "id", "found", size("omim"), size("orpha"), size("gard"), size("synonyms"),
        F.when(F.col("found"), F.coalesce("n_terms", F.lit(0))).alias("n_terms"))


def coverage_gaps(resolved: DataFrame, seed_phenotypes: DataFrame) -> DataFrame:
    """(id, gap) rows: what still has to be checked by hand for each seed."""
    unmentioned = gene_mentioned(resolved).groupBy("id").agg(F.bool_or(~F.col("mentioned")).alias("_unmentioned"))
    annotated = seed_phenotypes.select(F.col("mondo").alias("id")).distinct().withColumn("_annotated", F.lit(True))
    manual = lambda p: F.exists("manual_xrefs", lambda x: x.startswith(p))
    checks = F.array_compact(F.array(
        F.when((F.size("orpha") == 0) & ~manual("ORPHA:"), "no orpha xref"),
        F.when((F.size("omim") == 0) & ~manual("OMIM:"), "no omim xref"),
        F.when(F.col("_annotated").isNull(), "no annotations"),
        F.when(F.col("_unmentioned"), "gene not mentioned"),
        F.when(F.size("manual_xrefs") > 0, "manual xrefs used"),
        F.when(F.size("omim") + F.size("orpha") > 1, "several source ids"),
    ))
    return (
        resolved.filter("found").join(unmentioned, "id", "left").join(annotated, "id", "left")
        .select("id", F.explode(checks).alias("gap"))
    )


# ---------------------------------------------------------------- genes


def resolve_genes(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """(input, match, hgnc_id, symbol, ambiguous): current symbol, then alias, then previous symbol.

    Within a tier the text as given comes before its upper-case form; the first step with a hit wins.
    """
    names = lambda c, how, tier: docs.select(
        F.explode(_strings(c) if c != "symbol" else F.array("symbol")).alias("_key"), "hgnc_id", "symbol",
        F.lit(how).alias("match"), F.lit(tier).alias("_tier"))
    index = names("symbol", "symbol", 0).unionByName(names("alias_symbol", "alias", 2)).unionByName(names("prev_symbol", "previous", 4)).distinct()
    text = F.trim("input")
    variants = symbols.select("input", F.posexplode(F.array_distinct(F.array(text, F.upper(text)))).alias("_v", "_key"))
    hits = variants.join(index, "_key").withColumn("_step", F.col("_tier") + F.col("_v"))
    best = hits.groupBy("input").agg(F.min("_step").alias("_step"))
    winners = hits.join(best, ["input", "_step"]).select("input", "match", "hgnc_id", "symbol").distinct()
    several = winners.groupBy("input").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return winners.join(several, "input")


def gene_problems(symbols: DataFrame, resolved: DataFrame, docs: DataFrame) -> DataFrame:
    """(input, problem): not found, ambiguous, renamed, or not approved."""
    missing = symbols.join(resolved, "input", "left_anti").select("input", F.lit("not found").alias("problem"))
    ambiguous = resolved.filter("ambiguous").select("input", F.lit("ambiguous").alias("problem")).distinct()
    single = resolved.filter("NOT ambiguous").join(docs.select("hgnc_id", F.col("status").alias("_s")), "hgnc_id")
    renamed = single.filter("symbol <> input").select("input", F.lit("renamed").alias("problem"))
    status = single.filter("_s <> '' AND _s <> 'Approved'").select("input", F.lit("not approved").alias("problem"))
    return missing.unionByName(ambiguous).unionByName(renamed).unionByName(status)


def gene_alias_map(genes: DataFrame) -> DataFrame:
    """Distinct (alias, hgnc_id) over symbol, name and aliases."""
    return (
        genes.select("hgnc_id", F.explode(F.concat(F.array("symbol", "name"), _strings("aliases"))).alias("_n"))
        .filter(nonempty("_n").isNotNull()).select(norm_name("_n").alias("alias"), "hgnc_id").distinct()
    )


# ---------------------------------------------------------------- vocabularies and mentions


def build_vocabulary(kind: str, nodes: DataFrame) -> DataFrame:
    """Distinct (kind, key, id, label) over id, label and exact synonyms of usable records."""
    return (
        nodes.filter(~F.coalesce("deprecated", F.lit(False)))
        .select("id", F.coalesce("label", "id").alias("label"), F.explode(F.concat(F.array("id", F.coalesce("label", "id")), _strings("exact_synonyms"))).alias("_n"))
        .filter(nonempty("_n").isNotNull())
        .select(F.lit(kind).alias("kind"), norm_mention("_n").alias("key"), "id", "label").distinct()
    )


def gene_vocabulary(genes: DataFrame) -> DataFrame:
    """Genes enter the vocabulary only when unambiguous and approved."""
    usable = genes.filter(nonempty("hgnc_id").isNotNull() & ~F.col("ambiguous") & (F.col("status") == "Approved"))
    return build_vocabulary("Gene", usable.select(
        F.col("hgnc_id").alias("id"), F.col("symbol").alias("label"), F.lit(False).alias("deprecated"),
        F.concat(F.array("name"), _strings("aliases")).alias("exact_synonyms")))


def snapshot_hashes(files: DataFrame) -> DataFrame:
    """(path, sha256) of the vocabulary files read with the binaryFile source."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def resolve_mentions(mentions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Exact label or synonym only: one id resolves, several stay ambiguous with a null id, none is unresolved."""
    keys = vocabulary.groupBy("kind", "key").agg(F.count_distinct("id").alias("n_candidates"), F.min("id").alias("_only"))
    n = F.coalesce("n_candidates", F.lit(0))
    return (
        mentions.withColumn("key", norm_mention("mention")).join(keys, ["kind", "key"], "left")
        .withColumn("n_candidates", n)
        .withColumn("canonical_id", F.when(n == 1, F.col("_only")))
        .withColumn("status", F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved"))
        .drop("_only", "key")
    )


LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def _letter_counts(texts: list[str]) -> np.ndarray:
    """How often each of ``LETTERS`` occurs in each text, and how many other characters there are."""
    counts = np.zeros((len(LETTERS) + 1, len(texts)), dtype="int32")
    for i, text in enumerate(texts):
        for j, letter in enumerate(LETTERS):
            counts[j, i] = text.count(letter)
        counts[-1, i] = len(text) - counts[:-1, i].sum()
    return counts


def _at_most(xs: list[str], ys: list[str]) -> np.ndarray:
    """An upper bound of the ratio of every two texts: matching blocks cannot hold more of a letter than both texts have."""
    both = np.zeros((len(xs), len(ys)), dtype="int32")
    for x, y in zip(_letter_counts(xs), _letter_counts(ys)):
        if x.any() and y.any():
            both += np.minimum.outer(x, y)
    return 2.0 * both / np.add.outer([len(x) for x in xs], [len(y) for y in ys])


def _best_labels(k: int, floor: float):
    """The ``k`` labels most like each mention by the Ratcliff-Obershelp ratio, among those of one item in a group.

    Labels are taken by falling upper bound, and those that can no longer be among the ``k`` are not aligned.
    """
    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        labels, out = dict(list(right.groupby("item"))), []
        for item, asked in left.groupby("item"):
            if item not in labels:
                continue
            ys, ids = labels[item]["y"].tolist(), labels[item]["id"].tolist()
            xs = asked["x"].tolist()
            for kind, x, most in zip(asked["kind"], xs, _at_most(xs, ys)):
                top: list[tuple[float, bool, str, str]] = []
                for i in np.argsort(-most, kind="stable"):
                    if most[i] < floor - 1e-9 or len(top) == k and most[i] < top[-1][0] - 1e-9:
                        break
                    score = SequenceMatcher(None, x, ys[i]).ratio()
                    if score >= floor:
                        top = sorted([*top, (score, ids[i] is not None, ids[i] or "", ys[i])], reverse=True)[:k]
                out += [(kind, x, y, score) for score, _, _, y in top]
        return pd.DataFrame(out, columns=["kind", "text", "label_key", "score"])

    return best


def suggest_candidates(unresolved: DataFrame, vocabulary: DataFrame, k: int = 3, floor: float = 0.4, block: int = BLOCK) -> DataFrame:
    """Up to ``k`` suggestions per unresolved disease or phenotype mention; they are never merged.

    Only labels that share a word of at least three characters are compared. The mentions and the labels of a word that many
    have are cut into blocks of about ``block``, and every two blocks meet in a group of their own; other words go into
    groups of about that size. A group gives the best ``k`` labels of its mentions, so no pair of texts is shuffled but these.
    """
    words = lambda c: F.array_distinct(F.filter(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1), lambda w: F.length(w) >= 3))
    vocabulary = vocabulary.filter(F.col("kind").isin("Disease", "Phenotype"))
    mentions = (
        unresolved.filter(F.col("kind").isin("Disease", "Phenotype"))
        .select("kind", norm_mention("mention").alias("text")).distinct()
    )
    records = vocabulary.select("kind", "id", norm_mention("label").alias("label_key")).distinct()
    item = F.concat_ws("|", "kind", "word").alias("item")
    left = mentions.select("kind", F.col("text").alias("x"), F.explode(words(F.col("text"))).alias("word")).select(item, "kind", "x")
    # of labels that score alike the greater id comes first, so the greatest of a text stands for it
    right = vocabulary.select("kind", "id", norm_mention("label").alias("y"), F.explode(words(F.col("key"))).alias("word")).where("y is not null").groupBy(
        item, "y").agg(F.max("id").alias("id"))
    size = lambda df, n: df.groupBy("item").agg(F.count(F.lit(1)).alias(n))
    sizes = cut_lineage(size(left, "n_x").join(size(right, "n_y").hint("merge"), "item"))
    short = (F.col("n_x") <= block) & (F.col("n_y") <= block)
    buckets = sizes.where(short).agg((F.sum(F.col("n_x") + F.col("n_y")) / (2 * block)).alias("n")).first()["n"]
    bucket = F.pmod(F.xxhash64("item"), F.lit(int(buckets or 0) + 1)).cast("int")
    blocks = lambda n: F.ceil(F.col(n) / block).cast("int")

    def placed(df: DataFrame, text: str, n: str, n_other: str):
        here = F.pmod(F.xxhash64(text), blocks(n)).cast("int")
        places = F.when(short, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks(n_other) - 1))
        rows = df.join(sizes.hint("merge"), "item").select(
            *df.columns, F.when(short, "").otherwise(F.col("item")).alias("word"), F.when(short, bucket).otherwise(here).alias("own"), F.explode(places).alias("other"))
        x, y = ("own", "other") if text == "x" else ("other", "own")
        # the words of a bucket have its number on both sides
        either = lambda c: F.when(F.col("word") == "", F.col("own")).otherwise(F.col(c))
        return rows.select(*df.columns, "word", either(x).alias("block_x"), either(y).alias("block_y")).groupBy("word", "block_x", "block_y")

    found = placed(left, "x", "n_x", "n_y").cogroup(placed(right, "y", "n_y", "n_x")).applyInPandas(
        _best_labels(k, floor), "kind string, text string, label_key string, score double").distinct()
    ranked = top_by(found.join(records.hint("merge"), ["kind", "label_key"]), ["kind", "text"], [F.desc("score"), F.desc("id")], k)
    return ranked.select("kind", F.col("text").alias("mention_key"), "id", F.round("score", 3).alias("lexical_score"), "rank")


def apply_reviewed_alias(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Reviewed overrides for disease mentions that are still unresolved; never for anything else."""
    usable = first_by(
        aliases.filter((F.trim("canonical_id") != "") & (F.trim("reviewer") != "")).withColumn("_key", norm_mention("mention")),
        ["_key"], [F.asc("mention")],
    ).select("_key", F.col("canonical_id").alias("_id"), F.col("reviewer").alias("alias_reviewer"))
    hit = F.col("_id").isNotNull() & F.col("canonical_id").isNull() & (F.col("kind") == "Disease")
    return (
        entities.withColumn("_key", norm_mention("mention")).join(usable, "_key", "left")
        .withColumn("method", F.when(hit, "reviewed_alias").otherwise("exact_label_or_synonym"))
        .withColumn("status", F.when(hit, "resolved").otherwise(F.col("status")))
        .withColumn("alias_reviewer", F.when(hit, F.col("alias_reviewer")))
        .withColumn("canonical_id", F.when(hit, F.col("_id")).otherwise(F.col("canonical_id")))
        .drop("_key", "_id")
    )


def alias_problems(aliases: DataFrame) -> DataFrame:
    bad = (F.trim(F.coalesce("canonical_id", F.lit(""))) == "") | (F.trim(F.coalesce("reviewer", F.lit(""))) == "")
    return aliases.filter(bad).select("mention", F.lit("alias needs canonical_id and reviewer").alias("reason"))


# ---------------------------------------------------------------- catalogues, communities, report links


def search_catalog(catalog: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """Exact name or alias hits, then substring hits, in catalogue order (``seq``)."""
    needle = q.strip().lower()
    name = F.lower("name")
    lowered = F.transform(_strings("aliases"), F.lower)
    tier = (
        F.when(F.lit(needle == "") | (name == needle) | F.array_contains(lowered, needle), 0)
        .when(F.contains(name, F.lit(needle)) | F.exists(lowered, lambda a: F.contains(a, F.lit(needle))), 1)
    )
    return catalog.withColumn("tier", tier).filter("tier is not null").orderBy("tier", "seq").limit(limit)


def community_tier(query: Column) -> Column:
    """0 equal to name, default name or slug; 1 contained in one of them; 2 contained in the description."""
    names = [F.lower(F.coalesce(c, F.lit(""))) for c in ("name", "default_name", "slug")]
    equal, inside = F.lit(False), F.lit(False)
    for n in names:
        equal, inside = equal | (n == query), inside | F.contains(n, query)
    return F.when(equal, 0).when(inside, 1).when(F.contains(F.lower(F.coalesce("description", F.lit(""))), query), 2)


def search_communities(communities: DataFrame, q: str, limit: int = 20) -> DataFrame:
    found = communities.withColumn("tier", community_tier(F.lit(q.strip().lower()))).filter("tier is not null")
    if not q.strip():
        return found.orderBy(F.lower("name"), "slug").limit(limit)
    return found.orderBy("tier", F.desc("total_members"), F.lower("name"), "slug").limit(limit)


def get_by_slug(communities: DataFrame, slugs: DataFrame) -> DataFrame:
    return communities.withColumn("_k", F.lower("slug")).join(
        slugs.select(F.lower(F.trim("slug")).alias("_k")).distinct(), "_k", "left_semi").drop("_k")


def get_by_padded_id(catalog: DataFrame, ids: DataFrame, column: str = "gard_id") -> DataFrame:
    """First catalogue row of each id, compared without leading zeros."""
    hits = catalog.withColumn("_k", unpadded(column)).join(ids.select(unpadded("id").alias("_k")).distinct(), "_k", "left_semi")
    return first_by(hits, ["_k"], [F.asc("seq")]).drop("_k")


def resolve_report_url(queries: DataFrame, slug_map: DataFrame, base: str) -> DataFrame:
    """A report link for every query text: link as given, exact key, slug key, substring either way (first in map
    order), or a link guessed from the slug. ``slug_map(seq, key, url)``; ``tier`` tells how it was found."""
    q = queries.select("query").distinct().withColumn("_clean", F.lower(F.trim("query"))).withColumn("_slug", F.replace("_clean", F.lit(" "), F.lit("-")))
    is_url = F.trim("query").rlike("^https?://")
    given = q.filter(is_url).select("query", F.lit(0).alias("tier"), F.lit(0).cast("long").alias("seq"),
                                    F.concat(F.rtrim(F.trim("query"), F.lit("/")), F.lit("/")).alias("url"))
    names = q.filter(~is_url)
    keyed = lambda c, tier: names.join(slug_map, names[c] == slug_map["key"]).select("query", F.lit(tier).alias("tier"), "seq", "url")
    inside = containment_pairs(names.select(F.col("_clean").alias("pattern")), slug_map.select(F.col("key").alias("text"))).select(
        F.col("pattern").alias("_clean"), F.col("text").alias("key"))
    around = containment_pairs(slug_map.select(F.col("key").alias("pattern")), names.select(F.col("_clean").alias("text"))).select(
        F.col("text").alias("_clean"), F.col("pattern").alias("key"))
    partial = (
        inside.unionByName(around).distinct().join(names.select("query", "_clean"), "_clean").join(slug_map, "key")
        .select("query", F.lit(3).alias("tier"), "seq", "url")
    )
    guessed = names.select("query", F.lit(4).alias("tier"), F.lit(0).cast("long").alias("seq"),
                           F.concat(F.lit(base.rstrip("/") + "/"), F.col("_slug"), F.lit("/")).alias("url"))
    options = given.unionByName(keyed("_clean", 1)).unionByName(keyed("_slug", 2)).unionByName(partial).unionByName(guessed)
    return first_by(options, ["query"], [F.asc("tier"), F.asc("seq")]).select("query", "tier", "url")


def trusted_url_only(terms: DataFrame, slug_map: DataFrame, base: str, tries: int = 4) -> DataFrame:
    """(entity, url): the first of the entity's first terms whose link really comes from the map."""
    tried = terms.filter(F.col("pos") < tries)
    links = resolve_report_url(tried.select(F.col("term").alias("query")), slug_map, base).withColumnRenamed("query", "term")
    known = links.join(slug_map.select("url").distinct(), "url", "left_semi")
    return first_by(tried.join(known, "term"), ["entity"], [F.asc("pos")]).select("entity", "term", "url")


def entity_terms(entities: DataFrame) -> DataFrame:
    """(entity, pos, term): the specific terms of each entity in order."""
    return entities.select("entity", F.posexplode(specific_terms("name", "synonyms")).alias("pos", "term"))


def orpha_code(entities: DataFrame, fallback: DataFrame) -> DataFrame:
    """First directory code of each entity, else the fallback table with the label of the closest entry."""
    own = nonempty(first_xref("xrefs", "ORPHA", "ORPHANET"))
    return (
        entities.withColumn("_own", own).join(fallback.select("entity", F.col("code").alias("_code"), F.col("closest").alias("_closest")), "entity", "left")
        .select("entity", F.coalesce("_own", "_code").alias("code"), F.when(F.col("_own").isNull(), F.col("_closest")).alias("closest"))
    )


def match_communities(entities: DataFrame, communities: DataFrame) -> DataFrame:
    """(entity, slug): the community's name equals a term or the gene, contains one of more than five characters
    anywhere, or contains the gene as a whole word."""
    names = communities.select("slug", F.lower(F.coalesce(nonempty("name"), nonempty("default_name"), F.lit(""))).alias("text"))
    genes = entities.filter(F.length("gene") > 0).select("entity", F.lower("gene").alias("pattern")).distinct()
    terms = entity_terms(entities).select("entity", F.lower("term").alias("pattern")).unionByName(genes).distinct()
    equal = terms.join(names, terms["pattern"] == names["text"]).select("entity", "slug")
    long_terms = terms.filter(F.length("pattern") > 5)
    contained = containment_pairs(long_terms, names).join(long_terms, "pattern").join(names, "text").select("entity", "slug")
    by_gene = (
        containment_pairs(genes, names).filter(whole_word("text", "pattern"))
        .join(genes, "pattern").join(names, "text").select("entity", "slug")
    )
    return equal.unionByName(contained).unionByName(by_gene).distinct()
