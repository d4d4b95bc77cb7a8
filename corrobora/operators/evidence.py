"""From documents and extracted candidates to validated, reviewable claims.

Extraction candidates, verdicts and summaries are input tables. Everything here is joins and aggregations on
(source, chunk, local id) keys, so a source with very many claims spreads over all tasks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.functions.text import content_digest, folded, is_blank, screening_flags, span, span_problem
from corrobora.model import CLAIM_ENDPOINTS, endpoint_allowed
from corrobora.session import first_by, ordinal_within

CHUNK = ["source_id", "chunk_start"]
CHUNK_SIZE, CHUNK_OVERLAP = 12_000, 1_500
LIMITATIONS_NOTE = "Not separately extracted; see source evidence and limitation-category claims."
VERDICT_FLAGS = ["supported", "entities_correct", "relation_correct", "polarity_correct", "context_preserved"]
AUDIT_FLAGS = ["supported", "coherent", "main_findings_covered", "limitations_preserved", "plain_language"]


class Checked(NamedTuple):
    valid: DataFrame
    rejected: DataFrame


# ---------------------------------------------------------------- documents


def validate_documents(
    docs: DataFrame, max_papers: int | None = None, max_batch_chars: int | None = None, max_chars: int = 500_000
) -> DataFrame:
    """(source_id, reason) for every broken rule. The batch limits are options: a cluster run has no batch of 20."""
    url = F.col("url")
    parsed = lambda part: F.try_parse_url(url, F.lit(part))
    bad_url = url.isNotNull() & (
        ~F.coalesce(parsed("PROTOCOL").isin("http", "https"), F.lit(False)) | F.coalesce(parsed("HOST"), F.lit("")).eqNullSafe("")
        | parsed("USERINFO").isNotNull() | url.rlike(r"\s"))
    blank = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s", "") == ""
    reasons = F.array_compact(F.array(
        F.when(~F.coalesce(F.length("source_id").between(1, 256), F.lit(False)), "source_id length"),
        F.when(blank, "text blank"),
        F.when(F.length("text") > max_chars, "text length"),
        F.when(bad_url, "url"),
        F.when(~F.coalesce(F.col("source_kind").isin("abstract", "full_text"), F.lit(False)), "source_kind"),
        F.when(~F.coalesce(F.col("source_tier").isin(2, 3), F.lit(False)), "source_tier"),
    ))
    rows = docs.select("source_id", F.explode(reasons).alias("reason"))
    twice = docs.groupBy("source_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(
        "source_id", F.lit("source_id not unique").alias("reason"))
    out = rows.unionByName(twice)
    if max_papers is not None or max_batch_chars is not None:
        total = docs.agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("text")).alias("_c"))
        limits = F.array_compact(F.array(
            F.when(~F.col("_n").between(1, max_papers or 2**62), "batch size"),
            F.when(F.col("_c") > (max_batch_chars or 2**62), "batch characters")))
        out = out.unionByName(total.select(F.lit(None).cast("string").alias("source_id"), F.explode(limits).alias("reason")))
    return out


def split_passages(docs: DataFrame) -> DataFrame:
    """(source_id, passage_id, quote): non-blank lines; the number counts all non-empty lines."""
    lines = docs.select("source_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([^\n]+)"), 1)).alias("_i", "quote"))
    return lines.filter(F.regexp_replace("quote", r"(?U)\s", "") != "").select(
        "source_id", F.concat(F.lit("P"), F.col("_i") + 1).alias("passage_id"), "quote")


def chunk_text(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """(source_id, chunk_start, chunk): windows that overlap and end exactly with the text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than chunk size")
    n = F.length("text")
    starts = F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return docs.filter(n > 0).select("source_id", F.explode(starts).alias("chunk_start"), "text").select(
        "source_id", "chunk_start", F.substring(F.col("text"), F.col("chunk_start") + 1, F.lit(size)).alias("chunk"))


def screen_text(df: DataFrame, key: str | list[str], columns: list[str]) -> DataFrame:
    """(key..., flags): distinct sorted screening flags over all given text columns."""
    keys = [key] if isinstance(key, str) else key
    texts = df.select(*keys, *[F.coalesce(F.col(c), F.lit("")).alias(f"_r{i}") for i, c in enumerate(columns)])
    for i, _ in enumerate(columns):
        texts = texts.withColumn(f"_n{i}", folded(f"_r{i}"))
    flags = F.concat(*[screening_flags(f"_r{i}", f"_n{i}") for i, _ in enumerate(columns)])
    return texts.select(*keys, F.array_sort(F.array_distinct(flags)).alias("flags"))


def quarantine(docs: DataFrame, columns: list[str]) -> Checked:
    """Flagged sources leave the run with one rejection row and never yield claims."""
    flagged = screen_text(docs, "source_id", columns).filter(F.size("flags") > 0)
    return Checked(
        docs.join(flagged, "source_id", "left_anti"),
        flagged.select("source_id", F.lit("source quarantined").alias("reason"), "flags"))


def drop_unsafe_chunks(entities: DataFrame, claims: DataFrame, entity_columns: list[str], claim_columns: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entities, claims, rejected): a chunk goes with all its candidates when any of their texts trips the screen."""
    key = ["source_id", "chunk_start"]
    flagged = (
        screen_text(entities, key, entity_columns).unionByName(screen_text(claims, key, claim_columns))
        .filter(F.size("flags") > 0).select(*key).distinct()
    )
    keep = lambda df: df.join(flagged, key, "left_anti")
    return keep(entities), keep(claims), flagged.withColumn("reason", F.lit("unsafe model output"))


# ---------------------------------------------------------------- author metadata

_HEADER = "(?s)^(Title: .*?)\nAbstract:\n"


def metadata_authors(docs: DataFrame) -> DataFrame:
    """(source_id, idx, name, quote): the author list given in the header of a document, first spelling of each."""
    header = F.regexp_extract("text", _HEADER, 1)
    line = F.regexp_extract(header, "(?m)^(Authors: .+)$", 1)
    names = F.array_distinct(F.filter(F.transform(F.split(F.substr(F.col("_line"), F.lit(10)), ";"), lambda n: F.trim(n)), lambda n: n != ""))
    return (
        docs.select("source_id", line.alias("_line")).filter("_line <> ''")
        .select("source_id", F.col("_line").alias("quote"), F.posexplode(names).alias("idx", "name"))
    )


def author_claims(authors: DataFrame) -> DataFrame:
    """Authorship claims built from the header instead of from the extraction."""
    local = F.concat(F.lit("metadata_author_"), F.col("idx"))
    return authors.select(
        "source_id", F.concat(local, F.lit("_claim")).alias("local_id"), local.alias("subject"), F.lit("PAPER").alias("object"),
        F.concat("name", F.lit(" is listed as an author of this paper.")).alias("statement"), "quote",
        F.lit("AUTHORED").alias("relation"), F.lit("affirmed").alias("polarity"), F.lit("observation").alias("status"),
        F.lit("authorship").alias("category"), "name")


def replace_authorship(claims: DataFrame, entities: DataFrame, authors: DataFrame) -> Checked:
    """Where a header lists the authors, extracted authorship claims go, and with them entities nothing refers to.

    Returns the kept (claims, entities).
    """
    listed = authors.select("source_id").distinct().withColumn("_listed", F.lit(True))
    kept = claims.join(listed, "source_id", "left").filter(F.col("_listed").isNull() | (F.col("relation") != "AUTHORED"))
    refs = kept.select("source_id", "chunk_start", F.explode(F.array("subject", "object")).alias("local_id")).distinct()
    with_header = entities.join(listed, "source_id", "left_semi").join(refs, [*CHUNK, "local_id"], "left_semi")
    return Checked(kept.drop("_listed"), entities.join(listed, "source_id", "left_anti").unionByName(with_header))


def author_claim_check(claims: DataFrame, authors: DataFrame) -> DataFrame:
    """Claims plus ``author_verified``: passes without a verdict when it restates the header exactly.

    ``claims`` carries ``mention``, the mention of the subject entity.
    """
    known = authors.select("source_id", F.col("name").alias("mention"), F.col("quote").alias("_line")).distinct()
    ok = (
        F.col("_line").isNotNull() & (F.col("relation") == "AUTHORED") & (F.col("object") == "PAPER")
        & (F.col("quote") == F.col("_line")) & (F.col("category") == "authorship") & (F.col("polarity") == "affirmed")
        & (F.col("statement") == F.concat("mention", F.lit(" is listed as an author of this paper."))))
    return claims.join(known, ["source_id", "mention"], "left").withColumn("author_verified", F.coalesce(ok, F.lit(False))).drop("_line")


# ---------------------------------------------------------------- candidates


def anchor_evidence(claims: DataFrame, entities: DataFrame, passages: DataFrame) -> Checked:
    """Copies each quote from the passage it names. The valid claims have their subject and object rewritten to a
    local id where the text equals exactly one entity mention of the chunk; ``passages`` has the chunk keys."""
    text = passages.select(*CHUNK, F.col("passage_id").alias("evidence_id"), "quote")
    with_quote = claims.join(text, [*CHUNK, "evidence_id"], "left")
    ids = entities.select(*CHUNK, "local_id").distinct()
    unique = (
        entities.groupBy(*CHUNK, "mention").agg(F.count(F.lit(1)).alias("_n"), F.min("local_id").alias("_to")).filter("_n = 1").drop("_n")
    )
    out = with_quote.filter("quote is not null")
    for end in ("subject", "object"):
        out = (
            out.join(ids.withColumnRenamed("local_id", end).withColumn("_known", F.lit(True)), [*CHUNK, end], "left")
            .join(unique.withColumnRenamed("mention", end), [*CHUNK, end], "left")
            .withColumn(end, F.when(F.col("_known").isNull() & (F.col(end) != "PAPER"), F.coalesce("_to", end)).otherwise(F.col(end)))
            .drop("_known", "_to")
        )
    rejected = with_quote.filter("quote is null").select(*CHUNK, "local_id", F.lit("unknown claim evidence ID").alias("reason"))
    return Checked(out.withColumn("limitations", F.lit(LIMITATIONS_NOTE)), rejected)


def check_local_ids(entities: DataFrame, claims: DataFrame) -> DataFrame:
    """Chunks to reject as a whole: duplicate entity or claim ids, or an entity that takes the reserved id."""
    twice = lambda df: df.groupBy(*CHUNK, "local_id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(*CHUNK)
    reserved = entities.filter("local_id = 'PAPER'").select(*CHUNK)
    return twice(entities).unionByName(twice(claims)).unionByName(reserved).distinct().withColumn(
        "reason", F.lit("duplicate/reserved local IDs"))


def validate_candidates(claims: DataFrame, entities: DataFrame, chunks: DataFrame) -> Checked:
    """Anchors every claim and its end entities in the chunk; the first failing check is the reason.

    ``claims``/``entities`` carry ``quote``; ``chunks(source_id, chunk_start, chunk)``. Valid claims get
    ``start``/``end`` relative to the whole source and the kinds of their ends.
    """
    checked_entities = (
        entities.join(chunks, CHUNK)
        .withColumn("_p", F.coalesce(
            span_problem("chunk", "quote"),
            F.when(is_blank("mention") | ~F.contains("quote", "mention"), F.lit("entity mention missing from evidence"))))
        .select(*CHUNK, "local_id", "kind", "_p")
    )
    # the text is dropped before the next joins, so that it is shuffled once per chunk and not once per claim
    where = span("chunk", "quote", F.col("chunk_start"))
    out = claims.join(chunks, CHUNK).withColumn("_claim_p", span_problem("chunk", "quote")).withColumn("start", where["start"]).withColumn("end", where["end"]).drop("chunk")
    for end in ("subject", "object"):
        side = checked_entities.select(*CHUNK, F.col("local_id").alias(end), F.col("kind").alias(f"{end}_kind"), F.col("_p").alias(f"_{end}_p"))
        out = out.join(side, [*CHUNK, end], "left")
    paper = lambda end: (F.col(end) == "PAPER") & (F.col("relation") == "AUTHORED")
    of_end = lambda end: F.when(~paper(end), F.when(F.col(f"{end}_kind").isNull(), F.lit("dangling entity reference")).otherwise(F.col(f"_{end}_p")))
    target = F.when(F.col("object") == "PAPER", F.lit("Paper")).otherwise(F.col("object_kind"))
    wrong = F.col("relation").isin(*CLAIM_ENDPOINTS) & ~endpoint_allowed(F.col("relation"), F.col("subject_kind"), target, CLAIM_ENDPOINTS)
    reason = F.coalesce(
        "_claim_p", of_end("subject"), of_end("object"), F.when(wrong, F.lit("invalid relation endpoint types")))
    out = out.withColumn("reason", reason)
    internal = ["reason", "_claim_p", "_subject_p", "_object_p"]
    return Checked(out.filter("reason is null").drop(*internal), out.filter("reason is not null").select(*CHUNK, "local_id", "reason"))


def verdict_problems(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(candidate_id, problem): a verdict set must hold exactly one verdict per candidate."""
    per_id = verdicts.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_n"))
    joined = candidates.select("candidate_id", F.lit(True).alias("_c")).join(per_id, "candidate_id", "full_outer")
    problem = (
        F.when(F.col("_n").isNull(), "missing verdict").when(F.col("_c").isNull(), "unknown candidate").when(F.col("_n") > 1, "duplicate verdict"))
    return joined.select("candidate_id", problem.alias("problem")).filter("problem is not null")


def apply_verdicts(candidates: DataFrame, verdicts: DataFrame) -> Checked:
    """Keeps candidates whose single verdict is positive in all five respects."""
    passes = F.lit(True)
    for flag in VERDICT_FLAGS:
        passes = passes & F.coalesce(F.col(flag), F.lit(False))
    single = verdicts.groupBy("candidate_id").agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and(passes).alias("_ok"), F.min("reason").alias("_why")).filter("_n = 1")
    joined = candidates.join(single, "candidate_id")
    return Checked(
        joined.filter("_ok").drop("_n", "_ok", "_why"),
        joined.filter("NOT _ok").select("candidate_id", F.concat(F.lit("semantic verifier rejected: "), "_why").alias("reason")))


def claim_id(*columns: str) -> Column:
    return F.concat(F.lit("CLAIM:"), content_digest(*columns))


def dedupe_claims(claims: DataFrame) -> DataFrame:
    """Overlapping chunks yield the same claim twice; the first one stays."""
    return first_by(claims, ["source_id", "start", "end", "statement", "relation"], [F.asc("chunk_start"), F.asc("seq")])


def claim_coverage(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(source_id, what, value): kept categories, entity kinds and unresolved mentions, each once."""
    rows = claims.select("source_id", F.lit("category").alias("what"), F.col("category").alias("value"))
    kinds = entities.select("source_id", F.lit("entity_kind").alias("what"), F.col("kind").alias("value"))
    open_ = entities.filter("status <> 'resolved'").select("source_id", F.lit("unresolved_mention").alias("what"), F.col("mention").alias("value"))
    return rows.unionByName(kinds).unionByName(open_).distinct()


def claim_quality(sources: DataFrame, claims: DataFrame, summaries: DataFrame) -> DataFrame:
    counts = claims.groupBy("source_id").agg(
        F.count_if(F.col("relation") != "AUTHORED").alias("scientific_claims"),
        F.count_if(F.col("relation") == "AUTHORED").alias("authorship_claims"))
    has = summaries.select("source_id").distinct().withColumn("_s", F.lit(True))
    return sources.select("source_id").join(counts, "source_id", "left").join(has, "source_id", "left").select(
        "source_id", F.coalesce("scientific_claims", F.lit(0)).alias("scientific_claims"),
        F.coalesce("authorship_claims", F.lit(0)).alias("authorship_claims"),
        F.when(F.col("_s"), "ready_for_review").otherwise("withheld").alias("summary_status"))


# ---------------------------------------------------------------- summaries


def summary_problems(sentences: DataFrame, claims: DataFrame) -> DataFrame:
    """(source_id, idx, reason) of sentences that are empty, unsafe, uncited or cite a claim the source lacks."""
    flags = screen_text(sentences, ["source_id", "idx"], ["text"]).filter(F.size("flags") > 0).select("source_id", "idx", F.lit("unsafe content").alias("reason"))
    blank = sentences.filter(is_blank("text")).select("source_id", "idx", F.lit("empty sentence").alias("reason"))
    uncited = sentences.filter(F.size("claim_ids") < 1).select("source_id", "idx", F.lit("missing citation").alias("reason"))
    cited = sentences.select("source_id", "idx", F.explode("claim_ids").alias("id"))
    unknown = cited.join(claims.select("source_id", "id"), ["source_id", "id"], "left_anti").select(
        "source_id", "idx", F.lit("unknown citation").alias("reason")).distinct()
    return flags.unionByName(blank).unionByName(uncited).unionByName(unknown)


def check_summary(sentences: DataFrame, claims: DataFrame, audits: DataFrame | None = None) -> Checked:
    """Sentence mode drops bad sentences singly. With ``audits`` the summary of a source is one piece: any bad
    sentence or any failed audit flag withholds all of it."""
    bad = summary_problems(sentences, claims)
    if audits is None:
        return Checked(sentences.join(bad.select("source_id", "idx").distinct(), ["source_id", "idx"], "left_anti"), bad)
    passes = F.lit(True)
    for flag in AUDIT_FLAGS:
        passes = passes & F.coalesce(F.col(flag), F.lit(False))
    passed = audits.filter(passes).select("source_id").distinct()
    failed = audits.filter(~passes).select("source_id", F.lit(None).cast("int").alias("idx"), F.concat(F.lit("audit: "), "reason").alias("reason"))
    whole = sentences.join(passed, "source_id", "left_semi").join(bad.select("source_id").distinct(), "source_id", "left_anti")
    return Checked(whole, bad.unionByName(failed))


# ---------------------------------------------------------------- bundles and reviews


def _duplicates(df: DataFrame, column: str, reason: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col(column).alias("id"), F.lit(reason).alias("reason"))


def validate_bundle(
    sources: DataFrame, claims: DataFrame, entities: DataFrame, sentences: DataFrame, max_papers: int | None = None
) -> DataFrame:
    """(id, reason) of every rule the tables of a bundle break.

    sources(source_id, text, sha256); claims(id, digest_ok, source_id, source_sha256, quote, start, end, subject, object,
    relation, review_status, verified); entities(claim_id, local_id, kind, mention, quote, start, end, canonical_id, status,
    n_candidates); sentences(source_id, idx, text, claim_ids, review_status, verified).
    """
    out = _duplicates(sources, "source_id", "duplicate source ID").unionByName(_duplicates(claims, "id", "duplicate claim ID"))
    if max_papers is not None:
        out = out.unionByName(sources.agg(F.count(F.lit(1)).alias("_n")).filter(~F.col("_n").between(1, max_papers)).select(
            F.lit(None).cast("string").alias("id"), F.lit("invalid paper count").alias("reason")))
    flagged = screen_text(sources, "source_id", ["text"]).filter(F.size("flags") > 0)
    quarantined = claims.select("source_id").unionByName(sentences.select("source_id")).distinct().join(flagged, "source_id", "left_semi")
    out = out.unionByName(quarantined.select(F.col("source_id").alias("id"), F.lit("quarantined source cannot be published").alias("reason")))
    out = out.unionByName(sources.filter(F.sha2("text", 256) != F.col("sha256")).select(F.col("source_id").alias("id"), F.lit("source hash mismatch").alias("reason")))

    texts = sources.select("source_id", "text", "sha256")
    offsets = lambda s, e, q: ~F.coalesce((F.col(s) >= 0) & (F.col(s) < F.col(e)) & (F.col(e) <= F.length("text")) & (F.substring(F.col("text"), F.col(s) + 1, F.col(e) - F.col(s)) == F.col(q)), F.lit(False))
    per_claim = F.array_compact(F.array(
        F.when(F.col("review_status") != "pending", "forged review status"),
        F.when(~F.col("digest_ok"), "claim ID mismatch"),
        F.when(F.col("text").isNull() | (F.col("source_sha256") != F.col("sha256")), "claim source mismatch"),
        F.when(F.col("text").isNotNull() & offsets("start", "end", "quote"), "invalid evidence offsets"),
        F.when(~F.coalesce("verified", F.lit(False)), "unverified claim")))
    out = out.unionByName(claims.join(texts, "source_id", "left").select("id", F.explode(per_claim).alias("reason")))

    referenced = claims.select("id", F.explode(F.array_distinct(F.filter(
        F.array("subject", "object"), lambda r: ~((r == "PAPER") & (F.col("relation") == "AUTHORED"))))).alias("local_id"))
    have = entities.select(F.col("claim_id").alias("id"), "local_id", F.lit(True).alias("_have")).distinct()
    mismatch = referenced.withColumn("_ref", F.lit(True)).join(have, ["id", "local_id"], "full_outer").filter("_ref is null or _have is null or local_id = 'PAPER'")
    out = out.unionByName(mismatch.select("id", F.lit("invalid entity references").alias("reason")).distinct())

    prefix = F.when(F.col("kind") == "Disease", "MONDO").when(F.col("kind") == "Gene", "HGNC").when(F.col("kind") == "Phenotype", "HP")
    canonical_ok = prefix.isNotNull() & F.coalesce(F.rlike("canonical_id", F.concat(F.lit("^"), prefix, F.lit(r":\d+$"))), F.lit(False)) & (F.col("status") == "resolved") & (F.col("n_candidates") == 1)
    e = entities.join(claims.select(F.col("id").alias("claim_id"), "source_id"), "claim_id").join(texts, "source_id")
    per_entity = F.array_compact(F.array(
        F.when(is_blank("mention") | ~F.contains("quote", "mention") | offsets("start", "end", "quote"), "invalid entity evidence"),
        F.when(F.col("canonical_id").isNotNull() & ~canonical_ok, "invalid canonical identity"),
        F.when(F.col("canonical_id").isNull() & ~F.col("status").isin("unresolved", "ambiguous"), "invalid resolution status")))
    out = out.unionByName(e.select(F.col("claim_id").alias("id"), F.explode(per_entity).alias("reason")).distinct())

    kinds = entities.select(F.col("claim_id").alias("id"), "local_id", "kind")
    ends = (
        claims.filter(F.col("relation").isin(*CLAIM_ENDPOINTS))
        .join(kinds.select("id", F.col("local_id").alias("subject"), F.col("kind").alias("_s")), ["id", "subject"], "left")
        .join(kinds.select("id", F.col("local_id").alias("object"), F.col("kind").alias("_o")), ["id", "object"], "left")
    )
    target = F.when(F.col("object") == "PAPER", F.lit("Paper")).otherwise(F.col("_o"))
    out = out.unionByName(ends.filter(~endpoint_allowed(F.col("relation"), F.col("_s"), target, CLAIM_ENDPOINTS)).select(
        "id", F.lit("invalid relation endpoint types").alias("reason")))
    bad_sentence = summary_problems(sentences, claims).select("source_id", "idx").unionByName(
        sentences.filter((F.col("review_status") != "pending") | ~F.col("verified")).select("source_id", "idx")).distinct()
    return out.unionByName(bad_sentence.select(
        F.concat_ws("#", "source_id", "idx").alias("id"), F.lit("invalid summary evidence or verification").alias("reason")))


def validate_review(
    bundle_sha256: Column, review: DataFrame, approved: DataFrame, approved_sentences: DataFrame, claims: DataFrame, sentences: DataFrame
) -> DataFrame:
    """(id, reason). review(reviewer, bundle_sha256); approved(id); approved_sentences(source_id, idx)."""
    head = review.filter(is_blank("reviewer") | (F.col("bundle_sha256") != bundle_sha256)).select(
        F.col("bundle_sha256").alias("id"), F.lit("review must identify a reviewer and match the bundle").alias("reason"))
    unknown = approved.join(claims.select("id"), "id", "left_anti").select("id", F.lit("unknown approved claim").alias("reason"))
    key = F.concat_ws("#", "source_id", "idx")
    missing = approved_sentences.join(sentences, ["source_id", "idx"], "left_anti").select(key.alias("id"), F.lit("invalid summary sentence index").alias("reason"))
    cited = approved_sentences.join(sentences, ["source_id", "idx"]).select(key.alias("_k"), F.explode("claim_ids").alias("id"))
    unapproved = cited.join(approved, "id", "left_anti").select(F.col("_k").alias("id"), F.lit("summary cites an unapproved claim").alias("reason")).distinct()
    return (
        head.unionByName(_duplicates(approved, "id", "duplicate approved claim")).unionByName(unknown)
        .unionByName(_duplicates(approved_sentences.select(key.alias("id")), "id", "duplicate summary index"))
        .unionByName(missing).unionByName(unapproved)
    )


class AutoReview(NamedTuple):
    claims: DataFrame
    sentences: DataFrame


def auto_review(claims: DataFrame, sentences: DataFrame) -> AutoReview:
    """Accepts everything in a validated bundle and records that no person did."""
    who = [F.lit("automatic-verification (no human review)").alias("reviewer"), F.lit(True).alias("auto")]
    return AutoReview(claims.select("id", *who), sentences.select("source_id", "idx", *who))


def list_claims_for_review(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Claims numbered per source, scientific ones and authorship apart, with id or status of each subject entity."""
    grouped = claims.withColumn("section", F.when(F.col("relation") == "AUTHORED", "authorship").otherwise("scientific"))
    subject = entities.select(F.col("claim_id").alias("id"), F.col("local_id").alias("subject"), F.coalesce("canonical_id", "status").alias("subject_resolution"))
    return ordinal_within(grouped.join(subject, ["id", "subject"], "left"), ["source_id", "section"], ["seq"], "position")


def replace_summary(history: DataFrame, regenerated: DataFrame) -> DataFrame:
    """Appends regenerated summaries as new versions; each keeps the hash of the version it replaces.

    history(source_id, version, summary, summary_sha256, parent_sha256); regenerated(source_id, summary).
    """
    latest = history.groupBy("source_id").agg(F.max("version").alias("_v"), F.max_by("summary_sha256", "version").alias("_h"))
    new = regenerated.join(latest, "source_id", "left").select(
        "source_id", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"), "summary",
        F.sha2("summary", 256).alias("summary_sha256"), F.col("_h").alias("parent_sha256"))
    return history.select(*new.columns).unionByName(new)


def current_summaries(history: DataFrame) -> DataFrame:
    return history.groupBy("source_id").agg(
        F.max("version").alias("version"), F.max_by("summary", "version").alias("summary"),
        F.max_by("parent_sha256", "version").alias("parent_sha256"))
