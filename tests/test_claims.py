import difflib

import pytest
from pyspark.sql import functions as F

from corrobora.model import EvidenceGraph
from corrobora.operators import claims as C
from corrobora.operators import evidence as T
from corrobora.operators import resolve as N

def today():
    return F.lit("2026-01-01").cast("date")
KEY = "src string, dst string, rel string"


def test_chunks_cover_the_text(spark):
    for n in (0, 1, 9, 10, 11, 18, 19, 27, 28, 100):
        text = "".join(chr(97 + i % 26) for i in range(n))
        want, start = [], 0
        while start < n:
            end = min(start + 10, n)
            want.append((start, text[start:end]))
            if end == n:
                break
            start = end - 1
        df = spark.createDataFrame([("s", text)], "source_id string, text string")
        assert sorted((r.chunk_start, r.chunk) for r in T.chunk_text(df, 10, 1).collect()) == want
    with pytest.raises(ValueError):
        T.chunk_text(df, 5, 5)


def test_passages_count_blank_lines_only_when_not_empty(spark):
    df = spark.createDataFrame([("s", "one\n\n  \ntwo\n")], "source_id string, text string")
    assert [(r.passage_id, r.quote) for r in T.split_passages(df).collect()] == [("P1", "one"), ("P3", "two")]


def test_author_metadata(spark):
    text = "Title: T\nAuthors: Ada A.; Bo B;; Ada A. \nAbstract:\nBody. Authors: No One"
    df = spark.createDataFrame([("s", text), ("n", "Authors: X\nno header")], "source_id string, text string")
    authors = T.metadata_authors(df)
    assert [(r.source_id, r.idx, r.name) for r in authors.collect()] == [("s", 0, "Ada A."), ("s", 1, "Bo B")]
    claims = T.author_claims(authors).withColumn("mention", F.col("name"))
    assert all(r.author_verified for r in T.author_claim_check(claims, authors).collect())


def test_verdict_set_must_be_exact(spark):
    cand = spark.createDataFrame([("a",), ("b",), ("c",)], "candidate_id string")
    flags = ", ".join(f"{f} boolean" for f in T.VERDICT_FLAGS)
    rows = [("a", *[True] * 5, ""), ("b", *[True] * 4, False, "no"), ("b", *[True] * 5, ""), ("z", *[True] * 5, "")]
    verdicts = spark.createDataFrame(rows, f"candidate_id string, {flags}, reason string")
    assert {(r.candidate_id, r.problem) for r in T.verdict_problems(cand, verdicts).collect()} == {("c", "missing verdict"), ("z", "unknown candidate"), ("b", "duplicate verdict")}
    assert [r.candidate_id for r in T.apply_verdicts(cand, verdicts).valid.collect()] == ["a"]


def test_whole_summary_is_all_or_nothing(spark):
    claims = spark.createDataFrame([("s", "c1"), ("t", "c2")], "source_id string, id string")
    sentences = spark.createDataFrame([("s", 0, "fine", ["c1"]), ("s", 1, "bad", ["zz"]), ("t", 0, "ok", ["c2"])], "source_id string, idx int, text string, claim_ids array<string>")
    flags = ", ".join(f"{f} boolean" for f in T.AUDIT_FLAGS)
    audits = spark.createDataFrame([("s", *[True] * 5, ""), ("t", *[True] * 5, "")], f"source_id string, {flags}, reason string")
    assert {(r.source_id, r.idx) for r in T.check_summary(sentences, claims, audits).valid.collect()} == {("t", 0)}
    assert {(r.source_id, r.idx) for r in T.check_summary(sentences, claims).valid.collect()} == {("s", 0), ("t", 0)}


def _promote(spark, base, claims):
    b = spark.createDataFrame(base, f"edge_id string, {KEY}, seq long, status string, source_tier int")
    c = spark.createDataFrame(claims, f"id string, seq long, {KEY}, polarity string, status string, source_tier int")
    return {r.edge_id: r for r in C.promote_claims(b, c).edges.collect()}


def test_promotion_rules(spark):
    key = ("D", "G", "ASSOCIATED_WITH")
    base = [("e1", *key, 1, "hypothesis", 3), ("e2", *key, 2, "hypothesis", 3)]
    got = _promote(spark, base, [("c1", 5, *key, "affirmed", "observation", 2), ("c2", 6, *key, "affirmed", "observation", 1)])
    assert (got["e1"].status, got["e1"].source_tier, got["e1"].n_support) == ("observation", 2, 2)
    assert (got["e2"].status, got["e2"].source_tier, got["e2"].n_support) == ("hypothesis", 3, 0)


def test_negation_never_creates_an_edge_and_only_flags_older_ones(spark):
    key = ("D", "P", "HAS_PHENOTYPE")
    assert _promote(spark, [], [("c1", 1, *key, "negated", "observation", 2)]) == {}
    assert _promote(spark, [], [("c1", 1, *key, "affirmed", "hypothesis", 2)]) == {}
    early = _promote(spark, [], [("c0", 1, *key, "negated", "observation", 2), ("c1", 2, *key, "affirmed", "observation", 2)])
    assert not list(early.values())[0].contradicted
    late = _promote(spark, [], [("c1", 2, *key, "affirmed", "observation", 2), ("c2", 3, *key, "uncertain", "observation", 2)])
    assert list(late.values())[0].uncertain and not list(late.values())[0].contradicted


def _import(spark, graph_nodes):
    nodes = spark.createDataFrame(graph_nodes, "id string, type string")
    claims = spark.createDataFrame([("c1", "s", 1, "st", "q", "e1", "e2", "ASSOCIATED_WITH", "affirmed", "observation", "finding")],
        "id string, source_id string, seq long, statement string, quote string, subject string, object string, relation string, polarity string, status string, category string")
    entities = spark.createDataFrame([("c1", "e1", "Disease", "Dis", "MONDO:1", "resolved", "reviewed_alias"), ("c1", "e2", "Gene", "Gen", None, "unresolved", "exact")],
        "claim_id string, local_id string, kind string, mention string, canonical_id string, status string, method string")
    sources = spark.createDataFrame([("s", "h", "T", 2)], "source_id string, sha256 string, title string, source_tier int")
    edges = spark.createDataFrame([], f"edge_id string, {KEY}")
    return C.import_claims(EvidenceGraph(nodes, edges), claims, entities, sources, claims.select("id"), today())


def test_import_once_and_errors(spark):
    out = _import(spark, [("MONDO:1", "Disease")])
    nodes = {r.id: r for r in out.nodes.collect()}
    assert out.problems.count() == 0 and sorted(r.rel for r in out.edges.collect()) == ["ABOUT", "ABOUT", "CONTAINS"]
    assert [n.paper_scoped for i, n in nodes.items() if i.startswith("MENTION:")] == [True]
    again = _import(spark, [("MONDO:1", "Disease"), *[(i, n.type) for i, n in nodes.items()]])
    assert again.nodes.count() == 0 and again.edges.count() == 0
    assert [r.reason for r in _import(spark, []).problems.collect()] == ["alias target is not in the graph"]
    assert [r.reason for r in _import(spark, [("MONDO:1", "Gene")]).problems.collect()] == ["canonical ID conflicts with existing node type"]


def test_suggestions_equal_brute_force(spark):
    labels = {f"MONDO:{i}": name for i, name in enumerate(["early epileptic encephalopathy", "epileptic encephalopathy 2", "rett syndrome", "atypical rett syndrome", "dravet syndrome", "encephalopathy"])}
    nodes = spark.createDataFrame([(i, n, False, []) for i, n in labels.items()], "id string, label string, deprecated boolean, exact_synonyms array<string>")
    vocabulary = N.build_vocabulary("Disease", nodes)
    mentions = ["Rett like syndrome", "infantile encephalopathy", "zz"]
    df = spark.createDataFrame([("Disease", m) for m in mentions], "kind string, mention string")
    got = {(r.mention_key, r.id, r.lexical_score, r.rank) for r in N.suggest_candidates(df, vocabulary).collect()}
    want = set()
    for m in (x.lower() for x in mentions):
        near = [i for i, n in labels.items() if {w for w in m.split() if len(w) >= 3} & set(n.split() + ["mondo"])]
        scored = sorted(((difflib.SequenceMatcher(None, m, labels[i]).ratio(), i) for i in near), reverse=True)
        for k, (s, i) in enumerate([x for x in scored if x[0] >= 0.4][:3]):
            want.add((m, i, round(s, 3), k + 1))
    assert got == want
    assert N.resolve_mentions(df, vocabulary).filter("canonical_id is not null").count() == 0


def test_ambiguity_is_preserved(spark):
    nodes = spark.createDataFrame([("A:1", "same", False, []), ("A:2", "other", False, ["Same"])], "id string, label string, deprecated boolean, exact_synonyms array<string>")
    df = spark.createDataFrame([("Disease", " SAME "), ("Disease", "a:2")], "kind string, mention string")
    got = {r.mention: (r.canonical_id, r.status) for r in N.resolve_mentions(df, N.build_vocabulary("Disease", nodes)).collect()}
    assert got == {" SAME ": (None, "ambiguous"), "a:2": ("A:2", "resolved")}


def test_containment_equals_brute_force(spark):
    patterns, texts = ["a", "ab", "epi", "epilepsy", "rare x", "zzz"], ["epilepsy group", "a rare x", "xyz", "ab", "the epilepsies"]
    got = {(r.pattern, r.text) for r in N.containment_pairs(
        spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    assert got == {(p, t) for p in patterns for t in texts if p in t}


def test_curated_rows_leave_the_text_of_their_source_behind(spark):
    rows = spark.createDataFrame([
        ("D1", "MECH:loss_of_function", "s", "two", "r"), ("D1", "MECH:loss_of_function", "s", "two", "r"), ("D1", "MECH:loss_of_function", "s", "six", "r"),
        ("D1", "MECH:loss_of_function", "s", "", "r"), ("D1", "MECH:loss_of_function", "s", None, "r"), ("D1", "MECH:loss_of_function", "z", "one", "r"),
        ("D1", "MECH:loss_of_function", None, "one", "r"), ("D9", "MECH:loss_of_function", "s", "one", "r"), ("D1", "MECH:none", "s", "one", "r"),
        ("D1", "MECH:loss_of_function", "s", "one", " "), ("D1", "MECH:loss_of_function", "e", "one", "r")],
        "disease string, mechanism string, source_id string, quote string, reviewer string")
    sources = spark.createDataFrame([("s", "one two", "h", 2), ("e", None, "h", 2)], "source_id string, text string, sha256 string, source_tier int")
    nodes = spark.createDataFrame([("D1", "Disease"), ("D9", "Gene")], "id string, type string")
    out = C.import_curated_mechanisms(rows, sources, nodes, today())
    assert sorted(r.reason for r in out.problems.collect()) == sorted(
        ["quote not found verbatim"] * 3 + ["unknown source"] * 3 + ["unknown disease", "unknown mechanism", "curated mechanism needs a reviewer"])
    assert [(r.src, r.dst, r.source, r.source_tier, r.start, r.end) for r in out.edges.where("rel = 'INVOLVES'").collect()] == [("D1", "MECH:loss_of_function", "s", 2, 4, 7)]
    for df in (out.problems, out.edges, out.nodes):
        assert "text#" not in df._jdf.queryExecution().optimizedPlan().toString()
