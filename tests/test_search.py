"""The search index and the substring join against brute force."""

import random
import re

import pytest

from corrobora.operators import resolve, search


def errors(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def like(word, term):
    if word == term:
        return 1.0
    if term.startswith(word):
        return 0.9
    if len(word) >= 3 and word in term:
        return 0.75
    e = errors(word, term)
    return 0.6 * (1 - e / max(len(word), len(term))) if e <= (0 if len(word) < 4 else 1 if len(word) < 8 else 2) else None


def words(text):
    return list(dict.fromkeys(re.findall(r"[^\W_]+", text.lower())))


def brute(nodes, queries, limit):
    out = set()
    for q in set(queries):
        if len(q.strip()) < 2 or not words(q):
            continue
        best = {}
        for node in nodes:
            for field in ("name", "synonyms"):
                values = node[field] if isinstance(node[field], list) else [node[field]]
                for value in values or []:
                    if value is None:
                        continue
                    held = words(value)
                    found = [max((s for t in held if (s := like(w, t)) is not None), default=None) for w in words(q)]
                    if None not in found:
                        score = round(search.WEIGHTS[field] * sum(found) / len(found) * (0.5 + 0.5 * min(1, len(found) / len(held))), 6)
                        key = (node["type"], node["id"])
                        best[key] = max(best.get(key, (0, "", "")), (score, field, value))
        shown = []
        for kind in {k[0] for k in best}:
            ranked = sorted((-s, i, f, v) for (t, i), (s, f, v) in best.items() if t == kind)
            shown += [(-s, kind, i, f, v, r + 1) for r, (s, i, f, v) in enumerate(ranked[: search.CAPS.get(kind, search.OTHER_CAP)])]
        out |= {(q, kind, i, f, v, s, r) for s, kind, i, f, v, r in sorted(shown, key=lambda x: (-x[0], x[1], x[2]))[:limit]}
    return out


@pytest.fixture(scope="module")
def world(spark):
    rng = random.Random(4)
    stems = ["syndrome", "disorder", "epilepsy", "channel", "grin2b", "kcnq2", "dee27", "a", "ab", "encephalopathy", "éclair", "x" * 60]
    typo = lambda w: "".join(rng.choice(["", c, c, c, c, c, c, rng.choice("abxyz") + c]) for c in w)
    name = lambda: " ".join(typo(rng.choice(stems)) for _ in range(rng.randrange(1, 5)))
    nodes = [
        {"id": f"n{i}", "type": rng.choice(["Disease", "Gene", "Other"]), "name": name(), "synonyms": [name() for _ in range(rng.randrange(0, 3))], "term": "x", "df": 1}
        for i in range(250)
    ]
    nodes += [{"id": "e1", "type": "Gene", "name": None, "synonyms": [None, "", " -- "], "term": None, "df": 2}, {"id": "e2", "type": "Gene", "name": "GRIN2B grin2b", "synonyms": None, "term": "", "df": 3}]
    frame = spark.createDataFrame(nodes, "id string, type string, name string, synonyms array<string>, term string, df int")
    queries = [name() for _ in range(40)] + stems + ["", " ", "-- ", "grin2b disorder", "GRIN2B", "zzzzzzzzzz", "syndrome syndrome", "epilep"]
    return nodes, frame, queries


def test_search_equals_brute_force(spark, world):
    nodes, frame, queries = world
    index = search.build_index(frame.unionByName(frame.limit(20)))
    asked = spark.createDataFrame([(q,) for q in [*queries, queries[0]]] + [(None,)], "query string")
    found = {tuple(r) for r in search.search_all(index, asked, 7).select("query", "type", "id", "field", "matched", "score", "rank").collect()}
    assert found == brute(nodes, queries, 7)
    assert search.search(index, "grin2b").first().score > 0
    assert search.search(index, "").count() == search.search(index, "?!").count() == 0


def test_a_query_reads_few_buckets(spark, world):
    index = search.build_index(world[1])
    plan = index.matching("postings", spark.createDataFrame([("syndrome",)], "term string"), "term")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=) \(?\d+\)?", plan)


def test_index_of_nothing(spark):
    empty = spark.createDataFrame([], "id string, type string, name string")
    assert search.search(search.build_index(empty), "anything").count() == 0
    assert search.search(search.build_index(spark.createDataFrame([("ab", "b")], "id string, type string")), "ab").count() == 1


def test_containment_equals_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    texts = [text(rng.choice([1, 3, 8, 30, 255, 256, 257, 258, 700])) for _ in range(60)] + ["", None, "ab" * 400]
    patterns = [text(rng.choice([1, 2, 3, 4, 7, 8, 9])) for _ in range(60)] + ["", None, "ab" * 70, "q"]
    patterns += [t[i : i + n] for t in texts[:40] if t for i, n in [(rng.randrange(len(t)), rng.choice([5, 16, 63, 64, 65, 200]))]]
    frame = lambda rows, name: spark.createDataFrame([(r, 1) for r in rows + rows[:3]], f"{name} string, size int")
    found = {tuple(r) for r in resolve.containment_pairs(frame(patterns, "pattern"), frame(texts, "text")).collect()}
    assert found == {(p, t) for p in patterns if p for t in texts if t and p in t}
    assert resolve.containment_pairs(frame([], "pattern"), frame(texts, "text")).count() == 0
    assert resolve.containment_pairs(frame(patterns, "pattern"), frame([], "text")).count() == 0


def test_few_candidates_fail_the_check(spark):
    names = spark.createDataFrame([(f"condition {i} of the heart",) for i in range(400)], "pattern string")
    titles = spark.createDataFrame([(f"a study of condition {i} of the heart and more",) for i in range(0, 400, 2)], "text string")
    hits = resolve.containment_pairs(names, titles).count()
    assert hits >= 200 and resolve.containment_candidates(names, titles).count() <= 2 * hits


def test_a_word_is_looked_up_by_its_rarest_part(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"n{i}", "Gene", f"00000{i:03d}") for i in range(50)], "id string, type string, name string")
    index, asked = search.build_index(nodes), []
    matching = search.SearchIndex.matching
    monkeypatch.setattr(search.SearchIndex, "matching", lambda self, name, keys, key: asked.append((name, keys)) or matching(self, name, keys, key))
    words = spark.createDataFrame([("00000017",), ("000",), ("zz",)], "word string")
    found = search.matching_terms(index, words).where("contains(term, word)").collect()
    assert sorted((r.word, r.term) for r in found) == sorted([("00000017", "00000017")] + [("000", f"00000{i:03d}") for i in range(50)])
    by_word = [keys for name, keys in asked if name == "parts" and "word" in keys.columns]
    assert [sorted((r.word, r.part) for r in keys.collect()) for keys in by_word] == [[("000", "000"), ("00000017", "017")]]
