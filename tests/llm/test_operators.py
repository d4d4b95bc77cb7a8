"""The pipeline operators against brute force, planted cases and edge cases on small tables."""

import base64
import hashlib
import heapq
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrobora.llm import chat, decontaminate, licences, mixing, near_dedup, pii, quality, shingles, toxicity, url_rules, warc
from corrobora.llm.tables import connected_components, placed_by, sums_before

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, count long, fp string, size int"


def make_docs(spark, rows):
    """Rows of (doc_id, text, lang, source) with extra columns whose names the operators use themselves."""
    full = [(i, t, lang, s, len(t or ""), 9.9, 7, "x", 3) for i, t, lang, s in rows]
    return spark.createDataFrame(full, DOCS)


@pytest.fixture(scope="module")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def edge(spark):
    """Null, empty and blank texts, a null id, repeated rows, a very long text, one very long word."""
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    return make_docs(spark, [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n ", None, "b"), (4, "one two", "en", "a"), (4, "one two", "en", "a"),
        (None, "one two three", "de", "b"), (5, long, "en", "a"), (6, "z" * 200_000, "en", "a"), (7, long, "en", "b"),
    ])


@pytest.fixture(scope="module")
def empty(spark):
    return make_docs(spark, [])


# -- helpers -------------------------------------------------------------------------------------------------------


def test_connected_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {x: x for e in edges for x in e}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        one, two = sorted((find(a), find(b)))
        parent[two] = one
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_sums_before_splits_hot_keys(spark):
    rows = [("hot" if i % 3 else None, i, i % 7) for i in range(500)]
    placed = placed_by(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"])
    got = {(r.k, r.i): r.before for r in sums_before(placed, ["k"], ["i"], "v", "before").collect()}
    want, run = {}, Counter()
    for k, i, v in rows:
        want[(k, i)] = run[k]
        run[k] += v
    assert got == want


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    text = ("Ab cd\teé " * 50 + "x" * 500 + " tail ").encode()
    whole = shingles.word_hashes(text)
    assert len(whole) == len(text.lower().split())
    assert len(set(whole.tolist())) == len(set(text.lower().split()))
    monkeypatch.setattr(shingles, "_BLOCK", 7)
    assert (shingles.word_hashes(text) == whole).all()


def test_one_permutation_estimates_similarity():
    rng, oph = np.random.default_rng(1), shingles.OnePermutation(64, 8)
    for n in (6, 40, 900):
        pool = rng.integers(0, 2**63, int(n * 1.25), dtype=np.uint64)
        same = np.mean([
            (oph.minima(np.unique(shingles.mix(pool[: len(pool) * 9 // 10] + np.uint64(s)))) ==
             oph.minima(np.unique(shingles.mix(pool[len(pool) // 10 :] + np.uint64(s))))).mean() for s in range(60)
        ])
        union, both = len(pool), len(pool) * 9 // 10 - len(pool) // 10
        assert abs(same - both / union) < 0.06


# -- 4: near duplicates --------------------------------------------------------------------------------------------


def brute_components(rows, words, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    groups = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        groups[find(i)].append(doc_id)
    name = {g: min((x for x in v if x is not None), default=None) for g, v in groups.items()}
    return Counter((doc_id, len(sets[i]), name[find(i)]) for i, (doc_id, _) in enumerate(rows))


def test_near_duplicates_equal_brute_force(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    for k in range(60):  # a group whose members differ by zero to twenty words: links, chains and near misses
        w = list(base)
        for _ in range(int(rng.integers(0, 20))):
            w[int(rng.integers(0, 150))] = f"v{rng.integers(0, 10**9)}"
        rows.append((10_000 - k, " ".join(w)))
    found = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4, block=2_000).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_near_duplicates_edge_cases(edge, empty):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    found = near_dedup.near_duplicates(edge, words=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 4)
    kept = near_dedup.drop_near_duplicates(edge)
    assert kept.columns == edge.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert near_dedup.near_duplicates(empty).count() == near_dedup.drop_near_duplicates(empty).count() == 0


def test_rows_without_an_id_are_linked(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (None, " ".join(words[:-1] + ["other"])), (None, "quite another text here"), (None, " ".join(words))]
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in rows])
    found = near_dedup.near_duplicates(docs, words=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(rows, 4)
    assert sorted(r.kept for r in found) == [False, False, True, True]
    kept = near_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "quite another text here"), (1, " ".join(words))]


# -- 2: decontamination --------------------------------------------------------------------------------------------


def test_decontamination_finds_copies_and_reparameterised_items(spark):
    item = "A train leaves at 9 with Anna and covers 120 km while Anna reads 9 pages before the next long stop at 9"
    filler = "nothing of note was said about that on any of the other days "
    planted = [
        (1, filler + item + " " + filler),
        (2, filler * 3),
        (3, filler + item.replace("120", "77").replace("9", "14").replace("Anna", "Bruno") + " end."),
        (4, filler + item.replace("9 pages", "31 pages") + " end."),  # 9 stands for two values: not the same question
        (5, filler + " ".join(item.split()[:6]) + " and so on"),
        (None, item), (7, None), (8, ""), (1, filler + item + " " + filler),
    ]
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in planted])
    bench = spark.createDataFrame([(5, item), (6, None), (7, ""), (8, "short one")], "item_id long, text string")
    found = decontaminate.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 5), (3, 5), (None, 5)}
    left = decontaminate.drop_contaminated(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [2, 4, 5, 7, 8]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def test_decontamination_equals_search_for_verbatim_items(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t in r.text}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == want


def test_short_and_numeric_items_are_found_word_for_word(spark):
    figures = " ".join(str(n) for n in range(4, 18))
    items = {
        1: "Is 7 > 3 ?", 2: f"Sum {figures}", 3: "Der Hund und die Katze 12 km", 4: "What is 2 + 2 ?", 5: "Anna Bob Carl Dora Emil Fritz Gerd Hans Ida",
        6: "one two three four five six seven eight nine ten " + " ".join(f"word{i}x" for i in range(60)),
    }
    filler = "nothing of note was said about that"
    texts = {10 * i: f"{filler} {t} {filler}" for i, t in items.items()}
    texts |= {
        11: f"{filler} Is 8 > 4 ? {filler}", 21: f"{filler} sum {' '.join(str(n) for n in range(40, 54))}", 41: f"{filler} what is 3 + 9 ?",
        51: f"{filler} Xaver Yvonne Zoe Uwe Tim Sven Rolf Quirin Paul {filler}",
        61: f"{filler} {' '.join(items[6].split()[20:33])} {filler}", 62: f"{filler} {' '.join(items[6].split()[20:32])} {filler}", 99: filler * 5,
    }
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in texts.items()])
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert found == {(10 * i, i) for i in items} | {(61, 6)}  # thirteen words of the long item, but not twelve


# -- 10: mixing ----------------------------------------------------------------------------------------------------


def test_mix_plan(spark, docs, edge, empty):
    plan = mixing.mix_plan(docs).collect()
    sizes = {r.doc_id: len((r.text or "").encode().split()) for r in docs.collect()}
    assert {r.doc_id: r.size for r in plan} == sizes
    sources = sorted({r.source for r in plan})
    total = {s: sum(r.size for r in plan if r.source == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, open_sources, left = {}, set(sources), 1.5 * sum(total.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_sources) for s in open_sources}
        over = {s for s in open_sources if share[s] > 2 * total[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * total[s] for s in over}
        open_sources -= over
        left -= sum(target[s] for s in over)
    for s in sources:
        rows = [r for r in plan if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 and r.source_size == total[s] for r in rows)
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r.size for r in rows)
    assert all(r.taken in (0, r.size, 2 * r.size) for r in plan)
    assert all(sorted(r.positions) == list(r.positions) and all(0 <= p <= 1_000_000 for p in r.positions) for r in plan)
    assert sorted(plan) == sorted(mixing.mix_plan(docs.repartition(3)).collect())
    assert mixing.mix_plan(edge).count() == edge.count()
    assert mixing.mix_plan(empty).count() == 0
    order = mixing.training_sequence(docs, mixing.mix_plan(docs)).collect()
    assert [r.position for r in order] == sorted(p for r in plan for p in r.positions)


@pytest.mark.parametrize("knots", [((0.0, 1.5), (1.0, 0.5)), ((0.0, 0.0), (0.3, 2.0), (0.6, 0.0), (0.8, 0.0), (1.0, 5.0))])
def test_training_time_inverts_the_demand(spark, knots):
    def demand(t):
        grid = np.linspace(0, t, 20_001)
        return np.trapezoid(np.interp(grid, [k[0] for k in knots], [k[1] for k in knots]), grid)

    shares = [0.001, 0.1, 0.33, 0.5, 0.77, 0.999, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "s double").select("s", mixing.training_time(F.col("s"), knots).alias("t"))
    for r in df.collect():
        assert abs(demand(r.t) / demand(1.0) - r.s) < 1e-4
    with pytest.raises(ValueError):
        mixing.demand_pieces(((0.0, 1.0),))


# -- 7: toxicity ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_world(spark):
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(900):
        w = [f"w{x}" for x in rng.integers(0, 400, 40)]
        toxic = i % 5 == 0
        if toxic:
            w[int(rng.integers(0, 40))] = ("grumblo", "snarfish")[i % 2]
        elif i % 25 == 1:
            w[20:22] = ["lovely", "grumblo"]
        rows.append((i, " ".join(w), "en", "a"))
        labels.append((i, int(toxic)))
    docs = make_docs(spark, rows)
    labels = spark.createDataFrame(labels, "doc_id long, toxic int")
    return docs, labels, toxicity.learn_lexicon(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))


def test_lexicon_held_out_accuracy_and_exceptions(toxic_world):
    docs, labels, lexicon = toxic_world
    assert any("grumbio" in p for p in lexicon.exceptions)
    rows = toxicity.score_texts(docs, lexicon).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 100
    assert np.mean([(r.score >= 0.5) == bool(r.toxic) for r in rows]) > 0.97


def plain_score(lexicon, text):
    """Every entry looked for with plain substring search, occurrences inside an exception phrase left out."""
    folded = f" {' '.join(toxicity.fold(text or '').split())} "
    places = lambda needle: [i for i in range(len(folded)) if folded.startswith(needle, i)]
    spared = [(i, i + len(p) + 2) for p in lexicon.exceptions for i in places(f" {p} ")]
    total = 0.0
    for entry, weight in lexicon.weights.items():
        for i in places(" " + entry):
            if not any(s <= i and i + 1 + len(entry) <= e for s, e in spared):
                total += weight
    a, b, c = lexicon.curve
    x = a + b * np.log1p(100.0 * total / (20.0 + folded.strip().count(" "))) + c * np.log1p(total)
    return 1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, x))))


def test_scores_equal_plain_search(spark, docs, toxic_world):
    _, _, lexicon = toxic_world
    rng = np.random.default_rng(8)
    parts = ["grumblo", "GRUMBLO", "grumblos", "gr8mblo", "snarfish", "sn4rf1sh", "lovely grumblo", "lovely", "lovely grumblo grumblo", "x", "", "w1", "а"]
    texts = [" ".join(rng.choice(parts, int(rng.integers(0, 30)))) for _ in range(400)] + [r.text for r in docs.limit(60).collect()] + [None, ""]
    scored = toxicity.score_texts(make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), lexicon).collect()
    assert len(scored) == len(texts) and any(r.score > 0.5 for r in scored)
    for r in scored:
        assert abs(r.score - plain_score(lexicon, texts[r.doc_id])) < 1e-9


def test_folding_and_edges(spark, toxic_world, edge, empty):
    _, labels, lexicon = toxic_world
    machine = lexicon.matcher()
    for text in ("you gr­mblo no", "sn4rf1sh", "SNАRFISH", "ｓnarfish!", "a snarfіsh."):
        expected = text != "you gr­mblo no"
        assert (toxicity.score(lexicon, machine, text) >= 0.5) == expected
    scored = toxicity.score_texts(edge, lexicon).collect()
    assert len(scored) == edge.count() and all(0 <= r.score < 0.5 for r in scored)
    kept = toxicity.drop_toxic(edge, lexicon)
    assert kept.columns == edge.columns and kept.count() == edge.count()
    assert toxicity.score_texts(empty, lexicon).count() == 0
    blank = toxicity.learn_lexicon(edge, labels.limit(0))
    assert not blank.weights and toxicity.score(blank, blank.matcher(), "snarfish") < 0.5


# -- 6: personal data ----------------------------------------------------------------------------------------------

PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_spans(text):
    def luhn(d):
        v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return sum(x - 9 if x > 9 else x for x in v) % 10 == 0

    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = (
                True, kind == 1 and all(int(p) <= 255 for p in m.group().split(".")), 14 <= len(digits) <= 19 and luhn(digits), 10 <= len(digits) <= 15,
            )[kind]
            if fine:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def test_base_spans_equal_the_patterns(docs):
    rng = np.random.default_rng(2)
    texts = [r.text or "" for r in docs.collect()]
    alphabet = list("a.@-+() 0123456789") + ["4111111111111111", "a.b@c.de", "1.2.3.4", "+1 (222) 333-4444", "é\U0001f600"]
    texts += ["".join(rng.choice(alphabet, 60)) for _ in range(4000)]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text)


def test_spans_of_one_start_go_by_kind(spark):
    rows = [(1, "10.0.0.1@host.com"), (2, "4111111111111111@x.org"), (3, "+15550101234@a.b c")]
    found = {r.doc_id: r for r in pii.personal_data(make_docs(spark, [(i, t, "en", "a") for i, t in rows]), None).collect()}
    wanted = {1: "email:0:17,ip:0:8", 2: "email:0:22,card:0:16", 3: "email:0:16,phone:0:12"}
    assert {i: r.spans for i, r in found.items()} == wanted
    assert all(r.base_sha256 == hashlib.sha256(wanted[i].encode()).hexdigest() for i, r in found.items())


def test_field_pulls_repeats_along_and_leaves_clean_text_alone(spark, edge, empty):
    rows = [(i, f"call +1 (555) 010-{1000 + i} now, or write u{i}@mail.example.com from 10.0.{i % 250}.7 page {i}", "en", "a") for i in range(300)]
    rows += [(1000 + i, f"chapter {i} of 99 has {i * 7} lines", "en", "a") for i in range(100)]
    model = pii.train_skip_chain(make_docs(spark, rows))
    text = "reach 15550101234 today. again: +15550101234 or 1555 010 1234, " + "and so on and on " * 900 + "then (15550101234) at last"
    base, every = pii.find_spans(text, model)
    assert {text[s:e] for s, e, _ in base} == {"+15550101234"}
    assert [text[s:e] for s, e, _ in every] == ["15550101234", "+15550101234", "1555 010 1234", "15550101234"]
    assert pii.find_spans("order 15550101234 and 15550101299", model) == ([], [])
    assert pii.find_spans("chapter 12 of 99 has 84 lines", model) == ([], [])
    nodes = pii._node_tokens(text, base)
    far, alone = pii.marginals(model, text, nodes), pii.marginals(model, text[:17], pii._node_tokens(text[:17], []))
    many = ", ".join(["+15550101234", *["15550101234"] * 4_000])
    assert len(pii.find_spans(many, model)[1]) == 4_001  # messages stand still however many like tokens there are
    assert far[0][3] >= alone[0][3] - 1e-9  # like tokens elsewhere never make the label of a repeat less likely here
    found = pii.personal_data(edge, model).collect()
    assert len(found) == edge.count() and all(r.spans == "" for r in found)
    assert {r.base_sha256 for r in found} == {hashlib.sha256(b"").hexdigest()}
    clean = pii.redact_documents(make_docs(spark, [(1, "mail a.b@c.de now", "en", "a"), (2, None, "en", "a")]), model).collect()
    assert [(r.text, r.n_chars, r.score) for r in clean] == [("mail [EMAIL] now", 16, 9.9), (None, 0, 9.9)]
    assert pii.personal_data(empty, model).count() == 0
    assert pii.train_skip_chain(empty).skip_same == 0.0


def exact_marginals(model, text, nodes):
    """Sums over all labellings of a small graph."""
    bits = np.array([pii._bits(text[s:e], text[max(0, s - 1) : s]) for s, e, _ in nodes]) @ model.node
    a, b, kind = pii._edges(text, nodes)
    same = np.eye(pii.OTHER + 1)
    tables = [model.chain, same * model.skip_same, same * model.skip_like]
    total = np.zeros_like(bits)
    for labels in itertools.product(range(pii.OTHER + 1), repeat=len(nodes)):
        if any(k not in (pii.OTHER, y) for (_, _, k), y in zip(nodes, labels, strict=True)):
            continue
        energy = sum(bits[i, y] for i, y in enumerate(labels)) + sum(tables[k][labels[i], labels[j]] for i, j, k in zip(a, b, kind, strict=True))
        for i, y in enumerate(labels):
            total[i, y] += np.exp(energy)
    return total / total.sum(axis=1, keepdims=True)


def test_messages_come_close_to_exact_inference():
    rng = np.random.default_rng(21)
    for text in ("1234567 x 7654321", "call +15550101234 or 15550101234", "12345678, 12345678 a", "u@v w 5550101234 5550101234 5550101234 9"):
        model = pii.SkipChain(rng.normal(0, 0.4, (pii.N_BITS, 5)), rng.normal(0, 0.3, (5, 5)), 0.8, 0.4)
        nodes = pii._node_tokens(text, pii.base_spans(text))
        assert 1 < len(nodes) <= 6
        assert np.abs(pii.marginals(model, text, nodes) - exact_marginals(model, text, nodes)).max() < 0.06


# -- 5: licences ---------------------------------------------------------------------------------------------------


def plain_licences(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w, at, labels = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low), [], set()
    for phrase, label in licences.PHRASES.items():
        p = phrase.split()
        places = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        at += places
        labels |= {label} if places else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_licence_scan(spark, docs, edge, empty):
    lines = [
        "Released under the MIT License. Also under the MIT license!", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "License of the public, general and free",
        "cc by nc cc by nc", "(c) 2020: Redistribution and use in source and binary forms, with or without modification, are permitted",
    ]
    given = docs.select("doc_id", "text").union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(lines)], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in given.collect()}
    found = {r.doc_id: r for r in licences.scan_licences(given).collect()}
    assert len(found) == len(texts)
    for i, r in found.items():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(texts[i])
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert [found[9000 + i].labels for i in range(8)] == ["mit", "apache-2", "cc-by-nc", "gpl-3", "all-rights-reserved", "", "cc-by-nc", "bsd"]
    rows = licences.scan_licences(edge).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.labels) for r in rows) == Counter(
        (r.doc_id, plain_licences(r.text)[0], 0, "") for r in edge.collect()
    )
    assert licences.scan_licences(empty).count() == 0


def test_a_file_keeps_the_labels_of_all_its_licences(spark):
    texts = [". ".join(text for _, text, _ in licences.TEMPLATES), licences.TEMPLATES[1][1] + ". " + licences.TEMPLATES[14][1], "nothing here"]
    given = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: set(filter(None, r.labels.split(","))) for r in licences.scan_licences(given).collect()}
    assert found == {0: {label for label, _, _ in licences.TEMPLATES}, 1: {"mit", "bsd"}, 2: set()}


# -- 9: quality ----------------------------------------------------------------------------------------------------


def plain_statistics(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        covered |= {i, i + 1, i + 2} if often[x] > 1 else set()
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_plain_ones(docs, edge, empty):
    for df in (docs, edge):
        want = Counter((r.doc_id, *plain_statistics(r.text)) for r in df.collect())
        rows = quality.quality(df).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in rows)
        assert not any(r.kept for r in rows if r.base_failed)
    assert quality.quality(empty).count() == 0


def test_distances_follow_the_minimum_covariance_determinant(spark):
    rng = np.random.default_rng(7)
    mix = rng.normal(size=(5, 5)) * 300 + np.eye(5) * 900
    x = np.round(rng.normal(size=(1200, 5)) @ mix + 4000)
    x[:150] = np.round(rng.normal(size=(150, 5)) * 200 + [20000, -9000, 12000, 0, 9000])
    x *= 6  # no floor binds
    rows = [(i, "en", "a" if i % 2 else "b", *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = {r.doc_id: r.distance for r in quality.robust_distances(df).collect()}
    assert min(got[i] for i in range(150)) > 10 * np.median(list(got.values()))
    assert np.median([got[i] for i in range(150, 1200)]) < 2
    for part in (0, 1):  # brute force: concentration steps in numpy from the same start
        ids = [i for i in range(1200) if i % 2 == part]
        y = x[ids]
        centre = np.median(y, axis=0)
        spread = 1.4826 * np.median(np.abs(y - centre), axis=0)
        d = (((y - centre) / spread) ** 2).sum(axis=1)
        for _ in range(4):
            near = y[np.argsort(d)[: int(0.75 * len(y))]]
            off = y - near.mean(axis=0)
            d = (off @ np.linalg.inv(np.cov(near.T, bias=True)) * off).sum(axis=1)
        ours = np.array([got[i] for i in ids])
        clean = np.array(ids) >= 150
        assert np.corrcoef(np.log(d[clean]), np.log(ours[clean]))[0, 1] > 0.98


def test_every_feature_rejects_on_its_own(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{x:04d}" for x in rng.permutation(10_000)[: int(n)]), "en", "a") for i, n in enumerate(rng.integers(80, 400, 400))]
    fresh = lambda size, n=200: [f"{x:0{size}d}" for x in rng.permutation(10_000)[:n]]
    planted = {
        1000: " ".join(fresh(5) + ["lorem ipsum dolor sit amet"] * 14),  # 70 of 270 words repeated
        1001: " ".join(fresh(15)),
        1002: "\n".join(w for i, x in enumerate(fresh(5)) for w in ([x, "same"] if i % 4 == 0 else [x])),
        1003: " ".join(fresh(5)) + " #" * 30,
        1004: " ".join(f"w{x:06d}" for x in range(60_000)),
    }
    found = {r.doc_id: r for r in quality.quality(make_docs(spark, rows + [(i, t, "en", "a") for i, t in planted.items()])).collect()}
    assert not any(found[i].base_failed or found[i].kept for i in planted), [(i, found[i]) for i in planted]
    assert sum(found[i].kept for i in range(400)) >= 396


def test_group_sizes_switch_no_estimate(spark):
    x = np.random.default_rng(13).normal(size=(1000, 5)) * 400

    def distance(n):
        rows = [("en", "a", *map(float, np.round(r + 8000))) for r in x[:n]] + [("en", "b", *map(float, np.round(r + 4000))) for r in x[200:]]
        df = spark.createDataFrame(rows, "lang string, source string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
        return np.median([r.distance for r in quality.robust_distances(df).where("source = 'a'").collect()])

    assert distance(199) < 1.2 * distance(200)


# -- 1: URL rules --------------------------------------------------------------------------------------------------


def test_url_rules(spark):
    fixed = ["http://a.example.org/es/1?x=1", "https://ORG/", "http://x.org", None, "no url", "://org/es", "http://forg/x", "http://a.com/fr/2#t", "http://a.com/de/2", "http://b.example.org/en/17?u=http://q"]
    made = [f"https://{h}.example.{t}/{lang}/{i}{q}" for i, (h, t, lang, q) in enumerate(itertools.product(["a", "blog.b", "m.c"] * 8, ["net", "com", "org"], ["en", "fr", "de", "es"], ["", "?utm=1"]))]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(fixed + made + fixed[:2])], "page_id long, url string, host string, rule int")
    found = {r.page_id: r for r in url_rules.judge_urls(pages).collect()}
    assert len(found) == pages.count()
    want = [("a.example.org", "/es/1", "example.org/es/", "block"), ("org", "/", "org/", "allow"), ("x.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
            ("org", "/es", "org/", "allow"), ("forg", "/x", None, "allow"), ("a.com", "/fr/2", "com/fr/", "allow"), ("a.com", "/de/2", "com/de/", "block"), ("b.example.org", "/en/17", "example.org/en/1", "block")]
    for i, w in enumerate(want):
        assert (found[i].host, found[i].path, found[i].rule) == w[:3]
        assert found[i].verdict == w[3] or (w[2] is None and w[0])  # without a rule the mined ones may decide
    assert {r.by for r in found.values()} == {"rule", "mined", "default"}
    assert url_rules.judge_urls(pages.limit(0)).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(400):
        t = sorted({f"t{x}" for x in rng.integers(0, 7, 3)})
        rows.append((t, "block" if "t1" in t and "t2" in t else "allow" if "t3" in t else str(rng.choice(["allow", "block"]))))
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r.antecedent), r.verdict): round(r.confidence, 9) for r in url_rules.mine_rules(labelled, 0.02, 0.8).collect()}
    every = {}
    for k in range(1, 5):
        for combo in itertools.combinations([f"t{i}" for i in range(7)], k):
            holds = [v for t, v in rows if set(combo) <= set(t)]
            for v in ("allow", "block"):
                n = holds.count(v)
                if n >= 0.02 * len(rows) and n / max(1, len(holds)) >= 0.8:
                    every[(combo, v)] = n / len(holds)
    want = {k: round(c, 9) for k, c in every.items() if not any(set(a) < set(k[0]) and v == k[1] and d >= c for (a, v), d in every.items())}
    assert got == want
    urls = spark.createDataFrame([(str(i), t) for i, (t, _) in enumerate(rows)], "url string, tokens array<string>")
    matched = {r.url: r.mined for r in url_rules.match_rules(urls, url_rules.mine_rules(labelled, 0.02, 0.8)).collect()}
    for i, (t, _) in enumerate(rows):
        fits = [(c, len(a), v) for (a, v), c in want.items() if set(a) <= set(t)]
        assert (str(i) in matched) == bool(fits)
        if fits:
            assert matched[str(i)] in {v for c, _, v in fits if c == max(fits)[0]}


# -- 8: WARC -------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    extra = [(90_001, None, None), (90_002, "http://x/\r\nWARC-Type: evil", ""), (90_003, "http://y/é", "same"), (90_004, "http://z", "same"), (90_004, "http://z", "same"), (None, "http://n", "same"), (90_005, "u", "L" * 3_000_000)]
    pages = pages.union(spark.createDataFrame(extra, pages.schema))
    rows = pages.collect()
    owners = defaultdict(list)
    for r in rows:
        owners[r.html or ""].append(r.page_id)
    want = Counter()
    for r in rows:
        raw, own = (r.html or "").encode(), max(x for x in owners[r.html or ""] if x is not None)
        same = len(owners[r.html or ""]) == 1 or own == r.page_id
        want[(r.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if same else "revisit", None if same else own)] += 1
    assert Counter(tuple(r) for r in warc.archive_round_trip(pages).collect()) == want
    archives = warc.write_archives(pages, archive_bytes=50_000).collect()
    assert len(archives) > 3
    payloads = {}
    for a in archives:
        for rec in warc.read_archive(bytes(a.content)):
            assert rec["error"] is None
            if rec["record_type"] == "response":
                payloads[rec["page_id"]] = rec["payload"]
    assert all(payloads[r.page_id] == (r.html or "").encode() for r in rows if r.page_id in payloads)
    limited = warc.archive_round_trip(pages, least_bytes=1).where("payload_bytes = 0").collect()
    assert {r.record_type for r in limited} == {"response"}
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_broken_archives_are_told(spark):
    pages = spark.createDataFrame([(i, "u", "text " * 50 + str(i)) for i in range(20)], "page_id long, url string, html string")
    content = bytes(warc.write_archives(pages.coalesce(1)).first().content)
    assert [r["error"] for r in warc.read_archive(content)] == [None] * 20
    assert list(warc.read_archive(content[:-5]))[-1]["error"] == "the last frame is cut off"
    assert list(warc.read_archive(content[:6]))[-1]["error"] is not None
    record = warc.record_bytes(1, "u", b"abc", None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(record)["payload"] == b"abc"
    for wrong in (record.replace(b"abc", b"abd"), record.replace(b"abc", b"ab"), record[9:], record.replace(b"WARC-Date", b"WARC-Dote")):
        with pytest.raises(ValueError):
            warc.parse_record(wrong)


# -- 3: chat -------------------------------------------------------------------------------------------------------


def shortest(roles, costs):
    """Dijkstra over (turns used, state) with every single repair as a step."""
    seen, queue = {(0, 0): 0.0}, [(0.0, 0, 0)]
    while queue:
        d, i, q = heapq.heappop(queue)
        if i == len(roles) and q == 3:
            return d
        steps = []
        for t in (1, 2, 3):
            price = 0 if i < len(roles) and chat.ROLES[t - 1] == roles[i] else costs.relabel
            if (q, t) in chat.LEGAL:
                steps += [(d + costs.insert, i, t)] + ([(d + price, i + 1, t)] if i < len(roles) else [])
            if q == t and i < len(roles):
                steps.append((d + price + costs.merge, i + 1, t))
        for s in steps:
            if s[0] < seen.get(s[1:], 1e9) - 1e-12:
                seen[s[1:]] = s[0]
                heapq.heappush(queue, s)


@pytest.mark.parametrize("costs", [chat.Costs(), chat.Costs(relabel=0.3, merge=1.1, insert=0.5)])
def test_repair_cost_is_minimal(costs):
    for n in range(1, 5):
        for roles in itertools.product(["system", "user", "assistant", "tool"], repeat=n):
            cost, _, _, _ = chat.cheapest(list(roles), 0, costs)
            last = chat.best_exit(cost, costs)
            assert abs(cost[last] + costs.insert * len(chat._closing(last)) - shortest(roles, costs)) < 1e-9


def test_repair_of_conversations(spark):
    rng, costs = np.random.default_rng(9), chat.Costs()
    names = ["system", "user", "assistant", "Human ", "GPT", "tool", None]
    rows = [(int(c), t, names[int(rng.integers(0, 7))], f"t{t}", "x") for c in range(40) for t in range(int(rng.integers(1, 9)))]
    rows += [(99, t, names[int(rng.integers(0, 7))], f"t{t}", "x") for t in range(600)] + [(None, None, "user", None, "x"), (99, 5, "user", "t5", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, entry string").repartition(5)
    found = defaultdict(list)
    for r in chat.repair_roles(df).collect():
        found[r.conv_id].append(r)
    given = defaultdict(list)
    for r in df.collect():
        given[r.conv_id].append(r)
    assert found.keys() == given.keys()
    for conv, pieces in found.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.out_turn for r in pieces] == sorted(r.out_turn for r in pieces)
        assert sum(r.turn is not None or r.action != "insert" for r in pieces) == len(given[conv])
        states = [chat.ROLES.index(k[1]) + 1 for k in dict.fromkeys((r.out_turn, r.role) for r in pieces)]
        assert states[-1] == 3 and all(x in chat.LEGAL for x in zip([0, *states], states, strict=False))
        spent = sum(costs.relabel * ("relabel" in r.action) + costs.merge * ("merge" in r.action) + costs.insert * (r.action == "insert") for r in pieces)
        if conv != 99:  # equal turns are ordered by content there
            roles = [chat.normal_role(r.role) for r in sorted(given[conv], key=lambda r: r.turn or 0)]
            assert abs(spent - shortest(roles, costs)) < 1e-9
        text = "".join(r.rendered for r in pieces)
        assert len(re.findall(r"<\|(?:system|user|assistant)\|>\n", text)) == text.count("<|end|>\n") == len(states)
    assert chat.repair_roles(df.limit(0)).count() == 0
