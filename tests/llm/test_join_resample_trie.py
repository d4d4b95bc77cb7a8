"""The n-gram join, the resampling draw and the conversation trie against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from corrobora.llm import conv_trie, ngram_join, ngram_table, resampling

DOCS = "doc_id long, text string, token string, id long, n long, weight double, score string, rank int, source string"
TURNS = "conv_id long, turn long, role string, text string, depth int, n string, k1 double, digest string"
BLANK_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LETTER_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5, 6, 0.5, "s", 1, "a") for i, t in rows], DOCS)


# -- join ----------------------------------------------------------------------------------------------------------


def brute_join(rows, words=3, percent=90):
    sets = []
    for _, text in rows:
        found = BLANK_WORDS.findall(low(text))
        k = min(words, len(found))
        sets.append({tuple(found[i : i + k]) for i in range(len(found) - k + 1)} if found else set())
    linked = [[b for b in range(len(rows)) if b != a and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        reach, todo = {a}, [a]
        while todo:
            for b in linked[todo.pop()]:
                if b not in reach:
                    reach.add(b), todo.append(b)
        ids = [rows[b][0] for b in reach if rows[b][0] is not None]
        out.append((rows[a][0], len(sets[a]), min(ids) if ids else None, len(linked[a])))
    return Counter(out)


def near_copies(seed, n, groups=6):
    """Texts around a few originals, with none to many words changed, and passages that many of them share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    common = [word() for _ in range(60)]
    originals = [[word() for _ in range(rng.randrange(20, 220))] for _ in range(groups)]
    rows = []
    for i in range(n):
        text = list(rng.choice(originals))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            text[rng.randrange(len(text))] = word()
        rows.append((i, " ".join(text + common * (rng.random() < 0.3))))
    return rows


@pytest.mark.parametrize("options", [{}, {"light": 2, "most": 7, "wide": 900}, {"light": 10_000}])
def test_join_equals_brute_force(spark, options):
    rows = near_copies(1, 160)
    got = ngram_join.similar_documents(make_docs(spark, rows), **options)
    assert Counter(tuple(r) for r in got.collect()) == brute_join(rows)


def test_join_edge_cases(spark):
    long = " ".join(f"w{i % 977}x{i % 13}" for i in range(60_000))
    sixty = [f"a{i}" for i in range(200)]
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (4, "One two"), (None, "one two"), (None, "only here now"), (None, "only here now"),
        (5, long), (6, long + " end"), (7, "z" * 100_000), (8, " ".join(sixty)), (None, " ".join(sixty[:-1] + ["b"])), (9, "one two three"),
    ]
    got = ngram_join.similar_documents(make_docs(spark, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "n_links"]
    assert Counter(tuple(r) for r in got.collect()) == brute_join(rows)
    assert ngram_join.similar_documents(make_docs(spark, [])).collect() == []


def test_adaptive_prefix_asks_for_more_where_shingles_are_frequent():
    hashes = np.sort(np.random.default_rng(3).integers(0, 2**63, 400, dtype=np.uint64))
    rare, frequent = (np.full(1024, level, dtype=np.uint8) for level in (8, 120))
    (one, short), (many, lengthened) = (ngram_join.adaptive_prefix(hashes, levels, 90) for levels in (rare, frequent))
    assert one == 1 and len(short) == 41
    assert many > 1 and len(lengthened) == 40 + many


@pytest.mark.parametrize("seed", range(5))
def test_any_needs_keep_the_guarantee(seed):
    """Two sets at the similarity share at least the smaller need in their prefixes, whatever each of them chose."""
    rng = np.random.default_rng(seed)
    for _ in range(60):
        size = int(rng.integers(1, 120))
        one = np.unique(rng.integers(0, 2**62, size, dtype=np.uint64))
        cut = int(rng.integers(0, 1 + len(one) // 9))
        two = np.unique(np.concatenate((one[cut:], rng.integers(0, 2**62, int(rng.integers(0, 1 + len(one) // 12)), dtype=np.uint64))))
        both = len(np.intersect1d(one, two))
        if 100 * both < 90 * (len(one) + len(two) - both):
            continue
        levels = rng.integers(0, 200, 512).astype(np.uint8)
        (m, p), (k, q) = (ngram_join.adaptive_prefix(s, levels, 90, row_cost=float(rng.random() * 50)) for s in (one, two))
        assert len(np.intersect1d(p, q)) >= min(m, k)


# -- resampling ----------------------------------------------------------------------------------------------------


def brute_resampling(rows, target, buckets=10_000):
    def grams(text):
        w = LETTER_WORDS.findall(low(text))
        return w, w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t)[1])
    t = Counter(bucket(g) for x in target for g in grams(x)[1])
    sn, tn = float(s.total() + buckets), float(t.total() + buckets)
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * sn / ((s[b] + 1.0) * tn))) for b in s}
    out = []
    for doc_id, text in rows:
        w, g = grams(text)
        weight = sum(gain[bucket(x)] for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, row in enumerate(able[: 25 * len(able) // 100]):
        row[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


def drawn(spark, rows, target):
    table = spark.createDataFrame([(1, x) for x in target], "item_id long, text string")
    scored = resampling.importance(make_docs(spark, rows), table)
    return Counter(tuple(r) for r in resampling.draw(scored).select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_resampling_equals_brute_force(spark):
    rows = near_copies(2, 300) + [(9000 + i, t) for i, (_, t) in enumerate(near_copies(3, 40))]
    target = [t for _, t in near_copies(3, 10)] + ["w1 w2 W3", None, ""]
    assert drawn(spark, rows, target) == brute_resampling(rows, target)


def test_resampling_edge_cases(spark):
    long = " ".join(f"Word{i % 977}" for i in range(200_000))
    rows = [(1, None), (2, ""), (3, " ,;- "), (None, "no id but " * 20), (4, long), (5, "x" * 300_000), (6, "a b " * 30), (6, "a b " * 30), (7, "Ünï côde \x00 日本語 " * 12)]
    assert drawn(spark, rows, ["a b", "日本語"]) == brute_resampling(rows, ["a b", "日本語"])
    assert drawn(spark, rows, []) == brute_resampling(rows, [])
    assert drawn(spark, [], ["a"]) == Counter()


def test_resampled_documents_keep_their_columns(spark):
    docs = make_docs(spark, near_copies(4, 80))
    target = spark.createDataFrame([("w1 w2",)], "text string")
    got = resampling.resampled_documents(docs, target, percent=50)
    assert got.columns == docs.columns and got.count() == 40


@pytest.mark.parametrize("most_bytes", [1, 60, 1 << 20])
def test_table_interns_by_bytes(most_bytes):
    texts = ["Hello World, foo-bar! é hello world " + "z" * 77 + " " + "q" * 31 + " " + "r" * 32 + " " + "s" * 33, None, "", "a", "one two three four " * 90, "a\x00b 日本"]
    column, seen = pa.array([None if t is None else t.encode() for t in texts], pa.binary()), 0
    for row, grams in ngram_table.grams_of(column, 2, most_bytes):
        assert row == seen
        seen += len(grams.n_words)
        parts = [bytes(grams.data[s : s + n]) for s, n in zip(grams.start, grams.length, strict=True)]
        assert [xxhash.xxh64_intdigest(p) for p in parts] == ngram_table.xxhash64(grams.data, grams.start, grams.length).tolist()
        assert [zlib.crc32(p) for p in parts] == ngram_table.crc32(grams.data, grams.start, grams.length).tolist()
        held = ngram_table.intern(grams, 10_000)
        assert len(held.count) == len(set(parts))
        assert all(held.count[s] == parts.count(p) and held.bucket[s] == zlib.crc32(p) % 10_000 for p, s in zip(parts, held.slot, strict=True))
    assert seen == len(texts)


def test_equal_keys_of_different_bytes_get_slots_of_their_own(monkeypatch):
    monkeypatch.setattr(ngram_table, "xxhash64", lambda data, start, length: np.zeros(len(start), dtype=np.uint64))
    ((_, grams),) = ngram_table.grams_of(pa.array([b"aa bb aa cc bb aa"], pa.binary()))
    held = ngram_table.intern(grams, 10_000)
    parts = [bytes(grams.data[s : s + n]) for s, n in zip(grams.start, grams.length, strict=True)]
    assert {p: held.count[s] for p, s in zip(parts, held.slot, strict=True)} == Counter(parts)


# -- trie ----------------------------------------------------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    convs = {c: [t[3:] for t in sorted(turns)] for c, turns in convs.items()}
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return Counter(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]), leaves[node], saved[node],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(node)).encode()).hexdigest())
        for node, m in members.items()
    )


def trie(spark, rows, **options):
    turns = spark.createDataFrame([(*r, 1, "n", 0.5, "d") for r in rows], TURNS)
    return Counter(tuple(r) for r in conv_trie.prefix_trie(turns, **options).collect())


def conversations(seed, n, texts=3, longest=14):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["é", "bb", "ccc", "dddd"][:texts])) for c in range(n) for t in range(rng.randrange(1, longest))]


@pytest.mark.parametrize("single", [2, 16])
def test_trie_equals_brute_force(spark, single):
    rows = conversations(1, 120) + [(500 + c, t, "user", f"turn {t}") for c in range(6) for t in range(40 + 7 * (c % 3))]
    random.Random(2).shuffle(rows)
    assert trie(spark, rows, single=single) == brute_trie(rows)


def test_trie_edge_cases(spark):
    rows = [
        (None, 0, "user", "lost"), (0, None, "user", "first"), (0, 1, None, None), (0, 1, "user", "tie"), (0, 1, "user", "tie"), (3, 5, "user", ""),
        (7, 0, "a", "bc"), (8, 0, "ab", "c"), (11, 2, "user", "long " * 50_000), (12, 2, "user", "long " * 50_000), (1, 0, "user", "first"),
    ]
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, []) == Counter()
    assert trie(spark, [(None, 1, "user", "x")]) == Counter()


def test_digest_of_a_node_where_many_end(spark):
    rows = [(c, 0, "user", "same") for c in range(0, 25_000, 5)]
    assert trie(spark, rows) == brute_trie(rows)
