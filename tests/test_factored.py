"""Joins, layers and selections that are told in blocks, lists or ranks, against brute force."""

import itertools
import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pytest

from corrobora.operators import explore as Q
from corrobora.operators import pairs as P
from corrobora.operators import resolve as N
from corrobora.operators import similarity as S
from corrobora.session import ordinal_within, running_before
from corrobora.sources import sinks


def random_items(seed, entities=60, hot=0.4):
    """Rows of (entity, item); one item is held by a large part of all entities."""
    rng = random.Random(seed)
    rows = {(f"e{e}", f"i{rng.randrange(25) + rng.randrange(25)}") for e in range(entities) for _ in range(rng.randrange(0, 7))}
    return sorted(rows | {(f"e{e}", "hot") for e in range(entities) if rng.random() < hot})


def by_entity(rows):
    held = defaultdict(set)
    for e, i in rows:
        held[e].add(i)
    return held


@pytest.mark.parametrize(("seed", "k", "block"), [(1, 3, 1000), (2, 1, 4), (3, 100, 7)])
def test_best_partners_equal_brute_force(spark, seed, k, block):
    rows = random_items(seed)
    n = Counter(i for _, i in rows)
    items = spark.createDataFrame([(e, i, 1.0 / n[i], 9) for e, i in rows], "entity string, item string, weight double, rank int")
    held, want = by_entity(rows), set()
    for x in held:
        shares = [(-round(sum(1.0 / n[i] for i in both), 9), y, len(both)) for y in held if y != x and (both := held[x] & held[y])]
        want |= {(x, y, -o, m, r + 1) for r, (o, y, m) in enumerate(sorted(shares)[:k])}
    got = P.best_partners(items, k, width=1, block=block)
    assert {(r.entity, r.partner, r.overlap, r.n_shared, r["rank"]) for r in got.collect()} == want
    assert P.best_partners(items.limit(0), k).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_tagged_pairs_lose_no_pair(spark, seed):
    rng = random.Random(seed)
    kinds = {k: by_entity(random_items(seed * 10 + j)) for j, k in enumerate(("alpha", "beta"))}
    weights = {k: {i: rng.choice([0.2, 0.5, 1.0]) for held in kinds[k].values() for i in held} for k in kinds}
    rows = [(e, k, i, weights[k][i]) for k in kinds for e, held in kinds[k].items() for i in held]
    items = spark.createDataFrame(rows, "entity string, kind string, item string, weight double")
    got = {(r.a, r.b) for r in P.tagged_pairs(items, {"alpha": P.Bound(0.4), "beta": P.Bound(1.2, absolute=True)}, block=5).collect()}

    def total(k, chosen):
        return sum(weights[k][i] for i in chosen)

    for a, b in itertools.combinations(sorted({r[0] for r in rows}), 2):
        x, y = kinds["alpha"][a], kinds["alpha"][b]
        alike = bool(x & y) and total("alpha", x & y) >= 0.4 * total("alpha", x | y) - 1e-12
        heavy = total("beta", kinds["beta"][a] & kinds["beta"][b]) >= 1.2 - 1e-12
        assert not (alike or heavy) or (a, b) in got


def test_block_join_equals_join(spark):
    left = spark.createDataFrame([("h", f"x{i}") for i in range(20)] + [("q", "x1")], "item string, x string")
    right = spark.createDataFrame([("h", f"y{i}") for i in range(50)] + [("r", "y1")], "item string, y string")
    got = Counter((r.item, r.x, r.y) for r in P.block_join(left, right, block=7).collect())
    assert got == Counter(("h", f"x{i}", f"y{j}") for i in range(20) for j in range(50))


def test_closure_of_deep_and_cyclic_parents(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(70)] + [("n3", "m"), ("c1", "c2"), ("c2", "c1"), ("s", "s")]
    parents = spark.createDataFrame(edges + edges[:5], "child string, parent string")
    up = defaultdict(set)
    for c, p in edges:
        up[c].add(p)
    want = set()
    for t in {x for e in edges for x in e}:
        seen, todo = {t}, [t]
        while todo:
            for p in up[todo.pop()]:
                if p not in seen:
                    seen.add(p), todo.append(p)
        want |= {(t, a) for a in seen}
    got = [(r.term, r.ancestor) for r in S.ancestor_closure(parents).collect()]
    assert set(got) == want and len(got) == len(want)
    assert S.ancestor_closure(parents.limit(0)).count() == 0
    some = spark.createDataFrame([("n68",), ("alone",)], "term string")
    assert {tuple(r) for r in S.ancestor_closure(parents, some).collect()} == {("n68", "n68"), ("n68", "n69"), ("n68", "n70"), ("alone", "alone")}


def test_layers_told_by_lists_equal_their_pairs(spark):
    rng = random.Random(6)
    rows = [("groups", h, f"d{d}") for d in range(40) for h in rng.sample(["h1", "h2", "h3"], rng.randrange(0, 4))]
    links = spark.createDataFrame(rows, "lens string, hub string, disease string")
    held = defaultdict(set)
    for _, h, d in rows:
        held[d].add(h)
    shared = {(a, b): sorted(held[a] & held[b]) for a, b in itertools.combinations(sorted(held), 2) if held[a] & held[b]}
    signatures = Q.layer_signatures(links)
    classes = Q.signature_pairs(signatures)
    assert Counter(len(v) for v in shared.values()) == Counter({r.n_items: r.n for r in classes.groupBy("n_items").agg({"n_pairs": "sum"}).toDF("n_items", "n").collect()})
    assert {r.lens: r.n_pairs for r in Q.mode_counts(Q.mode_pairs(links).limit(0), classes).collect()} == {"groups": len(shared)}
    pairs = {(r.a, r.b): (r.n_items, r.first_item, r.strength) for r in Q.mode_pairs(links).collect()}
    assert pairs == {k: (len(v), v[0], 1 - 0.5 ** len(v)) for k, v in shared.items()}
    others = spark.createDataFrame([("d0", "d1", "papers", 0.5, 1, "p"), ("d2", "d3", "papers", 0.5, 1, "p"), ("x", "y", "papers", 0.5, 1, "p")],
                                   "a string, b string, lens string, strength double, n_items long, first_item string")
    got = {(r.a, r.b, r.n_items, r.first_item) for r in Q.with_signatures(others, signatures).where("lens = 'groups'").collect()}
    assert got == {(a, b, len(shared[a, b]), shared[a, b][0]) for a, b in (("d0", "d1"), ("d2", "d3")) if (a, b) in shared}


def test_running_sums_and_places(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", i, rng.randrange(10)) for i in range(2000)]
    df = spark.createDataFrame(rows, "key string, at long, n long").repartition(7)
    want, seen = {}, Counter()
    for k, i, n in sorted(rows, key=lambda r: r[1]):
        want[k, i] = seen[k]
        seen[k] += n
    assert {(r.key, r.at): r.before for r in running_before(df, ["key"], ["at"], df["n"], "before").collect()} == want
    assert sorted(r.place for r in ordinal_within(df, [], ["at"], "place").collect()) == list(range(2000))


def test_upper_median_of_one_gene_with_many_awards(spark):
    rng = random.Random(10)
    awards = [("big", rng.choice([5, 5, 7, 100, 2000, rng.randrange(1, 10**6)])) for _ in range(5001)] + [("two", 3), ("two", 9), ("one", 4), ("none", 0), ("none", -2)]
    grants = spark.createDataFrame([(g, i, float(a), 2000 + i % 9, f"o{i % 6}") for i, (g, a) in enumerate(awards)], "gene string, grant long, award_amount double, fiscal_year int, organization string")
    totals, _ = Q.funding_summary(grants)
    paid = defaultdict(list)
    for g, a in awards:
        if a > 0:
            paid[g].append(a)
    assert {r.gene: (r.median, r.n) for r in totals.collect()} == {g: (sorted(v)[len(v) // 2], len(v)) for g, v in paid.items()}


def test_tiles_hold_the_whole_matrix(spark):
    cells = [(f"e{a:02}", f"e{b:02}", 1.0 if a == b else 0.5) for a in range(23) for b in range(23) if a == b or (a * b) % 3 == 1]
    rows = spark.createDataFrame(cells, "row string, col string, similarity double")
    entities = spark.createDataFrame([(f"e{a:02}",) for a in range(23)], "entity string")
    tiles = sinks.similarity_tiles(rows, entities.union(entities), tile=5).collect()
    assert all(r.row_block == int(c.row[1:]) // 5 and r.col_block == int(c.col[1:]) // 5 for r in tiles for c in r.cells)
    assert sorted((c.row, c.col, c.similarity) for r in tiles for c in r.cells) == sorted(cells)
    assert all([(c.row, c.col) for c in r.cells] == sorted((c.row, c.col) for c in r.cells) and len(r.cells) <= 25 for r in tiles)


def test_suggestions_with_a_word_that_most_labels_have(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé-") for _ in range(rng.randrange(3, 9)))
    labels = [f"{word()} {rng.choice(['syndrome', 'syndrome', 'disease'])} {word()}" for _ in range(1300)]
    mentions = [f"{word()} syndrome", "syndrome", labels[0].upper(), f"{word()} disease {word()}", "zzz qqq"]
    vocabulary = spark.createDataFrame([("Disease", f"M{i:05}", t, t.lower()) for i, t in enumerate(labels)], "kind string, id string, label string, key string")
    asked = spark.createDataFrame([("Disease", m) for m in mentions], "kind string, mention string")
    tokens = lambda t: {w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in t).split() if len(w) >= 3}
    want = set()
    for m in {m.lower() for m in mentions}:
        scored = [(SequenceMatcher(None, m, t).ratio(), f"M{i:05}") for i, t in enumerate(labels) if tokens(m) & tokens(t)]
        want |= {(m, i, r + 1) for r, (s, i) in enumerate(sorted((x for x in scored if x[0] >= 0.4), key=lambda x: (x[0], x[1]), reverse=True)[:3])}
    assert {(r.mention_key, r.id, r["rank"]) for r in N.suggest_candidates(asked, vocabulary).collect()} == want
